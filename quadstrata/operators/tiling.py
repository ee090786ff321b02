"""Which tiles an object touches: a node its own, a way its nodes', a relation its members'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import tile_of
from ..schema import METADATA, NODE, OBJECT_COLUMNS, RELATION, WAY


def strip_metadata(objects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nulls changeset, uid, user and visible, but for those to keep."""
    kinds = dict(objects.dtypes)
    return objects.withColumns({c: F.lit(None).cast(kinds[c]) for c in METADATA if c in kinds and c not in keep})


def valid(objects: DataFrame) -> DataFrame:
    """Stops on objects without id or version and nodes without place; leaves out ways without nodes and relations without members."""
    bad = F.col("id").isNull() | F.col("version").isNull() | ((F.col("type") == NODE) & (F.col("lon").isNull() | F.col("lat").isNull()))
    checked = objects.filter(F.when(bad, F.raise_error(F.lit("an object lacks its id, version or place"))).otherwise(F.lit(True)))
    return checked.filter((F.col("type") == NODE) | ((F.col("type") == WAY) & F.col("nodes").isNotNull()) | ((F.col("type") == RELATION) & F.col("members").isNotNull()))


def way_refs(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("type") == WAY).select(F.col("id").alias("way_id"), F.explode("nodes").alias("node_id"))


def member_refs(objects: DataFrame) -> DataFrame:
    m = objects.filter(F.col("type") == RELATION).select(F.col("id").alias("relation_id"), F.explode("members").alias("m"))
    return m.select("relation_id", F.col("m.type").alias("member_type"), F.col("m.id").alias("member_id"))


def node_tiles(nodes: DataFrame, zoom: int = 14, clamp: bool = False) -> DataFrame:
    """id, tile of nodes with lon and lat."""
    return nodes.select("id", tile_of(F.col("lon"), F.col("lat"), zoom, clamp).alias("tile"))


def way_tiles(refs: DataFrame, node_tile: DataFrame) -> DataFrame:
    """way_id, node_id and id, tile -> distinct id, tile of ways; nodes not known are passed over."""
    t = node_tile.select(F.col("id").alias("node_id"), "tile")
    return refs.join(t, "node_id").select(F.col("way_id").alias("id"), "tile").distinct()


def relation_tiles(refs: DataFrame, node_tile: DataFrame, way_tile: DataFrame, relation_tile: DataFrame | None = None) -> DataFrame:
    """relation_id, member_type, member_id (type rank) -> distinct id, tile; relations within relations are passed over unless their tiles are given."""
    return member_tiles(refs, node_tile, way_tile, relation_tile).distinct()


def member_tiles(refs: DataFrame, node_tile: DataFrame, way_tile: DataFrame, relation_tile: DataFrame | None = None) -> DataFrame:
    """id of relations, tile: as many times as members are in it."""
    tag = lambda df, kind: df.select(F.lit(kind).alias("member_type"), F.col("id").alias("member_id"), "tile")
    every = tag(node_tile, NODE).union(tag(way_tile, WAY))
    if relation_tile is not None:
        every = every.union(tag(relation_tile, RELATION))
    return refs.join(every, ["member_type", "member_id"]).select(F.col("relation_id").alias("id"), "tile")


def object_tiles(objects: DataFrame, zoom: int = 14, nested_relations: int = 0) -> DataFrame:
    """type, id, tile, version of all objects: the bulk tiling.  nested_relations: through so many levels of relations a relation has the tiles of its member relations too."""
    n = node_tiles(objects.filter(F.col("type") == NODE), zoom)
    w = way_tiles(way_refs(objects), n)
    r = relation_tiles(member_refs(objects), n, w)
    for _ in range(nested_relations):
        r = relation_tiles(member_refs(objects), n, w, r)
    tag = lambda df, kind: df.select(F.lit(kind).cast("tinyint").alias("type"), "id", "tile")
    every = tag(n, NODE).union(tag(w, WAY)).union(tag(r, RELATION))
    return every.join(objects.select("type", "id", "version"), ["type", "id"]).select("type", "id", "tile", "version")


def object_keys(objects: DataFrame, zoom: int = 14, nested_relations: int = 0, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """type, id, version and all tiles of each object, once: the bulk tiling by key, rows of one object staying one.

    hold: what to do with the tiles of nodes and ways, which those of relations are made of, and with those of relations:
    what is returned is made of these two and not computed again.
    """
    kind = lambda k: F.lit(k).cast("tinyint").alias("type")
    nodes = objects.filter(F.col("type") == NODE)
    n = nodes.select("type", "id", "version", F.array_compact(F.array(tile_of(F.col("lon"), F.col("lat"), zoom))).alias("tiles"))
    place = node_tiles(nodes, zoom).select(F.col("id").alias("node_id"), "tile")
    refs = objects.filter(F.col("type") == WAY).select("id", "version", F.explode_outer(F.array_distinct("nodes")).alias("node_id"))
    w = refs.join(place, "node_id", "left").select("id", "version", "tile").repartition("id")
    w = w.groupBy("id").agg(F.max("version").alias("version"), F.sort_array(F.collect_set("tile")).alias("tiles")).select(kind(WAY), "id", "version", "tiles")
    parts = hold(n.union(w))

    def relations(of: DataFrame) -> DataFrame:
        member = F.explode_outer(F.array_distinct(F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["id"].alias("id"))))).alias("m")
        refs = objects.filter(F.col("type") == RELATION).select("id", "version", member).select("id", "version", F.col("m.type").alias("member_type"), F.col("m.id").alias("member_id"))
        own = of.select(F.col("type").alias("member_type"), F.col("id").alias("member_id"), "tiles")
        found = refs.join(own, ["member_type", "member_id"], "left").select("id", "version", "tiles").repartition("id")
        return found.groupBy("id").agg(F.max("version").alias("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tiles")))).alias("tiles")).select(kind(RELATION), "id", "version", "tiles")

    r = hold(relations(parts))
    for _ in range(nested_relations):
        r = hold(relations(parts.union(r)))
    return parts.union(r)


def references(objects: DataFrame) -> DataFrame:
    """member_type, member_id, parent_type, parent_id: what each object is part of, once for each object."""
    kind = lambda k: F.lit(k).cast("tinyint")
    once = objects.withColumns({"nodes": F.array_distinct("nodes"), "members": F.array_distinct(F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["id"].alias("id"))))})
    ways = way_refs(once).select(kind(NODE).alias("member_type"), F.col("node_id").alias("member_id"), kind(WAY).alias("parent_type"), F.col("way_id").alias("parent_id"))
    return ways.union(member_refs(once).select("member_type", "member_id", kind(RELATION), "relation_id"))


def with_columns(df: DataFrame, *more: str) -> DataFrame:
    """df with exactly the object columns, those it lacks being null, after the columns more."""
    from ..schema import OBJECTS

    kinds = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in _fields(OBJECTS)}
    have = set(df.columns)
    return df.select(*more, *[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in OBJECT_COLUMNS])


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
