"""Change sets: squash them, and turn one into a layer of the log.

A change set is a table of objects with op: create, modify or delete.  A modify of an
object that isn't there is an upsert, a delete of one that isn't there does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import tile_of
from ..schema import NODE, OBJECT_COLUMNS, RELATION, WAY
from .keysets import KeySet
from .tiling import member_refs, references, way_refs


def squash(changes: DataFrame, by: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """One change for each object (and diff): the highest version wins."""
    w = Window.partitionBy(*(by or []), "type", "id").orderBy((order if order is not None else F.col("version")).desc_nulls_last(), (F.col("op") == "delete").desc())
    return changes.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


@dataclass
class TiledDiff:
    """What a change set adds to the log: objects, tile rows (null version: tombstone), keys with all their tiles, and references."""

    objects: DataFrame
    tiles: DataFrame
    keys: DataFrame
    refs: DataFrame


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """id of those whose set of tiles differs; before, after: id, tile."""
    b, a = before.select("id", "tile"), after.select("id", "tile")
    return b.subtract(a).union(a.subtract(b)).select("id").distinct()


def parents_of(objects: DataFrame, moved_nodes: DataFrame) -> DataFrame:
    """id of the ways with a node among moved_nodes (id)."""
    return way_refs(objects).join(moved_nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()


def tiled_diff(objects: DataFrame, tiles: DataFrame, changes: DataFrame, zoom: int = 14, hold: Callable[[DataFrame], DataFrame] = lambda df: df, nested_relations: bool = False) -> TiledDiff:
    """objects and their tiles (type, id and tile, or tiles: all of them in one row) before, and squashed changes -> the new layer.

    Level by level: changed nodes, then changed ways and those over a node whose tile
    changed, then changed relations and those over a changed member.  Edits of the change
    set win over parents that only follow; every parent's tiles are computed anew from
    the state after the change, so the state equals a bulk build of the final objects.
    An object with all its tiles is one row throughout, joined once with those it had; tile rows come last.
    hold: what to do with tables of the change's size that are used more than once.
    nested_relations: a relation has the tiles that its member relations had before the change.
    """
    none = F.array().cast("array<bigint>")
    by_key = tiles if "tiles" in tiles.columns else tiles.groupBy("type", "id").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    alive = changes.filter(F.col("op") != "delete")
    keys = changes.select("type", "id")
    kind = lambda df, k: df.filter(F.col("type") == k)
    tag = lambda df, k, *more: df.select(F.lit(k).cast("tinyint").alias("type"), "id", *more)
    keys_of = lambda ids, k: KeySet(tag(ids, k), hold)
    payload = lambda k, follow: kind(alive, k).select(*OBJECT_COLUMNS).union(keys_of(follow, k).keep(kind(objects, k)).select(*OBJECT_COLUMNS))

    def moved(k: int, touched: KeySet, now: DataFrame) -> DataFrame:
        """id of those touched that have other tiles now (id, _now)."""
        had = touched.keep(kind(by_key, k)).select("id", F.col("tiles").alias("_had"))
        return had.join(now, "id", "full_outer").filter(F.coalesce("_had", none) != F.coalesce("_now", none)).select("id")

    def anew(of: DataFrame, refs: Column, parts: DataFrame) -> DataFrame:
        """id, version and the tiles, _now, of objects: those of all they refer to; a row for each object, which has none if none of it is in a tile."""
        found = of.select("id", "version", F.explode_outer(F.array_distinct(refs)).alias("_ref")).select("id", "version", F.col("_ref.type").alias("_type"), F.col("_ref.id").alias("_id"))
        own = parts.select(F.col("type").alias("_type"), F.col("id").alias("_id"), "tiles")
        tiles = found.join(own, ["_type", "_id"], "left").select("id", "version", "tiles").repartition("id")
        return tiles.groupBy("id").agg(F.max("version").alias("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tiles")))).alias("_now"))

    n_ids = kind(keys, NODE).select("id")
    n_new = kind(alive, NODE).select("id", "version", F.array_compact(F.array(tile_of(F.col("lon"), F.col("lat"), zoom))).alias("_now"))
    n_touched = keys_of(n_ids, NODE)
    n_moved = hold(moved(NODE, n_touched, n_new))
    n_after = n_touched.drop(kind(by_key, NODE)).select("id", "tiles").union(n_new.select("id", "_now"))

    w_ids = kind(keys, WAY).select("id")
    over = keys_of(n_moved, NODE).keep(tag(way_refs(objects).withColumnRenamed("node_id", "id"), NODE, "way_id"))
    w_follow = hold(over.select(F.col("way_id").alias("id")).distinct().join(w_ids, "id", "left_anti"))
    w_all = payload(WAY, w_follow)
    w_new = hold(anew(w_all, F.transform("nodes", lambda n: F.struct(F.lit(NODE).cast("tinyint").alias("type"), n.alias("id"))), tag(n_after, NODE, "tiles")))
    w_all_ids = w_ids.union(w_follow)
    w_touched = keys_of(w_all_ids, WAY)
    w_moved = hold(moved(WAY, w_touched, w_new))
    w_after = w_touched.drop(kind(by_key, WAY)).select("id", "tiles").union(w_new.select("id", "_now"))

    r_ids = kind(keys, RELATION).select("id")
    members = KeySet(tag(n_moved, NODE).union(tag(w_moved, WAY)), hold)
    r_follow = hold(members.keep(member_refs(objects), "member_type", "member_id").select(F.col("relation_id").alias("id")).distinct().join(r_ids, "id", "left_anti"))
    r_all = payload(RELATION, r_follow)
    parts = tag(n_after, NODE, "tiles").union(tag(w_after, WAY, "tiles"))
    if nested_relations:
        parts = parts.union(tag(kind(by_key, RELATION), RELATION, "tiles"))
    r_new = anew(r_all, F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["id"].alias("id"))), parts)
    r_all_ids = r_ids.union(r_follow)

    written = hold(kind(alive, NODE).select(*OBJECT_COLUMNS).union(w_all).union(r_all))
    now = tag(n_new, NODE, "version", "_now").union(tag(w_new, WAY, "version", "_now")).union(tag(r_new, RELATION, "version", "_now"))
    touched = KeySet(tag(n_ids, NODE).union(tag(w_all_ids, WAY)).union(tag(r_all_ids, RELATION)), hold)
    had = touched.keep(by_key).select("type", "id", F.col("tiles").alias("_had"))
    own = hold(now.join(had, ["type", "id"], "left").select("type", "id", "version", F.col("_now").alias("tiles"), F.array_except(F.coalesce("_had", none), "_now").alias("_left")))
    deleted = changes.filter(F.col("op") == "delete").select("type", "id")
    left = own.select("type", "id", "_left").union(had.join(deleted, ["type", "id"], "left_semi"))
    gone = hold(left.select("type", "id", F.explode("_left").alias("tile"), F.lit(None).cast("int").alias("version")))
    rows = own.select("type", "id", F.explode("tiles").alias("tile"), "version").union(gone)
    dead = changes.filter(F.col("op") == "delete").select("type", "id", F.lit(True).alias("deleted"), none.alias("tiles"))
    keys_now = own.select("type", "id", F.lit(False).alias("deleted"), "tiles")
    return TiledDiff(written, rows, keys_now.union(dead), references(alive))
