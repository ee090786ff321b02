"""Map XML: objects in and out by Spark's XML source with fixed schemas, change files by one scan of their elements."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANGES, TYPE_NAMES, arrow_changes

_COMMON = "_id bigint, _version int, _timestamp timestamp, _changeset bigint, _uid bigint, _user string, _visible boolean, tag array<struct<_k:string,_v:string>>"
_FIELDS = {
    "node": f"{_COMMON}, _lat double, _lon double",
    "way": f"{_COMMON}, nd array<struct<_ref:bigint>>",
    "relation": f"{_COMMON}, member array<struct<_type:string,_ref:bigint,_role:string>>",
}


def _objects(df: DataFrame, kind: str, *extra: str) -> DataFrame:
    """Rows with the source's attributes -> the object columns."""
    has = set(df.columns)
    rank = TYPE_NAMES.index(kind)
    kinds = F.create_map(*[F.lit(x) for k, n in enumerate(TYPE_NAMES) for x in (n, k)])
    pairs = F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    # of a key that repeats the last value holds
    last = F.filter(pairs, lambda t, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda o: o["k"] == t["k"]))
    tags = F.when(F.size("tag") > 0, F.map_from_entries(last))
    members = F.transform("member", lambda m: F.struct(F.element_at(kinds, m["_type"]).cast("tinyint").alias("type"), m["_ref"].alias("id"), F.coalesce(m["_role"], F.lit("")).alias("role"))) if "member" in has else F.lit(None).cast("array<struct<type:tinyint,id:bigint,role:string>>")
    nodes = F.transform("nd", lambda n: n["_ref"]) if "nd" in has else F.lit(None).cast("array<bigint>")
    place = {c: F.col(f"_{c}") if f"_{c}" in has else F.lit(None).cast("double") for c in ("lon", "lat")}
    return df.select(
        *extra, F.lit(rank).cast("tinyint").alias("type"), F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_timestamp").alias("ts"), F.col("_changeset").alias("changeset"), F.col("_uid").alias("uid"), F.col("_user").alias("user"),
        F.col("_visible").alias("visible"), tags.alias("tags"), place["lon"].alias("lon"), place["lat"].alias("lat"), nodes.alias("nodes"), members.alias("members"),
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Nodes, ways and relations of an XML extract."""
    return reduce(DataFrame.unionByName, [_objects(spark.read.format("xml").option("rowTag", k).schema(_FIELDS[k]).load(path), k) for k in TYPE_NAMES])


def parse_changes(data: bytes, batch: int = 10_000) -> Iterator[pa.RecordBatch]:
    """A change file's objects in order with their operation, read element by element."""
    schema, rows = arrow_changes(), []
    op, one = None, None
    for event, e in ElementTree.iterparse(io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), ("start", "end")):
        if event == "start":
            if e.tag in ("create", "modify", "delete"):
                op = e.tag
            elif e.tag in TYPE_NAMES and one is None:
                one = e
        elif e is one:
            rows.append(_row(op, e))
            one = None
            e.clear()
            if len(rows) >= batch:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        elif e.tag in ("create", "modify", "delete"):
            e.clear()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _row(op: str | None, e: ElementTree.Element) -> dict:
    number = lambda k, kind=int: kind(e.get(k)) if e.get(k) not in (None, "") else None
    stamp = e.get("timestamp")
    tags = {t.get("k"): t.get("v") for t in e.iterfind("tag")}  # of a key that repeats the last value holds
    members = [{"type": TYPE_NAMES.index(m.get("type")), "id": int(m.get("ref")), "role": m.get("role") or ""} for m in e.iterfind("member")]
    return {
        "op": op, "type": TYPE_NAMES.index(e.tag), "id": number("id"), "version": number("version"), "ts": datetime.fromisoformat(stamp.replace("Z", "+00:00")) if stamp else None, "changeset": number("changeset"), "uid": number("uid"),
        "user": e.get("user"), "visible": {"true": True, "false": False}.get(e.get("visible")), "tags": list(tags.items()) or None, "lon": number("lon", float), "lat": number("lat", float), "nodes": [int(n.get("ref")) for n in e.iterfind("nd")] or None, "members": members or None,
    }


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """op and the object columns of change files, plain or gzipped: one scan, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from parse_changes(data.as_py())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CHANGES)


def write_objects(objects: DataFrame, path: str) -> None:
    """One folder of XML for each type."""
    names = F.create_map(*[F.lit(x) for k, n in enumerate(TYPE_NAMES) for x in (k, n)])
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tags = F.transform(F.map_entries("tags"), lambda t: F.struct(t["key"].alias("_k"), t["value"].alias("_v"))).alias("tag")
    common = [F.col("id").alias("_id"), F.col("version").alias("_version"), stamp.alias("_timestamp"), F.col("changeset").alias("_changeset"), F.col("uid").alias("_uid"), F.col("user").alias("_user"), F.col("visible").alias("_visible"), tags]
    own = {
        "node": [F.col("lat").alias("_lat"), F.col("lon").alias("_lon")],
        "way": [F.transform("nodes", lambda n: F.struct(n.alias("_ref"))).alias("nd")],
        "relation": [F.transform("members", lambda m: F.struct(F.element_at(names, m["type"].cast("int")).alias("_type"), m["id"].alias("_ref"), m["role"].alias("_role"))).alias("member")],
    }
    for rank, kind in enumerate(TYPE_NAMES):
        objects.filter(F.col("type") == rank).select(*common, *own[kind]).write.format("xml").option("rootTag", "osm").option("rowTag", kind).mode("overwrite").save(f"{path}/{kind}")
