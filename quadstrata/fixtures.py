"""Map-shaped tables derived from the star-schema test tables: parts are points, orders are ways, customers are relations, events are hourly changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.tiles import tile_id, tile_x, tile_y
from .functions.times import unix_of
from .operators.changes import squash
from .plans.history import History
from .schema import NODE, RELATION, WAY

ZOOM = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key) -> list:
    """lon and lat of a number."""
    return [(F.lit(3.0) + (key * 7919) % 360 / F.lit(100.0)).alias("lon"), (F.lit(49.5) + (key * 104729) % 200 / F.lit(100.0)).alias("lat")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, version, lon, lat, x, y, tile."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return _tiled(p.select("id", F.lit(1).alias("version"), *_place(F.col("id"))))


def _tiled(df: DataFrame) -> DataFrame:
    xy = df.withColumns({"x": tile_x(F.col("lon"), ZOOM), "y": tile_y(F.col("lat"), ZOOM)})
    return xy.withColumn("tile", tile_id(F.col("x"), F.col("y"), ZOOM))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, seq, node_id."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long").alias("way_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").cast("long").alias("node_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_id, member_type, member_id, role."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("relation_id"), F.lit(NODE).alias("member_type"), F.col("c_custkey").cast("long").alias("member_id"), F.lit("label").alias("role"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("relation_id"), F.lit(WAY).alias("member_type"), F.col("o_orderkey").cast("long").alias("member_id"), F.lit("outer").alias("role"))
    return c.union(o)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer_id, at, op, type, id, version, lon, lat, x, y, tile: events as changes of nodes, with the hour's end as layer."""
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))  # one row
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(parts))
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    id_ = F.when(F.col("event_type") == "signup", 1000000 + F.col("event_id")).otherwise((F.col("user_id") * 13 + F.col("event_id")) % F.col("n_parts"))
    layer = (F.floor(unix_of(F.col("ts")) / 3600) + 1) * 3600
    return _tiled(e.select(layer.cast("long").alias("layer_id"), unix_of(F.col("ts")).alias("at"), op.alias("op"), F.lit(NODE).cast("tinyint").alias("type"), id_.cast("long").alias("id"), (2 + F.col("event_id")).cast("int").alias("version"), *_place(F.col("event_id"))))


def squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squash(changes(spark, sf_dir), ["layer_id"])


#: Six hours of changes make a layer of the test history, whose last is at the last midnight of the events.
STEP = 6 * 3600


def last_midnight(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "events").agg(F.floor(F.max(unix_of(F.col("ts"))) / 86400) * 86400).first()[0] or 0)


def change_set(spark: SparkSession, sf_dir: str, upto: int, span: int = STEP) -> DataFrame:
    """The changes within span seconds up to a moment, with the object columns and op, not squashed."""
    from .operators.tiling import with_columns

    c = changes(spark, sf_dir).filter((F.col("at") > upto - span) & (F.col("at") <= upto))
    return with_columns(c.withColumn("ts", F.timestamp_seconds("at")), "op")


#: Steps that make the test history: the full layer, a diff each, the compaction, the snapshot.
FULL, DIFF_1, DIFF_2, DIFFS, COMPACTED, WHOLE = 1, 2, 3, 4, 5, 6


def stored(spark: SparkSession, sf_dir: str, upto: int = WHOLE) -> History:
    """The test history: a full layer, three diffs, one diff in place of the last two, and a snapshot of the tiles that these two touched.

    Each step is taken once for each application and data folder, when the first query asks for it; a history may have
    taken more steps than asked for.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    h, done = _stored.get(key, (None, 0))
    top = last_midnight(spark, sf_dir) if done < upto else 0
    for step in range(done + 1, upto + 1):
        if step == FULL:
            h = History.create(spark, folder(spark, "history"), objects(spark, sf_dir), top - 3 * STEP)
        elif step <= DIFFS:
            at = top - (DIFFS - step) * STEP
            h.apply_diff(change_set(spark, sf_dir, at), at)
        elif step == COMPACTED:
            h.take_diff_snapshot(top, 2 * STEP)
        else:
            h.take_snapshot(top, 2 * STEP)
        _stored[key] = h, step
    return h


def stored_at_once(spark: SparkSession, sf_dir: str) -> History:
    """Another history: a full layer, and the changes of the first six hours as a snapshot."""
    key = (spark.sparkContext.applicationId, sf_dir, "at once")
    if key not in _stored:
        top = last_midnight(spark, sf_dir)
        h = History.create(spark, folder(spark, "at_once"), objects(spark, sf_dir), top - 3 * STEP)
        h.snapshot_of(change_set(spark, sf_dir, top - 2 * STEP), top - 2 * STEP)
        _stored[key] = h, WHOLE
    return _stored[key][0]


_stored: dict[tuple, tuple[History, int]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; it goes when the application ends."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{place.rstrip('/')}/quadstrata-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole data set with the object columns, as an input of builds."""
    from .operators.tiling import with_columns

    stamp = F.timestamp_seconds(F.lit(0))
    n = with_columns(nodes(spark, sf_dir).select(F.lit(NODE).alias("type"), "id", "version", stamp.alias("ts"), "lon", "lat"))
    # the order of way_nodes: rows that agree in line and part give the same node, so no more is moved
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("way_id"), "l_linenumber", F.col("l_partkey").cast("long").alias("node_id")).repartition("way_id")
    w = w.groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "node_id"))), lambda s: s["node_id"]).alias("nodes"))
    w = with_columns(w.select(F.lit(WAY).alias("type"), F.col("way_id").alias("id"), F.lit(1).alias("version"), stamp.alias("ts"), "nodes"))
    m = members(spark, sf_dir).groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct(F.col("member_type").cast("tinyint").alias("type"), F.col("member_id").alias("id"), "role"))).alias("members"))
    m = with_columns(m.select(F.lit(RELATION).alias("type"), F.col("relation_id").alias("id"), F.lit(1).alias("version"), stamp.alias("ts"), "members"))
    return n.union(w).union(m)
