"""What the queries on the test history have built and read for them."""

from pyspark.sql import functions as F

from quadstrata import fixtures as fx
from quadstrata import queries as q
from quadstrata.operators import changes


def tables(spark, d):
    for name, df in {"part": spark.range(20).select(F.col("id").alias("p_partkey")), "customer": spark.range(3).select(F.col("id").alias("c_custkey")), "orders": spark.range(9).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"))}.items():
        df.write.parquet(f"{d}/{name}.parquet")
    spark.range(30).select((F.col("id") % 9).alias("l_orderkey"), (F.col("id") % 20).alias("l_partkey"), F.col("id").cast("int").alias("l_linenumber")).write.parquet(f"{d}/lineitem.parquet")
    kind = F.element_at(F.array(F.lit("view"), F.lit("error"), F.lit("signup"), F.lit("view")), (F.col("id") % 4 + 1).cast("int"))
    spark.range(60).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), kind.alias("event_type"), F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 20 as int))").alias("ts")).write.parquet(f"{d}/events.parquet")
    spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as ts, 60L as event_id, 1L as user_id, 'view' as event_type").write.mode("append").parquet(f"{d}/events.parquet")


def test_parents_by_reference_compare_the_last_diffs_keys_alone(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    h = fx.stored(spark, d, 3)
    before, after = h.view(h.layers[1].id), h.latest
    found = q._moved_nodes(before, after)
    whole = changes.differing(*(v.tiled().filter("type = 0").select("id", "tile") for v in (before, after)))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in whole.collect()) != []
    assert not [f for f in found.inputFiles() if "tile_log" in f and h.layers[2].name not in f]


def test_time_travel_builds_two_diffs(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    got = sorted(map(tuple, q.history_time_travel(spark, d).collect()))
    h = fx.stored(spark, d, fx.FULL)
    assert [x.kind for x in h.layers] == ["full", "diff", "diff"]  # one diff less than there are
    assert got == sorted(map(tuple, h.view(h.layers[1].id).tiled().collect())) != sorted(map(tuple, h.latest.tiled().collect()))
