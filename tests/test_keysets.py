"""Lookups of many keys: by masks that every task holds, with the outcome of plain joins and nothing of the state moved."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quadstrata.operators import keysets
from quadstrata.operators.keysets import KeySet
from quadstrata.operators.tiling import with_columns
from quadstrata.plans.history import History

SCHEMA = "op string, type tinyint, id long, version int, ts timestamp, lon double, lat double, nodes array<long>, members array<struct<type:tinyint,id:long,role:string>>"
T = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_a_key_set_keeps_and_drops_as_a_join_does(spark, monkeypatch):
    keys = [(t, i) for t in (0, 1, 2) for i in (0, 1, 63, 64, 65, -1, -64, -65, 2**40 + 7, 2**61 - 1, 2**63 - 1, -(2**63)) if (t + i) % 3] * 2
    rows = [(t, i + d) for t, i in keys for d in (-1, 0, 1) if -(2**63) <= i + d < 2**63] + [(None, 1), (1, None)]
    df, some = spark.createDataFrame(rows, "kind tinyint, ref long"), spark.createDataFrame(keys, "type tinyint, id long")
    for limits in ((0, 10**6), (0, 0), (10**6, 10**6)):
        monkeypatch.setattr(keysets, "PLAIN", limits[0])
        monkeypatch.setattr(keysets, "MASKS", limits[1])
        own = KeySet(some)
        assert (own.masks is not None) == (limits == (0, 10**6))
        assert sorted(tuple(r) for r in own.keep(df, "kind", "ref").collect()) == sorted(r for r in rows if r in set(keys))
        assert sorted(map(str, own.drop(df, "kind", "ref").collect())) == sorted(map(str, (r for r in df.collect() if tuple(r) not in set(keys))))


def world(spark, n=40):
    nodes = [("create", 0, i, 1, T, 3.0 + i % 7 / 10, 50.0 + i % 5 / 10, None, None) for i in range(n)]
    ways = [("create", 1, i, 1, T, None, None, [i, (i * 3) % n, i, n + 5], None) for i in range(n)]
    rels = [("create", 2, i, 1, T, None, None, None, [(0, i, "a"), (1, (i * 7) % n, "b"), (1, (i * 7) % n, "c"), (2, i, "")]) for i in range(5)]
    return with_columns(spark.createDataFrame(nodes + ways + rels, SCHEMA), "op")


@pytest.mark.parametrize("masks", [10**6, 0])
def test_diffs_look_up_by_masks(spark, tmp_path, monkeypatch, masks):
    """A move, a delete, a way with other nodes, a deleted way, and then changes of the same: the state is that of a build of what there is at last."""
    monkeypatch.setattr(keysets, "PLAIN", 0)
    monkeypatch.setattr(keysets, "MASKS", masks)
    every = world(spark)
    h = History.create(spark, str(tmp_path / "h"), every.drop("op"), 100)
    sets = [
        [("modify", 0, 1, 2, T, 3.6, 50.4, None, None), ("delete", 0, 2, 2, T, None, None, None, None), ("modify", 1, 3, 2, T, None, None, [4, 5], None), ("delete", 1, 7, 2, T, None, None, None, None)],
        [("modify", 0, 1, 3, T, 3.1, 50.1, None, None), ("create", 0, 2, 3, T, 3.2, 50.0, None, None), ("modify", 1, 7, 3, T, None, None, [8, 1], None), ("modify", 2, 1, 3, T, None, None, None, [(0, 9, ""), (1, 3, "")])],
        [("modify", 0, 9, 4, T, 3.0, 50.0, None, None), ("delete", 2, 2, 4, T, None, None, None, None)],
    ]
    for k, rows in enumerate(sets):
        changed = with_columns(spark.createDataFrame(rows, SCHEMA), "op")
        h.apply_diff(changed, 200 + k)
        every = every.join(changed, ["type", "id"], "left_anti").select(*every.columns).union(changed.filter("op <> 'delete'")).localCheckpoint()
    built = History.create(spark, str(tmp_path / "built"), every.drop("op"), 100)
    for of in (lambda v: v.tiled(), lambda v: v.scan().select("type", "id", "version", F.col("nodes").cast("string"), F.col("members").cast("string"))):
        assert sorted(map(str, of(h.latest).collect())) == sorted(map(str, of(built.latest).collect()))


def test_the_full_layer_is_not_moved_by_a_diff(spark, tmp_path, monkeypatch):
    """What a diff reads of the full layer by key goes through no exchange and no sort-merge join, few keys or not."""
    monkeypatch.setattr(keysets, "PLAIN", 0)
    h = History.create(spark, str(tmp_path / "h"), world(spark).drop("op"), 100)
    view, keys = h.latest, spark.range(30).select(F.lit(1).cast("tinyint").alias("type"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with h._settling() as settle:
            for df in view._last(KeySet(keys, settle), view.newer(settle)):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and df.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
