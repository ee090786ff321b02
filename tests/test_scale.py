"""What keeps the store's cost in proportion: steps taken only when asked for, rows by key instead of by tile, writes in several tasks."""

import glob
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quadstrata import fixtures as fx
from quadstrata.operators import tiling
from quadstrata.operators.tiling import with_columns
from quadstrata.plans import history
from quadstrata.plans.history import History

SCHEMA = "op string, type tinyint, id long, version int, ts timestamp, lon double, lat double, nodes array<long>, members array<struct<type:tinyint,id:long,role:string>>"
T = datetime(2024, 1, 1, tzinfo=timezone.utc)


def some(spark, rows):
    return with_columns(spark.createDataFrame(rows, SCHEMA), "op")


def world(spark, n=40):
    nodes = [("create", 0, i, 1, T, 3.0 + i % 7 / 10, 50.0 + i % 5 / 10, None, None) for i in range(n)]
    ways = [("create", 1, i, 1, T, None, None, [i, (i * 3) % n, i, n + 5], None) for i in range(n)] + [("create", 1, n, 1, T, None, None, [n + 7], None)]
    rels = [("create", 2, i, 1, T, None, None, None, [(0, i, "a"), (1, (i * 7) % n, "b"), (1, (i * 7) % n, "c"), (2, i, "")]) for i in range(5)]
    return some(spark, nodes + ways + rels)


def test_steps_are_taken_when_asked_for(spark, tmp_path):
    for name, df in {"part": spark.range(20).select(F.col("id").alias("p_partkey")), "customer": spark.range(3).select(F.col("id").alias("c_custkey")), "orders": spark.range(9).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"))}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(30).select((F.col("id") % 9).alias("l_orderkey"), (F.col("id") % 20).alias("l_partkey"), F.col("id").cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert [x.kind for x in fx.stored(spark, str(tmp_path), fx.FULL).layers] == ["full"]
    h = fx.stored(spark, str(tmp_path), fx.DIFF_1)
    assert [x.kind for x in h.layers] == ["full", "diff"] and fx.stored(spark, str(tmp_path), fx.FULL) is h


def test_keys_hold_what_the_tiling_by_tile_gives(spark):
    objects = world(spark).drop("op")
    for nested in (0, 1):
        got = {(r.type, r.id): (r.version, r.tiles) for r in tiling.object_keys(objects, nested_relations=nested).collect()}
        want = {(r.type, r.id): (r.version, []) for r in objects.collect()}
        for r in tiling.object_tiles(objects, nested_relations=nested).collect():
            want[r.type, r.id][1].append(r.tile)
        assert got == {k: (v, sorted(t)) for k, (v, t) in want.items()}


def test_references_are_distinct_without_a_shuffle(spark):
    refs = tiling.references(world(spark).drop("op"))
    rows = refs.collect()
    assert len(rows) == len(set(rows)) and (1, 7 * 2, 2, 2) in {tuple(r) for r in rows}
    assert "Exchange" not in refs._jdf.queryExecution().executedPlan().toString()


def test_tile_rows_of_an_unsplit_layer_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "TASK_ROWS", 40, raising=False)
    h = History.create(spark, str(tmp_path / "h"), world(spark).drop("op"), 100)
    assert h.layers[0].parts == 1 and len(glob.glob(f"{h.layers[0].path}/tile_log/*/part-*")) > len(glob.glob(f"{h.layers[0].path}/tile_log/bucket=*"))
    assert h.latest.tiled().count() == tiling.object_tiles(world(spark).drop("op")).count()


def test_a_snapshot_has_the_last_rows_of_its_tiles(spark, tmp_path, monkeypatch):
    """With few tiles and with more than the driver takes: moves, a delete, a move back, an object that left a touched tile in an older diff."""
    for few in (20_000, 1):
        monkeypatch.setattr(history, "FEW", few)
        h = History.create(spark, str(tmp_path / f"h{few}"), world(spark).drop("op"), 100)
        h.apply_diff(some(spark, [("modify", 0, 1, 2, T, 3.0, 50.0, None, None), ("modify", 0, 6, 2, T, 3.3, 50.3, None, None)]), 200)
        h.apply_diff(some(spark, [("modify", 0, 1, 3, T, 3.1, 50.1, None, None), ("delete", 0, 2, 3, T, None, None, None, None)]), 300)
        h.apply_diff(some(spark, [("modify", 0, 21, 4, T, 3.6, 50.4, None, None)]), 400)
        view = h.latest
        touched = {r.tile for r in h.touched_tiles(400, 200).collect()}
        last = {}
        for r in view.tile_log().orderBy("layer_id").collect():
            if r.tile in touched:
                last[r.type, r.id, r.tile] = r.version
        state = {tuple(r) for r in view.tiled().collect()}
        made = h.take_snapshot(400, 200)
        rows = h.view(made.id).tile_log([made]).select("type", "id", "tile", "version").collect()
        assert {(r.type, r.id, r.tile): r.version for r in rows} == last and len(rows) == len(last)
        assert {tuple(r) for r in h.view(made.id).tiled().collect()} == state


def test_a_diff_holds_its_tiles_by_key(spark):
    """A row for each object with all its tiles, from which tile rows, keys and tombstones come."""
    from quadstrata.operators.changes import tiled_diff

    objects, held = world(spark).drop("op"), []
    tiles = tiling.object_tiles(objects).select("type", "id", "tile")
    diff = tiled_diff(objects, tiles, some(spark, [("modify", 0, 1, 2, T, 3.6, 50.4, None, None), ("delete", 0, 2, 2, T, None, None, None, None)]), hold=lambda df: held.append(df) or df)
    own = next(df for df in held if "tiles" in df.columns)
    now = {(r.type, r.id): r for r in own.collect()}
    rows = [tuple(r) for r in diff.tiles.collect()]
    assert len(rows) == len(set(rows)) and {r[:3] for r in rows if r[3] is not None} == {(*k, t) for k, r in now.items() for t in r.tiles}
    before = {tuple(r) for r in tiles.collect() if (r.type, r.id) in now or (r.type, r.id) == (0, 2)}
    assert {r[:3] for r in rows if r[3] is None} == before - {r[:3] for r in rows if r[3] is not None}
    assert (0, 2) in {(r.type, r.id) for r in diff.keys.collect() if r.deleted}


def test_a_build_holds_each_key_once(spark):
    """What object_keys gives is read from what it held: the tiles of nodes and ways aren't written again with those of relations."""
    held, objects = [], world(spark).drop("op")
    keys = tiling.object_keys(objects, hold=lambda df: held.append(df) or df)
    rows = [(r.type, r.id) for df in held for r in df.select("type", "id").collect()]
    assert len(rows) == len(set(rows)) == keys.count() == objects.count()


def test_a_diff_reads_its_tiles_by_key(spark, tmp_path):
    """The state comes to it as a row for each object, with the same outcome as from tile rows, and only tombstones are held as tile rows."""
    from quadstrata.operators.changes import squash, tiled_diff

    h = History.create(spark, str(tmp_path / "h"), world(spark).drop("op"), 100)
    changes = squash(some(spark, [("modify", 0, 1, 2, T, 3.6, 50.4, None, None), ("delete", 0, 2, 2, T, None, None, None, None), ("modify", 1, 3, 2, T, None, None, [4, 5], None), ("delete", 1, 6, 2, T, None, None, None, None), ("modify", 2, 1, 2, T, None, None, None, [(0, 9, ""), (1, 6, "")])]))
    held, settle = [], lambda df: spark.createDataFrame(df.collect(), df.schema)
    objects, tiles = h.latest.affected(changes, settle)
    assert tiles.columns == ["type", "id", "tiles"] and tiles.count() == tiles.select("type", "id").distinct().count()
    by_key = tiled_diff(objects, tiles, changes, hold=lambda df: held.append(settle(df)) or held[-1])
    by_tile = tiled_diff(objects, tiles.select("type", "id", F.explode("tiles").alias("tile")), changes, hold=settle)
    for a, b in ((by_key.tiles, by_tile.tiles), (by_key.keys, by_tile.keys), (by_key.refs, by_tile.refs), (by_key.objects.select("type", "id", "version"), by_tile.objects.select("type", "id", "version"))):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert [df.filter("version is not null").count() for df in held if "tile" in df.columns] == [0]
