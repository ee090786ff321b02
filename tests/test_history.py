import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quadstrata.functions import times
from quadstrata.operators import tiling
from quadstrata.plans import layers as ly
from quadstrata.plans.history import History, View
from quadstrata.schema import CHANGES, NODE, OBJECTS, RELATION, WAY

A, B = 5556 * 16384 + 8374, 8009 * 16384 + 10467
AT_A, AT_B = (4.0, 50.0), (50.0, 4.0)
T0 = times.to_unix(datetime(2020, 1, 1))
HOUR = 3600


def ts(k=0):
    return datetime.fromtimestamp(T0 + k * HOUR, timezone.utc).replace(tzinfo=None)


def node(i, place, version=1, k=0):
    return (NODE, i, version, ts(k), 7, 8, "u", True, {"k": "v"}, *place, None, None)


def way(i, nodes, version=1, k=0):
    return (WAY, i, version, ts(k), None, None, None, None, None, None, None, nodes, None)


def rel(i, members, version=1, k=0):
    return (RELATION, i, version, ts(k), None, None, None, None, None, None, None, None, [(t, m, "") for t, m in members])


@pytest.fixture
def make(spark, tmp_path):
    def start(*objects):
        return History.create(spark, str(tmp_path / "db"), spark.createDataFrame(objects, OBJECTS), T0)

    return start


def change(spark, *rows):
    return spark.createDataFrame([(op, *o) for op, o in rows], CHANGES)


def keys_in(df):
    return [(r.type, r.id) for r in df.collect()]


def test_full_layer(spark, make):
    h = make(node(7001, AT_A), node(7002, AT_A), way(8101, [7001, 7002]), rel(9201, [(0, 7001), (0, 7002), (1, 8101)]), way(1, None))
    v = h.latest
    assert [v.get_key(*k).count() for k in ((0, 7001), (0, 7002), (1, 8101), (2, 9201), (2, 9202), (0, 7000), (1, 8100), (1, 1))] == [1] * 4 + [0] * 4
    assert keys_in(v.get_tiles([A])) == [(0, 7001), (0, 7002), (1, 8101), (2, 9201)]
    assert v.scan().count() == 4 and keys_in(v.get_tiles([B])) == []
    n = v.get_key(0, 7001).collect()[0]
    assert (n.changeset, n.uid, n.user, n.visible, n.tags) == (None, None, None, None, {"k": "v"})
    assert [r.tile for r in v.tiles().collect()] == [A] and v.owner(A).kind == "full"
    want = spark.createDataFrame([(0, 7001), (0, 5)], "type tinyint, id bigint")
    assert {(r.id, r.tile) for r in v.tiles_for(want).collect()} == {(7001, A), (5, None)}


@pytest.mark.parametrize("snapshot", [False, True])
def test_scenarios(spark, make, snapshot):
    n1, n2 = 7101, 7102
    h = make(node(1, (0.0, 0.0)))
    step = [0]

    def apply(*rows):
        step[0] += 1
        (h.snapshot_of if snapshot else h.apply_diff)(change(spark, *rows), T0 + step[0] * HOUR)
        return h.latest

    v = apply(("create", node(n1, AT_A)), ("create", node(n2, AT_A)), ("create", way(8201, [n1, n2])))
    assert keys_in(v.get_tiles([A])) == [(0, n1), (0, n2), (1, 8201)]
    v = apply(("modify", node(n1, AT_B, 2)), ("modify", node(n2, AT_B, 2)))  # the way follows its nodes
    assert keys_in(v.get_tiles([A])) == [] and keys_in(v.get_tiles([B])) == [(0, n1), (0, n2), (1, 8201)]
    assert v.get_key(0, n1).collect()[0].lat == 4.0 and v.get_key(1, 8201).count() == 1
    v = apply(("create", rel(9, [(1, 8201)])), ("delete", node(n2, AT_B, 3)))
    assert v.get_key(0, n2).count() == 0 and keys_in(v.get_tiles([B])) == [(0, n1), (1, 8201), (2, 9)]
    assert h.view(T0 + HOUR).get_key(0, n2).count() == 1  # time travel
    assert (v.head.kind == "snapshot") == snapshot
    if snapshot:
        assert A in [r.tile for r in h.view(T0 + 2 * HOUR).tiles(True).collect()]  # marked empty


def test_edits_win_and_relations_follow(spark, make):
    h = make(node(1, AT_A), node(2, AT_A), way(5, [1, 2]), way(6, [1]), rel(7, [(1, 5)]), way(8, [99]))
    assert h.latest.get_key(1, 8).count() == 1  # only unknown nodes: by key, in no tile
    h.apply_diff(change(spark, ("modify", node(1, AT_B, 2)), ("modify", way(5, [1], 2)), ("delete", way(6, [1], 2))), T0 + HOUR)
    v = h.latest
    w = v.get_key(1, 5).collect()[0]
    assert w.version == 2 and w.nodes == [1] and v.get_key(1, 6).count() == 0
    assert keys_in(v.get_tiles([A])) == [(0, 2)] and keys_in(v.get_tiles([B])) == [(0, 1), (1, 5), (2, 7)]
    h.apply_diff(change(spark, ("delete", node(1, AT_B, 3)), ("modify", node(2, AT_B, 3))), T0 + 2 * HOUR)
    assert h.latest.get_key(0, 1).count() == 0 and h.latest.get_key(0, 2).collect()[0].version == 3
    with pytest.raises(ValueError):
        h.apply_diff(change(spark, ("delete", node(2, AT_A, 4))), T0 + 2 * HOUR)
    with pytest.raises(ValueError):
        h.apply_diff(change(spark, ("delete", node(2, AT_A, 4))), T0)


def test_complete_tile(spark, make):
    h = make(node(1, AT_A), node(2, AT_B), way(5, [1, 2]), rel(7, [(0, 1), (0, 3), (1, 6)]), node(3, (0.0, 0.0)), way(6, [3]))
    v = h.latest
    assert keys_in(v.complete(A, False, False)) == [(0, 1), (1, 5), (2, 7)]
    assert keys_in(v.complete(A)) == [(0, 1), (0, 2), (1, 5), (2, 7)]
    assert keys_in(v.complete(A, True, True)) == [(0, 1), (0, 2), (0, 3), (1, 5), (1, 6), (2, 7)]


def test_multi_tile_rows_carry_the_tiles_asked_for(make):
    places = [(4.0 + k * 0.05, 50.0) for k in range(5)]
    h = make(*[node(k, p) for k, p in enumerate(places)], way(10, [0, 1]), way(11, [3, 4]), rel(20, [(0, k) for k in range(5)]))
    t = [r.tile for r in h.latest.tiles().collect()]
    assert len(t) == 5
    got = {(r.type, r.id): r.tiles for r in h.latest.get_tiles(t[:3]).collect()}
    assert got[(1, 10)] == t[:2] and got[(2, 20)] == t[:3] and (1, 11) not in got


def test_compaction_and_snapshot(spark, make):
    h = make(node(1, AT_A), node(2, AT_A))
    h.apply_diff(change(spark, ("modify", node(1, AT_B, 2))), T0 + HOUR)
    h.apply_diff(change(spark, ("modify", node(1, (0.0, 0.0), 3)), ("delete", node(2, AT_A, 2))), T0 + 2 * HOUR)
    before = {(r.type, r.id, r.tile, r.version) for r in h.latest.tiled().collect()}
    made = h.take_diff_snapshot(None, 24 * HOUR)
    assert made.base == T0 and made.timespan == 2 * HOUR and made.name == "20200101-020000_00000007200_diff"
    assert len(h.latest.chain) == 2 and len(h.view(smallest=True).chain) == 3
    assert {(r.type, r.id, r.tile, r.version) for r in h.latest.tiled().collect()} == before
    assert keys_in(h.latest.get_tiles([A, B])) == []  # no stale object where it has passed through
    assert h.take_diff_snapshot(T0 + HOUR, HOUR) is None  # one diff only
    snap = h.take_snapshot(T0 + 2 * HOUR, 90 * 60)
    assert snap.kind == "snapshot" and snap.id == T0 + 2 * HOUR and h.latest.head == snap
    assert {(r.type, r.id, r.tile, r.version) for r in h.latest.tiled().collect()} == before and keys_in(h.latest.scan()) == [(0, 1)]
    assert h.smallest_owner(A).kind == "diff" and len(h.latest._pruned([A])) == 1


def test_time_travel_and_reload(spark, make):
    h = make(node(1, AT_A))
    other = History(spark, h.path)
    assert not other.try_reload()
    for year in (2021, 2022):
        h.add(spark.createDataFrame([node(1, AT_B, year)], OBJECTS), datetime(year, 1, 1))
    assert other.try_reload() and other.latest_id == h.latest_id
    on = lambda y: (lambda v: v and v.head.end.year)(h.get_on(datetime(y, 4, 5)))
    assert [on(y) for y in (2020, 2021, 2022, 2018)] == [2021, 2022, None, 2020]
    assert h.get_on_or_before(datetime(2021, 4, 5)).head.end.year == 2021 and h.get_on_or_before(datetime(2018, 1, 1)) is None
    assert h.previous(h.latest_id).head.end.year == 2021 and h.next(h.latest_id) is None and h.next(T0).head.end.year == 2021
    assert History.try_load(spark, h.path + "-none") is None and len(h.latest.chain) == 1


def test_names():
    id_ = times.to_unix(datetime(2021, 5, 1, 15, 17, 16))
    assert ly.layer_name(id_, "full") == "20210501-151716_full" and ly.parse_name("20210501-151716_full") == (id_, "full", None)
    assert ly.parse_name("20210501-151716_00000003600_diff") == (id_, "diff", 3600)
    assert ly.parse_name("20210501_full") is None and ly.parse_name("20219901-151716_full") is None
    assert ly.Layer(id_, "diff", id_ - 3600).start == times.from_unix(id_ - 3600)
    assert times.start_of_week(datetime(2021, 5, 1, 15)).date().isoformat() == "2021-04-26"


def test_bad_objects_stop_a_build(spark, tmp_path):
    with pytest.raises(Exception, match="lacks its id"):
        History.create(spark, str(tmp_path / "bad"), spark.createDataFrame([(NODE, 1, 1, ts(), *[None] * 9)], OBJECTS), T0)
    assert History.try_load(spark, str(tmp_path / "bad")) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_equals_bulk_build_of_the_final_objects(spark, tmp_path, seed):
    rnd = random.Random(seed)
    place = lambda: (3 + rnd.randrange(8) * 0.05, 50 + rnd.randrange(4) * 0.05)
    now = {(NODE, i): node(i, place()) for i in range(12)}
    now |= {(WAY, 100 + i): way(100 + i, [rnd.randrange(14) for _ in range(3)]) for i in range(5)}
    now |= {(RELATION, 200 + i): rel(200 + i, [(0, rnd.randrange(14)), (1, 100 + rnd.randrange(6))]) for i in range(3)}
    h = History.create(spark, str(tmp_path / "db"), spark.createDataFrame(list(now.values()), OBJECTS), T0)
    version = 1
    for k in range(1, 4):
        rows = []
        for _ in range(6):
            version += 1
            kind = rnd.choice([NODE, NODE, NODE, WAY, RELATION])
            i = rnd.randrange(14) if kind == NODE else 100 + rnd.randrange(6) if kind == WAY else 200 + rnd.randrange(4)
            o = node(i, place(), version, k) if kind == NODE else way(i, [rnd.randrange(14) for _ in range(2)], version, k) if kind == WAY else rel(i, [(1, 100 + rnd.randrange(6))], version, k)
            if rnd.random() < 0.25:
                rows.append(("delete", o))
                now.pop((kind, i), None)
            else:
                rows.append(("modify", o))
                now[(kind, i)] = o
        h.apply_diff(change(spark, *rows), T0 + k * HOUR)

    def agree(v):
        want = spark.createDataFrame(list(now.values()), OBJECTS)
        assert {(r.type, r.id, r.tile) for r in v.tiled().collect()} == {(r.type, r.id, r.tile) for r in tiling.object_tiles(want).collect()}
        assert {(r.type, r.id, r.version) for r in v.scan().collect()} == {(k[0], k[1], o[2]) for k, o in now.items()}

    agree(h.latest)
    h.take_diff_snapshot(None, 24 * HOUR)
    agree(h.latest)
    h.take_snapshot(None, 24 * HOUR)
    agree(h.latest)


def test_large_layers_are_split_and_looked_up_by_folder(spark, tmp_path):
    objects = [node(i, AT_A if i % 2 else AT_B) for i in range(40)] + [way(100 + i, [i, i + 1]) for i in range(20)] + [rel(200, [(1, 100)]), rel(201, [(2, 200)])]
    path = str(tmp_path / "db")
    h = History.create(spark, path, spark.createDataFrame(objects, OBJECTS), T0, part_rows=10)
    assert h.layers[0].parts == 7 and h.latest.scan().count() == len(objects)
    asked = spark.createDataFrame([(0, 3), (1, 104)], "type tinyint, id bigint")
    for df in (h.latest.get(asked), h.latest.tiles_of(asked), h.latest.parents(asked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [part#") == plan.count("FileScan") - plan.count("PartitionFilters: []")
        assert "part#" in plan and "IN (3,6)" in plan
    assert keys_in(h.latest.get(asked)) == [(0, 3), (1, 104)] and {(r.type, r.id) for r in h.latest.parents(asked).collect()} == {(1, 102), (1, 103)}
    seen = []
    real = View._keyed
    View._keyed = lambda self, table, schema, layers=None, ids=None: seen.append((table, ids)) or real(self, table, schema, layers, ids)
    try:
        h.apply_diff(change(spark, ("modify", node(3, AT_B, 2))), T0 + HOUR)
    finally:
        View._keyed = real
    assert seen and all(ids is not None for _, ids in seen)  # a diff looks up keys and scans no table whole
    want = [node(3, AT_B, 2) if o[:2] == (NODE, 3) else o for o in objects]
    assert {(r.type, r.id, r.tile) for r in h.latest.tiled().collect()} == {(r.type, r.id, r.tile) for r in tiling.object_tiles(spark.createDataFrame(want, OBJECTS)).collect()}


def test_nested_relations(spark, tmp_path):
    objects = [node(1, AT_A), rel(10, [(0, 1)]), rel(11, [(2, 10)]), rel(12, [(2, 11)])]
    in_tiles = lambda n: {(r.type, r.id) for r in tiling.object_tiles(spark.createDataFrame(objects, OBJECTS), nested_relations=n).collect()}
    assert [sum(t == RELATION for t, _ in in_tiles(n)) for n in (0, 1, 2)] == [1, 2, 3]
    h = History.create(spark, str(tmp_path / "db"), spark.createDataFrame(objects, OBJECTS), T0)
    h.apply_diff(change(spark, ("modify", rel(11, [(2, 10)], 2))), T0 + HOUR, nested_relations=True)
    assert keys_in(h.latest.get_tiles([A])) == [(0, 1), (2, 10), (2, 11)]


def test_pushdown(make):
    h = make(node(1, AT_A), node(2, AT_B))
    plan = h.latest.tile_log(tiles=[A])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(tile), EqualTo(tile" in plan
