import gzip
import lzma
import struct
import zlib
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quadstrata import cli
from quadstrata.functions.times import to_unix
from quadstrata.plans.files import Store
from quadstrata.plans.history import History
from quadstrata.plans.locks import is_locked, lock
from quadstrata.schema import OBJECTS
from quadstrata.sources import osm_pbf, osm_xml
from quadstrata.streaming import replication

OSC = """<osmChange version="0.6">
  <create><node id="1" version="1" lat="50" lon="4" timestamp="{t}"><tag k="a" v="b"/></node>
          <way id="7" version="1" timestamp="{t}"><nd ref="1"/><nd ref="2"/></way></create>
  <modify><node id="2" version="2" lat="4" lon="50" timestamp="{t}"/></modify>
  <delete><node id="3" version="3" lat="4" lon="50" timestamp="{t}"/></delete>
</osmChange>"""


def test_change_file(spark, tmp_path):
    (tmp_path / "c.osc").write_text(OSC.format(t="2020-01-01T00:00:00Z"))
    got = {(r.op, r.type, r.id): r for r in osm_xml.read_changes(spark, str(tmp_path / "c.osc")).collect()}
    assert set(got) == {("create", 0, 1), ("create", 1, 7), ("modify", 0, 2), ("delete", 0, 3)}
    assert got[("create", 0, 1)].tags == {"a": "b"} and got[("create", 1, 7)].nodes == [1, 2] and got[("modify", 0, 2)].lon == 50.0


def test_change_file_is_scanned_once_and_tags_may_repeat(spark, tmp_path):
    text = OSC.format(t="2020-01-01T00:00:00Z").replace('<tag k="a" v="b"/>', '<tag k="a" v="b"/><tag k="x" v="&amp;1"/><tag k="a" v="last"/>')
    (tmp_path / "c.osc.gz").write_bytes(gzip.compress(text.encode()))
    df = osm_xml.read_changes(spark, str(tmp_path / "c.osc.gz"))
    got = {(r.op, r.type, r.id): r for r in df.collect()}
    assert len(got) == 4 and got[("create", 0, 1)].tags == {"a": "last", "x": "&1"} and got[("create", 0, 1)].ts == datetime(2020, 1, 1)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    (tmp_path / "m.osm").write_text('<osm><node id="1" version="1" lat="1" lon="2"><tag k="a" v="b"/><tag k="a" v="last"/></node></osm>')
    assert osm_xml.read_objects(spark, str(tmp_path / "m.osm")).collect()[0].tags == {"a": "last"}


def test_xml_round_trip(spark, tmp_path):
    t = datetime(2020, 1, 1)
    rows = [(0, 1, 1, t, None, None, None, None, {"a": "b"}, 4.0, 50.0, None, None), (1, 7, 2, t, None, None, None, None, None, None, None, [1, 1], None), (2, 9, 3, t, None, None, None, None, {"x": "y"}, None, None, None, [(1, 7, "outer"), (0, 1, "")])]
    osm_xml.write_objects(spark.createDataFrame(rows, OBJECTS), str(tmp_path / "x"))
    got = sorted(osm_xml.read_objects(spark, str(tmp_path / "x" / "*")).collect())
    assert [(r.type, r.id, r.version, r.tags, r.lon, r.nodes, r.members and [tuple(m) for m in r.members]) for r in got] == [(r[0], r[1], r[2], r[8], r[9], r[11], r[12]) for r in rows]


# --- a small encoder, to test the decoder against ---


def vi(n):
    out = b""
    n &= (1 << 64) - 1
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


zz = lambda n: (n << 1) ^ (n >> 63)
num = lambda k, v: vi(k << 3) + vi(v)
msg = lambda k, b: vi(k << 3 | 2) + vi(len(b)) + b
pk = lambda k, vs: msg(k, b"".join(map(vi, vs)))
deltas = lambda vs: [zz(b - a) for a, b in zip([0, *vs], vs)]


def pbf(pack=lambda data: msg(3, zlib.compress(data))):
    strings = b"".join(msg(1, s) for s in (b"", b"name", b"x", "häus".encode(), b"outer"))
    info = pk(1, [1, 2]) + pk(2, deltas([1577836800, 1577836860])) + pk(3, deltas([5, 6])) + pk(4, deltas([7, 7])) + pk(5, deltas([2, 2]))
    dense = msg(2, pk(1, deltas([10, -3])) + msg(5, info) + pk(8, deltas([500000000, 40000000])) + pk(9, deltas([40000000, 500000000])) + pk(10, [1, 3, 0, 0]))
    single = msg(1, num(1, zz(77)) + pk(2, [1]) + pk(3, [2]) + msg(4, num(1, 4)) + num(8, zz(10000000)) + num(9, zz(-20000000)))
    way = msg(3, num(1, 20) + pk(2, [1]) + pk(3, [2]) + msg(4, num(1, 3) + num(2, 1577836800)) + pk(8, deltas([10, -3, 10])))
    rel = msg(4, num(1, 30) + msg(4, num(1, 1)) + pk(8, [4, 0]) + pk(9, deltas([20, 10])) + pk(10, [1, 0]))
    block = msg(1, strings) + b"".join(msg(2, g) for g in (dense, single, way, rel))
    file = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block), (b"OSMData", block)):
        blob = num(2, len(data)) + pack(data) if data else msg(1, data)
        head = msg(1, kind) + num(3, len(blob))
        file += struct.pack(">I", len(head)) + head + blob
    return file


def test_pbf(spark, tmp_path):
    (tmp_path / "m.osm.pbf").write_bytes(pbf())
    df = osm_pbf.read_objects(spark, str(tmp_path / "m.osm.pbf"))
    assert df.count() == 10
    got = {(r.type, r.id): r for r in df.collect()}
    assert set(got) == {(0, 10), (0, -3), (0, 77), (1, 20), (2, 30)}
    n = got[(0, 10)]
    assert (n.lat, n.lon, n.version, n.tags, n.changeset, n.uid, n.user) == (50.0, 4.0, 1, {"name": "häus"}, 5, 7, "x")
    assert (got[(0, -3)].lat, got[(0, -3)].lon, got[(0, -3)].tags) == (4.0, 50.0, None)
    assert (got[(0, 77)].lat, got[(0, 77)].lon) == (1.0, -2.0)
    assert got[(1, 20)].nodes == [10, -3, 10] and [tuple(m) for m in got[(2, 30)].members] == [(1, 20, "outer"), (0, 10, "")]
    assert df.select(F.max(F.unix_seconds("ts"))).first()[0] == 1577836860


def test_pbf_compressions_and_folders(spark, tmp_path):
    import pyarrow as pa
    import zstandard

    packs = [lambda d: msg(1, d), lambda d: msg(4, lzma.compress(d)), lambda d: msg(6, pa.Codec("lz4_raw").compress(d, asbytes=True)), lambda d: msg(7, zstandard.compress(d))]
    for k, pack in enumerate(packs):
        (tmp_path / f"{k}.osm.pbf").write_bytes(pbf(pack))
    one = {tuple(map(str, r)) for r in osm_pbf.read_objects(spark, str(tmp_path / "0.osm.pbf")).collect()}
    for k in range(1, 4):
        assert {tuple(map(str, r)) for r in osm_pbf.read_objects(spark, str(tmp_path / f"{k}.osm.pbf")).collect()} == one
    assert osm_pbf.read_objects(spark, str(tmp_path)).count() == 40


def start_at_22(spark, db):
    t = datetime(2020, 1, 1)
    return History.create(spark, db, spark.createDataFrame([(0, i, 1, t, None, None, None, None, None, 4.0, 50.0, None, None) for i in (2, 3)], OBJECTS), datetime(2020, 1, 1, 22))


def test_late_files_raise_and_compaction_is_made_up_for(spark, tmp_path):
    import pytest

    db = str(tmp_path / "db")
    start_at_22(spark, db)
    for name in ("20200101-233000", "20200102-000000", "20200101-231500"):
        (tmp_path / f"{name}.osc").write_text(OSC.format(t="2020-01-01T23:00:00Z"))
    assert len(replication.apply_file(spark, db, str(tmp_path / "20200101-233000.osc"))) == 1
    h = History(spark, db)
    h.apply_diff(osm_xml.read_changes(spark, str(tmp_path / "20200102-000000.osc")), datetime(2020, 1, 2), {"file": "20200102-000000.osc"})  # and then it fails
    assert [x.timespan for x in replication.apply_file(spark, db, str(tmp_path / "20200102-000000.osc"))] == [7200]
    assert replication.apply_file(spark, db, str(tmp_path / "20200102-000000.osc")) == []
    with pytest.raises(replication.LateFile):
        replication.apply_file(spark, db, str(tmp_path / "20200101-231500.osc"))


def test_replication_folders(spark, tmp_path):
    db = str(tmp_path / "db")
    start_at_22(spark, db)

    def publish(folder, n, moment, latest):
        state = f"#a comment\nsequenceNumber={n}\ntimestamp={moment:%Y-%m-%dT%H}\\:{moment:%M}\\:{moment:%S}Z\n"
        place = tmp_path / folder / f"{n:09d}"[:3] / f"{n:09d}"[3:6]
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{n % 1000:03d}.state.txt").write_text(state)
        (place / f"{n % 1000:03d}.osc.gz").write_bytes(gzip.compress(OSC.format(t=f"{moment:%Y-%m-%dT%H:%M:%SZ}").encode()))
        if latest:
            (tmp_path / folder / "state.txt").write_text(state)

    for k in range(4):
        publish("hour", 70_000 + k, datetime(2020, 1, 1, 20 + k), k == 3)
    for k in range(5):
        publish("minute", 4_000_998 + k, datetime(2020, 1, 1, 22, 58 + k) if k < 2 else datetime(2020, 1, 1, 23, k - 2), k == 4)
    made = replication.catch_up(spark, db, str(tmp_path / "hour"), str(tmp_path / "minute"), to_unix(datetime(2020, 1, 1, 23, 2, 30)))
    h = History(spark, db)
    assert [(x.meta.get("period"), x.meta.get("sequence_number")) for x in made if x.meta] == [(3600, 70_003), (60, 4_001_001), (60, 4_001_002)]
    assert h.latest_id == to_unix(datetime(2020, 1, 1, 23, 2)) and {(r.type, r.id) for r in h.latest.scan().collect()} == {(0, 1), (0, 2), (1, 7)}
    publish("minute", 4_001_003, datetime(2020, 1, 1, 23, 3), True)
    assert len(replication.catch_up(spark, db, None, str(tmp_path / "minute"), h.latest_id + 90)) == 1  # by its number
    assert replication.catch_up(spark, db, None, str(tmp_path / "minute"), h.latest_id + 90) == []


def test_publishing_survives_a_stop(spark, tmp_path, monkeypatch):
    import pytest

    from quadstrata.plans import layers as ly

    db = str(tmp_path / "db")
    h = start_at_22(spark, db)
    (tmp_path / "c.osc").write_text(OSC.format(t="2020-01-01T23:00:00Z"))
    apply = lambda: History(spark, db).apply_diff(osm_xml.read_changes(spark, str(tmp_path / "c.osc")), datetime(2020, 1, 1, 23))
    for step in ("write", "move"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                apply()
        assert not h.try_reload() and len(h.layers) == 1
    (tmp_path / "db" / "20200101-230000_00000003600_diff" / "objects").mkdir(parents=True)  # what a stop may leave
    assert len(History(spark, db).layers) == 1
    assert apply().kind == "diff" and len(History(spark, db).layers) == 2 and ly.META == "meta.json"
    with pytest.raises(ValueError):
        apply()


def test_a_lock_is_taken_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quadstrata.plans.locks import take

    store, place = Store(spark), str(tmp_path / "x.lock")
    with ThreadPoolExecutor(8) as pool:
        assert sum(x is not None for x in pool.map(lambda _: take(store, place, 60), range(24))) == 1
    store.write(place, '{"time": 0}')  # past its limit
    with ThreadPoolExecutor(8) as pool:
        assert sum(x is not None for x in pool.map(lambda _: take(store, place, 60), range(24))) == 1


def test_a_configuration_builds_and_updates(spark, tmp_path):
    import json

    (tmp_path / "m.osm.pbf").write_bytes(pbf())
    (tmp_path / "changes").mkdir()
    (tmp_path / "changes" / "20200101-230000.osc.gz").write_bytes(gzip.compress(OSC.format(t="2020-01-01T23:00:00Z").encode()))
    (tmp_path / "c.json").write_text(json.dumps({"db": str(tmp_path / "db"), "source": str(tmp_path / "m.osm.pbf"), "changes": str(tmp_path / "changes"), "snapshots": ["latest"]}))
    for _ in range(2):
        assert cli.main(["run", str(tmp_path / "c.json")], spark) == 0
    assert [x.kind for x in History(spark, str(tmp_path / "db")).layers] == ["full", "snapshot", "diff"]


def test_stream_applies_each_file_once_and_compacts(spark, tmp_path):
    db, folder = str(tmp_path / "db"), tmp_path / "changes"
    folder.mkdir()
    t = datetime(2020, 1, 1)
    History.create(spark, db, spark.createDataFrame([(0, i, 1, t, None, None, None, None, None, 4.0, 50.0, None, None) for i in (2, 3)], OBJECTS), datetime(2020, 1, 1, 22))
    for name in ("20200101-230000", "20200101-233000", "20200102-000000"):
        (folder / f"{name}.osc").write_text(OSC.format(t="2020-01-01T23:00:00Z"))
    for _ in range(2):
        replication.replicate(spark, db, str(folder), str(tmp_path / "cp")).awaitTermination()
    h = History(spark, db)
    assert [x.name for x in h.layers] == ["20200101-220000_full", "20200101-230000_00000003600_diff", "20200101-233000_00000001800_diff", "20200102-000000_00000007200_diff", "20200102-000000_00000001800_diff"]
    assert {(r.type, r.id) for r in h.latest.scan().collect()} == {(0, 1), (0, 2), (1, 7)} and len(h.latest.chain) == 2
    assert replication.apply_file(spark, db, str(folder / "20200101-230000.osc")) == []  # once more after a failure
    assert replication.scheduled_snapshot(spark, db, "latest").kind == "snapshot"


def test_commands_and_locks(spark, tmp_path):
    db, src = str(tmp_path / "db"), str(tmp_path / "m.osm.pbf")
    (tmp_path / "m.osm.pbf").write_bytes(pbf())
    assert cli.main(["build", src, db], spark) == 0
    assert History(spark, db).latest_id == int(datetime(2020, 1, 1, 0, 1, tzinfo=timezone.utc).timestamp())
    store, place = Store(spark), f"{db}.snapshot.lock"
    with lock(store, place, 60) as taken:
        assert taken and is_locked(store, place, 60) and not is_locked(store, place, 0)
        assert cli.main(["snapshot", db], spark) == 1
    assert not store.exists(place)
    store.write(place, "not json")
    assert not is_locked(store, place, 60)
    assert cli.main(["snapshot", db, "week"], spark) == 0
