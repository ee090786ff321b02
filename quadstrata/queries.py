"""The store's operators as queries over the derived tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import tiles as tl
from .functions import times as tm
from .operators import changes, state, tiling
from .plans.history import History, View, layer_id
from .sources import osm_xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = """
WITH osm_node AS (
  SELECT *, y * 16384 + x AS tile FROM (
    SELECT *, CAST(floor((lon + 180.0) / 360.0 * 16384) AS BIGINT) AS x,
           CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384) AS BIGINT) AS y FROM (
      SELECT CAST(p_partkey AS BIGINT) AS id, 1 AS version, 3.0 + CAST((p_partkey * 7919) % 360 AS DOUBLE) / 100.0 AS lon, 49.5 + CAST((p_partkey * 104729) % 200 AS DOUBLE) / 100.0 AS lat FROM part))
), osm_way_node AS (
  SELECT CAST(l_orderkey AS BIGINT) AS way_id, CAST(l_partkey AS BIGINT) AS node_id FROM lineitem
), osm_member AS (
  SELECT CAST(c_custkey AS BIGINT) AS relation_id, 0 AS member_type, CAST(c_custkey AS BIGINT) AS member_id FROM customer
  UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders
), way_tile AS (
  SELECT DISTINCT w.way_id AS id, n.tile FROM osm_way_node w JOIN osm_node n ON w.node_id = n.id
), rel_tile AS (
  SELECT m.relation_id AS id, n.tile FROM osm_member m JOIN osm_node n ON m.member_type = 0 AND m.member_id = n.id
  UNION SELECT m.relation_id, w.tile FROM osm_member m JOIN way_tile w ON m.member_type = 1 AND m.member_id = w.id
), object_tile AS (
  SELECT 0 AS type, id, tile FROM osm_node UNION ALL SELECT 1, id, tile FROM way_tile UNION ALL SELECT 2, id, tile FROM rel_tile
), osm_change AS (
  SELECT *, y * 16384 + x AS tile FROM (
    SELECT *, CAST(floor((lon + 180.0) / 360.0 * 16384) AS BIGINT) AS x,
           CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384) AS BIGINT) AS y FROM (
      SELECT (CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1) * 3600 AS layer_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
             CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS op,
             CAST(CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE (user_id * 13 + event_id) % (SELECT count(*) FROM part) END AS BIGINT) AS id,
             CAST(2 + event_id AS INTEGER) AS version,
             3.0 + CAST((event_id * 7919) % 360 AS DOUBLE) / 100.0 AS lon, 49.5 + CAST((event_id * 104729) % 200 AS DOUBLE) / 100.0 AS lat FROM events))
), squashed AS (
  SELECT * FROM osm_change QUALIFY row_number() OVER (PARTITION BY layer_id, id ORDER BY version DESC) = 1
), bounds AS (
  SELECT CAST(floor(max(CAST(floor(epoch(ts)) AS BIGINT)) / 86400) AS BIGINT) * 86400 AS top FROM events
), node_0 AS (SELECT id, version, tile FROM osm_node
), way_0 AS (SELECT id, tile FROM way_tile
), rel_0 AS (SELECT id, tile FROM rel_tile
)"""


def _layer_sql(k: int) -> str:
    """The state after the k-th change set, what follows it, and the rows that its layer has."""
    j = k - 1
    return f"""
, chg_{k} AS (
  SELECT * FROM osm_change, bounds WHERE sec > top - {4 - k} * 21600 AND sec <= top - {3 - k} * 21600 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1
), node_{k} AS (
  SELECT id, version, tile FROM node_{j} WHERE id NOT IN (SELECT id FROM chg_{k}) UNION ALL SELECT id, version, tile FROM chg_{k} WHERE op <> 'delete'
), moved_{k} AS (
  SELECT id FROM ((SELECT id, tile FROM node_{j} EXCEPT SELECT id, tile FROM node_{k}) UNION (SELECT id, tile FROM node_{k} EXCEPT SELECT id, tile FROM node_{j}))
), way_{k} AS (
  SELECT DISTINCT w.way_id AS id, n.tile FROM osm_way_node w JOIN node_{k} n ON w.node_id = n.id
), fway_{k} AS (
  SELECT DISTINCT way_id AS id FROM osm_way_node WHERE node_id IN (SELECT id FROM moved_{k})
), wmoved_{k} AS (
  SELECT id FROM ((SELECT id, tile FROM way_{j} EXCEPT SELECT id, tile FROM way_{k}) UNION (SELECT id, tile FROM way_{k} EXCEPT SELECT id, tile FROM way_{j}))
), rel_{k} AS (
  SELECT m.relation_id AS id, n.tile FROM osm_member m JOIN node_{k} n ON m.member_type = 0 AND m.member_id = n.id
  UNION SELECT m.relation_id, w.tile FROM osm_member m JOIN way_{k} w ON m.member_type = 1 AND m.member_id = w.id
), frel_{k} AS (
  SELECT DISTINCT relation_id AS id FROM osm_member WHERE member_type = 0 AND member_id IN (SELECT id FROM moved_{k}) OR member_type = 1 AND member_id IN (SELECT id FROM wmoved_{k})
), live_{k} AS (
  SELECT 0 AS type, id, tile, version FROM node_{k} WHERE id IN (SELECT id FROM chg_{k}) UNION ALL SELECT 1, id, tile, 1 FROM way_{k} WHERE id IN (SELECT id FROM fway_{k})
  UNION ALL SELECT 2, id, tile, 1 FROM rel_{k} WHERE id IN (SELECT id FROM frel_{k})
), gone_{k} AS (
  (SELECT 0 AS type, id, tile FROM node_{j} WHERE id IN (SELECT id FROM chg_{k}) UNION ALL SELECT 1, id, tile FROM way_{j} WHERE id IN (SELECT id FROM fway_{k})
  UNION ALL SELECT 2, id, tile FROM rel_{j} WHERE id IN (SELECT id FROM frel_{k})) EXCEPT SELECT type, id, tile FROM live_{k}
), log_{k} AS (
  SELECT top - {3 - k} * 21600 AS layer_id, type, id, tile, version FROM live_{k}, bounds UNION ALL SELECT top - {3 - k} * 21600, type, id, tile, NULL FROM gone_{k}, bounds
)"""


def _state_sql(k: int) -> str:
    return f"SELECT 0 AS type, id, tile, version FROM node_{k} UNION ALL SELECT 1, id, tile, 1 FROM way_{k} UNION ALL SELECT 2, id, tile, 1 FROM rel_{k}"


#: What the test history holds (fixtures.stored).
STORED = (
    "".join(_layer_sql(k) for k in (1, 2, 3))
    + f"""
, state_0 AS ({_state_sql(0)}), state_1 AS ({_state_sql(1)}), state_3 AS ({_state_sql(3)}), log AS (
  SELECT top - 3 * 21600 AS layer_id, type, id, tile, version FROM state_0, bounds UNION ALL SELECT * FROM log_1 UNION ALL SELECT * FROM log_2 UNION ALL SELECT * FROM log_3
), touched AS (SELECT tile FROM log_2 UNION SELECT tile FROM log_3
), object AS (
  SELECT 0 AS type, id, version FROM node_3 UNION ALL SELECT DISTINCT 1, way_id, 1 FROM osm_way_node UNION ALL SELECT DISTINCT 2, relation_id, 1 FROM osm_member
), layers AS (
  SELECT top - 3 * 21600 AS id, CAST(NULL AS BIGINT) AS base, CAST(NULL AS BIGINT) AS timespan, 'full' AS kind FROM bounds
  UNION ALL SELECT top - k * 21600, top - (k + 1) * 21600, 21600, 'diff' FROM bounds, (VALUES (0), (1), (2)) v(k)
  UNION ALL SELECT top, top - 2 * 21600, 2 * 21600, k FROM bounds, (VALUES ('diff'), ('snapshot')) v(k)
)
"""
)


def query(sql: str, stored: bool = False):
    """Register a query with its SQL; stored: it reads the test history."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = VIEWS + (STORED if stored else "") + sql
        return f

    return add


def full(spark: SparkSession, sf_dir: str) -> View:
    h = fx.stored(spark, sf_dir, fx.FULL)
    return h.view(h.layers[0].id)


def fine(spark: SparkSession, sf_dir: str) -> View:
    """The latest state through the finest layers: three diffs on the full layer."""
    return fx.stored(spark, sf_dir, fx.DIFFS).view(smallest=True)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("type").cast("int").alias("type"), "id", *columns)


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def keys(spark: SparkSession) -> DataFrame:
    """Keys asked for: every thousandth id up to a million and more, of each type, some of which don't exist."""
    return spark.range(0, 1_100_000, 1000).crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("tinyint").alias("type")))).select("type", "id")


KEYS = "(SELECT t.type, k.id FROM range(0, 1100000, 1000) k(id), (VALUES (0), (1), (2)) t(type))"
TILES = "(SELECT DISTINCT (4096 + (i * 37) % 200 + 1353) * 16384 + 8328 + (i * 53) % 160 AS tile FROM range(0, 5000) r(i))"


TILE_LIST = sorted({(4096 + (i * 37) % 200 + 1353) * 16384 + 8328 + (i * 53) % 160 for i in range(5000)})
TILE = 5541 * 16384 + 8401


@query("SELECT id, x, y FROM osm_node")
def tile_from_world(s, d):
    return fx.nodes(s, d).select("id", "x", "y")


@query("SELECT id, tile, tile % 16384 AS x, tile // 16384 AS y FROM osm_node")
def tile_roundtrip(s, d):
    return fx.nodes(s, d).select("id", "tile", tl.x_of(F.col("tile")).alias("x"), tl.y_of(F.col("tile")).alias("y"))


@query("SELECT type, id, id + CAST(type AS BIGINT) * 2305843009213693952 AS key FROM (SELECT 0 AS type, id FROM osm_node UNION SELECT 1, way_id FROM osm_way_node UNION SELECT 2, relation_id FROM osm_member)")
def key_encode(s, d):
    return plain(fx.objects(s, d), tl.encode_key(F.col("type"), F.col("id")).alias("key"))


@query("SELECT id, version, CAST(NULL AS BIGINT) AS changeset, CAST(NULL AS BIGINT) AS uid, CAST(NULL AS VARCHAR) AS \"user\", CAST(NULL AS BOOLEAN) AS visible FROM osm_node")
def strip_metadata(s, d):
    every = fx.nodes(s, d).select("id", "version", (F.col("id") * 7).alias("changeset"), F.col("id").alias("uid"), F.lit("someone").alias("user"), F.lit(True).alias("visible"))
    return tiling.strip_metadata(every)


@query("SELECT 1 AS type, way_id AS id FROM osm_way_node WHERE way_id % 2 = 0 GROUP BY way_id UNION ALL SELECT 2, relation_id FROM osm_member WHERE relation_id % 2 = 0 GROUP BY relation_id UNION ALL SELECT 0, id FROM osm_node")
def valid_objects(s, d):
    """Ways without nodes and relations without members are left out: those of odd ids lose theirs here."""
    keep = F.col("id") % 2 == 0
    every = fx.objects(s, d).withColumns({"nodes": F.when(keep, F.col("nodes")), "members": F.when(keep, F.col("members"))})
    return plain(tiling.valid(every))


@query("SELECT tile, count(*) AS objects FROM object_tile GROUP BY tile")
def objects_per_tile(s, d):
    return tiling.object_tiles(fx.objects(s, d)).groupBy("tile").agg(F.count("*").alias("objects"))


@query("SELECT tile, type, id FROM object_tile QUALIFY row_number() OVER (PARTITION BY tile ORDER BY type, id) = 1")
def first_object_per_tile(s, d):
    return tiling.object_tiles(fx.objects(s, d)).groupBy("tile").agg(F.min(F.struct(F.col("type").cast("int").alias("type"), "id")).alias("k")).select("tile", "k.type", "k.id")


@query("SELECT id, tile FROM way_tile")
def way_tiles(s, d):
    return tiling.way_tiles(fx.way_nodes(s, d), fx.nodes(s, d))


@query("SELECT id, tile FROM rel_tile")
def relation_tiles(s, d):
    n = fx.nodes(s, d)
    return tiling.relation_tiles(fx.members(s, d), n, tiling.way_tiles(fx.way_nodes(s, d), n))


NESTED = "osm_nested AS (SELECT relation_id, member_type, member_id FROM osm_member UNION ALL SELECT DISTINCT relation_id, 2, relation_id + 1 FROM osm_member)"


@query(f", {NESTED} SELECT id, tile FROM rel_tile UNION SELECT m.relation_id, r.tile FROM osm_nested m JOIN rel_tile r ON m.member_type = 2 AND m.member_id = r.id")
def relation_tiles_nested(s, d):
    """Each relation has the next one as a member too, and with it its tiles."""
    n, m = fx.nodes(s, d), fx.members(s, d).select("relation_id", "member_type", "member_id")
    nested = m.union(m.select("relation_id", F.lit(2), F.col("relation_id") + 1).distinct())
    w = tiling.way_tiles(fx.way_nodes(s, d), n)
    return tiling.relation_tiles(nested, n, w, tiling.relation_tiles(m, n, w))


@query("SELECT layer_id, op, id, version, x, y FROM squashed")
def squash_changes(s, d):
    return fx.squashed(s, d).select("layer_id", "op", "id", "version", "x", "y")


@query("SELECT layer_id, op, count(*) AS changes FROM squashed GROUP BY layer_id, op")
def change_counts(s, d):
    return fx.squashed(s, d).groupBy("layer_id", "op").agg(F.count("*").alias("changes"))


@query("SELECT max(sec) AS layer_id FROM osm_change, bounds WHERE sec > top - 21600 AND sec <= top")
def layer_id_from_data(s, d):
    return rows(s, [(layer_id(fx.change_set(s, d, fx.last_midnight(s, d)), None),)], "layer_id bigint")


# --- the test history: a full layer ---


@query("SELECT type, id, tile, version FROM state_0", True)
def history_build(s, d):
    return plain(full(s, d).tiled(), "tile", "version")


@query("SELECT type, id, version, refs FROM (SELECT 0 AS type, id, 1 AS version, 0 AS refs FROM osm_node UNION ALL SELECT 1, way_id, 1, count(*) FROM osm_way_node GROUP BY way_id UNION ALL SELECT 2, relation_id, 1, count(*) FROM osm_member GROUP BY relation_id)")
def scan_all(s, d):
    return plain(full(s, d).scan(), "version", (F.coalesce(F.size("nodes"), F.lit(0)) + F.coalesce(F.size("members"), F.lit(0))).cast("long").alias("refs"))


@query(f"SELECT o.type, o.id, o.version FROM (SELECT 0 AS type, id, 1 AS version FROM osm_node UNION ALL SELECT DISTINCT 1, way_id, 1 FROM osm_way_node UNION ALL SELECT DISTINCT 2, relation_id, 1 FROM osm_member) o JOIN {KEYS} k ON o.type = k.type AND o.id = k.id")
def get_by_keys(s, d):
    return plain(full(s, d).get(keys(s)), "version")


@query("SELECT type, id, 1 AS version FROM state_0 WHERE tile = 5541 * 16384 + 8401", True)
def get_by_tile(s, d):
    return plain(full(s, d).get_tiles([TILE]), "version")


@query(f"SELECT type, id, count(*) AS tiles, min(tile) AS first_tile, max(tile) AS last_tile FROM object_tile WHERE tile IN {TILES} GROUP BY type, id")
def get_by_tiles(s, d):
    return plain(full(s, d).get_tiles(TILE_LIST), F.size("tiles").cast("long").alias("tiles"), F.array_min("tiles").alias("first_tile"), F.array_max("tiles").alias("last_tile"))


@query("""SELECT type, id FROM (SELECT 0 AS type, id FROM osm_node WHERE tile = 5541 * 16384 + 8401
UNION SELECT 0, w.node_id FROM osm_way_node w JOIN way_tile t ON t.id = w.way_id JOIN osm_node n ON n.id = w.node_id WHERE t.tile = 5541 * 16384 + 8401
UNION SELECT 1, id FROM way_tile WHERE tile = 5541 * 16384 + 8401 UNION SELECT 2, id FROM rel_tile WHERE tile = 5541 * 16384 + 8401)""")
def tile_complete_ways(s, d):
    return plain(full(s, d).complete(TILE))


@query("""SELECT DISTINCT k.type, k.id FROM (SELECT type, id FROM object_tile WHERE tile = 5541 * 16384 + 8401
UNION SELECT m.member_type, m.member_id FROM osm_member m JOIN rel_tile t ON t.id = m.relation_id WHERE t.tile = 5541 * 16384 + 8401) k
JOIN (SELECT 0 AS type, id FROM osm_node UNION SELECT 1, way_id FROM osm_way_node UNION SELECT 2, relation_id FROM osm_member) o ON o.type = k.type AND o.id = k.id""")
def tile_complete_relations(s, d):
    return plain(full(s, d).complete(TILE, ways=False, relations=True))


@query("SELECT type, id, version, refs FROM (SELECT 0 AS type, id, 1 AS version, 0 AS refs FROM osm_node UNION ALL SELECT 1, way_id, 1, count(*) FROM osm_way_node GROUP BY way_id UNION ALL SELECT 2, relation_id, 1, count(*) FROM osm_member GROUP BY relation_id) o WHERE EXISTS (SELECT 1 FROM object_tile t WHERE t.type = o.type AND t.id = o.id AND t.tile = 5541 * 16384 + 8401)")
def xml_round_trip(s, d):
    """A tile's objects, written as map XML and read again."""
    place = fx.folder(s, "xml")
    osm_xml.write_objects(full(s, d).get_tiles([TILE]).drop("tiles"), place)
    return plain(osm_xml.read_objects(s, f"{place}/*"), "version", (F.coalesce(F.size("nodes"), F.lit(0)) + F.coalesce(F.size("members"), F.lit(0))).cast("long").alias("refs"))


# --- diffs on it ---


@query("SELECT layer_id, type, id, tile, version FROM log_1 UNION ALL SELECT * FROM log_2 UNION ALL SELECT * FROM log_3", True)
def history_apply_diff(s, d):
    """All rows of the three diff layers: changed nodes, ways and relations that follow, tombstones."""
    return fine(s, d).tile_log(fine(s, d).chain[:-1]).select("layer_id", F.col("type").cast("int").alias("type"), "id", "tile", "version")


@query("SELECT layer_id, type, id, tile FROM log WHERE version IS NULL", True)
def diff_tombstones(s, d):
    return fine(s, d).tile_log().filter("version is null").select("layer_id", F.col("type").cast("int").alias("type"), "id", "tile")


@query("SELECT type, id, tile, version FROM live_3", True)
def diff_live(s, d):
    return plain(fine(s, d).local().filter("version is not null"), "tile", "version")


@query("SELECT type, id, tile, version FROM log_3", True)
def layer_local_scan(s, d):
    return plain(fine(s, d).local(), "tile", "version")


@query("SELECT DISTINCT way_id AS id FROM osm_way_node WHERE node_id IN (SELECT id FROM moved_1)", True)
def parents_of_moved(s, d):
    h = fx.stored(s, d, fx.DIFF_1)
    before, after = (h.view(h.layers[k].id).tiled().filter("type = 0").select("id", "tile") for k in (0, 1))
    return changes.parents_of(h.view(h.layers[0].id).scan(), changes.differing(before, after))


@query("SELECT type, id FROM fway_3, (VALUES (1)) t(type) UNION SELECT 2, relation_id FROM osm_member WHERE member_type = 0 AND member_id IN (SELECT id FROM moved_3)", True)
def parents_by_reference(s, d):
    """What refers to the nodes that the last diff moved, by the index of references."""
    h = fx.stored(s, d, fx.DIFFS)
    return plain(fine(s, d).parents(_moved_nodes(h.view(h.latest_id - fx.STEP), fine(s, d))))


def _moved_nodes(before: View, after: View) -> DataFrame:
    """type, id of the nodes that the diff at the head of after moved: any of them has a row or a tombstone in it, so no others are compared."""
    own = after.local().filter("type = 0").select("type", "id").distinct()
    found = changes.differing(*(v.tiles_of(own).select("id", "tile") for v in (before, after)))
    return found.select(F.lit(0).cast("tinyint").alias("type"), "id")


@query("SELECT type, id, tile, version FROM state_3", True)
def current_state(s, d):
    return plain(fine(s, d).tiled(), "tile", "version")


@query("SELECT type, id, version FROM object", True)
def scan_layered(s, d):
    return plain(fine(s, d).scan(), "version")


@query(f"SELECT o.type, o.id, o.version FROM object o JOIN {KEYS} k ON o.type = k.type AND o.id = k.id", True)
def get_by_keys_layered(s, d):
    return plain(fine(s, d).get(keys(s)), "version")


@query("SELECT type, id, version FROM object WHERE type = 1 AND id = (SELECT min(id) FROM fway_3)", True)
def get_one_key(s, d):
    first = fine(s, d).local().filter("type = 1").agg(F.min("id")).first()[0]
    return plain(fine(s, d).get_key(1, first), "version")


@query(f"SELECT k.type, k.id, o.tile FROM {KEYS} k LEFT JOIN state_3 o ON o.type = k.type AND o.id = k.id", True)
def tiles_for_keys(s, d):
    return plain(fine(s, d).tiles_for(keys(s)), "tile")


TILED_ROWS = f"SELECT s.type, s.id, s.tile, o.version FROM state_3 s JOIN object o ON o.type = s.type AND o.id = s.id WHERE s.tile IN {TILES}"


@query(TILED_ROWS, True)
def get_by_tiles_diff(s, d):
    return plain(fine(s, d).get_tiles(TILE_LIST), "version", F.explode("tiles").alias("tile"))


@query(TILED_ROWS, True)
def get_by_tiles_snapshot(s, d):
    """The same through the snapshot, which answers for the tiles it owns, and the layers below it for the rest."""
    return plain(fx.stored(s, d).latest.get_tiles(TILE_LIST), "version", F.explode("tiles").alias("tile"))


@query("SELECT DISTINCT tile FROM log", True)
def tiles_all(s, d):
    return fx.stored(s, d).latest.tiles()


@query("SELECT DISTINCT tile FROM log_3", True)
def tiles_modified(s, d):
    return fine(s, d).tiles(modified_only=True)


@query("SELECT tile FROM touched", True)
def modified_tiles(s, d):
    return fx.stored(s, d, fx.DIFFS).touched_tiles(None, 2 * fx.STEP)


@query("SELECT type, id, tile FROM state_0 EXCEPT SELECT type, id, tile FROM state_3", True)
def vacated_tiles(s, d):
    return plain(state.vacated(full(s, d).tiled(), fine(s, d).tiled()), "tile")


@query("""SELECT coalesce(b.id, r.id) AS id, CASE WHEN r.id IS NULL THEN b.version ELSE r.version END AS version FROM osm_node b
FULL OUTER JOIN (SELECT id, max(version) AS version FROM squashed GROUP BY id) r ON b.id = r.id""")
def merge_recent_wins(s, d):
    recent = fx.squashed(s, d).groupBy("id").agg(F.max("version").alias("version"))
    return state.merge_recent_wins(fx.nodes(s, d).select("id", "version"), recent, ["id"])


@query("SELECT tile, max(layer_id) AS owner FROM log GROUP BY tile", True)
def owner_layer_of_tile(s, d):
    return fine(s, d).owners()


@query("SELECT tile, CASE WHEN tile IN (SELECT tile FROM touched) THEN (SELECT top FROM bounds) ELSE max(layer_id) END AS owner FROM log GROUP BY tile", True)
def owner_with_snapshot(s, d):
    """Through the snapshot, whose marks make it the owner of tiles that are empty now."""
    return fx.stored(s, d).latest.owners()


@query("SELECT tile, max(layer_id) AS id, CASE WHEN max(layer_id) = (SELECT top - 64800 FROM bounds) THEN 'full' ELSE 'diff' END AS kind FROM log WHERE tile IN (SELECT min(tile) FROM log UNION SELECT max(tile) FROM log UNION SELECT 5541 * 16384 + 8401 WHERE EXISTS (SELECT 1 FROM log WHERE tile = 5541 * 16384 + 8401)) GROUP BY tile", True)
def smallest_owner(s, d):
    h = fx.stored(s, d)
    ends = h.latest.tiles().agg(F.min("tile"), F.max("tile")).first()
    found = [(t, _finest_owner(h, t)) for t in sorted({*ends, *([TILE] if fine(s, d).owners([TILE]).count() else [])})]
    return rows(s, [(t, x.id, x.kind) for t, x in found], "tile bigint, id bigint, kind string")


def _finest_owner(h: History, tile: int):
    owner = h.view(smallest=True).owner(tile)
    return h.smallest_owner(tile, owner.id)


# --- compaction and snapshots ---


@query("""SELECT (SELECT top FROM bounds) AS layer_id, type, id, tile, version FROM (SELECT * FROM log_2 UNION ALL SELECT * FROM log_3)
QUALIFY row_number() OVER (PARTITION BY type, id, tile ORDER BY layer_id DESC) = 1""", True)
def compact_diffs(s, d):
    h = fx.stored(s, d, fx.COMPACTED)
    made = next(x for x in h.layers if x.kind == "diff" and x.timespan == 2 * fx.STEP)
    return View(h, made).local().select("layer_id", F.col("type").cast("int").alias("type"), "id", "tile", "version")


@query("SELECT type, id, tile, version FROM state_3", True)
def state_through_compaction(s, d):
    """The latest state by the diff that stands for two."""
    h = fx.stored(s, d, fx.COMPACTED)
    return plain(View(h, next(x for x in h.layers if x.kind == "diff" and x.timespan == 2 * fx.STEP)).tiled(), "tile", "version")


@query("SELECT type, id, tile, version FROM state_3 WHERE tile IN (SELECT tile FROM touched)", True)
def snapshot_materialize(s, d):
    return plain(fx.stored(s, d).latest.local().filter("version is not null"), "tile", "version")


@query("SELECT tile FROM touched EXCEPT SELECT tile FROM state_3", True)
def snapshot_empty_tiles(s, d):
    h = fx.stored(s, d)
    return h.latest.empty_tiles([h.latest.head]).select("tile")


@query("SELECT type, id, tile, version FROM state_3", True)
def state_through_snapshot(s, d):
    return plain(fx.stored(s, d).latest.tiled(), "tile", "version")


@query("SELECT type, id, tile, version FROM state_1 WHERE tile IN (SELECT tile FROM log_1)", True)
def snapshot_of_changes(s, d):
    return plain(fx.stored_at_once(s, d).latest.local().filter("version is not null"), "tile", "version")


# --- layers and moments ---


@query("SELECT id, base, timespan, kind FROM layers", True)
def history_layers(s, d):
    """From the folders, as another process would find them."""
    return History(s, fx.stored(s, d).path).table()


@query("""SELECT a.sec AS "at", (SELECT min(l.id) FROM layers l WHERE l.id >= a.sec) AS layer_id
FROM (SELECT DISTINCT sec FROM osm_change UNION SELECT max(id) + 1 FROM layers UNION SELECT -5) a""", True)
def asof_layer(s, d):
    h = fx.stored(s, d)
    return h.as_of(fx.changes(s, d).select("at").union(rows(s, [(h.latest_id + 1,), (-5,)], "at bigint")))


MOMENTS = "(SELECT top + k * 10800 AS sec FROM bounds, range(-8, 2) r(k))"


@query(f'SELECT sec AS "at", (SELECT min(id) FROM layers WHERE id >= sec) AS on_or_after, (SELECT max(id) FROM layers WHERE id <= sec) AS on_or_before FROM {MOMENTS}', True)
def history_get_on(s, d):
    h = fx.stored(s, d)
    id_ = lambda v: v and v.head.id
    return rows(s, [(at, id_(h.get_on(at)), id_(h.get_on_or_before(at))) for at in range(h.latest_id - 8 * 10800, h.latest_id + 2 * 10800, 10800)], "at bigint, on_or_after bigint, on_or_before bigint")


@query("SELECT type, id, tile, version FROM state_1", True)
def history_time_travel(s, d):
    """The state five hours after the first diff's moment, when the second was still to come."""
    h = fx.stored(s, d, fx.DIFF_2)  # what comes later than the second isn't asked for
    return plain(h.get_on_or_before(h.layers[0].id + fx.STEP + 5 * 3600).tiled(), "tile", "version")


@query("SELECT id, lag(id) OVER (ORDER BY id) AS previous, lead(id) OVER (ORDER BY id) AS next FROM (SELECT DISTINCT id FROM layers)", True)
def layer_prev_next(s, d):
    h = fx.stored(s, d)
    id_ = lambda v: v and v.head.id
    return rows(s, [(i, id_(h.previous(i)), id_(h.next(i))) for i in sorted({x.id for x in h.layers})], "id bigint, previous bigint, next bigint")


@query("SELECT id, base, timespan, kind FROM layers QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'full' THEN 0 WHEN 'snapshot' THEN 1 ELSE 2 END, timespan DESC) = 1", True)
def layer_pick(s, d):
    h = fx.stored(s, d)
    heads = [h.view(i).head for i in sorted({x.id for x in h.layers})]
    return rows(s, [(x.id, x.base, x.timespan, x.kind) for x in heads], "id bigint, base bigint, timespan bigint, kind string")


@query("SELECT event_id, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week FROM events")
def week_start(s, d):
    return fx.table(s, d, "events").select("event_id", tm.week_of(F.col("ts")).cast("string").alias("week"))


@query("SELECT y * 16384 + x AS tile, x, y FROM range(8350, 8401) a(x), range(5480, 5531) b(y)")
def tiles_for_bbox(s, d):
    edge = 360.0 / 16384
    import math

    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 16384))))
    return tl.tiles_for_bbox(s, 8350.5 * edge - 180, lat(5530.5), 8400.5 * edge - 180, lat(5480.5))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
