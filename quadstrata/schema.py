"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

NODE, WAY, RELATION = 0, 1, 2
TYPE_NAMES = ("node", "way", "relation")

OBJECTS = (
    "type tinyint, id bigint, version int, ts timestamp, changeset bigint, uid bigint, user string, visible boolean, tags map<string,string>, "
    "lon double, lat double, nodes array<bigint>, members array<struct<type:tinyint,id:bigint,role:string>>"
)
OBJECT_COLUMNS = ["type", "id", "version", "ts", "changeset", "uid", "user", "visible", "tags", "lon", "lat", "nodes", "members"]
#: Columns that a build leaves out unless asked for.
METADATA = ("changeset", "uid", "user", "visible")
CHANGES = "op string, " + OBJECTS
#: version null: the object left the tile in this layer.
TILE_LOG = "type tinyint, id bigint, tile bigint, version int"
KEY_LOG = "type tinyint, id bigint, deleted boolean, tiles array<bigint>"
#: Which ways and relations refer to an object: written with each layer that writes them.
REFS = "member_type tinyint, member_id bigint, parent_type tinyint, parent_id bigint"
DEFAULT_ZOOM = 14


def arrow_changes():
    """CHANGES as an Arrow schema, for sources that read in Python."""
    import pyarrow as pa

    member = pa.struct([("type", pa.int8()), ("id", pa.int64()), ("role", pa.string())])
    return pa.schema(
        [("op", pa.string()), ("type", pa.int8()), ("id", pa.int64()), ("version", pa.int32()), ("ts", pa.timestamp("us", "UTC")), ("changeset", pa.int64()), ("uid", pa.int64()), ("user", pa.string()), ("visible", pa.bool_())]
        + [("tags", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("nodes", pa.list_(pa.int64())), ("members", pa.list_(member))]
    )
