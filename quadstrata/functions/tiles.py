"""Web-mercator tile arithmetic and key encoding, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_x(lon: Column, zoom: int = 14, clamp: bool = False) -> Column:
    x = F.floor((lon + 180.0) / 360.0 * (1 << zoom)).cast("long")
    return F.greatest(F.lit(0), F.least(x, F.lit((1 << zoom) - 1))).cast("long") if clamp else x


def tile_y(lat: Column, zoom: int = 14, clamp: bool = False) -> Column:
    r = F.radians(lat)
    y = F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * (1 << zoom)).cast("long")
    return F.greatest(F.lit(0), F.least(y, F.lit((1 << zoom) - 1))).cast("long") if clamp else y


def tile_id(x: Column, y: Column, zoom: int = 14) -> Column:
    return y * F.lit(1 << zoom) + x


def tile_of(lon: Column, lat: Column, zoom: int = 14, clamp: bool = False) -> Column:
    return tile_id(tile_x(lon, zoom, clamp), tile_y(lat, zoom, clamp), zoom)


def x_of(tile: Column, zoom: int = 14) -> Column:
    return (tile % F.lit(1 << zoom)).cast("long")


def y_of(tile: Column, zoom: int = 14) -> Column:
    return F.floor(tile / F.lit(float(1 << zoom))).cast("long")


def encode_key(kind: Column, id_: Column) -> Column:
    """One sortable bigint: node < way < relation, then id."""
    return id_ + kind.cast("long") * F.lit(1 << 61)


def tile_bucket(tile: Column, zoom: int = 14, coarse: int = 6) -> Column:
    """The coarse tile (coarse zoom levels up) that holds a tile: the partition column of a tile log."""
    return (F.shiftright(y_of(tile, zoom), coarse) * F.lit(1 << max(0, zoom - coarse)) + F.shiftright(x_of(tile, zoom), coarse)).cast("int")


def bucket_of(tile: int, zoom: int = 14, coarse: int = 6) -> int:
    x, y = tile % (1 << zoom), tile >> zoom
    return (y >> coarse) * (1 << max(0, zoom - coarse)) + (x >> coarse)


def tiles_for_bbox(spark: SparkSession, west: float, south: float, east: float, north: float, zoom: int = 14) -> DataFrame:
    """tile, x, y of every tile that the box touches."""
    box = spark.range(1).select(tile_x(F.lit(west), zoom, True).alias("x0"), tile_x(F.lit(east), zoom, True).alias("x1"), tile_y(F.lit(north), zoom, True).alias("y0"), tile_y(F.lit(south), zoom, True).alias("y1"))
    cells = box.select("y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x")).select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return cells.select(tile_id(F.col("x"), F.col("y"), zoom).alias("tile"), "x", "y")
