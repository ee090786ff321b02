"""States of a layered log: latest row of each key wins, a null version is a tombstone.

A log is (layer_id, type, id, tile, version).  Spark keeps only the first row of each
window partition before the shuffle (window group limit), so a long log costs one row
per key and task in the exchange; filters on type, id and tile go below the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str | Column = "layer_id") -> DataFrame:
    """The row of each key with the greatest order; tombstones included."""
    by = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(by.desc())
    return log.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def current_tiles(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Objects by tile as of a layer."""
    seen = log if upto is None else log.filter(F.col("layer_id") <= upto)
    return latest(seen, ["type", "id", "tile"]).filter(F.col("version").isNotNull())


def get_by_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A log by key (layer_id, type, id, deleted, ...) -> the latest row of each key asked for, unless deleted."""
    return latest(log.join(keys.select("type", "id"), ["type", "id"], "left_semi"), ["type", "id"]).filter(~F.col("deleted"))


def compact(log: DataFrame) -> DataFrame:
    """One layer in place of several: the last row of each type, id and tile; tombstones stay."""
    return latest(log, ["type", "id", "tile"])


def owner_layers(log: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """tile, owner: the newest layer that has the tile, its empty marks (tile, layer_id) included."""
    seen = log.select("tile", "layer_id")
    return (seen if empty is None else seen.union(empty.select("tile", "layer_id"))).groupBy("tile").agg(F.max("layer_id").alias("owner"))


def merge_recent_wins(base: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer overlay of two tables of the same columns."""
    rest = [c for c in base.columns if c not in keys]
    r = recent.select(*keys, F.lit(True).alias("_recent"), *[F.col(c).alias(f"_{c}") for c in rest])
    return base.join(r, keys, "full_outer").select(*keys, *[F.when(F.col("_recent"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def vacated(before: DataFrame, after: DataFrame) -> DataFrame:
    """type, id, tile that objects left."""
    return before.select("type", "id", "tile").subtract(after.select("type", "id", "tile"))
