"""Layer lookups over a table of layers (id, base, timespan, kind), for many moments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(moments: DataFrame, layers: DataFrame) -> DataFrame:
    """at -> the first layer at or after it, null past the last: one sort, no range join."""
    both = moments.select("at", F.lit(None).cast("long").alias("id")).distinct().union(layers.select(F.col("id").alias("at"), "id").distinct())
    lo = F.floor(F.col("at") / (1 << 22))  # about 48 days: the first pass works within these, the second bridges them
    # backwards in time, so that the frame only grows: a frame that shrinks is computed anew for each row
    w = Window.partitionBy("_part").orderBy(F.col("at").desc(), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = both.withColumn("_part", lo).withColumn("_own", F.last("id", ignorenulls=True).over(w))
    part = layers.groupBy(F.floor(F.col("id") / (1 << 22)).alias("_p")).agg(F.min("id").alias("_first"))
    parts = marked.select(F.col("_part").alias("_p")).distinct().join(part, "_p", "left").withColumn("_next", F.last("_first", ignorenulls=True).over(Window.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)))  # a row for each 48 days
    found = marked.filter("id is null").join(parts, F.col("_part") == F.col("_p"), "left").select("at", F.coalesce("_own", "_next").alias("layer_id"))
    return found
