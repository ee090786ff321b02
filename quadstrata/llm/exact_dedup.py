"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition becomes one run: its distinct digests, each with the best
row seen.  Runs are merged ``fan_in`` at a time; in round r the runs whose number
agrees after division by fan_in^(r+1) meet: a binomial tree for fan_in 2, three of its
rounds in one multiway merge for 8, the default; cut into digest shards so that no task ever holds a whole run.  A merge sorts by
digest and keeps the best row of equal digests.  Two digests count as equal only
if the normalised length and an independent 64-bit hash agree as well, at every
level.  A hot digest is one row per run before anything is shuffled.

Null texts are empty texts; empty texts equal each other.  Null ids lose to any
id.  Of fully equal rows (repeated rows) exactly one stays.  Texts of any length are
hashed whole.  An empty table gives no row.  Only the id and the text column are read;
decisions go back to whole rows by number, and the job stops if a number has come to
mean another id, so columns of any name can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, materialise, text_or_empty, without

KEY = ["sha", "nlen", "proof"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, run, id, sha, nlen, proof and the rank (smallest is best) of each row."""
    norm = F.translate(text_or_empty(text_col), WS, "")
    return (
        docs.select(F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("run"), F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).alias("n"), norm.alias("norm"))
        .select("rid", "run", "id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), F.length("norm").alias("nlen"), F.xxhash64("norm").alias("proof"), (-F.col("n")).alias("neg"))
    )


def merge_tree(runs: DataFrame, n_runs: int, fan_in: int = 8, shards: int | None = None) -> DataFrame:
    """Distinct digests with their best row and number of copies, after all rounds."""
    shards = shards or max(16, n_runs // 16)  # digests are far smaller than texts; the last round too has tasks in proportion
    level = runs.withColumn("shard", F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long") % shards)
    level = level.groupBy("run", "shard", *KEY).agg(F.min(F.struct("neg", F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best"), F.count("*").alias("copies"))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = level.repartition(max(2, min(n_runs * shards, max(4096, shards))), "run", "shard").sortWithinPartitions("run", "shard", *KEY)
        level = level.groupBy("run", "shard", *KEY).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, shards: int | None = None) -> DataFrame:
    """One row per input row: rid, id, keep_id, group_size, kept, text_sha256."""
    runs = materialise(digests(docs, id_col, text_col), "exact")
    merged = merge_tree(runs, (runs.agg(F.max("run")).first()[0] or 0) + 1, fan_in, shards)
    best = merged.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("copies").alias("group_size"))
    return runs.join(best, KEY).select("rid", F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; docs must be a plan that repeats, such as a table scan."""
    return without(docs, exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select("rid", id_col), id_col)
