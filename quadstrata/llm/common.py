"""What the operators share: input, the shared folder, white space, row numbers."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder set on the context, else one in the warehouse; a folder of this machine would not do."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = found.get() if found.isDefined() else None
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quadstrata"
    return place.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back; cuts the lineage and fixes generated row numbers.

    The files go when the application ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        with contextlib.suppress(Exception):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: str, by: str, most: int = 1_000_000) -> DataFrame:
    """left join right on key, right having one row for each key and, in its column rows, how many rows of left have it.

    A key of more than ``most`` rows is split by a hash of the column ``by`` into parts of about that many, and its row of
    right copied to each.  The adaptive planner doesn't split such a key where right is an aggregate right below the join.
    What is broadcast is the keys to split, of which there are at most the rows of left / most.
    """
    parts = F.ceil(F.col(rows) / most).cast("int")
    split = right.filter(F.col(rows) > most).select(key, parts.alias("_parts"))
    l = left.join(F.broadcast(split), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    r = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return l.join(r, [key, "_part"]).drop("_part")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def numbered(docs: DataFrame) -> DataFrame:
    """doc (the whole row) and rid, so that no column of docs can clash with those joined to it.

    rid repeats whenever docs repeats its partitions and their order, as table scans do.
    """
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))


def checked(id_now: Column, id_then: Column) -> Column:
    """True; stops the job where a row number has come to mean another id, because docs didn't repeat its rows."""
    return F.when(id_now.eqNullSafe(id_then), True).otherwise(F.raise_error(F.lit("rows have changed their numbers between two reads of docs: materialise docs first")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows of which dropped has the rid; dropped has their ids too, which must agree."""
    gone = dropped.select("rid", F.col(id_col).alias("id_then"), F.lit(True).alias("gone"))
    kept = numbered(docs).join(gone, "rid", "left").filter(F.when(F.col("gone"), ~checked(F.col("doc")[id_col], F.col("id_then"))).otherwise(True))
    return kept.select("doc.*")
