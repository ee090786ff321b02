"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame operations only.

A source's target is its share of ``budget`` times all words, filled like water:
no source exceeds ``max_epochs`` times its words, the rest is shared by weight
among the others.  Whole epochs of a source come first; what is left of its
target is drawn without replacement with keys -ln(u)/quality, u a hash of the id,
smallest first, up to the token budget by prefix sums.  The document at the edge
gives only the words that still fit, so a source's taken words are its target
rounded down.

Quality is learned from ``labels.quality``: the share of good documents among the labelled
ones of about the same length and mean word length (``quality_cells``, at most 256 cells, all
labelled rows counted), as a weight of 0.5 to 1.  Without labels all weights are 0.75.

The prefix sum never sorts a whole source in one task: keys fall into bins, of which there
are more the more documents a source has; bins are summed first, and only the bin where the
budget ends is sorted.

Null texts have no words; null sources are one source, last.  Ties of the key go by id, size,
then row number; a null id hashes as the empty text, repeated ids have one key.  Texts of any
length are counted whole.  An empty table gives no row; without any words nothing is taken.
The columns doc_id, source and text are read, and of those that the mix adds none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, materialise, numbered, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cell_of(n_chars: Column, size: Column) -> Column:
    """0 to 255: mean length of words and, on a log scale, their number, sixteen steps each."""
    mean = F.least(F.floor(n_chars / F.greatest(size, F.lit(1))), F.lit(15))
    many = F.least(F.floor(F.log2(size + F.lit(1))), F.lit(15))
    return (mean * 16 + many).cast("int")


def quality_cells(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """q_cell, quality of the labelled rows of sized (doc_id, cell): 0.5 + 0.5 (good + 1) / (labelled + 2)."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = sized.select("doc_id", "cell").join(marked, "doc_id").groupBy("cell").agg(F.sum(F.col("quality").cast("long")).alias("good"), F.count("*").alias("n"))
    return seen.select(F.col("cell").alias("q_cell"), (F.lit(0.5) + F.lit(0.5) * (F.col("good") + 1) / (F.col("n") + 2)).alias("quality"))


def uniform(id_text: Column, salt: str) -> Column:
    """In (0, 1): 48 bits of an md5."""
    return (F.conv(F.substring(F.md5(F.concat(id_text, F.lit(salt)).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(totals: DataFrame, budget: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size -> and target; one row per source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("all", F.sum("source_size").over(every) * budget).withColumn("w_all", F.sum("w").over(every))
    t = t.withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("left") * F.col("w") >= F.col("cap") * F.col("w_left"))
    t = t.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)).withColumn("w_free", F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(every))
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("all") - F.col("cap_sum")) * F.col("w") / F.when(F.col("w_free") > 0, F.col("w_free"))).alias("target"))


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, bin_rows: int = 50_000, salt: str = ":mix") -> DataFrame:
    """One row per input row: rid, doc_id, source, size, source_size, target, taken.  labels: doc_id, quality; bin_rows: documents in a bin, about."""
    text, id_text = text_or_empty(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.length(text).alias("len"), uniform(id_text, salt).alias("u"))
    sized = materialise(sized.withColumn("cell", cell_of(F.col("len"), F.col("size"))).drop("len"), "mix")
    if labels is None:
        weighed = sized.withColumn("quality", F.lit(0.75))
    else:
        weighed = sized.join(F.broadcast(quality_cells(sized, labels)), F.col("cell") == F.col("q_cell"), "left").drop("q_cell").withColumn("quality", F.coalesce("quality", F.lit(0.75)))
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bins = max(256, -(-most // bin_rows))
    sized = weighed.withColumn("key", -F.log("u") / F.col("quality")).withColumn("bin", F.floor((1.0 - F.exp(-0.75 * F.col("key"))) * bins).cast("int")).drop("u", "cell", "quality")
    by_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    totals = by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    plan = targets(totals, budget, max_epochs, weights)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_bin.select(F.col("source").alias("cell_source"), F.col("bin").alias("cell_bin"), "bin_size", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)).alias("before"))
    cells = cells.join(plan, cells["cell_source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
    joined = sized.join(cells, sized["source"].eqNullSafe(cells["cell_source"]) & (sized["bin"] == cells["cell_bin"])).drop("cell_source", "cell_bin")
    edge = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bin_size"))
    inner = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    whole = joined.filter(~edge).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0))
    cut = joined.filter(edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inner), F.lit(0)))))
    return whole.unionByName(cut).select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def whole_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole texts: each document taken / size times, rounded up, so a source exceeds its target by less than one text; documents without words don't appear."""
    taken = mix_sources(docs, **options).filter("taken > 0").select("rid", F.col("doc_id").alias("id_then"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    rows = numbered(docs).join(taken, "rid").filter(checked(F.col("doc")["doc_id"], F.col("id_then"))).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select("doc.*")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as taken / size says, the one at the budget's edge cut after the words that fit; documents without words don't appear."""
    taken = mix_sources(docs, **options).filter("taken > 0").select("rid", F.col("doc_id").alias("id_then"), "size", "taken")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = numbered(docs).join(taken, "rid").filter(checked(F.col("doc")["doc_id"], F.col("id_then"))).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    head = F.regexp_extract("doc.text", r"^[\x20\x09-\x0D]*", 0)
    cut = F.concat(head, F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), words), ""))
    changed = {"text": cut} | ({"n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[F.when(words < F.col("size"), changed[c]).otherwise(F.col("doc")[c]).alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])
