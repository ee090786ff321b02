"""From documents to token ids, in five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadstrata.llm import byte_bpe, exact_dedup, mixing, near_copies, toxicity
from quadstrata.llm.common import documents, materialise
from quadstrata.llm.queries import labels, split_pattern, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model rejects; trained on the labelled rows among docs."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_one(docs, width=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as its source's target asks for."""
    return mixing.whole_documents(docs, labels=labels(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix holds, with the round trip's digest."""
    return byte_bpe.byte_bpe(docs, tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern(), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mix", mix), ("byte_bpe", encode)]

#: SQL can't train the model of the first stage, nor run the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
