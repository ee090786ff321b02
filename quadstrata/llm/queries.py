"""The queries of the ten operators and of the pipeline, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, iblt, lm, mixing, pii, secrets, simhash, token_files, toxicity
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("rid")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.toxicity(docs, toxicity.fit(docs, labels(spark, sf_dir)))
    return found.withColumn("offending", F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).withColumn("scores", F.array_join(F.transform("scores", lambda s: F.format_number(s, 2)), ","))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_secrets, op4_mix, op5_fingerprints, op6_pii, op7_lm, op8_token_files, op9_simhash, op10_byte_bpe)}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(coalesce(text, '')) AS n,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents
), cells AS (
  SELECT *, CAST(least(floor(n / greatest(size, 1)), 15) * 16 + least(floor(log2(size + 1)), 15) AS INTEGER) AS cell FROM d
), marked AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), learned AS (
  SELECT cell, 0.5::DOUBLE + 0.5::DOUBLE * (CAST(sum(quality) AS BIGINT) + 1) / (count(*) + 2) AS quality FROM cells JOIN marked USING (doc_id) GROUP BY cell
), k AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(quality, 0.75::DOUBLE) AS key FROM cells LEFT JOIN learned USING (cell)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w, 2.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, cap / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(w) OVER () AS w_all FROM r
), g AS (
  SELECT *, w_all - coalesce(sum(w) OVER b, 0) AS w_left, total - coalesce(sum(cap) OVER b, 0) AS rest FROM f
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, rest * w >= cap * w_left AS capped FROM g
), h AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_sum, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE (total - cap_sum) * w / w_free END AS target FROM h
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), m AS (
  SELECT *, CAST(floor(target - epochs * source_size) AS BIGINT) AS left_over FROM e
)
SELECT k.doc_id, k.size, m.source_size, m.target,
       CAST(m.epochs * k.size + greatest(0, least(k.size, m.left_over - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_mix": OP4_SQL}
