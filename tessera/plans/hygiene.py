"""Document hygiene: prose gates, first-copy dedup and per-source counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table

MIN_CHARS, MAX_CHARS, MIN_LETTERS, MIN_LATIN = 3, 2000, 0.4, 0.55


def sql_key(text):
    """Letters lower-cased, all else one space: the form of the duplicate key that SQL engines share."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def gate_reason(text):
    """The first prose gate that a text fails, or null."""
    n = F.char_length(text)
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.char_length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(n < MIN_CHARS, "too_short")
        .when(n > MAX_CHARS, "too_long")
        .when(letters / n < MIN_LETTERS, "not_prose")
        .when(latin / letters < MIN_LATIN, "wrong_script")
    )


def doc_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    gated = docs.withColumn("reason", gate_reason(F.col("text"))).withColumn("key", F.md5(sql_key(F.col("text"))))
    first = Window.partitionBy("key", F.col("reason").isNull()).orderBy("source", "doc_id")
    verdict = gated.select("source", "doc_id", "reason", "key").withColumn("rn", F.row_number().over(first))
    verdict = verdict.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("rn") > 1), "duplicate").otherwise(F.coalesce("reason", F.lit("kept"))))
    return verdict.groupBy("source", "reason").agg(F.count("*").alias("n"))


QUERIES = {"f01_doc_hygiene": doc_hygiene}

ORACLES = {
    "f01_doc_hygiene": r"""
WITH g AS (
  SELECT doc_id, source, md5(trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'))) AS key,
    CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty'
      WHEN length(text) < 3 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long'
      WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.4 THEN 'not_prose'
      WHEN length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 0.55 THEN 'wrong_script' END AS reason
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key, reason IS NULL ORDER BY source, doc_id) AS rn FROM g)
SELECT source, CASE WHEN reason IS NULL AND rn > 1 THEN 'duplicate' ELSE coalesce(reason, 'kept') END AS reason, count(*) AS n
FROM r GROUP BY ALL"""
}
