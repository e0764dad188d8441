"""The training-data pipeline: five stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, opened, release, small
from tessera.llm.decontam import clean
from tessera.llm.langid import UNDETERMINED, identify, train
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.pii import with_pii

#: Posterior below which a document's language counts as not identified.
LEAST_SCORE = 0.5
#: Mean log-probability of an n-gram, less that of the language's training texts, below which no language fits: below
#: the least of a labelled document on check_s (-4.9, of 82 characters).
LEAST_FIT = -6.0
#: Words of a shingle and the similarity, in percent, from which two documents are near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that carry a language and gives the others the one predicted; documents that no language
    fits, or without letters, go.

    The posterior compares the learned languages with each other only and is near 1 for all but the shortest texts, so a
    document must also fit its language by itself, whatever its length. Other scripts and letter junk fall far below; a
    language that is spelled much like a learned one (Finnish beside Spanish: -3) does not and stays. Where no document
    carries a language, nothing can be learned and all go. Columns of any name stay."""
    lang, score, fit = (fresh(docs, c) for c in ("_lang", "_score", "_fit"))
    found = identify(docs, train(docs), label=lang, score=score, fit=fit)
    fits = (F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE) & (F.col(fit) >= LEAST_FIT)
    return found.where(fits).withColumn("lang", F.coalesce("lang", lang)).drop(lang, score, fit)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays, and every document without a doc_id. Of rows that repeat a
    doc_id one stays. Columns of any name stay."""
    groups = Scratch(spark, "dedup").save(near_duplicates(docs, SHINGLE_WORDS, SIMILARITY), "groups")
    kept = groups.where("kept").select("doc_id").distinct()
    n = kept.count()
    stay = docs.join(small(kept, n), "doc_id", "left_semi").select(docs.columns)
    if groups.where("kept").count() > n:
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited ones too, go. Columns of any name stay."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows. Columns of any name
    stay."""
    pii = fresh(docs, "_pii")
    masked = with_pii(docs, target=pii).withColumn("text", F.col(f"{pii}.masked")).drop(pii)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, with all its columns, gets its length bucket, batch and slot. A column with the name of
    one of these gives way to it."""
    return pack(docs, keep=docs.columns)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", mask_pii),
    ("packing", packing),
]

#: A learned model, MinHash search, alignment and a random field have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What a stage wrote on its way is freed once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = opened()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            release(before)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
