"""Benchmark leaks by exact key and by n-gram, and the exclusions built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ngram_hashes, ngrams, tokens
from tessera.session import written

#: Rows up to which the benchmark side is sent to every task.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the side's counted rows allow it; else the join shuffles both sides. Counting runs the side, so one
    that reads a corpus is written first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_matches(corpus: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Corpus rows joined to the benchmark items of the same key."""
    return corpus.join(bounded(benchmark), key)


def ngram_matches(corpus: DataFrame, benchmark: DataFrame, row: str, item: str, text: str = "text", size: int = 8) -> DataFrame:
    """(row, item, shared) for each corpus row and item that share n-grams; texts shorter than size match nothing.

    The corpus' n-grams are compared by a hash of their tokens, so none is spelled out; the few places that meet are read
    again and confirmed on the n-grams themselves."""
    grams = benchmark.select(F.col(item), F.explode(ngrams(F.col(text), size)).alias("gram")).withColumn("_h", F.xxhash64(F.split("gram", " ")))
    own = corpus.select(F.col(row), F.posexplode(ngram_hashes(F.col(text), size)).alias("_at", "_h"))
    met = own.join(bounded(grams.select("_h").distinct()), "_h").groupBy(row).agg(F.collect_set("_at").alias("_places"))
    met = written(met, "places")
    again = corpus.select(row, text).join(bounded(met), row)
    spelled = F.array_distinct(F.transform("_places", lambda i: F.array_join(F.slice(tokens(F.lower(F.col(text))), i + 1, size), " ")))
    found = again.select(row, F.explode(spelled).alias("gram"))
    return found.join(bounded(grams.drop("_h")), "gram").groupBy(row, item).agg(F.count("*").alias("shared"))


def scan(corpus: DataFrame, benchmark: DataFrame, row: str, item: str, size: int = 8) -> DataFrame:
    """One row for each leaked item: item, kind (exact or ngram), and the least corpus row that holds it.

    Both sides have `key`, an array of exact keys in the benchmark and one key in the corpus, and `text`. A corpus row with an
    exact match counts as that only; n-grams are sought in the others. The order of rows decides, not that of reading."""
    keys = bounded(benchmark.select(F.col(item), F.explode("key").alias("key")).distinct())
    exact = corpus.select(row, "key").join(keys, "key").select(row, item, F.lit("exact").alias("kind"))
    exact = written(exact, "exact")
    others = corpus.join(bounded(exact.select(row).distinct()), row, "left_anti")
    near = ngram_matches(others, benchmark, row, item, size=size).select(row, item, F.lit("ngram").alias("kind"))
    return exact.unionByName(near).groupBy(item).agg(F.min(F.struct(row, "kind")).alias("m")).select(item, "m.kind", f"m.{row}")


def without(rows: DataFrame, blocked: DataFrame, keys: list[str], blocked_key: str) -> DataFrame:
    """Rows none of whose keys is blocked: one anti join for each side."""
    sealed = bounded(blocked.select(F.col(blocked_key).alias("_blocked")).distinct())
    for key in keys:
        rows = rows.join(sealed, F.col(key) == F.col("_blocked"), "left_anti")
    return rows


def whole_groups_without(rows: DataFrame, blocked: DataFrame, group: str, key: str, blocked_key: str) -> DataFrame:
    """Rows of the groups that have no blocked member."""
    bad = rows.join(bounded(blocked.select(F.col(blocked_key).alias(key)).distinct()), key, "left_semi").select(group).distinct()
    return rows.join(bad, group, "left_anti")
