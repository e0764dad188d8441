"""Packing by optimal length buckets: dynamic programming on the global length histogram, then token-budget batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, gapless
from tessera.llm.token_count import n_tokens_of

BUCKETS = 16
#: Padded tokens that a batch may hold.
BATCH_TOKENS = 65_536


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[int], int]:
    """At most k upper boundaries, among the ascending lengths, of least padding; and that padding.

    cost[j] is the least cost of the first j lengths; one bucket more takes lengths i to j - 1 and stores each of their
    rows with lengths[j - 1] tokens. The best i never falls as j grows, so each bucket's row is filled by halving:
    the middle j's choice bounds those of both halves, in len(lengths) * log(len(lengths)) steps.
    """
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    came = []
    best = None
    for b in range(1, k + 1):
        new, from_ = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            option = cost[i] + (rows[j] - rows[i]) * lengths[j - 1]
            at = int(i[np.argmin(option)])
            new[j], from_[j] = option[at - first], at
            todo += [(low, j - 1, first, at), (j + 1, high, at, last)]
        cost = new
        came.append(from_)
        if best is None or cost[n] < best[0]:
            best = (cost[n], b)
    edges, j = [], n
    for b in range(best[1], 0, -1):
        edges.append(int(lengths[j - 1]))
        j = came[b - 1][j]
    return edges[::-1], int(best[0] - (lengths.astype(np.float64) * counts).sum())


#: The columns that packing adds.
PACKED = ("n_tokens", "bucket", "bucket_tokens", "batch", "slot", "pad_tokens")


def pack(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, tokens: Column | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns keep, then n_tokens, bucket, bucket_tokens, batch, slot, pad_tokens.

    tokens gives a row's length; by default the model tokens of its text. The histogram of all lengths goes to the
    driver: one row for each length that occurs, so its size is bounded by the longest text. There dynamic programming
    finds the boundaries of least padding. A batch of a bucket holds as many rows as fit batch_tokens when padded
    to the bucket's boundary; a row longer than batch_tokens makes a batch alone. batch counts from 0 in
    each bucket and slot from 0 in each batch. Null and empty texts have 0 tokens and share the lowest
    bucket; repeated rows are packed each; an empty table gives an empty result; columns of docs that are not kept are
    ignored, kept ones with the name of an added column give way to it.
    """
    spark = docs.sparkSession
    length = F.coalesce(n_tokens_of(spark, F.col("text")) if tokens is None else tokens, F.lit(0)).cast("long")
    kept = [c for c in keep if c not in PACKED]
    # inside, kept columns have names of their own
    own = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)]
    counted = docs.select(*own, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.monotonically_increasing_id().alias("_row"), length.alias("n_tokens"))
    counted = Scratch(spark, "pack").save(counted, "lengths")
    histogram = counted.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    edges = best_boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)[0] if len(histogram) else [0]
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0))
    upper = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    rows = counted.withColumn("bucket", bucket.cast("int")).withColumn("bucket_tokens", upper)
    rows = gapless(rows, "bucket", F.when(F.col("_id") == "", F.col("_row").cast("string")).otherwise(F.col("_id")), ["_id", "n_tokens", "_row"], int(histogram["n"].sum()), "_place")
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)],
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(F.col("_place") / room).cast("long").alias("batch"),
        (F.col("_place") % room).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("pad_tokens"),
    )
