"""Orders that become batches and blocks. Orders are cut into cells, so that no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.leaks import bounded
from tessera.session import written


#: Rows of a cell, on average, and the most cells.
CELL_ROWS, CELLS = 100_000, 4_096


def running(rows: DataFrame, group: str, order: list, amount: Column, name: str, total: str) -> DataFrame:
    """rows with the sum of amount up to each row of its group, in order, and the group's total. Spark's ranges of group and
    order, of some CELL_ROWS rows each, are the cells, whose sums give each its offset; rows of equal order share one."""
    held = written(rows.withColumn("_amount", amount), "order")
    n = min(CELLS, held.count() // CELL_ROWS + 1)
    # ranges are drawn anew by each run, so what they cut is written
    dealt = written(held.repartitionByRange(n, group, *order).withColumn("_cell", F.spark_partition_id()), "cells") if n > 1 else held.withColumn("_cell", F.lit(0))
    sums = dealt.groupBy(group, "_cell").agg(F.sum("_amount").alias("_sum"))
    along = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_cell", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(group)).alias(total))
    inside = Window.partitionBy(group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn(name, F.sum("_amount").over(inside)).join(bounded(offsets), [group, "_cell"])
    return ranked.withColumn(name, F.col("_before") + F.col(name)).drop("_cell", "_amount", "_before")


def blocks(docs: DataFrame, shard: str, order: str, tokens: str, size: int) -> DataFrame:
    """Documents of each shard are strung together with one separator each and cut into blocks of `size`: for every document the
    first and last block that it reaches, and whether it ends in the dropped tail of its shard."""
    ends = running(docs, shard, [order], F.col(tokens) + 1, "end", "total")
    start = F.col("end") - F.col(tokens) - 1
    whole = F.floor(F.col("total") / size)
    return ends.select(shard, order, F.floor(start / size).alias("first_block"), F.floor((F.col("end") - 1) / size).alias("last_block"), (F.col("end") > whole * size).alias("in_tail"))


def full_batches(sizes: dict[int, int], batch: int) -> int:
    """The most batches of that many rows of different clusters, from {cluster size: clusters}: the greatest n for which the
    clusters, none with more than n of its rows, can fill n batches."""
    low, high = 0, sum(c * k for c, k in sizes.items()) // batch
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if sum(min(c, n) * k for c, k in sizes.items()) >= n * batch else (low, n - 1)
    return low


def distinct_cluster_batches(rows: DataFrame, cluster: str, key: str, size: int, full: bool = True, seed: str = "batch") -> DataFrame:
    """rows with batch and slot, no batch with a cluster twice. Clusters and rows stand in an order of digests of the seed.

    Rows are numbered cluster after cluster and dealt in turn to n batches: a cluster of at most n rows then meets none
    twice. With full, n is the number of batches that can be filled, and what they leave over is left out; without, all rows
    are dealt to the fewest batches that hold them. Only the counts of clusters by size come to the driver, and neither a
    cluster nor a batch is in one task."""
    counts = rows.groupBy(cluster).agg(F.count("*").alias("_c"))
    sizes = {r["_c"]: r["k"] for r in counts.groupBy("_c").agg(F.count("*").alias("k")).collect()}
    n = full_batches(sizes, size) if full else max(max(sizes, default=0), -(-sum(c * k for c, k in sizes.items()) // size))
    drawn = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))
    taken = counts.withColumns({"_taken": F.least("_c", F.lit(n)), "_one": F.lit(0), "_d": drawn(cluster)})
    begins = running(taken, "_one", ["_d", cluster], F.col("_taken"), "_end", "_total").select(cluster, (F.col("_end") - F.col("_taken")).alias("_begins"))
    placed = running(rows.withColumn("_d", drawn(key)), cluster, ["_d", key], F.lit(1), "_k", "_n").where(F.col("_k") <= n)
    at = F.col("_begins") + F.col("_k") - 1
    dealt = placed.join(bounded(begins), cluster).withColumns({"batch": (at % n).cast("long"), "slot": F.floor(at / n).cast("long")})
    return dealt.where(F.col("slot") < size).drop("_d", "_k", "_n", "_begins")


def length_batches(rows: DataFrame, group: str, length: str, key: str, size: int) -> DataFrame:
    """In each group, longest first in batches of `size`; the key restores the order."""
    placed = running(rows, group, [F.desc(length), key], F.lit(1), "_place", "_total")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place", "_total")
