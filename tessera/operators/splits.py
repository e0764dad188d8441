"""Splits, draws and orders by a hash of the key: the same for any partitioning, and independent of a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(key: Column, seed: str) -> Column:
    """A hexadecimal digest that orders keys pseudo-randomly, in the same way in any engine."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows, uniformly: the first by draw order. A top-k, so each task keeps n rows."""
    return rows.orderBy(draw_order(F.col(key), seed), key).limit(n)


def balanced(rows: DataFrame, label: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each label; fails if a label has fewer."""
    rank = Window.partitionBy(label).orderBy(draw_order(F.col(key), seed), key)
    # each task keeps n rows of a label before the shuffle
    first = rows.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n)
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    checked = first.join(sizes, label).withColumn("_ok", F.assert_true(F.col("_size") >= n, F.concat(F.lit("too few rows of "), F.col(label).cast("string"))))
    return checked.where(F.col("_ok").isNull()).select(rows.columns)


def by_group(rows: DataFrame, group: str, n_dev: int, seed: str) -> DataFrame:
    """rows with a column split: n_dev whole groups are dev, the others train."""
    dev = rows.select(group).distinct().orderBy(draw_order(F.col(group), seed), group).limit(n_dev).withColumn("_dev", F.lit(True))
    joined = rows.join(dev, group, "left")
    return joined.withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).drop("_dev")


def placed(rows: DataFrame, key: str, seed: str, place: str = "_place") -> DataFrame:
    """rows with their place, from 0, in the draw order of the key. Places come from counts of the 4,096 leading digits of the
    digests, so no task orders all rows."""
    drawn = rows.withColumn("_draw", draw_order(F.col(key), seed)).withColumn("_cell", F.substring("_draw", 1, 3))
    cells = drawn.groupBy("_cell").agg(F.count("*").alias("_n"))
    # 4,096 rows
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", key)) - 1
    return drawn.join(F.broadcast(offsets), "_cell").withColumn(place, F.col("_before") + inside).drop("_draw", "_cell", "_before")


def by_ratio(groups: DataFrame, key: str, seed: str, cuts: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """Distinct keys with a column split: train, validation, test at truncated places of the draw order."""
    drawn = placed(groups.select(key).distinct(), key, seed)
    # one row
    ranked = drawn.join(F.broadcast(drawn.agg(F.count("*").alias("_total"))))
    first, second = (F.floor(F.col("_total") * c) for c in cuts)
    return ranked.withColumn("split", F.when(F.col("_place") < first, "train").when(F.col("_place") < second, "validation").otherwise("test")).select(key, "split")


def disjoint(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """rows unchanged; fails if a key stands in two splits. The keys at fault are found by partial counts, so a frequent key
    costs no task its rows; a sound table has none."""
    spread = rows.groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
    refused = F.raise_error(F.concat(F.lit("in two splits: "), F.col(key).cast("string"))).cast("boolean")
    bad = spread.where(F.when(F.col("_a") != F.col("_b"), refused).otherwise(False)).select(key)
    return rows.join(bad, key, "left_anti").select(rows.columns)
