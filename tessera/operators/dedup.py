"""First copy wins: exact deduplication under a total order, and its variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_folder


def first_copies(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes first; order must be total, so that partitioning cannot matter."""
    rank = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def first_per_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group. Spark limits each task's groups before the shuffle."""
    rank = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def most_frequent(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent non-empty value of each group; among equals the first by sort order."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def either_side_first(rows: DataFrame, left: str, right: str, order: str, max_rounds: int = 1_000_000) -> DataFrame:
    """Greedy pass in order: a row stays if neither side was seen on a row that stayed. Rows of equal order stand in that of
    their sides; of rows with equal sides only the first can stay.

    The pass is settled in rounds instead of one by one. A round finds the first two open rows of each side; each task sends
    two of a side at most, however many it has. A row that is first on both sides stays. A row that is first on one side and
    second on the other stays if and only if the first of that side goes: such rows hang in chains, which are followed by
    doubling, so a chain of any length that ends in a row that stays is decided in one round. Open rows that share a side with
    one that stays go. Tables between rounds are written to the shared folder, those of a round are freed after the next.
    """
    spark = rows.sparkSession
    root = shared_folder(spark, "either")

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    def free(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    own = F.struct(order, left, right, "_row")
    open_ = saved(first_copies(rows, [left, right], [order]).withColumn("_row", F.monotonically_increasing_id()), "open-start")
    kept = None
    for turn in range(max_rounds):
        before = f"open-{turn - 1}" if turn else "open-start"
        marked = open_.withColumn("_own", own)
        for side in (left, right):
            two = first_per_group(open_.select(side, own.alias("_o")), [side], ["_o"], 2).groupBy(side).agg(F.array_sort(F.collect_list("_o")).alias(f"_{side}"))
            marked = marked.join(two, side)
        at = lambda side, k: F.get(f"_{side}", F.lit(k))
        first, second = ({side: at(side, k) == F.col("_own") for side in (left, right)} for k in (0, 1))
        parent = F.when(first[left] & second[right], at(right, 0)["_row"]).when(first[right] & second[left], at(left, 0)["_row"])
        marked = saved(marked.select(*rows.columns, "_row", (first[left] & first[right]).alias("_stays"), parent.alias("_parent")), f"round-{turn}")
        settled = marked.where("_stays").select("_row")
        chains = marked.where("_parent IS NOT NULL").select("_row", F.col("_parent").alias("_to"), F.lit(1).alias("_odd"))
        step = 0
        while True:
            chains = saved(chains, f"chains-{turn}-{step}")
            further = chains.select(F.col("_row").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_more"))
            if chains.join(further, "_to", "left_semi").isEmpty():
                break
            chains = chains.join(further, "_to", "left").select("_row", F.coalesce("_next", "_to").alias("_to"), ((F.col("_odd") + F.coalesce("_more", F.lit(0))) % 2).alias("_odd"))
            step += 1
        hung = chains.where("_odd = 0").join(settled.withColumnRenamed("_row", "_to"), "_to", "left_semi").select("_row")
        stay = saved(marked.join(settled.unionByName(hung), "_row", "left_semi").select(*rows.columns, "_row"), f"kept-{turn}")
        kept = stay.select(*rows.columns) if kept is None else kept.unionByName(stay.select(*rows.columns))
        left_over = marked.select(*rows.columns, "_row")
        for side in (left, right):
            left_over = left_over.join(stay.select(side).distinct(), side, "left_anti")
        open_ = saved(left_over.select(*rows.columns, "_row"), f"open-{turn}")
        for old in (f"round-{turn}", before, *(f"chains-{turn}-{k}" for k in range(step + 1))):
            free(old)
        if open_.isEmpty():
            return kept
    raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
