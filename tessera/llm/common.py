"""What the operators share: a scratch area that survives executors, gapless slots, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast whole; its columns are longs, so this stays within some 64 MB.
BROADCAST_ROWS = 1_000_000


_OWN: dict[str, str] = {}
#: Scratch areas of this process that are not cleared yet.
_OPEN: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='tessera-')}")


class Scratch:
    """Tables written once to the shared folder, so that lineage ends there and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Frees tables that no later plan reads; without names the whole area."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if not names:
            _OPEN.remove(self)


def release(since: int = 0) -> None:
    """Frees the scratch areas opened since len(_OPEN) was `since`, once their results are written. At exit, all."""
    for area in _OPEN[since:]:
        area.drop()


def opened() -> int:
    return len(_OPEN)


@atexit.register
def _release_all() -> None:
    if _OPEN and _OPEN[-1].spark.sparkContext._jsc is not None:
        release()


#: Rows of a batch that goes to a Python worker. Texts can be long, and a worker holds a few batches at once.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch, so that a worker's memory stays bounded with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows per Arrow batch of the plans that run inside, for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted size allows it; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows that are numbered by one task, on average.
SUB_ROWS = 16_384


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def gapless(df: DataFrame, group: str, row: Column, order: list[str], rows: int, slot: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without gaps and without one task for a whole group.

    A group is dealt by a hash of row into subdivisions, as many as the number of all rows asks for; rows are numbered
    within (group, subdivision), and the running counts of the subdivisions give each its offset.
    """
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(row), F.lit(rows // SUB_ROWS + 1)))
    counts = dealt.groupBy(group, "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_sub").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside))
    # 1,000 groups at most
    joined = ranked.join(small(offsets, 1_000 * (rows // SUB_ROWS + 1)), [group, "_sub"])
    return joined.withColumn(slot, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank", "_sub")
