"""How filters interact: what each would remove at each place of each order they can be applied in.

A document is the mask of the filters it fails, so documents of one part, mask and label are one weighted cell. Each cell
is folded over the array of all orders, a constant of the plan that every task holds: per order, an aggregate walks the
filters and keeps whether one has removed the cell yet. A cell of five filters gives 600 structs (120 orders of 5 steps);
those of a part are added up place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

#: The filters, by the bit that a document failing it has in its mask.
FILTERS = "ABCDE"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_mask(text: Column) -> Column:
    """The bits of the filters that look at a text alone.

    A: under 200 words; B: under half of the words distinct; C: more than 2 in 100 code points are capitals A to Z; D: holds
    one of # $ % & * |. Words are what stands between blanks and control characters 9 to 13."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # a lambda's argument is computed once, however often it is used
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))[0]
    of = lambda s: (
        F.when(s["n"] < 200, 1).otherwise(0)
        + F.when(100 * s["own"].cast("long") < 50 * s["n"].cast("long"), 2).otherwise(0)
    )
    few = F.transform(F.array(sizes), of)[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return few + F.when(100 * capitals > 2 * F.char_length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents counted by source, failed filters and labels.

    Filter E is failed by a document whose text a smaller doc_id has, too. Rows are not joined with their copies: the rows of
    one text are counted by what else a cell asks for, with the least doc_id and how many rows have it; only those of the
    least doc_id of the whole text, and those without one, pass E. So a text with any number of copies is combined before it
    is shuffled."""
    text = text_or_empty()
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    read = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        own_mask(text).cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    marked = read.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    cell = ["digest", "part", "mask", "good", "toxic"]
    rows = marked.groupBy("doc_id", *cell).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = rows.groupBy(*cell).agg(F.min(named).alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("least.doc_id") == F.col("_least"), F.col("least.n")).otherwise(0) + F.col("unnamed")
    counted = texts.withColumn("_least", least).withColumn("_first", first)
    two = counted.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("_first").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("_first")).alias("n")),
    )))
    return two.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def folded(mask: Column, good: Column, toxic: Column, n: Column) -> Column:
    """The weighted structs of a cell, order by order and step by step."""
    constant = F.array(*[F.array(*[F.lit(1 << FILTERS.index(c)) for c in order]) for order in orders()])
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, alive = mask.bitwiseAND(bit) != 0, state["alive"]
        removed = F.when(alive & fails, n).otherwise(none)
        counts = F.struct(
            F.when(alive & ~fails, n).otherwise(none).alias("kept"),
            removed.alias("removed"),
            F.when(~alive & fails, n).otherwise(none).alias("redundant"),
            F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
            F.when(good, removed).otherwise(none).alias("good_lost"),
            F.when(toxic, removed).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    nothing = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), nothing.alias("steps"))
    return F.flatten(F.transform(constant, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley (what the step's filter removes, over all orders and wherever it stands).

    docs has doc_id, text and source, labels has doc_id, quality and toxic; other columns are ignored. A text of null is
    empty and so equal to empty ones, a source of null is the part ''. A document without doc_id has no labels, is no one's
    earlier copy and passes E. Rows that repeat a doc_id count as they are; none of them is an earlier copy of another. If a
    doc_id has several labels, one of 1 is enough. Labels of null are 0. No documents, no rows.
    """
    held = cells(docs, labels)
    each = held.select("part", F.posexplode(folded(F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"))).alias("place", "s"))
    summed = each.groupBy("part", "place").agg(*[F.sum(f"s.{c}").alias(c) for c in _COUNTS])
    names = F.array(*map(F.lit, orders()))
    order = F.get(names, (F.col("place") / len(FILTERS)).cast("int"))
    step = F.pmod("place", F.lit(len(FILTERS))) + 1
    placed = summed.select("part", order.alias("filter_order"), step.cast("int").alias("step"), *_COUNTS)
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return placed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
