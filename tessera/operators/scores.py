"""Confusion counts and the scores that are read from them; error rates; correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from tessera.functions import batches, subword
from tessera.operators.leaks import bounded
from tessera.operators.packing import running
from tessera.session import written


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """support, predicted, hits, precision, recall and f1 of each label of a confusion matrix (gold, pred, n)."""
    truth = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    drawn = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = truth.join(drawn, "label", "full_outer").na.fill(0, ["support", "hits", "predicted"]).where("label IS NOT NULL")
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return both.select("label", "support", "predicted", "hits", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def summary(counts: DataFrame, nameable: list[str] | None = None) -> DataFrame:
    """One row: accuracy, coverage (answers that are not null), accuracy among answers, macro-F1 over nameable labels or those with support."""
    n = F.sum("n")
    hits = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    answered = F.sum(F.when(F.col("pred").isNotNull(), F.col("n")).otherwise(0))
    totals = counts.agg((hits / n).alias("accuracy"), (answered / n).alias("coverage"), (hits / F.nullif(answered, F.lit(0))).alias("answered_accuracy"))
    labels = class_scores(counts)
    labels = labels.where(F.col("label").isin(nameable)) if nameable else labels.where("support > 0")
    # both sides have one row
    return totals.join(labels.agg(F.avg("f1").alias("macro_f1")), how="inner")


def error_rate(edits: Column, size: Column) -> Column:
    """Corpus totals, never a mean of row rates."""
    return F.sum(edits) / F.sum(size)


def average_ranks(rows: DataFrame, within: list[str], *values: str) -> DataFrame:
    """rows with <value>_rank for each of the values, its fractional rank in its group: ties share the mean of their places.

    Rows of one value are counted before anything is ordered, so a group of ties of any size is one row; the values' counts are
    summed up in cells, so no task orders a whole group. Nulls rank first, as one value."""
    out = rows
    for value in values:
        grouped = rows.select(F.struct(*within).alias("_g") if within else F.lit(0).alias("_g"), F.col(value).alias("_v"))
        counts = grouped.groupBy("_g", "_v").agg(F.count("*").alias("_n"))
        ends = running(counts, "_g", [F.asc_nulls_first("_v")], F.col("_n"), "_end", "_total")
        rank = ends.select("_g", "_v", (F.col("_end") - (F.col("_n") - 1) / 2).alias(f"{value}_rank"))
        joined = out.withColumn("_own", F.struct(*within) if within else F.lit(0)).join(bounded(rank), (F.col("_own") == F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")))
        out = joined.drop("_own", "_g", "_v")
    return out


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, 0 for fewer than two rows or no variance."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def counted(ref: pa.ListArray, hyp: pa.ListArray, most: int, cut: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None = None) -> pa.ListArray:
    """For each row of two arrays of units (order, shared, of_ref, of_hyp). Units and n-grams are numbered, rows are counted all at
    once: an n-gram of one order more is the number of the shorter one before its last unit. With cut, what is counted are the
    pieces that it gives of the units."""
    n = len(ref)
    every = pa.concat_arrays([ref.flatten(), hyp.flatten()])
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ref, hyp)]
    if cut:
        codes, pieces = cut(every)
        before = np.concatenate([[0], np.cumsum(pieces)])
        sizes = np.split(np.diff(before[np.concatenate([[0], np.cumsum(np.concatenate(sizes))])]), 2)
    else:
        codes = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.concatenate([np.repeat(np.arange(n), k) for k in sizes])
    ends = np.cumsum(np.concatenate(sizes))
    left = np.repeat(ends, np.concatenate(sizes)) - np.arange(len(codes))
    first = int(sizes[0].sum())
    units, grams = int(codes.max(initial=0)) + 1, np.zeros(len(codes), np.int64)
    table = np.zeros((n, most, 4), np.int64)
    for order in range(1, most + 1):
        at = np.flatnonzero(left >= order)
        distinct, own = np.unique(grams[at] * units + codes[at + order - 1], return_inverse=True)
        grams[at] = own
        keys = rows[at] * max(len(distinct), 1) + own
        (a, na), (b, nb) = (np.unique(keys[side], return_counts=True) for side in (at < first, at >= first))
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = np.bincount(both // max(len(distinct), 1), np.minimum(na[i], nb[j]), n)
        table[:, order - 1] = np.stack([np.full(n, order), shared.astype(np.int64), *(np.maximum(k - order + 1, 0) for k in sizes)], axis=1)
    there = table[:, :, 2:].any(axis=2)
    flat = table[there]
    values = pa.StructArray.from_arrays([pa.array(flat[:, k], t) for k, t in enumerate(CLIPPED.values())], names=list(CLIPPED))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32()), values)


def counting(most: int, vocabulary: Broadcast | None = None) -> Callable[[Iterator], Iterator[pa.Array]]:
    """The batch form of clipped."""

    def made(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cut, limit = (subword.numbering(vocabulary), UNITS // PIECES) if vocabulary else (None, UNITS)
        for r, h in columns:
            sizes = [x + y for x, y in zip(*(pc.fill_null(pc.list_value_length(c), 0).to_pylist() for c in (r, h)), strict=True)]
            for i, j in batches.stretches(sizes, limit):
                yield counted(r[i:j], h[i:j], most, cut)

    return made


def clipped(ref: Column, hyp: Column, most: int, vocabulary: Broadcast | None = None) -> Column:
    """(order, shared, of_ref, of_hyp) of two arrays of units for each order up to most, n-grams that both have clipped. An n-gram
    is counted within its row only, so none leaves the task. With a vocabulary, n-grams are of the units' pieces, which do not
    leave the task either."""
    return F.arrow_udf(counting(most, vocabulary), "array<struct<order:int,shared:bigint,of_ref:bigint,of_hyp:bigint>>", ArrowUDFType.SCALAR_ITER)(ref, hyp)


#: Units of rows that a task counts before it sends them on, and the pieces that a unit may well have.
UNITS, PIECES = 1 << 18, 4
CLIPPED = {"order": pa.int32(), "shared": pa.int64(), "of_ref": pa.int64(), "of_hyp": pa.int64()}


def matched(rows: DataFrame, ref: dict[str, Column], hyp: dict[str, Column], orders: dict[str, int], vocabulary: Broadcast | None = None) -> DataFrame:
    """(kind, order, shared, of_ref, of_hyp) over all rows: the n-grams of each kind of unit, shared ones clipped row by
    row. ref and hyp have a column of units for each kind, orders how far it goes; with a vocabulary, units are its pieces."""
    each = rows.select(*[clipped(ref[k], hyp[k], most, vocabulary).alias(f"_{i}") for i, (k, most) in enumerate(orders.items())])
    kinds = each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{i}").alias("c")) for i, k in enumerate(orders)])).alias("k"))
    return kinds.select("k.kind", F.inline("k.c")).groupBy("kind", "order").agg(*[F.sum(c).alias(c) for c in ("shared", "of_ref", "of_hyp")])


def letters(text: Column) -> Column:
    """Characters, white space apart."""
    return F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")


# Fixed value: the marks that a word is parted from.
MARKS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def parted(text: Column) -> Column:
    """Words, a mark at the end, or else at the start, by itself."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def one(w: Column) -> Column:
        n = F.char_length(w)
        last = F.array(F.substring(w, F.lit(1), n - 1), F.substring(w, n, F.lit(1)))
        first = F.array(F.substring(w, 1, 1), F.substring(w, F.lit(2), n))
        return F.when(n == 1, F.array(w)).when(w.rlike(MARKS + "$"), last).when(w.rlike("^" + MARKS), first).otherwise(F.array(w))

    return F.flatten(F.transform(words, one))


# The steps of the standard tokenisation for BLEU.
BLEU_STEPS = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def bleu_words(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, sound in BLEU_STEPS:
        out = F.regexp_replace(out, pattern, sound)
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def chrf(rows: DataFrame, ref: str, hyp: str, chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """One row: the F-score of character and word n-grams in percent, from corpus totals; precision and recall are
    means over the orders that both sides have."""
    units = lambda c: {"char": letters(F.col(c)), "word": parted(F.col(c))}
    counts = matched(rows, units(ref), units(hyp), {"char": chars, "word": words}).where("of_ref > 0 AND of_hyp > 0")
    p, r = F.avg(F.col("shared") / F.col("of_hyp")), F.avg(F.col("shared") / F.col("of_ref"))
    return counts.agg(F.coalesce(100 * F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0)).alias("chrf"))


def bleu(rows: DataFrame, ref: str, hyp: str, most: int = 4, units: Callable[[str], Column] | None = None, vocabulary: Broadcast | None = None) -> DataFrame:
    """One row: BLEU in percent from corpus totals; an order without a match counts half of one, then a quarter, and so on.
    units makes the array of a column's units: its words if not given. With a vocabulary, their pieces are scored."""
    cut = units or (lambda c: bleu_words(F.col(c)))
    counts = matched(rows, {"w": cut(ref)}, {"w": cut(hyp)}, {"w": most}, vocabulary).where("of_hyp > 0")
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("order", "shared", "of_hyp", "of_ref"))).alias("o"))
    missed = lambda o, x: F.size(F.filter(o, lambda y: (y["order"] <= x["order"]) & (y["shared"] == 0)))
    logs = F.transform("o", lambda x: F.log(F.when(x["shared"] > 0, x["shared"] / x["of_hyp"]).otherwise(1 / (F.pow(F.lit(2.0), missed(F.col("o"), x)) * x["of_hyp"]))))
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size("o")
    n_hyp, n_ref = F.get("o", 0)["of_hyp"], F.get("o", 0)["of_ref"]
    brevity = F.when(n_hyp < n_ref, F.exp(1 - n_ref / n_hyp)).otherwise(1.0)
    # without a longest n-gram there is no score
    return listed.select(F.when(F.size("o") == most, 100 * brevity * F.exp(total)).otherwise(0.0).alias("bleu"))


def dice(a: Column, b: Column) -> Column:
    """Twice what two sets share by their sizes; 0 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def remapped(ids: DataFrame, table: DataFrame, strict: bool, unknown: int = 0) -> DataFrame:
    """ids (with a column id) with new_id from table (id, new_id). An id that the table has not fails the job if strict, else
    it becomes unknown."""
    joined = ids.join(table, "id", "left")
    gone = F.raise_error(F.concat(F.lit("no longer in the vocabulary: "), F.col("id").cast("string"))).cast("long") if strict else F.lit(unknown).cast("long")
    return joined.withColumn("new_id", F.coalesce(F.col("new_id").cast("long"), gone))


def projected(words: Column, pieces: Column, labels: Column, budget: int, ignored: int = -100) -> Column:
    """A label for each piece and for the marks at both ends: a word's on its first piece, `ignored` elsewhere. Words are taken
    whole, as long as they fit the budget with the marks; pieces has the number of each word's pieces."""
    ends = F.transform(pieces, lambda _, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    # the first word that does not fit, or has no piece, ends the row
    bad = F.transform(ends, lambda e, i: F.when((e > budget - 2) | (F.get(pieces, i) == 0), i))
    taken = F.coalesce(F.array_min(F.array_compact(bad)), F.size(words))
    spread = F.transform(F.slice(pieces, F.lit(1), taken), lambda n, i: F.concat(F.array(F.get(labels, i)), F.array_repeat(F.lit(ignored), n - 1)))
    return F.concat(F.array(F.lit(ignored)), F.flatten(spread), F.array(F.lit(ignored)))
