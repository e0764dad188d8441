"""Subword pieces of a byte-pair vocabulary: a text's units are cut by built-in functions, each is merged by the ranks of its
pairs. A vocabulary is a file of base64 tokens and ranks; its path is a parameter."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units of a text whose white space is single blanks: a blank goes with what follows it.
UNITS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+"
#: Units whose pieces a task remembers.
REMEMBERED = 1 << 16


def ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary as {token: rank} on every task; vocabularies have some 10^5 tokens at most."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", " ").alias("v")).select(F.col("v")[0].alias("token"), F.col("v")[1].cast("int").alias("rank")).collect()
    return spark.sparkContext.broadcast({base64.b64decode(r["token"]): r["rank"] for r in rows})


def units(text: Column) -> Column:
    """A blank stands before the first word, too, so each word has one unit with a blank. Joined, they are the text."""
    squeezed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_extract_all(F.concat(F.lit(" "), squeezed), F.lit(UNITS), 0)


def merged(unit: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """The unit's bytes with adjacent pieces merged, those of the least rank first, the first of equal ones; a heap of pairs, so
    that a unit of any length takes little more than linear time."""
    pieces: list[bytes] = [unit[i : i + 1] for i in range(len(unit))]
    after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap = [(r, i, unit[i : i + 2]) for i in range(len(unit) - 1) if (r := ranks.get(unit[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        # what has been merged since is no longer such a pair
        if not pieces[i] or j == len(unit) or len(both) != len(pieces[i]) + len(pieces[j]):
            continue
        pieces[i], pieces[j], after[i] = both, b"", after[j]
        if after[i] < len(unit):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(unit) and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, pieces[a] + pieces[b]))
    return [p for p in pieces if p]


def pieces(units: Column, vocabulary: Broadcast) -> Column:
    """The pieces of each unit, as hexadecimal bytes. A task remembers those of the units it has met."""

    def batches(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}

        def of(unit: str) -> list[str]:
            if (found := known.get(unit)) is None:
                if len(known) == REMEMBERED:
                    known.clear()
                found = known[unit] = [p.hex() for p in merged(unit.encode(), vocabulary.value)]
            return found

        for column in columns:
            yield pd.Series([None if row is None else [of(u) for u in row] for row in column], dtype=object)

    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(batches, "array<array<string>>", PandasUDFType.SCALAR_ITER)(units)


def numbering(vocabulary: Broadcast) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function of units that gives their pieces as numbers, one unit's after the other's, and how many each has. Equal pieces
    have one number as long as the function lives. It merges distinct units only, and remembers those it has met."""
    numbers: dict[bytes, int] = {}
    known: dict[str, np.ndarray] = {}

    def of(unit: str) -> np.ndarray:
        if (found := known.get(unit)) is None:
            if len(known) == REMEMBERED:
                known.clear()
            found = known[unit] = np.array([numbers.setdefault(p, len(numbers)) for p in merged(unit.encode(), vocabulary.value)], np.int64)
        return found

    def cut(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = units.dictionary_encode()
        own = [of(u) for u in coded.dictionary.to_pylist()]
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([len(x) for x in own], np.int64)
        n = lengths[at]
        # where a unit's pieces begin among those of the distinct units, less where they begin in the result
        shift = (np.cumsum(lengths) - lengths)[at] - (np.cumsum(n) - n)
        return np.concatenate([np.empty(0, np.int64), *own])[np.repeat(shift, n) + np.arange(n.sum())], n

    return cut


def unit_counts(rows: DataFrame, text: str, vocabulary: Broadcast, *groups: str) -> DataFrame:
    """(*groups, unit, n, pieces): each distinct unit is counted by group and encoded once, wherever it occurs."""
    counts = rows.select(*groups, F.explode(units(F.col(text))).alias("unit")).groupBy(*groups, "unit").agg(F.count("*").alias("n"))
    by_unit = counts.groupBy("unit").agg(F.collect_list(F.struct(*groups, "n")).alias("_of"))
    own = by_unit.withColumn("pieces", F.get(pieces(F.array("unit"), vocabulary), 0))
    return own.select("unit", "pieces", F.inline("_of"))


def words_of(unit: Column, n: Column) -> Column:
    return F.sum(F.when(F.startswith(unit, F.lit(" ")), n).otherwise(0))


def parts_of_characters(pieces: Column) -> Column:
    """Pieces that are a single byte of a character beyond ASCII: what a vocabulary falls back to where it has not the letter."""
    return F.size(F.filter(pieces, lambda p: (F.length(p) == 2) & (p >= "80")))
