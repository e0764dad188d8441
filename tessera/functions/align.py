"""Edit distances and alignments of texts of any length: a column of Levenshtein's table is two integers, a bit for each row.

A step from one column to the next is a handful of operations on these integers, so 100,000 by 100,000 symbols take seconds
and a few kB. Alignments need the way back, too: columns are kept at every square root of the length, and those between are
made again, a stretch at a time, from the end to the beginning.

That takes the square of the length, so texts are parted where this is sure to change nothing (see parted).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import batches

#: Pairs of gaps that a task remembers, and their longest.
REMEMBERED, PIECE = 1 << 16, 64


def masks(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """The rows at which each symbol stands, as bits."""
    places: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    size = (len(a) + 7) // 8
    found = {}
    for x, at in places.items():
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        found[x] = int.from_bytes(bits, "little")
    return found


def columns(rows: dict[Hashable, int], n: int, up: int, down: int, b: Sequence[Hashable]) -> Iterator[tuple[int, int, int, int]]:
    """For each symbol of b the rows at which the table grows and falls from the row above (up, down), and from the column before
    (right, left). The first row grows by one each column."""
    every = (1 << n) - 1
    for y in b:
        equal = rows.get(y, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        left = diagonal & up
        right = down | (every & ~(diagonal | up))
        shifted = (right << 1) | 1
        down = shifted & diagonal & every
        up = ((left << 1) | ~(shifted | diagonal)) & every
        yield up, down, right, left


def parted(a: str, b: str) -> tuple[Counter, list[str], list[str], str, int] | None:
    """What stands between the symbols that both texts have as often, if every least alignment matches these, each with its like:
    the pairs of these gaps, counted, the gaps of either text, the symbols between them, and the edits.

    Of a symbol that a has more often than b, so many must go: the sum of these surpluses, on either side, is the least number of
    edits there can be. Where the gaps take no more than that, a least alignment edits surplus symbols only, so all others are
    matched in their order. Otherwise nothing is known, and there is no result."""
    own, other = Counter(a), Counter(b)
    least = max((own - other).total(), (other - own).total())
    uneven = "".join(map(re.escape, sorted(c for c in own.keys() | other.keys() if own[c] != other[c])))
    even = re.sub(f"[{uneven}]+", "", a) if uneven else a
    if not even or even != (re.sub(f"[{uneven}]+", "", b) if uneven else b):
        return None
    gaps = [re.split(f"[^{uneven}]", x, flags=re.DOTALL) if uneven else [""] * (len(x) + 1) for x in (a, b)]
    pairs = Counter(zip(*gaps, strict=True))
    edits = 0
    for (x, y), k in pairs.items():
        if x != y and (edits := edits + k * (remembered(x, y) if len(x) <= PIECE else whole_distance(x, y))) > least:
            return None
    return pairs, *gaps, even, edits


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and substitutions that make b of a."""
    if isinstance(a, str) and isinstance(b, str) and (found := parted(a, b)) is not None:
        return found[-1]
    return whole_distance(a, b)


@lru_cache(REMEMBERED)
def remembered(a: str, b: str) -> int:
    return whole_distance(a, b)


def whole_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    n = len(a)
    if not n or not len(b):
        return max(n, len(b))
    total, last = n, 1 << (n - 1)
    for _, _, right, left in columns(masks(a), n, (1 << n) - 1, 0, b):
        total += bool(right & last) - bool(left & last)
    return total


def alignment(a: str, b: str) -> list[tuple[str, str]]:
    """Aligned characters, an empty one on the side of a gap; substitutions are taken before gaps, gaps of b before those of a."""
    if (found := parted(a, b)) is None:
        return whole_alignment(a, b)
    _, own, other, even, _ = found
    out = whole_alignment(own[0], other[0])
    for c, x, y in zip(even, own[1:], other[1:], strict=True):
        out.append((c, c))
        if x or y:
            out += whole_alignment(x, y)
    return out


def tally(a: str, b: str) -> list[tuple[str, str, int]]:
    """The different pairs of aligned characters, and how often each occurs."""
    if (cut := parted(a, b)) is None:
        found = Counter(whole_alignment(a, b))
    else:
        found = Counter({(c, c): n for c, n in Counter(cut[3]).items()})
        for (x, y), k in cut[0].items():
            for pair, n in gap_tally(x, y) if len(x) <= PIECE else Counter(whole_alignment(x, y)).items():
                found[pair] += k * n
    return [(*pair, n) for pair, n in found.items()]


@lru_cache(REMEMBERED)
def gap_tally(a: str, b: str) -> list[tuple[tuple[str, str], int]]:
    return list(Counter(whole_alignment(a, b)).items())


def whole_alignment(a: str, b: str) -> list[tuple[str, str]]:
    n, rows = len(a), masks(a)
    every, step = (1 << n) - 1, isqrt(len(b)) + 1
    kept = [(every, 0)]
    for j, (up, down, _, _) in enumerate(columns(rows, n, every, 0, b), start=1):
        if j % step == 0:
            kept.append((up, down))
    out: list[tuple[str, str]] = []
    i, j = n, len(b)
    while j:
        # the stretch of columns that ends at j
        first = (j - 1) // step * step
        stretch = list(columns(rows, n, *kept[first // step], b[first:j]))
        while j > first:
            up, down, right, left = stretch[j - first - 1]
            if i:
                grows = (up >> (i - 1) & 1) - (down >> (i - 1) & 1)
                along = (right >> (i - 2) & 1) - (left >> (i - 2) & 1) if i > 1 else 1
                if grows + along == (a[i - 1] != b[j - 1]):
                    i, j = i - 1, j - 1
                    out.append((a[i], b[j]))
                    continue
                if grows == 1:
                    i -= 1
                    out.append((a[i], ""))
                    continue
            j -= 1
            out.append(("", b[j]))
    out += [(x, "") for x in reversed(a[:i])]
    return out[::-1]


def edits(a: Column, b: Column) -> Column:
    """Edits between the characters of two texts of any length."""
    each = lambda x, y: pa.array([distance(p, q) for p, q in zip(x, y, strict=True)], pa.int64())
    return batches.column(each, "long")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def word_distance(a: Column, b: Column) -> Column:
    """Edits between white-space tokens."""
    each = lambda x, y: pa.array([distance(p.split(), q.split()) for p, q in zip(x, y, strict=True)], pa.int64())
    return batches.column(each, "long")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


PAIR = {"ref": pa.string(), "hyp": pa.string()}


def aligned(a: Column, b: Column) -> Column:
    each = lambda x, y: batches.lists([alignment(p, q) for p, q in zip(x, y, strict=True)], PAIR)
    return batches.column(each, "array<struct<ref:string,hyp:string>>")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def tallied(a: Column, b: Column) -> Column:
    """The aligned characters of two texts, counted: what is left of them where their order is not needed."""
    each = lambda x, y: batches.lists([tally(p, q) for p, q in zip(x, y, strict=True)], PAIR | {"n": pa.int64()})
    return batches.column(each, "array<struct<ref:string,hyp:string,n:bigint>>")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
