"""Informal spellings of canonical text, drawn from a seed of the row itself, so that order and partitioning do not matter."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import batches, digests
from tessera.functions.normalise import RULES, on_texts
from tessera.functions.text import let

# Informal spellings with their weights, and the probabilities of each kind of change.
SPELLINGS = {
    "ɣ": [("gh", 0.75), ("g", 0.10), ("3", 0.08), ("8", 0.07)],
    "x": [("kh", 0.85), ("k", 0.10), ("5", 0.05)],
    "c": [("ch", 0.75), ("c", 0.20), ("sh", 0.05)],
    "č": [("tch", 0.70), ("ch", 0.20), ("tc", 0.10)],
    "ğ": [("dj", 0.80), ("j", 0.15), ("g", 0.05)],
    "ḍ": [("dh", 0.75), ("d", 0.25)],
    "ṭ": [("th", 0.70), ("t", 0.30)],
    "ṣ": [("s", 0.75), ("ss", 0.25)],
    "ẓ": [("z", 0.80), ("zz", 0.20)],
    "ṛ": [("r", 0.90), ("rr", 0.10)],
    "ḥ": [("h", 0.70), ("7", 0.25), ("hh", 0.05)],
    "ɛ": [("e", 0.35), ("a", 0.30), ("3", 0.25), ("'", 0.10)],
}
UNCHANGED, OU, SUBSTITUTED, HYPHEN, SHORTENED = 0.15, 0.45, 0.90, 0.50, 0.25
LOOKALIKES = {"ɛ": "ε", "ɣ": "γ", "Ɛ": "Σ", "Ɣ": "Γ"}
LOOKALIKE_TABLE = str.maketrans(LOOKALIKES)
#: Hexadecimal digits of a draw: 52 bits, so a double holds it exactly.
DIGITS = 13
#: The prepositions that are typed as one letter; applied twice, as neighbours share the blank between them.
SHORT_FORMS = ((r"(^|[^\p{L}\p{N}_])deg\s+", "$1g "), (r"(^|[^\p{L}\p{N}_])seg\s+", "$1s "))


def bound(p: float) -> str:
    """The digits that a draw of a probability below p stays under; digits are compared as they stand."""
    return "g" if p >= 1 else f"{math.ceil(p * 16**DIGITS):0{DIGITS}x}"


def below(digest: Column, k: int, p: float) -> Column:
    """Whether the kth draw from [0, 1) that a digest holds, from 0, is below p."""
    return F.substring(digest, 1 + DIGITS * k, DIGITS) < bound(p)


def cumulated(options: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Options with the upper ends of their parts of [0, 1)."""
    ends = [round(sum(w for _, w in options[: k + 1]), 9) for k in range(len(options))]
    return [(to, end) for (to, _), end in zip(options, ends, strict=True)]


#: Characters that are worked through at a time.
BLOCK = 1 << 15
#: The letters that are changed, in both cases; the kind of a letter is its place here, from 1, and 0 is any other character.
CHANGED = [(c, [(to if c.islower() else to.capitalize(), end) for to, end in options]) for low, options in {"u": [("ou", 1.0)], **{c: cumulated(listed) for c, listed in SPELLINGS.items()}}.items() for c in (low, low.upper())]
MOST = max(len(options) for _, options in CHANGED)


def tables() -> tuple[np.ndarray, ...]:
    """By code point: the kind of a letter, all above the last have none. By kind: what the first draw stays under if the letter
    is changed, and the ends of its options. By kind and option: the length of the spelling and its characters."""
    kinds = np.zeros(max(ord(c) for c, _ in CHANGED) + 2, np.uint8)
    limits, ends = np.zeros(len(CHANGED) + 1, np.int64), np.full((len(CHANGED) + 1, MOST - 1), 16**DIGITS, np.int64)
    sizes, spelled = np.ones((len(CHANGED) + 1, MOST), np.int64), np.zeros((len(CHANGED) + 1, MOST, 3), np.uint32)
    for kind, (c, options) in enumerate(CHANGED, start=1):
        kinds[ord(c)] = kind
        limits[kind] = math.ceil((OU if c.lower() == "u" else SUBSTITUTED) * 16**DIGITS)
        for k, (to, end) in enumerate(options):
            if end < 1:
                ends[kind, k] = math.ceil(end * 16**DIGITS)
            sizes[kind, k] = len(to)
            spelled[kind, k, : len(to)] = [ord(x) for x in to]
    return kinds, limits, ends, sizes, spelled


KINDS, LIMITS, ENDS, SIZES, SPELLED = tables()


def respelled(owns: list[str | None], texts: list[str | None]) -> pa.Array:
    """Texts with their letters spelled informally by the digests of their rows, in hexadecimal."""
    rows = [(own, x) for own, x in zip(owns, texts, strict=True) if x is not None]
    sizes = np.array([len(x) for _, x in rows], np.int64)
    points = np.frombuffer("".join(x for _, x in rows).encode("utf-32-le"), "<u4")
    states = digests.begun([own for own, _ in rows])
    ends, grown, pieces = np.cumsum(sizes), np.zeros(len(rows), np.int64), []
    for first in range(0, len(points), BLOCK):
        part = points[first : first + BLOCK]
        kind = KINDS.take(part, mode="clip")
        at = np.flatnonzero(kind)
        row = np.searchsorted(ends, first + at, side="right")
        kind = kind[at]
        one, two = drawn([s[row] for s in states], first + at + 1 - (ends - sizes)[row])
        hit = np.flatnonzero(one < LIMITS[kind])
        at, row, kind, two = at[hit], row[hit], kind[hit], two[hit]
        option = (two[:, None] >= ENDS[kind]).sum(axis=1)
        lengths = np.ones(len(part), np.int64)
        lengths[at] = SIZES[kind, option]
        to = np.cumsum(lengths) - lengths
        out = np.empty(lengths.sum(), "<u4")
        out[to] = part
        for k in range(SPELLED.shape[2]):
            longer = lengths[at] > k
            out[to[at[longer]] + k] = SPELLED[kind[longer], option[longer], k]
        grown += np.bincount(row, lengths[at] - 1, len(rows)).astype(np.int64)
        pieces.append(out.tobytes().decode("utf-32-le"))
    spelled, bounds = "".join(pieces), [0, *np.cumsum(sizes + grown).tolist()]
    made: Iterator[str] = itertools.starmap(lambda a, b: spelled[a:b], itertools.pairwise(bounds))
    return pa.array([None if x is None else next(made) for x in texts], pa.string())


def drawn(states: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two draws of each letter, from the digest of its row's digest, a colon and its place in the text."""
    high, low = digests.ended(states, places)
    return (high >> 12).astype(np.int64), ((high & 0xFFF) << 40 | low >> 24).astype(np.int64)


def misspelled(text: Column, seed: str = "informal") -> Column:
    """An informal spelling, drawn from digests of the text itself, so that order and partitioning do not matter.

    One digest for the row decides whether it stays, its hyphens and its prepositions; one for each letter of the table, whether
    it is replaced and by what. An upper-case letter gets a capitalised spelling. Letters are drawn in Arrow batches, as there are
    as many digests as letters; all else is built in."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    row = F.sha2(F.concat(own, F.lit(":row")), 256)
    spelled = batches.column(respelled, "string")(own, F.when(~below(row, 0, UNCHANGED), text))

    def ended(row: Column, out: Column) -> Column:
        parted = F.when(F.contains(out, F.lit("-")) & below(row, 1, HYPHEN), F.replace(out, F.lit("-"), F.when(below(row, 2, 0.5), " ").otherwise(""))).otherwise(out)
        short = parted
        for pattern, to in SHORT_FORMS:
            short = F.regexp_replace(F.regexp_replace(short, pattern, to), pattern, to)
        return F.when(below(row, 3, SHORTENED), short).otherwise(parted)

    return let(F.struct(row.alias("row"), spelled.alias("out")), lambda x: F.when(x["out"].isNull(), text).otherwise(ended(x["row"], x["out"])))


def lookalike(text: Column) -> Column:
    """The homoglyph condition; every pair must be one that normalisation undoes."""
    wrong = [c for c, fake in LOOKALIKES.items() if RULES.letters.get(fake) != c]
    if wrong:
        raise ValueError(f"normalisation would not undo {wrong}")
    return F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def chunks(text: str, low: int = 30, high: int = 80, seed: str = "lines") -> list[str]:
    """Words packed greedily to line widths that are drawn from the row's own seed."""
    rng = random.Random(hashlib.sha256(f"{seed}:{text}".encode()).digest())
    lines: list[list[str]] = []
    width = used = 0
    for word in text.split():
        if not lines or used + len(word) + 1 > width:
            lines.append([])
            width, used = rng.randint(low, high), -1
        lines[-1].append(word)
        used += len(word) + 1
    return [" ".join(x) for x in lines]


def chunked(text: Column, low: int = 30, high: int = 80) -> Column:
    return on_texts(lambda t: chunks(t, low, high), "array<string>")(text)
