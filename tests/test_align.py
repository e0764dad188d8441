"""Distances and alignments against Levenshtein's whole table, and on texts too long for one."""

from __future__ import annotations

import random
import time
import tracemalloc

import pytest

from tessera.functions import align


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, start=1):
        up, row = rows[-1], [i]
        for j, y in enumerate(b, start=1):
            row.append(min(up[j - 1] + (x != y), up[j] + 1, row[j - 1] + 1))
        rows.append(row)
    return rows


def way_back(a, b):
    rows, i, j, out = table(a, b), len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1]


@pytest.mark.parametrize("alphabet", ["ab", "abcdé日", "a"])
def test_results_are_those_of_the_table(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(400):
        a, b = ("".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in "ab")
        assert align.distance(a, b) == table(a, b)[-1][-1]
        assert align.alignment(a, b) == way_back(a, b)
        words = [[rng.choice(["x", "yy", "z"]) for _ in range(rng.randint(0, 12))] for _ in "ab"]
        assert align.distance(*words) == table(*words)[-1][-1]


def test_long_texts_take_bounded_memory():
    rng = random.Random(9)
    a = "".join(rng.choices("abcdefgh ", k=100_000))
    b = "".join(c if rng.random() < 0.9 else rng.choice(["", "x", c + "y"]) for c in a)
    began = time.perf_counter()
    edits = align.distance(a, b)
    assert 0 < edits < 12_000 and time.perf_counter() - began < 60
    c, d = a[:30_000], b[:30_000]
    tracemalloc.start()
    found = align.alignment(c, d)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 100 << 20
    assert "".join(x for x, _ in found) == c and "".join(y for _, y in found) == d
    assert sum(x != y for x, y in found) == align.distance(c, d)


def test_parted_texts_align_as_a_whole():
    rng = random.Random(4)
    parts = 0
    for _ in range(1_500):
        a = "".join(rng.choices("abc^]- \n", k=rng.randint(0, 30)))
        drop, to = rng.choice("abc^]- "), rng.choice(["\x01", "b", "", " "])
        b = "".join(c if rng.random() < 0.3 else {drop: to}.get(c, c) for c in a)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        parts += align.parted(a, b) is not None
        assert align.distance(a, b) == table(a, b)[-1][-1]
        assert align.alignment(a, b) == way_back(a, b)
        counts = {}
        for pair in way_back(a, b):
            counts[pair] = counts.get(pair, 0) + 1
        assert {(x, y): n for x, y, n in align.tally(a, b)} == counts
    assert parts > 200


def test_edited_words_take_linear_time():
    a = "some of the words here " * 20_000
    b = a.replace("e", "").replace("o", "\x01")
    began = time.perf_counter()
    assert align.distance(a, b) == a.count("e") + a.count("o")
    assert sum(n for x, y, n in align.tally(a, b) if x != y) == a.count("e") + a.count("o")
    assert time.perf_counter() - began < 5
