"""Batch functions hold the results of a stretch of their batch at a time, whatever its size."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from tessera.functions import batches, labels, normalise, raster


def held(make, texts, limit=batches.STRETCH):
    """The arrays that come of one batch, and the most that Python held for them."""
    column = pa.array(texts)
    rows, parts = 0, 0
    tracemalloc.start()
    for part in batches.by_stretches(make, limit)(iter([column])):
        rows, parts = rows + len(part), parts + 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    return parts, most


def test_stretches_hold_all_in_order():
    assert list(batches.stretches([3, 3, 9, 0, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(batches.stretches([], 6)) == []


def test_lists_keep_nulls_and_empty_rows():
    fields = {"a": pa.string(), "n": pa.int32()}
    rows = [[("x", 1), ("y", 2)], None, [], [("z", 3)]]
    want = [None if r is None else [{"a": a, "n": n} for a, n in r] for r in rows]
    assert batches.lists(rows, fields).to_pylist() == want
    assert batches.lists([None], fields).to_pylist() == [None] and batches.lists([[]], fields).to_pylist() == [[]]


def test_labelled_words_of_a_full_batch():
    parts, most = held(labels.labelled, ["Ab, cd " * 300] * 200, 16 << 10)
    assert parts > 20 and most < 8 << 20


def test_reports_of_a_full_batch():
    parts, most = held(normalise.both_reports(fold=True), ["εγé ç" * 400] * 100, 16 << 10)
    assert parts > 20 and most < 16 << 20


def test_page_images_of_a_full_batch():
    image = pa.array([raster.write(raster.set_page(["a line of text"] * 50))] * 200, pa.binary())
    sizes = [len(part) for part in batches.by_stretches(raster.cut, raster.IMAGES)(iter([image]))]
    # a page has 540 kB
    assert sum(sizes) == 200 and max(sizes) < 40
