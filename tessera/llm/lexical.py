"""Ranked lexical search: every document scored for every item by dense blocked matrix products.

Texts are read once into the counts of the items' terms. Then tiles of documents, their impacts by term, are multiplied by
tiles of items, their weights by term over a vocabulary of the items' own terms. Entries are integers held in float64, and
the vocabulary is cut so that no sum within a tile can reach 2^53; sums of tiles are longs. Each task keeps the best of
each item, ties by doc_id, and the tasks' rankings are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_batches
from tessera.llm.topk import NAMED, UNNAMED, Best

#: Terms and items of an item tile, documents of a document tile.
TILE_TERMS, TILE_ITEMS, TILE_DOCS = 1024, 512, 1024
#: Different (item, term) pairs that are searched in one pass over the documents: at most 256 MB as dense tiles.
PASS_TERMS = 1 << 16
#: What a term's impact in a document stays below, and what sums in a tile stay below.
IMPACT, EXACT = 10**6, 2**53
#: Terms are runs of digits, Latin letters without marks and all characters beyond ASCII; A to Z in lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_STATS = "slot int, n long"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item with their repeats."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                counts = Counter(terms(text))
                if counts:
                    own = batch.column(0).slice(k, 1).take(pa.array([0] * len(counts)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(read, f"item_id {kind}, term binary, n long")
    return found.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, slots, counts) of the documents with terms: how many there are, and those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = sent.value.get
        for batch in batches:
            sizes, slots, counts, kept = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = terms(text)
                if found:
                    own = Counter(map(slot, found))
                    own.pop(None, None)
                    kept.append(k)
                    sizes.append(len(found))
                    slots.append(np.fromiter(own.keys(), np.int32, len(own)))
                    counts.append(np.fromiter(own.values(), np.int32, len(own)))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(slots, lists), pa.array(counts, lists)], names=["doc_id", "n", "slots", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(read, "doc_id long, n long, slots array<int>, counts array<int>")


def statistics(held: DataFrame, n_slots: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the documents that hold each term of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_slots + 2, dtype=np.int64)
        for batch in batches:
            totals[:n_slots] += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=n_slots)
            totals[n_slots] += batch.num_rows
            totals[n_slots + 1] += batch.column(0).to_numpy(zero_copy_only=False).sum()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], names=["slot", "n"])

    totals = np.zeros(n_slots + 2, dtype=np.int64)
    for row in held.select("n", "slots").mapInArrow(add, _STATS).groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[row["slot"]] = row["n"]
    return int(totals[n_slots]), int(totals[n_slots + 1]), totals[:n_slots]


def item_tiles(postings: list[tuple[int, int, int]], weights: list[int], n_items: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first item, slots, matrix of terms by items) from (item, slot, repeats).

    A tile's vocabulary is of its own items' terms. It ends where a sum of some item could reach 2^53; a term that could by
    its repeats alone stands in several tiles with a part of them in each."""
    by_item: dict[int, list[tuple[int, int]]] = {}
    for item, slot, n in postings:
        by_item.setdefault(item, []).append((slot, n))
    for first in range(0, n_items, TILE_ITEMS):
        by_slot: dict[int, list[tuple[int, int]]] = {}
        for item in range(first, min(first + TILE_ITEMS, n_items)):
            for slot, n in by_item.get(item, ()):
                if weights[slot]:
                    by_slot.setdefault(slot, []).append((item - first, n))
        slots: list[int] = []
        columns: list[list[tuple[int, int]]] = []
        reach: Counter[int] = Counter()
        for slot in sorted(by_slot):
            most = (EXACT - 1) // (weights[slot] * IMPACT)
            left = by_slot[slot]
            while left:
                part = [(item, min(n, most)) for item, n in left]
                left = [(item, n - most) for item, n in left if n > most]
                adds = {item: n * weights[slot] * IMPACT for item, n in part}
                if slots and (len(slots) == TILE_TERMS or any(reach[item] + x >= EXACT for item, x in adds.items())):
                    yield first, *_dense(slots, columns, weights)
                    slots, columns, reach = [], [], Counter()
                slots.append(slot)
                columns.append(part)
                reach.update(adds)
        if slots:
            yield first, *_dense(slots, columns, weights)


def _dense(slots: list[int], columns: list[list[tuple[int, int]]], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.zeros((len(slots), TILE_ITEMS))
    for row, (slot, part) in enumerate(zip(slots, columns, strict=True)):
        for item, n in part:
            matrix[row, item] = n * weights[slot]
    return np.array(slots), matrix


def impacts(n: np.ndarray, counts: np.ndarray, offsets: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """The impact of each count of a document of n terms: (1000000000 tf) div (1000 tf + 8 m)."""
    m = np.array([25 + 75 * int(x) * documents // all_terms for x in n], dtype=np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, np.diff(offsets)))


def scored(held: DataFrame, tiles: list[tuple[int, np.ndarray, np.ndarray]], n_items: int, n_slots: int, documents: int, all_terms: int, k: int) -> DataFrame:
    """(item, score, doc_id) of the best of each task, item as the place of it in the tiles."""
    sent = held.sparkSession.sparkContext.broadcast(tiles)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, best = sent.value, Best(n_items, k)
        where = np.full(n_slots, -1, dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(begin, TILE_DOCS)
                slots, counts = (tile.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                offsets = np.concatenate([[0], np.cumsum(tile.column(2).value_lengths().to_numpy(zero_copy_only=False))])
                values = impacts(tile.column(1).to_numpy(zero_copy_only=False), counts, offsets, documents, all_terms)
                doc = np.repeat(np.arange(tile.num_rows), np.diff(offsets))
                state = np.where(tile.column(0).is_null().to_numpy(zero_copy_only=False), UNNAMED, NAMED)
                ids = tile.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                sums: dict[int, np.ndarray] = {}
                for first, own, matrix in tiles:
                    where[own] = np.arange(len(own))
                    at = where[slots]
                    dense = np.zeros((tile.num_rows, len(own)))
                    dense[doc[at >= 0], at[at >= 0]] = values[at >= 0]
                    where[own] = -1
                    products = (dense @ matrix).astype(np.int64)
                    sums[first] = sums[first] + products if first in sums else products
                for first, found in sums.items():
                    items = slice(first, min(first + TILE_ITEMS, n_items))
                    _take(best, items, found[:, : items.stop - first], ids, state)
        item, value, ids, named = best.held()
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(value), pa.array(ids, mask=~named)], names=["item", "score", "doc_id"])

    return held.mapInArrow(score, "item int, score long, doc_id long")


def _take(best: Best, items: slice, found: np.ndarray, ids: np.ndarray, state: np.ndarray) -> None:
    """Takes a tile's scores into the rankings. What is below the tile's own kth score or the ranking's can't get in; what
    equals it can, by its doc_id."""
    least = np.maximum(best.floor(items), 1)
    if len(found) > best.k:
        least = np.maximum(least, np.partition(found, -best.k, axis=0)[-best.k])
    doc, item = np.nonzero(found >= least)
    best.add(items.start + item, found[doc, item], ids[doc], state[doc])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: (item_id, rank from 1, doc_id, score).

    docs has (doc_id, text), items has (item_id, text); other columns are ignored. Equal scores rank by ascending doc_id,
    documents without one after them. Rows that repeat a doc_id are documents of their own; rows that repeat an item_id are
    one item with the terms of all, also those without an item_id. Texts without a term count nowhere. No documents or no
    items, no rows. Items go through in passes of about PASS_TERMS different terms each; each pass reads
    the documents once, its counts are written to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lexical")
    asked = scratch.save(item_terms(items), "items")
    n_postings = asked.count()
    passes = -(-n_postings // PASS_TERMS)
    kind = items.schema["item_id"].dataType
    found = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        place = rows.column("item_id").dictionary_encode(null_encoding="encode").unify_dictionaries()
        item = np.concatenate([c.indices.to_numpy() for c in place.chunks])
        names = place.chunk(0).dictionary
        words = rows.column("term").to_pylist()
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
        held = scratch.save(counted(docs, vocabulary), f"counts{p}")
        documents, all_terms, holding = statistics(held, len(vocabulary))
        if not documents:
            break
        weights = [weight(documents, int(x)) for x in holding]
        postings = list(zip(item.tolist(), (vocabulary[w] for w in words), rows.column("n").to_pylist(), strict=True))
        tiles = list(item_tiles(postings, weights, len(names)))
        hits = scored(held, tiles, len(names), len(vocabulary), documents, all_terms, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names.to_pylist())), f"item int, item_id {kind.simpleString()}")
        own = scratch.save(best.join(named, "item").select("item_id", "rank", "doc_id", "score"), f"best{p}")
        scratch.drop(f"counts{p}")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
