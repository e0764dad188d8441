"""Benchmark decontamination: rare n-gram seeds join documents to test items, and Smith-Waterman alignment scores them.

Frequent n-grams are never joined: a phrase of k items in m documents would make k times m rows. Items that hold some are
sent, in blocks of a bounded size, to the documents that hold any; there an exact bound decides where an alignment is
worth its time, and only copies leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_batches, small, text_or_empty
from tessera.llm.neardup import _POWERS, mix, word_hashes, words_at

#: Words of a seed. An n-gram is rare if its document frequency is RARE or 1 in RARE_PART of all documents at most.
SEED_WORDS, RARE, RARE_PART = 3, 16, 10_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible score from which a document counts as holding a copy of it.
THRESHOLD = 0.4
#: Distinct n-grams of the items up to which their table goes to every task (8 bytes each); beyond, n-grams are joined by shuffle.
SHARED_GRAMS = 2_000_000
#: Bytes of items' words that are broadcast at once.
SHARED_BYTES = 32 << 20
#: Items, on average, that go to the alignment beside one copy of a document's text.
ITEMS_AT_ONCE = 64
_U = np.uint64
#: Letters A to Z in lower case, all other ASCII but digits a blank; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


#: Bytes of texts that are hashed together: small texts then share the cost of a pass.
GROUP_BYTES = 1 << 18


def prepared(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words: lower case, punctuation of ASCII apart."""
    return word_hashes(prepared(text)) if text else np.zeros(0, dtype=np.uint64)


def grams_of(words: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    """The hash of the n-gram that starts at each word; of the whole where there are fewer words."""
    size = min(size, len(words))
    n = len(words) - size + 1 if size else 0
    with np.errstate(over="ignore"):
        h = np.full(n, _U(size))
        for k in range(size):
            h = h * _U(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(h)


def grams_of_all(texts: Sequence[str | None], sizes: Sequence[int] = (SEED_WORDS,)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, n-gram) arrays that together hold the n-grams of all texts, a group of texts at a time."""
    for size in sizes:
        yield from _grams_of_size(texts, size)


def _grams_of_size(texts: Sequence[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    group: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        data = prepared(text)
        if len(data) >= GROUP_BYTES:
            own = grams_of(word_hashes(data), size)
            yield np.full(len(own), i), own
            continue
        if group and held + len(data) > _POWERS - GROUP_BYTES:
            yield from _grams_of_group(group, size)
            group, held = [], 0
        group.append((i, data))
        held += len(data) + 1
    if group:
        yield from _grams_of_group(group, size)


def _grams_of_group(group: list[tuple[int, bytes]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words, at = words_at(b"\n".join(data for _, data in group))
    begins = np.cumsum([0, *(len(data) + 1 for _, data in group[:-1])])
    owner = np.searchsorted(begins, at, side="right") - 1
    places = np.array([i for i, _ in group])
    if len(words) >= size:
        whole = owner[: len(words) - size + 1] == owner[size - 1 :]
        yield places[owner[: len(whole)][whole]], grams_of(words, size)[whole]
    counts = np.bincount(owner, minlength=len(group))
    ends = np.cumsum(counts)
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        own = grams_of(words[ends[k] - counts[k] : ends[k]], size)
        yield np.full(len(own), places[k]), own


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and start and end (exclusive) in the text.

    A row of the table is filled at once: the running maximum of score + gap * place covers all gaps."""
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0
    place = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, dtype=np.int64)
    begun = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        here = np.concatenate([[0], np.maximum(np.maximum(step, down), 0)])
        came = np.concatenate([[0], np.where(step >= down, begun[:-1], begun[1:])])
        came = np.where(here > 0, came, np.arange(n + 1))
        lifted = here + place
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - place
        begun = np.where(score > 0, came[source], np.arange(n + 1))
        above = np.maximum(score, 0)
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), int(begun[j]), j)
    return best


def most(item: np.ndarray, text: np.ndarray) -> int:
    """A bound that no local alignment exceeds: the best stretch of the text where a word of the item counts as
    a match and any other costs no more than a mismatch or a gap."""
    if not len(text):
        return 0
    total = np.cumsum(np.where(np.isin(text, item), MATCH, max(MISMATCH, GAP)))
    return max(0, int((total - np.minimum.accumulate(np.concatenate([[0], total[:-1]]))).max()))


def best_copy(item: np.ndarray, text: np.ndarray, least: float = 0.0, grams: np.ndarray | None = None) -> tuple[float, int, int]:
    """The best alignment over the windows around the text's words that start a seed-sized n-gram of the
    item; score as a share of the item's best possible. Windows that `most` shows to stay below the least score are left out."""
    if grams is None or len(item) < SEED_WORDS:
        grams = grams_of(text, min(SEED_WORDS, len(item)))
    spots = np.flatnonzero(np.isin(grams, grams_of(item)))
    found = (0.0, 0, 0)
    reach = len(item) * 2
    at = 0
    while at < len(spots):
        low = high = spots[at]
        while at < len(spots) and spots[at] <= high + reach:
            high = spots[at]
            at += 1
        start = max(0, low - reach)
        window = text[start : high + reach + SEED_WORDS]
        if least and most(item, window) / (MATCH * len(item)) < least:
            continue
        score, s, e = align(item, window)
        if score > found[0] * MATCH * len(item):
            found = (score / (MATCH * len(item)), int(start + s), int(start + e))
    return found


def items_of(benchmark: DataFrame, least_words: int) -> DataFrame:
    """item_id, words and grams of the benchmark's items with at least so many words; repeated rows once."""

    @F.pandas_udf("words array<long>, grams array<long>")
    def split(texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        return pd.DataFrame({"words": [w.view(np.int64) for w in words], "grams": [np.unique(grams_of(w)).view(np.int64) for w in words]})

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    return items.select("item_id", split("text").alias("s")).select("item_id", "s.*").where(F.size("words") >= max(1, least_words))


def gram_hits(docs: DataFrame, grams: DataFrame, n_grams: int, sizes: Sequence[int]) -> DataFrame:
    """(doc_id, gram) for the distinct n-grams, of those sizes, of each document that the grams have."""
    if n_grams <= SHARED_GRAMS:
        table = np.sort(np.array([r["gram"] for r in grams.select("gram").toLocalIterator()], dtype=np.int64)).view(np.uint64)
        table.sort()
        shared = docs.sparkSession.sparkContext.broadcast(table)
    else:
        shared = None

    @F.pandas_udf("array<long>")
    def hits(texts: pd.Series) -> pd.Series:
        mask = _U((1 << 18) - 1)
        known = shared.value if shared else None
        if known is not None:
            seen = np.zeros(1 << 18, dtype=bool)
            seen[(known & mask).astype(np.int64)] = True
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for places, own in grams_of_all(texts, sizes):
            if known is not None and len(known):
                maybe = np.flatnonzero(seen[(own & mask).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
                maybe = maybe[known[at] == own[maybe]]
                places, own = places[maybe], own[maybe]
            elif known is not None:
                continue
            cuts = np.flatnonzero(np.diff(places)) + 1
            for p, part in zip(places[np.concatenate([[0], cuts])] if len(places) else (), np.split(own, cuts), strict=False):
                found[p].append(part)
        return pd.Series([np.unique(np.concatenate(f)).view(np.int64) if f else np.zeros(0, dtype=np.int64) for f in found])

    found = docs.select("doc_id", F.explode(hits("text")).alias("gram"))
    return found if shared else found.join(grams, "gram", "left_semi").select("doc_id", "gram")


SCORED = "item_id array<long>, score array<double>, start_word array<long>, end_word array<long>, item_words array<long>"


def aligned(texts: DataFrame, pairs: DataFrame, items: DataFrame, n_items: int, item_bytes: int) -> DataFrame:
    """The alignments of the pairs (doc_id, item_id), a text once for some ITEMS_AT_ONCE items."""
    loaded = pairs.join(F.broadcast(items) if item_bytes <= SHARED_BYTES else items, "item_id").select("doc_id", "item_id", "words")
    part = F.pmod(F.xxhash64("item_id"), F.lit(n_items // ITEMS_AT_ONCE + 1))
    each = loaded.groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("item_id", "words")).alias("of"))
    # the bytes of the words beside all pairs decide whether the texts stay where they are
    held = pairs.join(items.select("item_id", F.size("words").alias("n")), "item_id").agg(F.sum(8 * F.col("n") + 64)).first()[0] or 0
    rows = texts.join(F.broadcast(each) if held <= SHARED_BYTES else each, "doc_id")

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series, ids: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for t, own_ids, ws in zip(texts, ids, words, strict=True):
            own = words_of(t)
            grams = grams_of(own)
            best = [(int(i), *best_copy(w, own, 0.0, grams), len(w)) for i, w in zip(own_ids, (np.asarray(w, dtype=np.int64).view(np.uint64) for w in ws), strict=True)]
            out.append([list(c) for c in zip(*best, strict=True)])
        return pd.DataFrame(out, columns=[f.split()[0] for f in SCORED.split(", ")])

    return rows.select("doc_id", score("text", "of.item_id", "of.words").alias("s"))


def blocks_of(frequent: DataFrame) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Items with frequent n-grams in blocks of SHARED_BYTES: their ids and words, and the n-grams, sorted, each with the
    place of an item that has it."""
    ids, words, grams, owner, held = [], [], [], [], 0

    def block() -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        flat, of = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(flat, kind="stable")
        return np.array(ids), list(words), flat[order], of[order]

    for r in frequent.toLocalIterator():
        own = np.array(r["words"], dtype=np.int64).view(np.uint64)
        have = np.array(r["frequent"], dtype=np.int64).view(np.uint64)
        if ids and held + own.nbytes + have.nbytes > SHARED_BYTES:
            yield block()
            ids, words, grams, owner, held = [], [], [], [], 0
        grams.append(have)
        owner.append(np.full(len(have), len(ids)))
        ids.append(r["item_id"])
        words.append(own)
        held += own.nbytes + have.nbytes
    if ids:
        yield block()


def bounded_copies(texts: DataFrame, block: tuple, threshold: float) -> DataFrame:
    """The alignments of the texts with the items of a block of which they hold a frequent n-gram; windows in which
    no alignment can reach the threshold are left out, so only a pair with a copy, or nearly, costs an alignment."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        ids, words, table, owner = shared.value
        out = []
        for t in texts:
            own = words_of(t)
            grams = grams_of(own)
            known = np.unique(grams)
            low, high = np.searchsorted(table, known, side="left"), np.searchsorted(table, known, side="right")
            met = np.unique(np.concatenate([owner[a:b] for a, b in zip(low, high, strict=True) if b > a])) if (high > low).any() else ()
            best = [(int(ids[k]), *best_copy(words[k], own, threshold, grams), len(words[k])) for k in met]
            out.append([list(c) for c in zip(*best, strict=True)] if best else [[]] * 5)
        return pd.DataFrame(out, columns=[f.split()[0] for f in SCORED.split(", ")])

    return texts.select("doc_id", score("text").alias("s"))


def copies(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = 1) -> DataFrame:
    """One row per document and item that it holds a copy of: doc_id, item_id, score (0 to 1), start and end
    of the aligned words in the document, item_words.

    The document frequency of every item n-gram is counted over all documents. A document is aligned with every item
    that it shares a rare n-gram with, or any where the item has no more than two; after frequent ones only, in the windows in which an
    alignment can reach the threshold at all. So frequency costs no copy. An item of fewer words than a seed is its own
    seed; items below least_words words are left out. Null and blank texts and items match nothing; rows with null
    doc_id are not reported; repeated rows with a doc_id are reported once with their best score; empty
    tables give an empty result; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "decontam")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    items = scratch.save(items_of(benchmark, least_words).withColumn("item_id", F.col("item_id").cast("long")), "items")
    n_items, item_bytes, *short = items.agg(F.count("*"), F.sum(8 * F.size("words")), *[F.max(F.size("words") == k) for k in range(1, SEED_WORDS)]).first()
    sizes = [SEED_WORDS, *(k for k, some in enumerate(short, start=1) if some)]
    item_grams = items.select("item_id", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    grams = scratch.save(item_grams.select("gram").distinct(), "grams")
    n_grams = grams.count()
    hits = scratch.save(gram_hits(texts, grams, n_grams, sizes), "hits")
    rare = F.col("df") <= max(RARE, texts.count() // RARE_PART)
    seen = hits.groupBy("gram").agg(F.count("*").alias("df"))
    seeds = scratch.save(item_grams.join(seen, "gram").select("gram", "item_id", (rare | (F.col("of") <= 2)).alias("joins")), "seeds")
    joining = seeds.where("joins").drop("joins")
    pairs = scratch.save(hits.join(small(joining, joining.count()), "gram").select("doc_id", "item_id").distinct(), "pairs")
    found = [aligned(texts, pairs, items, n_items, item_bytes or 0)]
    others = seeds.where("NOT joins")
    frequent = others.groupBy("item_id").agg(F.collect_list("gram").alias("frequent")).join(items, "item_id").select("item_id", "words", "frequent")
    holders = scratch.save(hits.join(small(others.select("gram").distinct(), n_grams), "gram", "left_semi").select("doc_id").distinct(), "holders")
    n = holders.count()
    if n:
        held = texts.join(small(holders, n), "doc_id", "left_semi")
        found += [bounded_copies(held, block, threshold) for block in blocks_of(frequent)]
    single = reduce(DataFrame.unionByName, found).select("doc_id", F.explode(F.arrays_zip(*[f"s.{c.split()[0]}" for c in SCORED.split(", ")])).alias("s"))
    best = F.max(F.struct("s.score", "s.start_word", "s.end_word")).alias("b")
    flat = single.where(F.col("s.score") >= threshold).groupBy("doc_id", F.col("s.item_id").alias("item_id"), F.col("s.item_words").alias("item_words")).agg(best)
    return flat.select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no copy of a benchmark item, with all their columns, of any name; rows without a doc_id
    stay."""
    flagged = Scratch(docs.sparkSession, "decontam-ids").save(copies(docs, benchmark, threshold).select("doc_id").distinct(), "ids")
    return docs.join(small(flagged, flagged.count()), "doc_id", "left_anti").select(docs.columns)
