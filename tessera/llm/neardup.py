"""Near-duplicates: MinHash signatures joined by a multi-index Hamming search, links confirmed on full sets.

A signature has chunks * width symbols of 16 bits. By the pigeonhole principle two signatures that differ in at most
chunks * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS errors; enumerating the places of the errors in
each chunk turns that into equality of keys, so every such pair meets under a key. Keys with one member are dropped.
Members of a key are never paired all with all. Each is first confirmed against the member that shares most with
others, which joins most copies of a text into one component. Pairs of members that are then still in different
components are compared inside a join, by set size and by a long sketch of one-bit symbols, under the least key that
they share; what passes, nearly all of it true links, is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_batches, small

#: Symbols of a signature at most, and the places of a chunk that may be in error.
SYMBOLS, ERRORS = 50, 1
#: Chance with which a pair at the similarity may fail to meet under any key, and then to stay within the sketch's limit.
MISSED = 2e-6
#: Bits of the long sketch.
SKETCH = 2_048
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text whose words are hashed at a time with the powers below; longer texts go word by word.
_POWERS = 1 << 20


@dataclass(frozen=True)
class Layout:
    """How a signature is cut for a similarity, in percent: `chunks` chunks of `width` symbols, the widest (and so
    most selective) under which a pair at the similarity meets but for MISSED; and the sketch's distance limit."""

    chunks: int
    width: int
    limit: int

    @classmethod
    def of(cls, percent: int) -> Layout:
        s = percent / 100
        meets = lambda w: sum(comb(w, e) * s ** (w - e) * (1 - s) ** e for e in range(ERRORS + 1))
        width = next((w for w in range(SYMBOLS // 2, ERRORS + 1, -1) if (1 - meets(w)) ** (SYMBOLS // w) <= MISSED), ERRORS + 1)
        apart = (1 - s) / 2
        beyond = NormalDist(SKETCH * apart, max(0.1, SKETCH * apart * (1 - apart)) ** 0.5).inv_cdf(1 - MISSED)
        return cls(SYMBOLS // width, width, min(SKETCH, ceil(beyond)))

    @property
    def guaranteed(self) -> int:
        """Symbols in which two signatures may differ and still be sure to meet under a key."""
        return self.chunks * (ERRORS + 1) - 1

    @property
    def kept(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.width), self.width - ERRORS))


def _powers(base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(_POWERS, base, dtype=np.uint64)]))


_FORWARD, _BACKWARD = _powers(_BASE), _powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are runs of bytes other than space and the controls 9 to 13.

    Differences of one running polynomial sum give all words' hashes at once. Long inputs are cut at
    blanks; a single word longer than the table of powers is hashed by itself."""
    if len(data) > _POWERS:
        found = []
        words = data.split()
        at, size = [], 0
        for w in words:
            if len(w) + 1 + size > _POWERS and at:
                found.append(word_hashes(b" ".join(at)))
                at, size = [], 0
            if len(w) > _POWERS:
                found.append(np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), dtype=np.uint64))
            else:
                at.append(w)
                size += len(w) + 1
        if at:
            found.append(word_hashes(b" ".join(at)))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    return words_at(data)[0]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of at most _POWERS bytes, and the bytes at which they start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * _FORWARD[: len(raw)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * _BACKWARD[starts] + (ends - starts).astype(np.uint64)), starts


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of that many words; the whole sequence where it is shorter."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, _U(min(size, len(words))))
        for k in range(min(size, len(words))):
            h = h * _U(0xD6E8FEB86659FD93) + words[k : k + n]
    return np.unique(mix(h))


_RNG = np.random.default_rng(10)
_MULTIPLY = _RNG.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SKETCH_MULTIPLY = _RNG.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(hashes: np.ndarray, multiply: np.ndarray) -> np.ndarray:
    """For each odd multiplier, a mix of the least product modulo 2^32 with the folded hashes: multiplication is
    a permutation of them. Hashes are handled in pieces."""
    folded = (hashes >> _U(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 18) // len(multiply))
    for at in range(0, len(folded), step):
        np.minimum(least, (folded[at : at + step, None] * multiply[None, :]).min(axis=0), out=least)
    return mix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << _U(40)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The symbols of 16 bits."""
    return minima(hashes, _MULTIPLY) >> _U(48)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH one-bit symbols as longs."""
    return np.packbits((minima(hashes, _SKETCH_MULTIPLY) >> _U(63)).astype(np.uint8)).view(np.int64)


def keys(symbols: np.ndarray, layout: Layout) -> np.ndarray:
    """One key for each chunk and each set of places that are kept: the others may be in error."""
    with np.errstate(over="ignore"):
        grid = symbols[: layout.chunks * layout.width].reshape(layout.chunks, layout.width)
        out = []
        for which, keep in enumerate(layout.kept):
            h = np.arange(layout.chunks, dtype=np.uint64) * _U(len(layout.kept)) + _U(which + 1)
            for place in keep:
                h = mix(h * _BASE + grid[:, place])
            out.append(h)
    return np.concatenate(out).view(np.int64)


SIGNED = "n_shingles long, digest binary, keys array<long>"


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int, layout: Layout) -> DataFrame:
    @F.pandas_udf(SIGNED)
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            own = shingles(text, words)
            if len(own):
                rows.append((len(own), digest_of(own), keys(signature(own), layout)))
            else:
                rows.append((0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "digest", "keys"])

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): comp is the least node reachable.

    Each round gives a node the least label among itself and its neighbours, then follows that label's
    own label; it ends when no label changes. Rounds grow with the logarithm of a chain's length, and
    each round's labels are a written table."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
    edges = scratch.save(both.distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("comp")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("node").alias("to"), "comp"), "to").groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        low = scratch.save(low, f"{name}-{turn}-low")
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        # the label of the old label's node also falls: it takes the least label of those that point to it
        hook = low.where("old > comp").groupBy(F.col("old").alias("comp")).agg(F.min("comp").alias("hooked"))
        new = low.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        new = new.join(hook.select(F.col("comp").alias("node"), "hooked"), "node", "left").select("node", "old", F.least("comp", F.coalesce("hooked", "comp")).alias("comp"))
        labels = scratch.save(new, f"{name}-{turn}")
        changed = labels.where("old <> comp").limit(1).count()
        scratch.drop(f"{name}-{turn}-low", f"{name}-{turn - 1}")
        labels = labels.select("node", "comp")
        if not changed:
            return labels


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity: 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * shared >= percent * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set has its distinct shingles of `words` words (A to Z lower-cased), or its whole word
    sequence where it has fewer. Documents link if 100 * intersection >= percent * union, confirmed on the full
    sets; component_id is the least doc_id reachable. Null, empty and blank texts have no set and link
    with nothing. Equal sets are handled as one node, so copies cost one row each. Each row counts as a document of its
    own text: rows that share a doc_id but no text may be in different components. A null doc_id stays alone with a null
    component_id; an empty table gives an empty result; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neardup")
    layout = Layout.of(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(signed(texts, words, layout).withColumn("row", F.monotonically_increasing_id()), "signed")
    # one node for each distinct set, named by its least row; its least doc_id leads to its text
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.save(nodes, "nodes")
    key = Window.partitionBy("key")
    met = nodes.select("node", F.explode("keys").alias("key")).withColumn("members", F.count("*").over(key))
    met = scratch.save(met.where("members > 1"), "met")
    shares = scratch.save(met.groupBy("node").agg(F.sum("members").alias("shares")), "shares")
    known = shares.count()
    nearby = lambda df: small(df, known)

    @F.pandas_udf("digest binary, hashes array<long>, sketch array<long>")
    def of(column: pd.Series) -> pd.DataFrame:
        own = [shingles(t, words) for t in column]
        return pd.DataFrame({"digest": list(map(digest_of, own)), "hashes": [h.view(np.int64) for h in own], "sketch": [sketch(h) for h in own]})

    # the sets of the nodes that meet others, from the texts of their doc_ids; a doc_id can stand on other texts too
    met_nodes = nodes.join(nearby(shares), "node").select("digest", "node", "least", "n", "keys")
    needed = texts.join(nearby(met_nodes.select(F.col("least").alias("doc_id"))), "doc_id", "left_semi")
    # marked so that no test of its result is moved before the join above, where it would run on every text
    sets = needed.select(of.asNondeterministic()("text").alias("s")).select("s.*").join(met_nodes.drop("least"), "digest").drop("digest")
    sets = scratch.save(sets, "sets")
    if sets.count() > known:
        # the node's text stands on several rows with its doc_id: all have the same set
        sets = scratch.save(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "keys", "hashes", "sketch")]), "one-set")

    rank = F.struct("shares", (-F.col("node")).alias("least"))
    led = met.join(nearby(shares), "node").withColumn("hub", F.max(rank).over(key))
    hubs = led.groupBy("node").agg(F.max("hub").alias("hub")).select("node", (-F.col("hub.least")).alias("hub")).where("node <> hub")
    hubs = scratch.save(hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "hubs")
    links = scratch.save(confirm(hubs, sets, percent), "hub-links")
    comps = components(links, scratch, "hub")
    # keys whose members are still in several components: all their cross pairs are compared
    open_ = met.select("key", "node").join(nearby(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = open_.withColumns({"lo": F.min("comp").over(key), "hi": F.max("comp").over(key)}).where("lo < hi").select("key", "node", "comp")
    open_ = open_.join(sets.select("node", "n", "sketch", "keys"), "node")
    x, y = (open_.select(F.col("key"), *[F.col(c).alias(f"{p}{c}") for c in open_.columns if c != "key"]) for p in ("x_", "y_"))
    apart = (F.col("x_node") < F.col("y_node")) & (F.col("x_comp") != F.col("y_comp"))
    fits = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    bits = sum((F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("y_sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    # a pair counts once, under the least key that both have
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == x["key"]
    cross = x.join(y, (x["key"] == y["key"]) & apart & fits & (bits <= layout.limit) & once)
    cross = scratch.save(cross.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).join(hubs, ["a", "b"], "left_anti"), "cross")
    more = confirm(cross, sets, percent)
    comps = components(scratch.save(links.union(more), "links"), scratch, "all")
    comps = scratch.save(comps, "comps")
    scratch.drop("met", "shares", "sets", "one-set", "hubs", "hub-links", "cross", "links", "hub-edges", "all-edges")
    labelled = nodes.join(comps, "node", "left").select("digest", "least", F.coalesce("comp", "node").alias("comp"))
    first = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = labelled.join(first, "comp").select("digest", "component_id")
    joined = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def brute_force(rows: list[tuple[int, str | None]], words: int = 2, percent: int = 80) -> list[int]:
    """The component_id of each row by comparing all pairs; for tests."""
    sets = [set(shingles(t, words).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [least[root(i)] for i in range(len(rows))]
