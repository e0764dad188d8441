"""Edit-aware token counts: a segment tree over a document's pre-tokens, of which edits re-encode only what they touch."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate
from pathlib import Path

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Fixed value: the pre-token pattern of the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points beyond its end on which a pre-token can depend: the one that ends it, and one that \s+(?!\S) looks at.
CONTEXT = 2
#: Pre-tokens of a leaf when the tree is built, and the number beyond which the tree is built anew.
LEAF, LEAF_MOST = 64, 512
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Counter:
    """Counts the tokens of pre-tokens with a byte-pair vocabulary given by the bytes of its ranks file."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def counts(self, pieces: Iterable[str]) -> list[int]:
        known = self.known
        return [known[p] if p in known else self.count(p) for p in pieces]


class TokenTree:
    """A segment tree of one document. Leaves hold runs of pre-tokens (lengths in code points, token counts);
    inner nodes hold the sums of both over their subtree, at 2 * i and 2 * i + 1 below node i."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.split(text)
        self.reencoded = 0
        self._build(list(map(len, pieces)), counter.counts(pieces))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        starts = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in starts]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (own_lengths, own_counts) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(own_lengths), sum(own_counts)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = (t[2 * i] + t[2 * i + 1] for t in (self.chars, self.tokens))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(len(c) for _, c in self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds the code point, by descent, and the code points before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), before

    def _set(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = (t[2 * node] + t[2 * node + 1] for t in (self.chars, self.tokens))

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the code points from start to end. Pre-tokens that end CONTEXT before start stay; from there on
        the new text is split again until a boundary after the edit meets an old one, beyond which nothing can differ."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        shift = len(replacement) - (end - start)
        old = self.text
        self.text = new = old[:start] + replacement + old[end:]
        keep_to = max(0, start - CONTEXT)
        leaf, before = self._leaf_at(max(0, keep_to - 1))
        lengths, counts = self.leaves[leaf]
        ends = [before + x for x in accumulate(lengths)]
        first = bisect_right(ends, keep_to)
        at = ends[first - 1] if first else before
        last, old_ends, seen_to = leaf, list(ends), leaf + 1
        boundaries = {e + shift: (leaf, i) for i, e in enumerate(ends) if e >= end}
        fresh_lengths, fresh_counts, met = [], [], None
        pos, target = at, end + shift
        while pos < len(new):
            piece = self.counter.pattern.match(new, pos)[0]
            fresh_lengths.append(len(piece))
            fresh_counts.append(self.counter.count(piece))
            pos += len(piece)
            if pos < target:
                continue
            while seen_to < len(self.leaves) and (not old_ends or old_ends[-1] + shift < pos):
                base = old_ends[-1] if old_ends else before
                more = [base + x for x in accumulate(self.leaves[seen_to][0])]
                boundaries |= {e + shift: (seen_to, i) for i, e in enumerate(more) if e >= end}
                old_ends += more
                seen_to += 1
            met = boundaries.get(pos)
            if met:
                break
        self.reencoded += len(fresh_lengths)
        if met:
            last, i = met
            tail = (self.leaves[last][0][i + 1 :], self.leaves[last][1][i + 1 :])
        else:
            last, tail = len(self.leaves) - 1, ([], [])
        for gone in range(leaf + 1, last + 1):
            self._set(gone, [], [])
        self._set(leaf, [*lengths[:first], *fresh_lengths, *tail[0]], [*counts[:first], *fresh_counts, *tail[1]])
        if len(self.leaves[leaf][0]) > LEAF_MOST:
            self._build([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])


Edit = tuple[int, int, str]


def standard_edits(text: str) -> list[Edit]:
    """Three edits of any text, each stated on the text that the one before left: a deletion at a quarter, an
    insertion at the half, and at three quarters a replacement by other characters of the text."""
    n = len(text)
    cut = min(24, n // 4)
    return [(n // 4, n // 4 + cut, ""), (n // 2, n // 2, " [edited] "), (3 * n // 4, 3 * n // 4 + min(12, n // 8), text[: min(16, n // 8)][::-1])]


COUNTED = "n_pretokens long, n_tokens long, edited_chars long, edited_tokens long, reencoded long"


def shared_ranks(spark: SparkSession, vocabulary: str) -> Broadcast[bytes]:
    """The bytes of a ranks file (about 1 MB), read by Spark where the path is a URI, else on the driver."""
    if "://" in vocabulary:
        ranks = bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0])
    else:
        ranks = Path(vocabulary).read_bytes()
    return spark.sparkContext.broadcast(ranks)


def n_tokens_of(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a whole text; of a null one 0."""
    bounded_batches(spark)
    shared = shared_ranks(spark, vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(shared.value)
        return pd.Series([sum(counter.counts(counter.split(t))) if t else 0 for t in texts], dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, edits: Callable[[str], list[Edit]] = standard_edits, text: str = "text") -> DataFrame:
    """docs with a struct column `tokens`: pre-tokens and tokens of the text; code points and tokens after
    the edits; and the pre-tokens that the edits had encoded again.

    vocabulary is the path of a ranks file, by Spark where it is a URI, else a file of the driver; its bytes (about
    1 MB) are broadcast. A null text counts as empty (all zero but for what the edits insert); whole texts of any length are counted; repeated
    rows get equal results; an empty table stays empty; edits outside a text are clipped to it; a column `tokens` that
    docs has is replaced, all others stay.
    """
    bounded_batches(docs.sparkSession)
    shared = shared_ranks(docs.sparkSession, vocabulary)

    @F.pandas_udf(COUNTED)
    def count(texts: pd.Series) -> pd.DataFrame:
        counter = _counter(shared.value)
        rows = []
        for value in texts:
            tree = TokenTree(value or "", counter)
            size, tokens = tree.n_pretokens, tree.n_tokens
            for edit in edits(tree.text):
                tree.edit(*edit)
            rows.append((size, tokens, len(tree.text), tree.n_tokens, tree.reencoded))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in COUNTED.split(", ")])

    return docs.withColumn("tokens", count(F.col(text)))


_COUNTERS: dict[int, Counter] = {}


def _counter(ranks: bytes) -> Counter:
    """One counter for each vocabulary and worker process."""
    key = hash(ranks)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(ranks)
    return _COUNTERS[key]
