"""Span masks over token windows: every draw is a part of a digest of seed, window and position, so any partitioning, any engine
and any later run draws the same masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Hexadecimal digits of a draw; a digest of 64 holds four: the length of a span, its ratio, its replacement, a random id.
DIGITS = 13
#: The label where nothing is masked, and the ratio of a protected position, greater than any.
IGNORED, PROTECTED = -100, "z"


@dataclass(frozen=True)
class SpanMasker:
    """Spans of 1 to max_span tokens are masked from the least ratio on, until the share is reached. Of masked spans a part is
    replaced by random ids, a part is kept, the others become mask_id. Ids below special are never masked nor drawn."""

    vocabulary: int
    mask_id: int
    special: int
    random_share: float
    kept_share: float
    max_span: int

    def __post_init__(self) -> None:
        if self.max_span < 1:
            raise ValueError("a span has one token at least")
        if self.special >= self.vocabulary:
            raise ValueError("special ids leave no other id")
        if not 0 <= self.random_share + self.kept_share <= 1:
            raise ValueError("random and kept are shares of the masked spans")

    def masked(self, ids: Column, window: Column, share: float, seed: str = "mask") -> Column:
        """A struct of inputs and labels for an array of ids, of which max(floor(size * share), 1) are masked, and the other
        positions of the last span."""

        def bound(p: float) -> str:
            return "g" if p >= 1 else f"{round(p * 16**DIGITS):0{DIGITS}x}"

        part = lambda h, k: F.substring(h, 1 + DIGITS * k, DIGITS)
        number = lambda h, k: F.conv(part(h, k), 16, 10).cast("long")
        positions = F.transform(ids, lambda _, i: i)
        digests = F.transform(positions, lambda i: F.sha2(F.concat(F.lit(f"{seed}:"), window.cast("string"), F.lit(":"), i.cast("string")), 256))

        def spans(d: Column) -> Column:
            return F.slice(F.flatten(F.transform(d, lambda h, k: F.array_repeat(k, (number(h, 0) % self.max_span + 1).cast("int")))), F.lit(1), F.size(ids))

        def whole(d: Column, span: Column) -> Column:
            ratios = F.zip_with(ids, span, lambda x, k: F.when(x < self.special, F.lit(PROTECTED)).otherwise(part(F.get(d, k), 1)))
            wanted = F.greatest(F.floor(F.size(ids) * share), F.lit(1)).cast("int")
            return let(ratios, lambda r: let(F.get(F.sort_array(r), wanted - 1), lambda least: replaced(d, span, r, least)))

        def replaced(d: Column, span: Column, ratios: Column, least: Column) -> Column:
            hit = lambda i: (F.get(ratios, i) <= least) & (F.get(ratios, i) < PROTECTED)
            draw = lambda i: part(F.get(d, F.get(span, i)), 2)
            drawn = lambda i: number(F.get(d, i), 3) % (self.vocabulary - self.special) + self.special
            put = lambda x, i: F.when(~hit(i), x.cast("long")).when(draw(i) < bound(self.random_share), drawn(i)).when(draw(i) >= bound(self.random_share + self.kept_share), F.lit(self.mask_id).cast("long")).otherwise(x.cast("long"))
            return F.struct(F.transform(ids, put).alias("inputs"), F.transform(ids, lambda x, i: F.when(hit(i), x.cast("long")).otherwise(F.lit(IGNORED).cast("long"))).alias("labels"))

        return F.when(F.size(ids) > 0, let(digests, lambda d: let(spans(d), lambda span: whole(d, span))))


def windows(tokens: DataFrame, position: str, value: str, size: int) -> DataFrame:
    """(window, ids) of the whole windows of a stream of (position from 0, value); the remainder is left out."""
    dealt = tokens.groupBy(F.floor(F.col(position) / size).alias("window")).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("t"))
    return dealt.where(F.size("t") == size).select("window", F.col(f"t.{value}").alias("ids"))
