"""Vector bin packing of documents into shards, balancing bytes, tokens and rows jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, gapless, text_or_empty

#: Bytes that a stored row takes besides its text.
ROW_BYTES = 16
#: Groups larger than 1 part in BUNDLES of a shard are packed by themselves; smaller ones are hashed to as many bundles.
#: So the packing sees 3 * shards * BUNDLES vectors at most, whatever the input.
BUNDLES = 256
#: What a unit of relative imbalance counts for each component (bytes, tokens, rows): first jointly, then, since equal
#: bytes are what is promised, mainly in bytes.
WEIGHTS = np.array([[1.0, 1.0, 1.0], [1.0, 0.01, 0.01]])


def pack_vectors(loads: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of each load vector (rows of loads): largest first, to where its dot product with the
    residual capacity is highest; ties go to the lower bin. Then single vectors move while that evens the bins out."""
    total = loads.sum(axis=0)
    scaled = loads / np.where(total > 0, total, 1)
    residual = np.full((n_bins, loads.shape[1]), 1.0 / n_bins)
    bins = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -scaled.max(axis=1))):
        best = int(np.argmax(residual @ scaled[i]))
        bins[i] = best
        residual[best] -= scaled[i]
    for weights in WEIGHTS:
        evened(scaled, bins, n_bins, weights[: loads.shape[1]])
    return bins


def evened(scaled: np.ndarray, bins: np.ndarray, n_bins: int, weights: np.ndarray) -> None:
    """Moves vectors between bins, in place. Of the pairs of bins that lie farthest apart in a component, a turn makes the
    move of one vector, or where none helps the exchange of two, that lowers the weighted squares of all components'
    deviations most; it ends when none does."""
    held = np.zeros((n_bins, scaled.shape[1]))
    np.add.at(held, bins, scaled)
    members = [list(np.flatnonzero(bins == b)) for b in range(n_bins)]
    for _ in range(64 * n_bins):
        apart = [(int(held[:, c].argmax()), int(held[:, c].argmin())) for c in range(scaled.shape[1])]
        best = None
        for swaps in (False, True):
            for high, low in apart:
                own = np.array(members[high], dtype=np.int64)
                back = np.array(members[low], dtype=np.int64)
                if high == low or not len(own) or (swaps and not len(back)):
                    continue
                x = scaled[own][:, None] - (scaled[back][None] if swaps else 0.0)
                # what the squares change by when x goes from high to low
                gain = (2 * x * (x - (held[high] - held[low])) * weights).sum(axis=-1)
                i, j = np.unravel_index(int(gain.argmin()), gain.shape)
                if gain[i, j] < -1e-16 and (best is None or gain[i, j] < best[0]):
                    best = (gain[i, j], high, low, int(own[i]), int(back[j]) if swaps else None)
            if best:
                break
        if best is None:
            return
        _, high, low, gone, come = best
        for i, a, b in ((gone, high, low), (come, low, high)):
            if i is not None:
                members[a].remove(i)
                members[b].append(i)
                held[a] -= scaled[i]
                held[b] += scaled[i]
                bins[i] = b


def assign_shards(docs: DataFrame, n_shards: int = 40, bundles: int = BUNDLES) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes and ROW_BYTES), text_crc32, shard, slot.

    Equal texts form a group, which stays in one shard unless it is larger than a shard's even part; such a group is
    dealt out in the fewest even pieces that fit. Larger groups and pieces are packed each by itself, small groups in
    bundles by a hash; only these load vectors (bytes, tokens, rows), of bounded number, reach the driver. Slots run
    from 0 without gaps in each shard. Null texts count as empty; rows with null or repeated doc_id each get a
    slot of their own; an empty table gives an empty result; other columns of docs, of any name, are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("group"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    scratch = Scratch(spark, "shard")
    base = scratch.save(base, "rows")
    sums = base.agg(F.sum("size"), F.count("*")).first()
    even = (sums[0] or 0) / n_shards
    # the sizes of groups above 1 part in `bundles` of a shard: n_shards * bundles of them at most
    groups = base.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * bundles > even)
    large = scratch.save(groups.select("group", F.when(F.col("bytes") > even, F.ceil(F.col("bytes") / F.lit(max(1.0, even)))).otherwise(1).alias("pieces")), "large")
    # at most n_shards groups are split; their rows are numbered, so that pieces have as many rows each
    split = large.where("pieces > 1")
    marked = base.join(F.broadcast(large), "group", "left")
    plain = F.concat_ws("/", F.lit("b"), F.pmod(F.col("group"), F.lit(n_shards * bundles)))
    bundle = F.when(F.col("pieces").isNull(), plain).otherwise(F.concat_ws("/", F.lit("g"), "group"))
    bundled = marked.where("pieces IS NULL OR pieces = 1").withColumn("bundle", bundle)
    counts = {r["group"]: r["count"] for r in base.join(F.broadcast(split), "group").groupBy("group").count().collect()}
    if counts:
        numbered = gapless(marked.where("pieces > 1"), "group", F.col("row"), ["row"], sums[1], "place")
        of = F.element_at(F.create_map(*[F.lit(x).cast("long") for g in counts.items() for x in g]), F.col("group"))
        piece = F.floor(F.col("place") * F.col("pieces") / of)
        bundled = bundled.unionByName(numbered.withColumn("bundle", F.concat_ws("/", F.lit("g"), "group", piece)).drop("place"))
    loads = bundled.groupBy("bundle").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).toPandas()
    loads = loads.sort_values("bundle", ignore_index=True)
    bins = pack_vectors(loads[["b", "t", "r"]].to_numpy(dtype=float), n_shards)
    chosen = spark.createDataFrame(list(zip(loads["bundle"].tolist(), bins.tolist(), strict=True)), "bundle string, shard int")
    placed = bundled.join(F.broadcast(chosen), "bundle").select("doc_id", "size", "text_crc32", "shard", "row")
    return gapless(placed, "shard", F.col("row"), ["doc_id", "text_crc32", "row"], sums[1]).select("doc_id", "size", "text_crc32", "shard", "slot")
