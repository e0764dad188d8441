"""Queries against all passages by a grid of blocks: one matrix product for each pair of a block of queries and one of passages.

Vectors are packed as blocks of rows, so that what is joined are blocks, by the number of a query block; query blocks go to
every task where their counted size allows it, else the pairs are dealt by a shuffle. Within a block pair only what a query
needs leaves: how many passages are nearer than its target and the sum of the others, or its k nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and bytes of query blocks that go to every task.
BLOCK_ROWS, SHARED_BYTES = 1024, 64 << 20
#: Similarities are compared to so many decimals: equal vectors then tie, whatever the order of a sum.
DECIMALS = 9
_BLOCK = "n int, dims int, id binary, target binary, v binary, t binary"


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles; shorter vectors and nulls are filled with zeros."""
    out = np.zeros((len(lists), dims))
    for i, row in enumerate(lists.to_pylist()):
        if row:
            out[i, : len(row)] = row
    return out


def _packed(table: pa.Table | pa.RecordBatch) -> dict:
    sizes = [pc.max(pc.list_value_length(table.column(c))).as_py() or 0 for c in ("v", "t")]
    dims = max(sizes)
    column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
    longs = lambda c: column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
    return {"n": table.num_rows, "dims": dims, "id": longs("id"), "target": longs("target"), "v": _matrix(column("v"), dims).tobytes(), "t": _matrix(column("t"), dims).tobytes()}


_TYPES = {"n": pa.int32(), "dims": pa.int32()}


def _row(found: dict, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([v], type=_TYPES.get(c, pa.int64() if isinstance(v, int) else pa.binary())) for c, v in (found | more).items()})


def _shaped(df: DataFrame) -> DataFrame:
    has = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    return df.select(F.col("id").cast("long").alias("id"), has("target", "long").alias("target"), has("v", "array<double>").alias("v"), has("t", "array<double>").alias("t"))


def passage_blocks(passages: DataFrame) -> DataFrame:
    """Blocks of (id, v), as the rows lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                yield _row(_packed(batch.slice(begin, BLOCK_ROWS)))

    return _shaped(passages).mapInArrow(pack, _BLOCK)


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Numbered blocks of (id, v, target, t), t being the target's vector, dealt by a hash."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(_packed(table), block=int(table.column("block")[0].as_py()))])

    dealt = _shaped(queries).withColumn("block", F.pmod(F.xxhash64("id", "target"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("block").applyInArrow(pack, f"{_BLOCK}, block long")


def grid(queries: DataFrame, passages: DataFrame, one: Callable[[dict, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """one's rows for each pair of a query block and a passage block, both as dicts of numpy arrays."""
    n, dims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    q = query_blocks(queries, blocks).select("block", *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "id", "target", "v", "t")])
    hint = F.broadcast if n * max(dims or 0, 1) * 16 <= SHARED_BYTES else lambda df: df
    p = passage_blocks(passages).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                sides = []
                for prefix in ("q_", ""):
                    shape = (row[f"{prefix}n"], row[f"{prefix}dims"])
                    sides.append({c: np.frombuffer(row[prefix + c], np.int64) for c in ("id", "target")} | {c: np.frombuffer(row[prefix + c]).reshape(shape) for c in ("v", "t")})
                yield one(*sides)

    return p.join(hint(q), "block").drop("block").mapInArrow(products, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _fit(m: np.ndarray, dims: int) -> np.ndarray:
    return m[:, :dims] if m.shape[1] >= dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def ranks(queries: DataFrame, passages: DataFrame, prefixes: Sequence[int]) -> DataFrame:
    """(query, dims, rank, hit, others, n): for each query (id, v, target, t) and each number of leading dimensions, one more than
    the passages (id, v) that are strictly nearer than the target, the target's cosine, and the sum and number of the other
    passages' cosines. The passage with the query's id is left out."""

    def one(q: dict, p: dict) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("query", "dims", "above", "hit", "others", "n")}
        counted = (p["id"][None, :] != q["id"][:, None]) & (p["id"][None, :] != q["target"][:, None])
        for d in prefixes:
            own, target, other = _unit(_fit(q["v"], d)), _unit(_fit(q["t"], d)), _unit(_fit(p["v"], d))
            similar = np.round(own @ other.T, DECIMALS)
            hit = np.round(np.einsum("ij,ij->i", own, target), DECIMALS)
            for c, values in zip(out, (q["id"], np.full(len(own), d, np.int32), ((similar > hit[:, None]) & counted).sum(axis=1), hit, (similar * counted).sum(axis=1), counted.sum(axis=1)), strict=True):
                out[c].append(values)
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in out.items()})

    found = grid(queries, passages, one, "query long, dims int, above long, hit double, others double, n long")
    return found.groupBy("query", "dims").agg((1 + F.sum("above")).alias("rank"), F.max("hit").alias("hit"), F.sum("others").alias("others"), F.sum("n").alias("n"))


def metrics(ranked: DataFrame) -> DataFrame:
    """recall_at_1, recall_at_5, mrr, mean_positive, mean_negative and margin by dims, from ranks()."""
    positive, negative = F.avg("hit"), F.sum("others") / F.sum("n")
    at = lambda k: F.avg((F.col("rank") <= k).cast("int"))
    return ranked.groupBy("dims").agg(at(1).alias("recall_at_1"), at(5).alias("recall_at_5"), F.avg(1 / F.col("rank")).alias("mrr"), positive.alias("mean_positive"), negative.alias("mean_negative"), (positive - negative).alias("margin"))


def nearest(queries: DataFrame, passages: DataFrame, k: int, excluded: bool = True) -> DataFrame:
    """(query, neighbour, cosine, place): the k passages (id, v) nearest to each query (id, v), equal ones by ascending id. With
    excluded, the passage with the query's id is left out."""

    def one(q: dict, p: dict) -> pa.RecordBatch:
        d = max(q["v"].shape[1], p["v"].shape[1])
        similar = np.round(_unit(_fit(q["v"], d)) @ _unit(_fit(p["v"], d)).T, DECIMALS)
        if excluded:
            similar[p["id"][None, :] == q["id"][:, None]] = -np.inf
        # all that reach the kth of the block, ties too
        least = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(len(similar), -2.0)
        row, column = np.nonzero(similar >= np.maximum(least, -2.0)[:, None])
        value, ids = similar[row, column], p["id"][column]
        order = np.lexsort((ids, -value, row))
        row, value, ids = row[order], value[order], ids[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.RecordBatch.from_pydict({"query": pa.array(q["id"][row[kept]]), "neighbour": pa.array(ids[kept]), "cosine": pa.array(value[kept])})

    found = grid(queries, passages, one, "query long, neighbour long, cosine double")
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
