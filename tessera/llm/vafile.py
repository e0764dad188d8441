"""Exact top-k search by vector-approximation files.

Vectors are packed in blocks. A block is a vector-approximation file by itself: each dimension is cut into cells of equal
depth, a vector is its cells (4 bits a dimension), and only the cells are scanned. The bounds of its cells bound a
vector's distance to a query from below; distance is the negative inner product here, so they bound the score from above.
Exact vectors are read in the order of these bounds, until the kth result is certain: no unread vector's bound reaches it.

What was certain in a block is the floor of the next one, so a task reads ever fewer exact vectors. Rankings of the tasks
are merged by query. All arithmetic is on integers, in float64 products as long as no sum can reach 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batch_rows, bounded_batches
from tessera.llm.topk import ANY, NAMED, UNNAMED, Best

#: Vectors of a block, cells of a dimension, queries that are held against a block at once.
BLOCK_ROWS, CELLS, QUERY_TILE = 4096, 16, 512
#: Blocks that a task reads at once.
BATCH_BLOCKS = 8
#: Bytes of queries that go to every task at once; more queries take more passes over the index.
PASS_BYTES = 32 << 20
_BLOCK = "n int, dims int, width int, ids binary, states binary, marks binary, codes binary, exact binary"


def as_integers(vector: str = "embedding") -> F.Column:
    """floor(64 x) of every component; null for a vector that is null or holds a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("long")))


def cells_of(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, cells) of a block: the least value of each cell by dimension and, last, the greatest value; the cell of each
    component. Cells of a dimension hold as many of the block's vectors as each other, but for ties."""
    n = len(exact)
    ordered = np.sort(exact, axis=0)
    marks = ordered[[*(c * n // CELLS for c in range(CELLS)), n - 1]]
    cells = np.zeros(exact.shape, dtype=np.uint8)
    for mark in marks[1:CELLS]:
        cells += exact >= mark
    return marks, cells


def bounds_of(marks: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value that a component can have by its cell. Components are integers, so a cell ends one
    below the next one's mark."""
    greatest = np.concatenate([marks[1:CELLS] - 1, marks[CELLS:]])
    across = np.arange(cells.shape[1])
    return marks[:CELLS][cells, across], greatest[cells, across]


def _padded(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    for i, (begin, size) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        out[i, :size] = flat[begin : begin + size]
    return out


def _packed(ids: list[pa.Array], vectors: list[pa.ListArray]) -> pa.RecordBatch:
    names, lists = pa.concat_arrays(ids), pa.concat_arrays(vectors)
    dims = int(np.diff(lists.offsets.to_numpy()).max())
    exact = _padded(lists, dims)
    marks, cells = cells_of(exact)
    even = np.pad(cells, ((0, 0), (0, dims % 2)))
    least = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not exact.size or (np.iinfo(t).min <= exact.min() and exact.max() <= np.iinfo(t).max))
    state = np.where(names.is_null().to_numpy(zero_copy_only=False), UNNAMED, NAMED).astype(np.int8)
    row = {
        "n": len(exact), "dims": dims, "width": np.dtype(least).itemsize,
        "ids": names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "states": state.tobytes(),
        "marks": marks.tobytes(), "codes": (even[:, 0::2] << 4 | even[:, 1::2]).tobytes(), "exact": exact.astype(least).tobytes(),
    }
    types = {"n": pa.int32(), "dims": pa.int32(), "width": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([v], type=types.get(c, pa.binary())) for c, v in row.items()], names=list(row))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    vectors: list[pa.ListArray] = []
    held = 0
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            part = batch.slice(begin, BLOCK_ROWS - held)
            ids.append(part.column(0))
            vectors.append(part.column(1))
            held, begin = held + part.num_rows, begin + part.num_rows
            if held == BLOCK_ROWS:
                yield _packed(ids, vectors)
                ids, vectors, held = [], [], 0
    if held:
        yield _packed(ids, vectors)


def index(rows: DataFrame, copies: int) -> DataFrame:
    """Blocks of (id, v) rows. Of equal vectors those with the least ids stay, as many as a ranking has places: the others
    come after them for every query. Each task sheds them before the shuffle, so no vector is too frequent for one task."""
    equal = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    kept = rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= copies).select("id", "v")
    return kept.mapInArrow(_pack, _BLOCK)


class Block:
    """An index row: cells, ids, and exact vectors that are turned into integers only where they are read."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.dims = dims
        self.ids, self.states = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["states"], dtype=np.int8)
        self.marks = np.frombuffer(row["marks"], dtype=np.int64).reshape(CELLS + 1, dims)
        self.exact = np.frombuffer(row["exact"], dtype=f"i{row['width']}").reshape(n, dims)
        pairs = np.frombuffer(row["codes"], dtype=np.uint8).reshape(n, (dims + 1) // 2)
        self.cells = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(n, -1)[:, :dims]

    def search(self, queries: np.ndarray, best: Best) -> int:
        """Brings the rankings up to date with this block; returns how many exact vectors were read."""
        dims = min(self.dims, queries.shape[1])
        low, high = (b[:, :dims] for b in bounds_of(self.marks, self.cells))
        top = int(max(np.abs(queries).max(initial=0), 1)) * int(max(abs(int(low.min(initial=0))), abs(int(high.max(initial=0))), 1)) * max(dims, 1)
        if top >= 2**63 - 1:
            raise OverflowError("scores of these vectors do not fit a long")
        kind = np.float64 if top < 2**53 else np.int64
        seen = -np.inf if kind is np.float64 else ANY - 1
        low, high, read = low.T.astype(kind), high.T.astype(kind), 0
        for begin in range(0, len(queries), QUERY_TILE):
            q = queries[begin : begin + QUERY_TILE, :dims]
            bound = np.maximum(q, 0).astype(kind) @ high + np.minimum(q, 0).astype(kind) @ low
            step = 2 * best.k
            while True:
                open_ = bound >= best.floor(slice(begin, begin + len(q)))[:, None]
                n = open_.sum(axis=1)
                if not n.any():
                    break
                # the highest bounds first; queries with few vectors left read them all
                rows, cols = np.nonzero(open_ & (n <= step)[:, None])
                many = np.flatnonzero(n > step)
                if len(many):
                    first = np.argpartition(bound[many], -step, axis=1)[:, -step:]
                    rows, cols = np.concatenate([rows, np.repeat(many, step)]), np.concatenate([cols, first.ravel()])
                score = np.einsum("ij,ij->i", self.exact[cols, :dims].astype(np.int64), q[rows])
                best.add(begin + rows, score, self.ids[cols], self.states[cols])
                bound[rows, cols] = seen
                read += len(rows)
                step *= 2
        return read


def _pass(blocks: DataFrame, queries: pa.Table, dims: int, places: int) -> DataFrame:
    """(qid, score, id) of the best of each task, for a bounded number of queries."""
    qids = queries.column("qid").to_numpy()
    lists = queries.column("v").combine_chunks()
    matrix = _padded(lists if isinstance(lists, pa.ListArray) else lists.chunk(0), dims)
    sent = blocks.sparkSession.sparkContext.broadcast((qids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = sent.value
        best = Best(len(qids), places)
        for batch in batches:
            for row in batch.to_pylist():
                Block(row).search(matrix, best)
        query, score, ids, named = best.held()
        for begin in range(0, len(query), 65_536):
            at = slice(begin, begin + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(qids[query[at]]), pa.array(score[at]), pa.array(ids[at], mask=~named[at])], names=["qid", "score", "id"])

    return blocks.mapInArrow(search, "qid long, score long, id long")


def search(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of the greatest inner product with each query, from queries and rows of (id long, v array<long>).

    Returns (query_id, rank from 1, vec_id, score), all candidates if there are fewer; equal scores rank by ascending id.
    A query is a row, too: its own row (one with its id and its vector) is no candidate of its own, any other row is.

    Rows whose v is null take no part; shorter vectors count as filled with zeros; an id of null ranks after the others of
    the same score; queries without an id are not asked. Rows that repeat an id are rows of their own, as candidates and as
    queries. Equal queries are searched once. Scores that could exceed a long raise OverflowError. Empty tables give no
    rows. The index is written to the shared folder and scanned once for each PASS_BYTES of distinct queries.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch, places = Scratch(spark, "vafile"), k + 1
    asked = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    # numbers are fixed once the table is written; an id can stand for several vectors
    classes = scratch.save(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    n, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = scratch.save(index(rows.where("v IS NOT NULL").select("id", "v"), places), "index")
    passes = max(1, -(-n * 8 * max(dims or 1, 1) // PASS_BYTES))
    found = None
    for p in range(passes):
        part = classes if passes == 1 else classes.where(F.pmod(F.xxhash64("v"), F.lit(passes)) == p)
        with batch_rows(spark, BATCH_BLOCKS):
            hits = scratch.save(_pass(blocks, part.select("qid", "v").toArrow(), dims or 0, places), f"hits{p}")
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    ranked = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("best"))

    # distinct queries and their rankings go to every task where they are small; else both are joined by shuffle
    hint = F.broadcast if n * (8 * (dims or 0) + 24 * places) <= PASS_BYTES else lambda df: df
    answers = hint(classes.join(hint(ranked), "qid"))
    named = asked.join(answers, "v")
    self_score = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    own = F.filter("best", lambda b: b["id"].eqNullSafe(F.col("id")) & (b["score"] == F.col("_self")))
    others = F.filter("best", lambda b: F.size("_own").__eq__(0) | (b["place"] != F.col("_own")[0]["place"]))
    rest = named.withColumn("_self", self_score).withColumn("_own", own).select(F.col("id").alias("query_id"), F.slice(others, 1, k).alias("best"))
    out = rest.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
