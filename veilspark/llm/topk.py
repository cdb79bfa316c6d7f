"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import partition_count, store
from .common import name
from .heaps import merge_heaps, row_blocks

#: Dimensions accumulated before the survivors are compacted.
DIMS = 16
#: Candidates held in vertical layout at first (they fill the heaps) and at most, and queries
#: compared with them at a time.
FIRST, ROWS, QUERIES = 256, 4096, 256
LEAST = np.iinfo(np.int64).min
HEAP = "query bigint, query_key bigint, run bigint, key bigint, score bigint"


def _quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Number, key and whole-number components of the vectors that take part."""
    source = vectors.select(name(key).cast("bigint").alias("key"), name(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    source = source.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    numbered = source.select(F.monotonically_increasing_id().alias("number"), "key", whole.alias("v"))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size("v"), F.lit(1)))).cast("bigint")
    return numbered.where(F.forall("v", lambda x: x.between(-most, most)))


def _matrices(table: pa.Table | pa.RecordBatch):
    """Per vector length: the vectors in vertical layout, their keys (null masked) and numbers."""
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    keys = table.column("key")
    missing = np.asarray(keys.is_null())
    plain = np.asarray(keys.fill_null(0)).astype(np.int64)
    numbers = np.asarray(table.column("number")).astype(np.int64)
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        found = flat[offsets[rows][:, None] + np.arange(length)] if length else np.zeros((len(rows), 0), np.int64)
        yield int(length), np.ascontiguousarray(found.T), plain[rows], missing[rows], numbers[rows]


def _rest(columns: np.ndarray, cuts: range) -> np.ndarray:
    """Per cut, the length of each vector from that dimension on: its remaining mass."""
    squares = columns.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[cut:].sum(axis=0)) for cut in cuts])


class _Block:
    """Queries of one length, dimensions in order of their mass, and a heap of k rows for each."""

    def __init__(self, columns, keys, missing, numbers, k):
        mass = (columns.astype(np.float64) ** 2).sum(axis=1)
        self.order = np.argsort(-mass, kind="stable")
        self.columns = columns[self.order]
        self.cuts = range(0, len(columns), DIMS) if len(columns) else range(1)
        self.rest = _rest(self.columns, self.cuts)
        self.peak = int(np.abs(columns).max(initial=0))
        self.keys, self.missing, self.numbers, self.k = keys, missing, numbers, k
        count = len(keys)
        self.scores = np.full((count, k), LEAST)
        self.found = np.zeros((count, k), dtype=np.int64)
        self.found_missing = np.ones((count, k), dtype=bool)

    def take(self, columns, keys, missing, numbers):
        """Compare candidates with all queries and keep the best of each."""
        columns = columns[self.order]
        exact = self.peak * int(np.abs(columns).max(initial=0)) * max(1, len(columns)) < 1 << 53
        kind, slack = (np.float64, 1.0) if exact else (np.int64, 4096.0)
        rest, columns = _rest(columns, self.cuts), columns.astype(kind)
        for at in range(0, len(self.keys), QUERIES):
            some = slice(at, at + QUERIES)
            queries = self.columns[:, some].astype(kind)
            partial = queries[:DIMS].T @ columns[:DIMS]
            for i in range(queries.shape[1]):
                self._one(at + i, queries[:, i], partial[i], columns, rest, slack, keys, missing, numbers)

    def _one(self, q, query, scores, columns, rest, slack, keys, missing, numbers):
        least = self.scores[q, -1]
        alive = np.flatnonzero(numbers != self.numbers[q])
        scores = scores[alive]
        for step, cut in enumerate(self.cuts):
            if step:
                block = slice(cut, cut + DIMS)
                scores = scores + query[block] @ columns[block, alive]
            if least > LEAST and step + 1 < len(self.cuts):
                bound = self.rest[step + 1, q] * rest[step + 1, alive] * (1 + 1e-9) + slack
                stay = scores + bound >= float(least)
                alive, scores = alive[stay], scores[stay]
        scores = scores.astype(np.int64)
        stay = scores >= least if least > LEAST else slice(None)
        alive, scores = alive[stay], scores[stay]
        if not len(alive):
            return
        real = self.scores[q] > LEAST
        scores = np.concatenate([self.scores[q][real], scores])
        found = np.concatenate([self.found[q][real], keys[alive]])
        none = np.concatenate([self.found_missing[q][real], missing[alive]])
        best = np.lexsort((found, none, -scores))[: self.k]
        self.scores[q, : len(best)], self.found[q, : len(best)] = scores[best], found[best]
        self.found_missing[q, : len(best)] = none[best]

    def rows(self, run: int) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores > LEAST)
        columns = [
            pa.array(self.numbers[query]),
            pa.array(self.keys[query], mask=self.missing[query]),
            pa.array(np.full(len(query), run, dtype=np.int64)),
            pa.array(self.found[query, place], mask=self.found_missing[query, place]),
            pa.array(self.scores[query, place]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["query", "query_key", "run", "key", "score"])


def _search(shared, k: int, width: int, most: int):
    def run(batches):
        blocks = {length: _Block(*parts, k) for length, *parts in _matrices(shared.value)}
        held = width
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                for length, *parts in _matrices(batch.slice(at, held)):
                    if length in blocks:
                        blocks[length].take(*parts)
                at, held = at + held, min(2 * held, most)
        for block in blocks.values():
            yield block.rows(TaskContext.get().partitionId())

    return run


def top_k(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 10,
    scale: int = 1024,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """For each query row the ``k`` other rows of highest inner product: exact, ties to smaller keys.

    Components become ``floor(scale * x)``. ``is_query`` turns the key, an integer
    column, into a condition. Columns of the result: query (the row's number), query_key, rank, key, score.

    Vectors that are null or hold a null or non-finite component take no part, nor do those with
    a component so large that a score might not be a long (beyond ``sqrt(2^62 / length)`` once
    scaled). Vectors of different lengths are not compared. A query's own row is left out; other
    rows with its key are candidates. A null key is no query, and last among ties. Repeated rows
    are rows of their own. Other columns are not read; an empty table gives no rows.

    Queries are broadcast in blocks of bounded bytes, each against all rows. A task holds its
    candidates by dimension, adds up a few dimensions of most mass at a time, and goes on only with
    candidates whose sum and remaining mass (by Cauchy and Schwarz) can still reach the query's
    k-th best. It returns at most k rows per query; the heaps are merged in rounds.
    """
    table = store(_quantised(vectors, key, vector, scale)).df
    asked = table.where(F.coalesce(is_query(F.col("key")), F.lit(False)))
    heaps = []
    for block in row_blocks(asked, "number", F.size("v").cast("bigint") * 8 + 24):
        shared = table.sparkSession.sparkContext.broadcast(block)
        heaps.append(table.mapInArrow(_search(shared, k, FIRST, ROWS), HEAP))
    if not heaps:
        return table.sparkSession.createDataFrame([], f"{HEAP}, rank int").drop("run")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    runs = partition_count(table) * len(heaps)
    return merge_heaps(reduce(DataFrame.unionAll, heaps), "query", order, k, runs)
