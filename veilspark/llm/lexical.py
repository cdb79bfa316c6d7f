"""Ranked lexical search, reversed: documents stream through an inverted index over the items."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import partition_count, store
from .common import name, whole
from .heaps import merge_heaps, row_blocks
from .wordhash import small

#: Maximal runs of ASCII letters, ASCII digits and all other code points.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores held at a time by a task.
CELLS = 1 << 20
COUNTS = "key bigint, n bigint, terms array<int>, times array<bigint>"
HEAP = "item bigint, run bigint, key bigint, score bigint"


def _byte_table() -> np.ndarray:
    """Per byte what a term holds in its place: a space for separators, small letters."""
    table = np.arange(256, dtype=np.uint8)
    letters = np.isin(table, np.frombuffer((UPPER + LOWER + "0123456789").encode(), np.uint8))
    return np.where(letters | (table >= 128), table + 32 * ((table >= 65) & (table <= 90)), 32).astype(np.uint8)


BYTES = _byte_table()


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order (empty strings between them), and where each text begins."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    plain = [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(BYTES[data].tobytes())]
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), plain))
    return split.flatten(), np.asarray(split.offsets).astype(np.int64)


def _counts(vocabulary):
    """Per document its number of terms, and how often it has each term of the vocabulary."""

    def run(batches):
        known = vocabulary.value
        for batch in small(batches, 1):
            terms, bounds = term_lists(batch.column(1))
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(terms)) > 0)])
            totals = sizes[bounds[1:]] - sizes[bounds[:-1]]
            place = np.asarray(pc.fill_null(pc.index_in(terms, value_set=known), -1)).astype(np.int64)
            hits = np.flatnonzero(place >= 0)
            row = np.searchsorted(bounds, hits, side="right") - 1
            cells, times = np.unique(row * len(known) + place[hits], return_counts=True)
            row, place = np.divmod(cells, max(1, len(known)))
            firsts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            listed = [
                pa.ListArray.from_arrays(firsts, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(firsts, pa.array(times.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals.astype(np.int64)), *listed], ["key", "n", "terms", "times"]
            )

    return run


class _Heaps:
    """The best k documents of each item, as far as a task has come."""

    def __init__(self, items: int, k: int):
        self.least, self.k = np.ones(items, dtype=np.int64), k
        self.rows = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64)]

    def take(self, scores: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` has a row per item and a column per document."""
        if scores.shape[1] >= self.k:
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.least = np.maximum(self.least, kth)
        item, doc = np.nonzero(scores >= self.least[:, None])
        found = [item, scores[item, doc], missing[doc], keys[doc]]
        rows = [np.concatenate(pair) for pair in zip(self.rows, found)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(rows[0])) - first
        self.rows = [r[place < self.k] for r in rows]
        full = place == self.k - 1
        self.least[rows[0][full]] = np.maximum(self.least[rows[0][full]], rows[1][full])


def _stream(index, k: int, cells: int):
    """Documents' term counts through the index, into one heap per item of the task."""

    def run(batches):
        numbers, firsts, postings, weights, documents, length = index.value
        heaps = _Heaps(len(numbers), k)
        width = max(1, cells // max(1, len(numbers)))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                key, n, terms, times = part.columns
                counts = np.diff(np.asarray(terms.offsets).astype(np.int64))
                row = np.repeat(np.arange(len(counts)), counts)
                term, tf = np.asarray(terms.flatten()), np.asarray(times.flatten()).astype(np.int64)
                m = 75 + (25 * np.asarray(n).astype(np.int64) * documents) // length
                gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                scores = np.zeros((len(numbers), len(counts)), dtype=np.int64)
                order = np.argsort(term, kind="stable")
                cuts = np.flatnonzero(np.diff(term[order])) + 1
                for held in np.split(order, cuts):
                    if len(held):
                        own = slice(firsts[term[held[0]]], firsts[term[held[0]] + 1])
                        scores[postings[own][:, None], row[held]] += weights[own][:, None] * gain[held]
                heaps.take(scores, np.asarray(key.is_null()), np.asarray(key.fill_null(0)).astype(np.int64))
        item, score, missing, keys = heaps.rows
        run_id = np.full(len(item), TaskContext.get().partitionId(), dtype=np.int64)
        columns = [pa.array(numbers[item]), pa.array(run_id), pa.array(keys, mask=missing), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "run", "key", "score"])

    return run


def _index(block: pa.Table):
    """The vocabulary of a block of postings, and per term its items with their counts."""
    terms = block.column("term").combine_chunks().dictionary_encode()
    place = np.asarray(terms.indices).astype(np.int64)
    order = np.argsort(place, kind="stable")
    numbers, item = np.unique(np.asarray(block.column("item")), return_inverse=True)
    firsts = np.searchsorted(place[order], np.arange(len(terms.dictionary) + 1))
    return terms.dictionary, numbers, firsts, item[order], np.asarray(block.column("times"))[order]


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item_key, rank, key, score.

    Terms are the matches of ``TERM`` with A-Z lower-cased, null has none. With N documents that
    hold a term, L terms in all, n terms in the document and df documents that hold the term, a
    term weighs w = floor(1000 ln((2N+2)/(2df+1))), the document's measure is
    m = 75 + 25nN div L, and its score sums w * (10^9 tf div (1000 tf + 12 m)) over the item's
    terms, repeats included. Equal scores rank by ascending key (an integer column), null last.

    Repeated items and repeated documents are rows of their own. Items without terms, documents
    without terms and empty tables give no rows. Other columns are not read.

    The items' terms are an inverted index, broadcast in blocks of bounded bytes; a document is
    read once per block, its counts of the index's terms are stored, and these stream through the
    postings into heaps of at most k documents per item and task, which are merged in rounds.
    """
    spark = docs.sparkSession
    lowered = F.translate(whole(name(item_text)), UPPER, LOWER)
    asked = store(
        items.select(F.monotonically_increasing_id().alias("item"), name(item_key).alias("item_key"), lowered.alias("t"))
    ).df
    listed = F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))
    postings = asked.select("item", listed.alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    postings = store(postings).df
    source = docs.select(name(key).cast("bigint").alias("key"), name(text).cast("string").alias("body"))
    found = []
    for block in row_blocks(postings, "item", F.octet_length("term").cast("bigint") + 24):
        vocabulary, numbers, firsts, item, times = _index(block)
        shared = spark.sparkContext.broadcast(vocabulary)
        counted = store(
            source.mapInArrow(_counts(shared), COUNTS),
            documents=F.count(F.when(F.col("n") > 0, 1)),
            length=F.sum("n"),
        )
        documents, length = counted.size["documents"], max(1, counted.size["length"])
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        for row in counted.df.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_batches():
            frequency[np.asarray(row.column(0))] = np.asarray(row.column(1))
        weigh = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()]
        weights = np.repeat(np.array(weigh, dtype=np.int64), np.diff(firsts)) * times
        index = spark.sparkContext.broadcast((numbers, firsts, item, weights, documents, length))
        hits = counted.df.where(F.size("terms") > 0)
        heaps = hits.mapInArrow(_stream(index, k, CELLS), HEAP)
        order = [F.desc("score"), F.asc_nulls_last("key")]
        found.append(merge_heaps(heaps, "item", order, k, partition_count(counted.df)))
    if not found:
        found = [spark.createDataFrame([], "item bigint, key bigint, score bigint, rank int")]
    best = reduce(DataFrame.unionAll, found)
    return best.join(asked.select("item", "item_key"), "item").select("item_key", "rank", "key", "score")
