"""Which texts contain a term of a dictionary of any size, in time linear in the texts.

Shipped to the executors by value, so they need no installation of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The filter has about so many bits per term, two of them set, and at most ``2 ** MOST_BITS``. A
#: fuller filter only lets more windows through to the check.
BITS_PER_TERM, MOST_BITS = 16, 26
#: Bytes of text that a task looks at together.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def text_digest(c: Column) -> Column:
    """Stands for a text wherever rows are moved."""
    return F.unhex(F.sha2(c, 256))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _places(prints: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a fingerprint sets."""
    mixed, mask = _spread(prints + np.uint64(length)), np.uint64((1 << bits) - 1)
    return mixed & mask, (mixed >> np.uint64(32)) & mask


def _powers(count: int) -> np.ndarray:
    powers = np.full(count, BASE, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


class _Rolling:
    """Fingerprints of all windows of some bytes, from sums over their prefixes."""

    def __init__(self, data: np.ndarray):
        self.powers = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Every window's sum, brought to the power of the last: one multiplication each."""
        found = self.sums[length:] - self.sums[:-length]
        return found * self.powers[: len(found)][::-1]


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(BASE), exponent, 1 << 64))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _filter_words(bits: int, size: int):
    """The words of the filter and the bits that terms set there. Terms are fingerprinted as if each
    stood in ``size`` bytes, which the windows are scaled to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            lengths = np.diff(offsets)
            places = []
            for length in np.unique(lengths):
                starts = offsets[:-1][lengths == length]
                rows = data[starts[:, None] + np.arange(length)].astype(np.uint64) + np.uint64(1)
                prints = (rows * _powers(int(length))).sum(axis=1, dtype=np.uint64) * _power(size - int(length))
                places += _places(prints, int(length), bits)
            place = np.unique(np.concatenate(places)) if places else np.zeros(0, np.uint64)
            mask = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"]
            )

    return run


def _windows_through(held, bits: int, size: int, chunk: int):
    """The windows that the filter lets through: the text's digest and the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = held.value
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            data, offsets = _buffers(batch.column(1))
            first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
            for at in range(first, last, chunk):
                part = data[at : min(last, at + chunk + max(lengths) - 1)]
                rolling = _Rolling(part)
                # The windows of a part are scaled to its size; the terms' to the largest.
                scale = _power(size - len(part))
                rows, found = [], []
                for length in lengths:
                    if length > len(part):
                        continue
                    prints = rolling.windows(length)[:chunk] * scale
                    hits = np.ones(len(prints), dtype=bool)
                    for place in _places(prints, length, bits):
                        hits &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    starts = at + np.flatnonzero(hits)
                    row = np.searchsorted(offsets, starts, side="right") - 1
                    inside = starts + length <= offsets[row + 1]
                    rows.append(row[inside])
                    found += [data[s : s + length].tobytes() for s in starts[inside].tolist()]
                rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(found, pa.binary())], ["digest", "term"]
                )

    return run


def digests_containing(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Distinct digests (``text_digest``) of the texts of column ``key`` that contain a ``term``.

    Rolling fingerprints of all windows of the lengths that terms have are held against a filter of
    bounded size, which is built by an aggregate. Only the windows that pass move on, with the
    digest of their text, and are compared with the terms themselves. Texts do not move.
    """
    spark = texts.sparkSession
    terms = terms.where("term <> ''").select(F.col("term").cast("binary").alias("term"))
    sizes = terms.groupBy(F.octet_length("term").alias("length")).count().collect()
    if not sizes:
        return texts.select(text_digest(F.col(key)).alias("digest")).where(F.lit(False))
    lengths = sorted(r["length"] for r in sizes)
    bits = min(MOST_BITS, max(10, (BITS_PER_TERM * sum(r["count"] for r in sizes)).bit_length()))
    size = CHUNK + max(lengths)
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    filled = terms.mapInArrow(_filter_words(bits, size), "word long, mask long")
    for part in filled.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        words[np.asarray(part.column(0))] = np.asarray(part.column(1)).view(np.uint64)
    held = spark.sparkContext.broadcast((words, lengths))
    source = texts.select(text_digest(F.col(key)).alias("digest"), F.col(key))
    windows = source.mapInArrow(_windows_through(held, bits, size, CHUNK), "digest binary, term binary")
    return windows.join(terms, "term", "left_semi").select("digest").distinct()
