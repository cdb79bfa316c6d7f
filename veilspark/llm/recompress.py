"""Passages that repeat across documents, found by recompression of the token sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import name, whole
from .wordhash import STEP, mix, small, word_hashes

WINDOW = 50
LEVELS = 3
#: Words of a symbol at most, and words at either end of a window whose names may depend on
#: what lies outside it: one word for the run and one for the pair of the first level, then the
#: length of one symbol per level.
MOST = 1 << LEVELS
EDGE = 2 + sum(1 << k for k in range(1, LEVELS))
NONE = np.uint64((1 << 64) - 1)
RUN = np.uint64(0x8EBC6AF09C88C6E3)


def parse(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, lengths and first words of the symbols of the last level.

    Names are global, as they are functions of the names below: a word that equals a neighbour
    is renamed as part of a run, and two symbols become one where the coin of the left one's
    name falls 0 and the right one's 1. So equal word sequences get equal symbols, but for
    ``EDGE`` words at either end.
    """
    names, starts = hashes.copy(), np.arange(len(hashes))
    lengths = np.ones(len(hashes), dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    together = (names[:-1] == names[1:]) & (text[:-1] == text[1:])
    runs = np.zeros(len(names), dtype=bool)
    runs[:-1] |= together
    runs[1:] |= together
    names = np.where(runs, mix(names ^ RUN), names)
    for level in range(1, LEVELS + 1):
        coin = mix(names + np.uint64(level * int(STEP) % (1 << 64))) & np.uint64(1)
        joins = (coin[:-1] == 0) & (coin[1:] == 1) & (text[:-1] == text[1:])
        left = np.flatnonzero(joins)
        names[left] = mix(names[left] * STEP + names[left + 1] + np.uint64(level))
        lengths[left] += lengths[left + 1]
        stay = np.ones(len(names), dtype=bool)
        stay[left + 1] = False
        names, lengths, starts, text = names[stay], lengths[stay], starts[stay], text[stay]
    return names, lengths, starts


def _slide(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each ``width`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = join(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return join(values[: len(values) - rest], values[rest:]) if rest else values


def signs(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window start, the symbol that stands for the window: a longest one inside it.

    It is chosen among the symbols that no word outside the window can change, so equal windows
    have equal signs. Starts too close to the end of all words have none.
    """
    names, lengths, starts = parse(hashes, first)
    values = np.full(len(hashes), NONE, dtype=np.uint64)
    values[starts] = ((np.uint64(MOST) - lengths.astype(np.uint64)) << np.uint64(60)) | (
        mix(names) >> np.uint64(4)
    )
    inner = window - 2 * EDGE - MOST + 1
    if len(values) < window:
        return values[:0]
    return _slide(values[EDGE:], inner, np.minimum)[: len(hashes) - window + 1]


def window_hashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """An order-dependent hash of each window of words."""
    if len(hashes) < window:
        return hashes[:0]
    span, power, have, offset = 1, hashes, None, 0
    while span <= window:
        if window & span:
            part = power[offset:]
            if have is None:
                have = part
            else:
                size = min(len(have), len(part))
                have = mix(have[:size] * STEP + part[:size])
            offset += span
        if 2 * span <= window:
            power = mix(power[: len(power) - span] * STEP + power[span:] + np.uint64(span))
        span *= 2
    return have[: len(hashes) - window + 1]


def label(words: np.ndarray) -> int:
    """A hash of a whole word sequence."""
    placed = mix(words + mix(np.arange(1, len(words) + 1, dtype=np.uint64)))
    return int(np.bitwise_xor.reduce(placed).view(np.int64)) if len(words) else 0


def _described(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            hashes, first = word_hashes(batch.column(2))
            marks = signs(hashes, first, window)
            labels, found = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                labels.append(label(hashes[a:b]))
                found.append(np.unique(marks[a : max(a, b - window + 1)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(first)),
                    pa.array(labels, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["doc", "key", "n", "cls", "signs"],
            )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            hashes, first = word_hashes(batch.column(2))
            marks, whole_windows = signs(hashes, first, window), window_hashes(hashes, window)
            rows, starts, found = [], [], []
            for i, shared in enumerate(batch.column(3).to_numpy(zero_copy_only=False)):
                a, b = int(first[i]), int(first[i + 1]) - window + 1
                hits = np.flatnonzero(np.isin(marks[a : max(a, b)].view(np.int64), shared))
                rows.append(np.full(len(hits), i))
                starts.append(hits)
                found.append(whole_windows[a + hits])
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate(starts).astype(np.int32)),
                    pa.array(np.concatenate(found).view(np.int64)),
                ],
                names=["doc", "key", "start", "window"],
            )

    return run


def covered(starts: np.ndarray, window: int, count: int) -> np.ndarray:
    """Which of ``count`` items lie in a window that begins at one of the starts."""
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, count), -1)
    return np.cumsum(change[:-1]) > 0


def _kept(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            counts, removed, digests, kept_texts = [], [], [], []
            starts = batch.column(3).to_numpy(zero_copy_only=False)
            for i, copy in enumerate(batch.column(2).to_pylist()):
                words = texts[i].as_py().split()
                kept = words
                if copy:
                    kept = []
                elif starts[i] is not None:
                    gone = covered(np.asarray(starts[i]), window, len(words))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_texts.append(joined.decode())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            arrays.append(pa.array(digests, pa.string()))
            names = ["key", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def repeats(docs: DataFrame, text: str, key: str, window: int) -> Stored:
    """Rows that lose words: doc (a hash of key and text), copy, starts of the repeated windows."""
    source = _source(docs, text, key)
    kind = source.schema["key"].dataType.simpleString()
    base = store(
        source.mapInArrow(
            _described(window), f"doc long, key {kind}, n long, cls long, signs array<long>"
        )
    )
    classes = base.df.groupBy("cls").agg(F.min("key").alias("least"), F.count("*").alias("members"))
    rows = lookup_join(base.df.where(F.col("n") >= window), store(classes, "members"), ["cls"], "members", ["doc"])
    behind = (F.col("key") > F.col("least")) | (F.col("key").isNull() & F.col("least").isNotNull())
    rows = store(rows.withColumn("copy", F.coalesce(behind, F.lit(False)))).df
    marks = rows.where(~F.col("copy")).select("doc", F.explode("signs").alias("sign"))
    often = marks.groupBy("sign").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = marks.join(often.where("low < high").select("sign"), "sign").distinct()
    wanted = store(
        shared.groupBy("doc").agg(F.collect_list("sign").alias("signs")).withColumn("weight", F.lit(1)), "weight"
    )
    texts = lookup_join(source, wanted, ["doc"], "weight", ["doc"], "inner").select("doc", "key", "body", "signs")
    found = store(
        texts.mapInArrow(_windows(window), f"doc long, key {kind}, start int, window long")
    ).df
    least = found.groupBy("window").agg(
        F.min("key").alias("least"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    repeated = found.join(least.where("low < high").select("window", "least"), "window").where(
        (F.col("key") > F.col("least")) | (F.col("key").isNull() & F.col("least").isNotNull())
    )
    parts = repeated.groupBy("doc").agg(F.collect_set("start").alias("starts"))
    gone = parts.select("doc", F.lit(False).alias("copy"), "starts").unionAll(
        rows.where("copy").select("doc", "copy", F.lit(None).cast("array<int>")).distinct()
    )
    return store(gone.withColumn("weight", F.lit(1)), "weight")


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    plain = docs.select(name(key).alias("key"), whole(name(text)).alias("body"))
    return plain.select(F.xxhash64("key", "body").alias("doc"), "key", "body")


def dedup_passages(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    keep_text: bool = False,
) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_sha256; and ``kept_text`` if wanted.

    Removes each word that lies in a window of ``window`` words whose sequence also starts in a
    row with a smaller key, judged on the input. Null texts have no words. Equal keys, repeated
    rows too, do not remove each other's words; a null key comes after all others. Kept words are
    joined by one space. Other columns are not read; an empty table gives no rows.

    Rows that equal one with a smaller key go whole and take no further part. Every window of
    the others is represented by a high symbol of its parse, its sign; windows whose sign no
    other row has cannot repeat. For the rest, hashes of the whole windows are compared, which
    verifies the repeat word by word (64 bits). Signs and windows are aggregated before they are
    joined back, so a passage that a third of the rows share is no hot task.
    """
    if window < 2 * EDGE + MOST:
        raise ValueError(f"a window has {2 * EDGE + MOST} words at least")
    source = _source(docs, text, key)
    kind = source.schema["key"].dataType.simpleString()
    joined = lookup_join(source, repeats(docs, text, key, window), ["doc"], "weight", ["doc"])
    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string"
    rows = joined.select("key", "body", "copy", "starts")
    return rows.mapInArrow(_kept(window, keep_text), schema + (", kept_text string" if keep_text else ""))
