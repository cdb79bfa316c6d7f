"""Repeated byte strings, found by suffix sorting with hashed comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import name, whole
from .recompress import _slide
from .wordhash import BASE, STEP, _powers, mix, small

LENGTH = 400
#: Bytes looked at together; the place of a byte fits in the low bits of a comparison key.
CHUNK = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
HALF = (1 << 31) - 1
#: Occurrences of a sign above which its windows are compared as rows, not within one task.
HOT = 10_000
#: Bytes of contexts that a task sorts, and that it holds hashes of at a time.
TASK_BYTES = 1 << 23
PART_BYTES = 1 << 19
#: Bytes of common prefixes compared at a time.
VERIFY_BYTES = 1 << 18


def gram_of(length: int) -> int:
    """Bytes of the part that stands for a string: a power of two, about a third of it."""
    return 1 << ((length // 3).bit_length() - 1)


def marks(data: np.ndarray, length: int = LENGTH):
    """Runs of string starts that share their sign: first start, last start, place, sign.

    The sign of a string is its least hashed gram, the leftmost of equals, so equal strings have
    equal signs at equal offsets.
    """
    starts = len(data) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if starts <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    hashes = mix(data.astype(np.uint64) + STEP)
    span, gram = 1, gram_of(length)
    while span < gram:
        hashes = hashes[: len(hashes) - span] * BASE + (hashes[span:] ^ np.uint64(span))
        hashes ^= hashes >> np.uint64(29)
        span *= 2
    hashes = mix(hashes)
    keys = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = _slide(keys, length - gram + 1, np.minimum)[:starts]
    turn = np.flatnonzero(np.diff(least)) + 1
    first, last = np.append(0, turn), np.append(turn, starts) - 1
    place = (least[first] & PLACE).astype(np.int64)
    return first, last, place, hashes[place]


def _pieces(data: np.ndarray, length: int):
    """A text in pieces that overlap by one string less a byte, and where each begins."""
    at = 0
    while True:
        yield at, data[at : at + CHUNK + length - 1]
        at += CHUNK
        if at + length > len(data):
            return


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) for t in column.cast(pa.large_binary())]


def _signs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            found = []
            for data in _texts(batch.column(1)):
                own = [marks(part, length)[3] for _, part in _pieces(data, length)]
                found.append(np.concatenate(own).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc", "signs"]
            )

    return run


def _contexts(length: int):
    """Per place of a sign that has a shared half: the bytes of all strings that it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            docs, out = [], {n: [] for n in ("sign", "start", "count", "place", "context")}
            for row, (data, shared) in enumerate(
                zip(_texts(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
            ):
                for at, part in _pieces(data, length):
                    first, last, place, sign = marks(part, length)
                    own = sign.view(np.int64)
                    for i in np.flatnonzero(np.isin(own & HALF, shared)).tolist():
                        docs.append(row)
                        out["sign"].append(own[i])
                        out["start"].append(at + first[i])
                        out["count"].append(last[i] - first[i] + 1)
                        out["place"].append(place[i] - first[i])
                        out["context"].append(part[first[i] : last[i] + length].tobytes())
            arrays = [batch.column(0).take(pa.array(docs, pa.int64()))]
            arrays += [pa.array(out[n], pa.int64()) for n in ("sign", "start", "count", "place")]
            arrays.append(pa.array(out["context"], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", *out])

    return run


class Hashed:
    """Polynomial hashes of the substrings of concatenated contexts, from those of the prefixes.

    Powers count from the start of a context, so their table is as long as the longest one.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data = data
        longest = int(sizes.max()) if len(sizes) else 0
        rising, self.falling = _powers(longest + 1)
        ends = np.cumsum(sizes)
        self.inner = np.arange(len(data), dtype=np.int32)
        self.inner -= np.repeat((ends - sizes).astype(np.int32), sizes)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        weighed = rising[self.inner]
        weighed *= data + np.uint64(1)
        np.cumsum(weighed, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        within = self.inner[np.minimum(start, len(self.inner) - 1)]
        return (self.sums[start + length] - self.sums[start]) * self.falling[within]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.of(a, middle) == self.of(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low


def suffix_order(text: Hashed, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` (of ``size`` bytes) within ascending groups, by mergesort.

    Runs of a group merge in pairs: a suffix's place is its place in its run and the number of
    smaller ones in the other, which a binary search counts. Two suffixes are compared by the
    byte after their common prefix.
    """
    count = len(at)
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    order, width = np.arange(count), 1
    widest = int((end - begin).max()) if count else 0
    while width < widest:
        place = np.arange(count)
        inner = place - begin
        run = begin + inner // width * width
        right = (inner // width) % 2 == 1
        other = np.where(right, run - width, np.minimum(run + width, end))
        stop = np.where(right, run, np.minimum(other + width, end))
        low, high = other.copy(), stop.copy()
        while (open_ := low < high).any():
            rows = np.flatnonzero(open_)
            middle = (low[rows] + high[rows]) // 2
            x, y = order[rows], order[middle]
            most = np.minimum(size[x], size[y])
            same = text.common(at[x], at[y], most)
            ended = same == most
            mine, theirs = (np.minimum(at[i] + same, len(text.data) - 1) for i in (x, y))
            less = np.where(ended, size[y] < size[x], text.data[theirs] < text.data[mine])
            equal = ended & (size[x] == size[y])
            before = less | (equal & right[rows])
            low[rows] = np.where(before, middle + 1, low[rows])
            high[rows] = np.where(before, high[rows], middle)
        base = np.where(right, run - width, run)
        merged = base + (place - run) + (low - other)
        moved = np.empty(count, dtype=np.int64)
        moved[merged] = order
        order, width = moved, 2 * width
    return order


def _verify(text: Hashed, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> None:
    """Cut the lengths ``same`` of common prefixes, in place, at the first bytes that differ."""
    step = np.arange(int(same.sum())) - np.repeat(np.cumsum(same) - same, same)
    unlike = text.data[np.repeat(a, same) + step] != text.data[np.repeat(b, same) + step]
    if unlike.any():
        pair = np.repeat(np.arange(len(same)), same)[unlike]
        np.minimum.at(same, pair, step[unlike])


def _longest(text: Hashed, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per suffix its longest common prefix with another of its group: that with a neighbour in
    sorted order. Each is verified byte by byte, and cut where hashes had agreed by chance."""
    best = np.zeros(len(at), dtype=np.int64)
    if len(at) < 2:
        return best
    order = suffix_order(text, at, size, group)
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum(size[a], size[b]), 0)
    same = text.common(at[a], at[b], most)
    ends = np.cumsum(same)
    cuts = np.searchsorted(ends, np.arange(VERIFY_BYTES, int(ends[-1]), VERIFY_BYTES)) + 1
    for x, y in pairwise(np.unique([0, *cuts.tolist(), len(same)]).tolist()):
        _verify(text, at[a[x:y]], at[b[x:y]], same[x:y])
    np.maximum.at(best, a, same)
    np.maximum.at(best, b, same)
    return best


def repeated(rows: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Ranges of string starts (doc, start, stop) that occur again among the contexts' strings.

    ``rows`` are whole signs. The extensions to the right and left of the signs, from a suffix
    sort each way, leave few starts that can repeat; of those the whole strings are compared.
    """
    rows = rows.sort_values(["sign", "doc", "start"], kind="stable").reset_index(drop=True)
    sizes = rows["context"].map(len).to_numpy()
    _, group = np.unique(rows["sign"].to_numpy(), return_inverse=True)
    part = np.cumsum(sizes) // PART_BYTES
    part = np.maximum.accumulate(part[np.searchsorted(group, group, "left")]) if len(part) else part
    found = [_repeated(own, length) for _, own in rows.groupby(part, sort=True)]
    return pd.concat(found) if found else pd.DataFrame({"doc": [], "start": [], "stop": []}, dtype="int64")


def _repeated(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    sizes = rows["context"].map(len).to_numpy()
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(rows["context"]), np.uint8)
    _, group = np.unique(rows["sign"].to_numpy(), return_inverse=True)
    place, count = rows["place"].to_numpy(), rows["count"].to_numpy()
    text = Hashed(data, sizes)
    right = _longest(text, begins + place, sizes - place, group)
    turned = Hashed(data[::-1], sizes[::-1])
    left = _longest(turned, len(data) - begins - place, place, group)
    del turned
    # A string that starts k bytes before the sign needs k equal bytes to the left.
    low = np.maximum(0, place - left)
    high = np.minimum(count - 1, place + right - length)
    width = np.maximum(0, high - low + 1)
    stops = np.cumsum(width)
    total = int(stops[-1]) if len(stops) else 0
    owner = np.repeat(np.arange(len(rows)), width)
    inner = np.arange(total) - np.repeat(stops - width - low, width)
    value = mix(text.of(begins[owner] + inner, length)) ^ mix(group[owner].astype(np.uint64))
    order = np.lexsort((inner, value))
    again = value[order][1:] == value[order][:-1]
    twice = np.zeros(total, dtype=bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    owner, inner = owner[twice], inner[twice]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(inner) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner))[: len(head)] - 1
    docs, starts = rows["doc"].to_numpy(), rows["start"].to_numpy()
    return pd.DataFrame(
        {
            "doc": docs[owner[head]],
            "start": starts[owner[head]] + inner[head],
            "stop": starts[owner[head]] + inner[tail] + length,
        },
        dtype="int64",
    )


def _strings(length: int):
    """All strings of the contexts of hot signs, as rows: hundreds per context, so in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4, PART_BYTES):
            counts = batch.column(3).to_numpy(zero_copy_only=False)
            values, starts = [], []
            for i, data in enumerate(_texts(batch.column(4))):
                inner = np.arange(counts[i])
                values.append(mix(Hashed(data, np.array([len(data)])).of(inner, length)))
                starts.append(inner + batch.column(2)[i].as_py())
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate([*values, none.astype(np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([*starts, none])),
                ],
                names=["doc", "sign", "value", "start"],
            )

    return run


def _hot_ranges(rows: DataFrame, length: int) -> DataFrame:
    """The same for signs with very many places: strings are counted before they are shuffled, and
    the counts joined back so that one string in very many places is no hot task."""
    strings = rows.select("doc", "sign", "start", "count", "context").mapInArrow(
        _strings(length), "doc long, sign long, value long, start long"
    )
    often = store(strings.groupBy("sign", "value").agg(F.count("*").alias("n")).where("n > 1"), "n")
    again = lookup_join(strings, often, ["sign", "value"], "n", ["doc", "start"], "inner")
    return again.select("doc", "start", (F.col("start") + length).alias("stop"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of each text as maximal runs, in order: a few, where signs have thousands."""
    for batch in batches:
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        start, stop = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        reach = np.maximum.accumulate(stop[order] + (owner << 40))
        new = np.ones(len(owner), dtype=bool)
        new[1:] = start[1:] + (owner[1:] << 40) > reach[:-1]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(owner))[: len(head)] - 1
        runs = pa.StructArray.from_arrays(
            [pa.array(start[head]), pa.array(reach[tail] - (owner[tail] << 40))], names=["start", "stop"]
        )
        firsts = np.searchsorted(owner[head], np.arange(len(lists) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(firsts), runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc", "spans"])


def spans_of(docs: DataFrame, text: str, key: str, length: int) -> Stored:
    """Rows that lose bytes: doc (a hash of key and text), copied, spans (start, stop)."""
    source = _source(docs, text, key).where(F.octet_length("body") >= length)
    texts = source.groupBy("text").agg(F.min("doc").alias("only"), F.count("*").alias("members"))
    texts = store(texts, "members").df
    # One row of each text takes part; the others, and it, are removed whole if there are others.
    one = texts.select(F.col("only").alias("doc"), F.lit(1).alias("weight"))
    parts = lookup_join(source, store(one, "weight"), ["doc"], "weight", ["doc"], "inner")
    signs = store(
        parts.select("doc", "body").mapInArrow(_signs(length), "doc long, signs array<long>")
    ).df
    # A row that occurs twice with one key is one doc here.
    signs = signs.dropDuplicates(["doc"]).select("doc", F.explode("signs").alias("sign"))
    often = store(signs.groupBy("sign").agg(F.count("*").alias("n")).where("n > 1")).df
    # Half of a sign tells the shared ones of a text; the join below drops what is told by chance.
    half = F.col("sign").bitwiseAND(F.lit(HALF)).cast("int")
    shared = signs.join(often, "sign").groupBy("doc").agg(F.collect_set(half).alias("signs"))
    shared = _counted(shared.withColumn("weight", F.lit(1)), "signs", 4)
    held = lookup_join(source, shared, ["doc"], "weight", ["doc"], "inner").dropDuplicates(["doc"])
    contexts = held.select("doc", "body", "signs").mapInArrow(
        _contexts(length),
        "doc long, sign long, start long, count long, place long, context binary",
    )
    contexts = store(
        contexts.join(often, "sign"), held=F.sum(F.length("context")), hot=F.max("n")
    )
    tasks = max(1, int(contexts.size["held"]) // TASK_BYTES)
    cool = contexts.df.where(F.col("n") <= HOT)
    cool = cool.withColumn("task", F.pmod(F.xxhash64("sign"), F.lit(tasks)))
    ranges = cool.groupBy("task").applyInPandas(
        lambda rows: repeated(rows, length), "doc long, start long, stop long"
    )
    if contexts.size["hot"] > HOT:
        ranges = ranges.unionAll(_hot_ranges(contexts.df.where(F.col("n") > HOT), length))
    spans = ranges.groupBy("doc").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    spans = spans.mapInArrow(_merged, "doc long, spans array<struct<start:long,stop:long>>")
    copied = texts.where("members > 1").select("text", "members")
    ids = lookup_join(source.select("doc", "text"), store(copied, "members"), ["text"], "members", ["doc"], "inner")
    gone = ids.select("doc", F.lit(True).alias("copied")).distinct()
    answer = spans.join(gone, "doc", "full").select(
        "doc", F.coalesce("copied", F.lit(False)).alias("copied"), "spans", F.lit(1).alias("weight")
    )
    return _counted(answer, "spans", 16)


def _counted(rows: DataFrame, lists: str, width: int) -> Stored:
    """A stored table whose size has ``width`` bytes for each element of a column of arrays, as it
    decides on a broadcast."""
    table = store(rows, "weight", elements=F.sum(F.greatest(F.size(lists), F.lit(0))))
    table.size["bytes"] += width * table.size["elements"]
    return table


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    plain = docs.select(name(key).alias("key"), whole(name(text)).alias("body"))
    same = F.unhex(F.sha2("body", 256)).alias("text")
    return plain.select(F.xxhash64("key", "body").alias("doc"), "key", "body", same)


def _kept(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, parts, digests, kept_bytes = [], [], [], [], []
            spans = batch.column(3).to_pylist()
            for i, (data, copied) in enumerate(zip(_texts(batch.column(1)), batch.column(2).to_pylist())):
                merged: list[list[int]] = [[0, len(data)]] if copied else []
                for span in [] if copied else sorted((s["start"], s["stop"]) for s in spans[i] or []):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept, at, raw = [], 0, data.tobytes()
                for start, stop in merged:
                    kept.append(raw[at:start])
                    at = stop
                rest = b"".join([*kept, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                parts.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_bytes:
                    kept_bytes.append(rest)
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, parts)]]
            arrays.append(pa.array(digests, pa.string()))
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                arrays.append(pa.array(kept_bytes, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def dedup_substrings(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    keep_bytes: bool = False,
) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256; and ``kept``.

    Removes each byte of the UTF-8 text that lies in a string of ``length`` bytes which also
    starts elsewhere, in this row or another, judged on the input. Null texts are empty. Texts
    that occur twice, repeated rows too, go whole; keys do not matter. Other columns are not
    read; an empty table gives no rows.

    Of equal texts one takes part. Every string has a sign, its least hashed gram; strings whose
    sign stands nowhere else cannot repeat. The bytes around the places of the other signs meet
    by sign, so any two equal strings meet. There the suffixes from the signs on are sorted by
    mergesort, comparing by the hashes of prefixes and binary search; the common extensions to
    the right, and by the reversed bytes to the left, are verified byte by byte and bound which
    strings can repeat, and the hashes of these are compared. A sign with very many places is
    split: its strings are counted as rows.
    """
    if length < 3:
        raise ValueError("a string has 3 bytes at least")
    source = _source(docs, text, key)
    kind = source.schema["key"].dataType.simpleString()
    joined = lookup_join(source, spans_of(docs, text, key, length), ["doc"], "weight", ["doc"])
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = joined.select("key", "body", "copied", "spans")
    return rows.mapInArrow(_kept(keep_bytes), schema + (", kept binary" if keep_bytes else ""))
