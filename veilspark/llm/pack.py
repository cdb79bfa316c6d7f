"""Packing into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import store
from .common import name, whole

WINDOW = 2048
END_ID = 1
#: Windows that one group balances: its pieces, a few per window, fit in a task many times over.
GROUP_WINDOWS = 512
#: What is left of a document beyond whole windows is cut into pieces of these sizes.
LEAST_PIECE, MOST_PIECE = 192, 384


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids, for a ``.json`` file of tokenizers or a ``.tiktoken`` rank file.

    Both keep the end-of-text token of the vocabulary when a text holds its name.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )
    return lambda text: fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def cuts(length: int, seed: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Pieces (start, length) of a document: whole windows, then small pieces of mixed sizes.

    Sizes differ from document to document even where lengths repeat, so that differencing has
    opposing imbalances to merge.
    """
    least, most = max(1, LEAST_PIECE * window // WINDOW), max(2, MOST_PIECE * window // WINDOW)
    pieces, at = [], 0
    while length - at >= window:
        pieces.append((at, window))
        at += window
    while at < length:
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        size = min(length - at, least + (seed >> 8) % (most - least))
        pieces.append((at, size))
        at += size
    return pieces


def _pieces(path: str | None, window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from public_tokenizers import path as vocabulary

        encode = encoder(path or vocabulary("byte_bpe_50k.tiktoken"))
        for batch in batches:
            keys = batch.column(0)
            rows, out = [], {n: [] for n in ("start", "length", "ids_crc32", "doc_tokens", "ids")}
            for i, (key, text) in enumerate(zip(keys.to_pylist(), batch.column(1).to_pylist())):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4").tobytes()
                total = len(ids) // 4
                for start, length in cuts(total, zlib.crc32(repr(key).encode()), window):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(i)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(total)
                    if keep_ids:
                        out["ids"].append(part)
            arrays = [keys.take(pa.array(rows, pa.int64()))]
            names = ["start", "length", "ids_crc32", "doc_tokens"]
            arrays += [pa.array(out[n], pa.int64()) for n in names]
            if keep_ids:
                arrays.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *names])

    return run


def _difference(sizes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each size, and the bins' sums, by merging partial partitions.

    A partial partition is one vector of sums, one per bin. It starts as the next ``bins`` sizes
    in falling order; the two with the largest spread merge, large sums onto small ones, until
    one is left. Membership follows the merges back from the last.
    """
    order = np.argsort(-sizes, kind="stable")
    rows = -(-len(sizes) // bins)
    padded = np.zeros(rows * bins, dtype=np.int64)
    padded[: len(sizes)] = sizes[order]
    sums = {i: padded[i * bins : (i + 1) * bins] for i in range(rows)}
    heap = [(-int(v[0] - v[-1]), i) for i, v in sums.items()]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        up, down = np.argsort(sums[a], kind="stable"), np.argsort(-sums[b], kind="stable")
        merged = sums.pop(a)[up] + sums.pop(b)[down]
        number = rows + len(merges)
        merges.append((number, a, up, b, down))
        sums[number] = merged
        heapq.heappush(heap, (-int(merged.max() - merged.min()), number))
    (_, last), (result,) = heap[0], sums.values()
    place = {last: np.arange(bins)}
    for number, a, up, b, down in reversed(merges):
        at = place.pop(number)
        for part, taken in ((a, up), (b, down)):
            place[part] = np.empty(bins, dtype=np.int64)
            place[part][taken] = at
    spots = np.concatenate([place[i] for i in range(rows)])[: len(sizes)]
    found = np.empty(len(sizes), dtype=np.int64)
    found[order] = spots
    return found, result


def balance(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Window of each size; the number of windows rises until none is over capacity."""
    bins = max(1, -(-int(sizes.sum()) // window))
    while True:
        found, sums = _difference(sizes, bins)
        over = int(sums.max())
        if over <= window:
            return found
        bins += 1


def _windows(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", kind="stable").reset_index(drop=True)
        spot = balance(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (int(key[0]) << 20) + spot
        rows = rows.iloc[np.argsort(spot, kind="stable")]
        ends = rows.groupby("sequence_id")["length"].cumsum()
        return rows.assign(offset=ends - rows["length"]).drop(columns=["number", "group"])

    return run


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    tokenizer: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; and ``ids`` (unsigned little-endian 32-bit) if ``keep_ids``.

    A document is its ids and then ``END_ID``; null and empty texts are that id alone. Each id
    lies in one piece, and each row is its own document: repeated rows and null keys are packed
    as often as they occur. A piece of a whole window is a sequence by itself. The others are
    dealt by hash to groups of about ``GROUP_WINDOWS`` windows, whatever document they come
    from, so a very long text or a key with many rows spreads over all groups; each group is
    balanced by differencing in one task. Other columns are not read; an empty table gives no
    rows. ``tokenizer`` is a file that executors can open; by default the public byte-level
    vocabulary, read from its rank file (the same ids as its ``.json`` file).
    """
    source = docs.select(name(key).alias("key"), whole(name(text)).alias("body"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if keep_ids else ""
    pieces = source.mapInArrow(_pieces(tokenizer, window, keep_ids), schema)
    cut = F.col("length") < window
    stored = store(
        pieces.withColumn("number", F.monotonically_increasing_id()),
        rest=F.sum(F.when(cut, F.col("length"))),
    )
    groups = max(1, round(stored.size["rest"] / (window * GROUP_WINDOWS)))
    single = stored.df.where(~cut).withColumn("sequence_id", F.lit(1 << 62) + F.col("number"))
    single = single.withColumn("offset", F.lit(0).cast("bigint")).drop("number")
    group = F.pmod(F.xxhash64("key", "start", "ids_crc32", "number"), F.lit(groups))
    dealt = stored.df.where(cut).withColumn("group", group)
    shared = dealt.groupBy("group").applyInPandas(
        _windows(window), f"{schema}, sequence_id long, offset long"
    )
    return shared.unionByName(single)
