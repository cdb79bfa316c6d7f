"""Hashes of words and of word windows, for a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; texts beyond it are cut between words, so a batch stays small.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def small(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22):
    """The batches cut to about ``most`` bytes of text each, as several numbers per word are held."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits (a finaliser of three xor-shifts)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_table = [np.ones(1, dtype=np.uint64)] * 2


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from a worker's one table, which grows as needed."""
    if len(_table[0]) < size:
        length = 1 << (size - 1).bit_length()
        for i, base in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            table = np.full(length, base, dtype=np.uint64)
            table[0] = 1
            _table[i] = np.cumprod(table, out=table)
    return _table[0][:size], _table[1][:size]


def _hash(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of some bytes, and their hashes. Bytes 0-based; words are maximal."""
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rising, falling = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    weighed = letters[data].astype(np.uint64)
    weighed += np.uint64(1)
    weighed *= rising[: len(data)]
    np.cumsum(weighed, out=sums[1:])
    found = (sums[ends] - sums[starts]) * falling[starts]
    return starts, mix(found + (ends - starts).astype(np.uint64) * STEP)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and per text its first word's index (one more at
    the end). Words are runs of bytes other than the six white-space bytes; null has none."""
    letters = LOWER if lower else AS_IS
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    hashes, firsts, total = [], [np.zeros(1, dtype=np.int64)], 0
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK)) - 1)
        until = min(until, len(texts))
        part = data[offsets[at] : offsets[until]]
        if until == at + 1 and len(part) > CHUNK:
            own = [h for _, h in (_hash(piece, letters) for piece in _at_spaces(part))]
            found = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
            firsts.append(np.array([total + len(found)]))
        else:
            bounds = offsets[at : until + 1] - offsets[at]
            spaced, shift = _apart(part, bounds)
            starts, found = _hash(spaced, letters)
            firsts.append(total + np.searchsorted(starts, bounds[1:] + shift[1:]))
        hashes.append(found)
        total += len(found)
        at = until
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), np.concatenate(firsts)


def _apart(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space after each text, and how far each bound has moved."""
    shift = np.arange(len(bounds), dtype=np.int64)
    spaced = np.insert(part, bounds[1:], np.uint8(32))
    return spaced, shift


def _at_spaces(part: np.ndarray):
    """Pieces of a long text, cut between words where it has any."""
    at = 0
    while at < len(part):
        end = min(len(part), at + CHUNK)
        while end < len(part) and not IS_SPACE[part[end]]:
            ahead = np.flatnonzero(IS_SPACE[part[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(len(part), end + CHUNK)
        yield part[at:end]
        at = end


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive words; those across texts are included."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    found = hashes[:count].copy()
    for k in range(1, width):
        found = found * STEP + hashes[k : k + count]
    return mix(found)
