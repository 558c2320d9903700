"""Words and word shingles of many texts at once, as 64-bit hashes, by array operations on the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of a string up to which it is hashed by array operations.
LONG = 64
WHITE, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads its input over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and where each row starts, one end more; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def block_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = LONG) -> np.ndarray:
    """A 64-bit hash of each string raw[starts:ends]. Eight bytes at a time go through a bijection that is not linear, so that strings of up to eight bytes and of equal length never share a hash and no pattern of longer ones cancels; strings of more than most bytes go through BLAKE2."""
    lengths = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix(U(BASE) + lengths.astype(U))
    live = np.flatnonzero((lengths > 0) & (lengths <= most))
    at = 0
    while len(live):
        left = lengths[live] - at
        block = eight[starts[live] + at]
        short = left < 8
        block[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        out[live] = mix(out[live] ^ block)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(lengths > most).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased, split at ASCII white space) of all rows, and each row's first word, one end more."""
    raw, offsets = bytes_of(column)
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    blank = WHITE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | first[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | first[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return block_hashes(LOWER[raw], begins, ends), np.searchsorted(begins, offsets)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of all rows, ascending within a row, and each row's first, one end more. A row of fewer words has its whole sequence as one; a row without words, none."""
    hashes, first = word_hashes(column)
    counts = np.diff(first)
    n = len(hashes)
    whole = np.full(max(0, n - k + 1), k, U)
    for j in range(k):
        whole = mix(whole ^ hashes[j : j + len(whole)])
    made = np.maximum(counts - k + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(counts)), made)
    start = np.arange(ends[-1]) - ends[:-1][rows] + first[:-1][rows]
    out = np.zeros(ends[-1], U)
    long_ = counts[rows] >= k
    out[long_] = whole[start[long_]]
    for i in np.flatnonzero(~long_):
        s, c = start[i], counts[rows[i]]
        one = np.array([c], U)
        for j in range(c):
            one = mix(one ^ hashes[s + j])
        out[i] = one[0]
    keep = np.ones(len(out), bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[ends[:-1][made > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about most_bytes, one row at least."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).cumsum()
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
