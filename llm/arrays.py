"""Array code for tasks: texts as byte arrays, words, rolling hashes, packed entries.

A polynomial hash modulo 2**64 with an odd base has an inverse base, so the hash
of every span is a difference of prefix sums times an inverse power: all words
or windows of a few megabytes of text are hashed by a handful of array steps.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a task needs about 60 times as much memory.
CHUNK_BYTES = 1 << 20
#: Bytes that end a word: space and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base, out = BASES[which], []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * powers(len(values) + 1, which)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Scrambled hashes of the spans [start, end), from prefix()."""
    x = sums[end] - sums[start]
    x *= powers(len(sums), which)[1][start]
    return mix(x)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and each row's offsets; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text; a longer text is a slice of its own.

    At the end the worker gives back memory that it holds but doesn't use: workers
    live on, and an executor's limit is for all of them.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word (one more at the end)."""
    solid = ~SPACES[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(prefix(data.astype(U64) + U64(1)), start, end)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n items inside one row, and their rows."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - before[row] + first[:-1][row], row


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as [start, end) rows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window [s, s + width)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """An even bucket by the upper half of each hash; the lower half stays free to tell entries apart."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def pack_by(bucket: np.ndarray, n: int, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """For each bucket in use, its part of each column as bytes, in the given order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = {k: v[order] for k, v in columns.items()}
    for b in np.flatnonzero(np.diff(cuts)):
        a, z = cuts[b], cuts[b + 1]
        yield int(b), {k: v[a:z].tobytes() for k, v in columns.items()}


def unpack(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All blobs of a column as one array, and the number of items from each."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x is not None]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    """Differences as int32; they compress well."""
    return np.diff(sorted_values, prepend=0).astype(np.int32)
