"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are folded (lower case, other than letters and digits
to one space). An item of m bytes is in a text when some region of it is within
e = 10 % of m edits. By the q-gram lemma such a region shares at least
m + 1 - q * (e + 1) of the item's q-grams with it, all on e + 1 adjacent diagonals
(place in the text minus place in the item). Diagonals are grouped in bands of
twice that width that overlap by half, so one band holds them all: bands with
too few shared q-grams are dropped, and the rest are aligned by a dynamic
programme over the band alone. q is 8, or m / (e + 1) for short items, so that
the lemma always asks for a shared q-gram; items of each q have an index.

The benchmark's q-gram index is broadcast in blocks of a fixed size, a few
blocks in each pass over the texts; the texts are not shuffled. A benchmark of
one pass marks the texts as they go by. Of a larger one each pass writes only
the hits, which are few, and ends there, so no task holds more than one pass's
blocks; the hits of all passes join the texts once, by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import arrays as A
from llm.storage import join_checked, stored

Q = 8
#: Bytes of item text in one broadcast index, which takes about 40 times as much.
BLOCK_BYTES = 1 << 20
#: Blocks searched in one pass over the texts.
PASS_BLOCKS = 4
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_solid = np.zeros(256, bool)
_solid[48:58] = _solid[97:123] = _solid[128:] = True


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, each row's offsets, and the place of each byte in the lower-cased text."""
    data, offsets = A.text_bytes(pc.utf8_lower(texts.cast(pa.string())))
    solid = _solid[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first other byte after a word is its space
    keep[offsets[:-1][offsets[:-1] < len(data)]] = solid[offsets[:-1][offsets[:-1] < len(data)]]
    out = np.where(solid, data, 32)[keep].astype(np.uint8)
    place = np.concatenate(([0], np.cumsum(keep)))
    return out, place[offsets], np.flatnonzero(keep)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each place as one number."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out |= data[i : i + n].astype(np.uint64) << A.U64(8 * i)
    return out


def gram_size(m: int, rate: float) -> int:
    """The longest q up to 8 for which an item of m bytes with all its edits shares a q-gram."""
    return min(Q, m // (int(m * rate) + 1))


def indexes(items: list[tuple[int, str]], rate: float) -> list[Index]:
    """An index for each size of q-grams that a block's items need; items without letters and digits have none."""
    by_size: dict[int, list[tuple[int, str]]] = {}
    data, offsets, _ = fold(pa.array([t for _, t in items], pa.string()))
    for item, a, z in zip(items, offsets[:-1], offsets[1:]):
        if m := len(data[a:z].tobytes().rstrip(b" ")):
            by_size.setdefault(max(1, gram_size(m, rate)), []).append(item)
    return [Index(some, rate, q) for q, some in sorted(by_size.items())]


class Index:
    """The q-grams of a block of items, sorted, and a table of bits to drop most of a text at once."""

    def __init__(self, items: list[tuple[int, str]], rate: float, q: int = Q):
        self.ids, self.q = [i for i, _ in items], q
        data, offsets, _ = fold(pa.array([t for _, t in items], pa.string()))
        self.items = [data[a : z - (z > a and data[z - 1] == 32)] for a, z in zip(offsets[:-1], offsets[1:])]
        self.edits = np.array([int(len(x) * rate) for x in self.items])
        self.needed = np.array([len(x) + 1 - q * (e + 1) for x, e in zip(self.items, self.edits)])
        # a band is 2 * 2**shift diagonals wide and starts every 2**shift, so it holds any e + 1 of them
        self.shift = np.array([int(e).bit_length() for e in self.edits])
        parts = [(grams(x, q), np.full(max(0, len(x) - q + 1), i), np.arange(max(0, len(x) - q + 1))) for i, x in enumerate(self.items) if self.needed[i] > 0]
        gram = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0, np.int64)
        self.at = np.concatenate([p[2] for p in parts])[order] if parts else np.zeros(0, np.int64)
        self.unique, self.first = np.unique(self.gram, return_index=True)
        self.first = np.append(self.first, len(self.gram))
        self.bits = max(10, len(self.gram).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.slot(self.gram)] = True

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * A.U64(A.BASES[0])) >> A.U64(64 - self.bits)

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, first diagonal of the band) of the bands with enough shared q-grams."""
        gram = grams(data, self.q)
        place = np.flatnonzero(self.seen[self.slot(gram)])
        found = np.searchsorted(self.unique, gram[place])
        same = self.unique[np.minimum(found, len(self.unique) - 1)] == gram[place] if len(self.unique) else np.zeros(0, bool)
        place, found = place[same], found[same]
        row = np.searchsorted(offsets, place, "right") - 1
        inside = place + self.q <= offsets[row + 1]
        place, found, row = place[inside], found[inside], row[inside]
        times = self.first[found + 1] - self.first[found]
        which = np.repeat(self.first[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        row = np.repeat(row, times)
        item = self.item[which]
        diagonal = np.repeat(place - offsets[row[np.cumsum(times) - times]] if len(place) else place, times) - self.at[which]
        shift = self.shift[item]
        size = 1 << 31
        band = (diagonal + (1 << 40) >> shift) - ((1 << 40) >> shift)
        out = []
        group = row * len(self.items) + item
        key = np.concatenate([group, group]) * size + np.concatenate([band, band - 1]) + (size >> 1)
        every = np.sort(key)
        new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        bands, count = every[new], np.diff(np.append(new, len(every)))
        full = bands[count >= self.needed[bands // size % max(1, len(self.items))]]
        # a place of the item counts once, however often a repetitive text has its q-gram in the band
        inside = np.isin(key, full)
        once = np.unique(np.searchsorted(full, key[inside]) << 32 | np.tile(self.at[which], 2)[inside]) >> 32
        full = full[np.bincount(once, minlength=len(full)) >= self.needed[full // size % max(1, len(self.items))]]
        group, band = full // size, full % size - (size >> 1)
        for g, b, i in zip(group, band, group % max(1, len(self.items))):
            out.append((int(g // len(self.items)), int(i), int(b) << int(self.shift[i])))
        return out

    def align(self, texts: list[np.ndarray], items: list[int], lows: list[int]) -> list[tuple[int, int, int]]:
        """(edits, start, end) of each item's best region with its path in the band of diagonals from low, all bands at once."""
        spread = np.array([(2 << int(self.shift[i])) + 2 * int(self.edits[i]) + 1 for i in items])
        sizes = np.array([len(self.items[i]) for i in items])
        width, length = int(spread.max()), int(sizes.max())
        low = np.array(lows) - self.edits[items]
        rows = np.arange(len(items))
        seg = np.zeros((len(items), length + width), np.uint8)  # 0 is no folded byte
        want = np.full((len(items), length), 255, np.uint8)
        ends = np.array([len(t) for t in texts])
        for r, (t, i, at) in enumerate(zip(texts, items, low)):
            part = t[max(0, at) : max(0, at + length + width)]
            seg[r, max(0, -at) : max(0, -at) + len(part)] = part
            want[r, : sizes[r]] = self.items[i]
        steps = np.arange(width, dtype=np.int32)
        big = np.int32(1 << 20)
        j = low[:, None] + steps
        cost = np.where((j >= 0) & (j <= ends[:, None]) & (steps < spread[:, None]), 0, big).astype(np.int32)
        start = j.copy()
        out: list[tuple[int, int, int]] = [(1 << 30, 0, 0)] * len(items)
        edge, none = np.full((len(items), 1), big, np.int32), np.zeros((len(items), 1), start.dtype)
        for k in range(length + 1):
            for r in rows[sizes == k]:
                at = int(np.argmin(cost[r]))
                out[r] = (int(cost[r, at]), int(start[r, at]), int(low[r] + at + k))
            if k == length:
                break
            here = seg[:, k : k + width]
            diag = np.where(here == 0, big, cost + (here != want[:, k : k + 1]))
            up = np.hstack((cost[:, 1:], edge)) + 1  # this byte of the item is missing in the text
            best = np.minimum(diag, up)
            begin = np.where(up < diag, np.hstack((start[:, 1:], none)), start)
            # more bytes in the text: each step to the right costs one
            run = np.minimum.accumulate(best - steps, axis=1)
            source = np.maximum.accumulate(np.where(best - steps == run, steps, 0), axis=1)
            j = low[:, None] + steps + k + 1
            cost = np.where((j >= 0) & (j <= ends[:, None]) & (steps < spread[:, None]), run + steps, big)
            start = np.take_along_axis(begin, source, axis=1)
        return out


def _place(text: bytes, item: bytes) -> int:
    """Where the item stands in the text, -1 if nowhere; an item shorter than 8 bytes only as whole words."""
    return text.find(item) if len(item) >= Q else (b" " + text + b" ").find(b" " + item + b" ")


def _hits(index: Index, texts: pa.Array) -> list[list[dict]]:
    """An item that stands in a text unchanged has no edits; the other bands are aligned."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    data, offsets, _ = fold(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    todo = []
    looked: dict[tuple[int, int], int] = {}
    for row, i, low in index.bands(data, offsets):
        text = data[offsets[row] : offsets[row + 1]]
        if (row, i) not in looked:
            looked[row, i] = _place(text.tobytes(), index.items[i].tobytes())
            if looked[row, i] >= 0:
                best[row, i] = (0, looked[row, i], looked[row, i] + len(index.items[i]))
        if looked[row, i] < 0 and len(index.items[i]) >= Q:
            todo.append((text, i, low, row))
    for at in range(0, len(todo), 256):
        part = todo[at : at + 256]
        for (_, i, _, row), found in zip(part, index.align([x[0] for x in part], [x[1] for x in part], [x[2] for x in part])):
            if found[0] <= index.edits[i] and found < best.get((row, i), (1 << 30,)):
                best[row, i] = found
    for (row, i), (edits, a, z) in sorted(best.items()):
        out[row].append({"item_id": index.ids[i], "start": a, "end": z, "edits": edits})
    return out


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def _all_hits(indexes: list[Index], texts: pa.Array) -> list[list[dict]]:
    return [sorted(chain(*of_row), key=lambda x: x["item_id"]) for of_row in zip(*(_hits(index, texts) for index in indexes))]


def _marked(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, text, 1 << 20):
            found = _all_hits(shared.value, chunk.column(text))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(found, _KIND)], [*chunk.schema.names, "benchmark_hits"])

    return run


def _listed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text", 1 << 20):
            found = pa.array(_all_hits(shared.value, chunk.column("text")), _KIND)
            some = pc.greater(pc.list_value_length(found), 0)
            yield pa.RecordBatch.from_arrays([chunk.column("text_key").filter(some), found.filter(some)], ["text_key", "benchmark_hits"])

    return run


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_BYTES, one block in memory at a time."""
    rows = benchmark.select(F.col(id).cast("long"), F.col(text).cast("string")).where(F.col(id).isNotNull() & F.col(text).isNotNull())
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in rows.toLocalIterator():
        if block and size + len(t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with a column benchmark_hits of (item_id, start, end, edits), by item.

    start and end are places in the folded text; an item counts once in a text,
    at its best region (of equal ones the first to end). Items of fewer than 8
    folded bytes have no edits and are found as whole words; items without letters
    and digits are nowhere. Null texts have no hits, texts are searched whole, and
    a column with the result's name is replaced.
    """
    docs = docs.drop("benchmark_hits").withColumn(text, F.col(text).cast("string"))
    share, none = docs.sparkSession.sparkContext.broadcast, F.expr(f"cast(array() as {HITS})")
    passes = batched(_blocks(benchmark, item_id, item_text), PASS_BLOCKS)
    first, second = next(passes, None), next(passes, None)
    if first is None:
        return docs.withColumn("benchmark_hits", none)
    if second is None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(_marked(share([x for b in first for x in indexes(b, rate)]), text), f"{fields}, benchmark_hits {HITS}")
    key = F.sha2(F.col(text), 256)
    texts = docs.where(F.col(text).isNotNull()).select(key.alias("text_key"), F.col(text).alias("text"))
    found = []
    for blocks in chain([first, second], passes):
        shared = share([x for b in blocks for x in indexes(b, rate)])
        found.append(stored(texts.mapInArrow(_listed(shared), f"text_key string, benchmark_hits {HITS}"), "benchmark-hits"))
        shared.destroy()
    hit = reduce(DataFrame.unionAll, found).select("text_key", F.explode("benchmark_hits").alias("hit"))
    hits = stored(hit.groupBy("text_key").agg(F.array_sort(F.collect_set("hit")).alias("benchmark_hits")), "benchmark-hits")
    joined = join_checked(docs.withColumn("text_key", key), hits, ["text_key"], "left").drop("text_key")
    return joined.withColumn("benchmark_hits", F.coalesce("benchmark_hits", none))
