"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window. A run
of 50 equal words always holds one whole reference block of the other copy, so
probing the block index with every rolling block of a text finds every repeat.

1. A task hashes all rolling blocks of a chunk of texts and sends each distinct
   hash once to the hash's bucket, with a flag if it is also a reference block.
   Hashes that occur twice in the chunk are hits already.
2. A bucket finds the hashes that are indexed and come from two chunks or more.
3. Only documents with hits are read again. Hits are extended: every window
   around a hit is fingerprinted and goes to its bucket, which keeps the
   smallest document of each fingerprint. Runs of adjacent windows that a
   smaller document has too are the maximal repeats that are removed.

No pair of documents is ever formed, so work grows with the text alone. Entries
are packed arrays; a chunk sends a hot passage once however many of its
documents hold it, so no bucket grows with the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import arrays as A
from llm.storage import join_checked, partitions, small_batches, stored, with_row_key

SENT = "bucket long, chunk long, a binary, b binary, c binary, d binary"
SPANS = "doc_id long, row_key long, spans array<struct<start:int,end:int>>"
sent_schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in "abcd")])
_spans = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def packed_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def chunk_row(number: int, ids: np.ndarray, keys: np.ndarray, first: np.ndarray, local: np.ndarray) -> tuple:
    return (-1 - number, number, ids.tobytes(), keys.tobytes(), first.tobytes(), A.deltas(local).tobytes())


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Chunks with numbers that a task run again gives again."""
    part = TaskContext.get().partitionId() << 32
    for i, chunk in enumerate(A.chunks(batches, "text")):
        yield part + i, chunk


def _probes(buckets: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in numbered(batches):
            data, offsets = A.text_bytes(chunk.column("text"))
            start, end, first = A.words(data, offsets)
            at, row = A.window_starts(first, block)
            hashes = A.spans(A.prefix(A.word_hashes(data, start, end), 1), at, at + block, 1)
            aligned = (at - first[:-1][row]) % block == 0
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(new, len(h)))
            flag = np.maximum.reduceat(aligned[order].astype(np.uint8), new) if len(h) else np.zeros(0, np.uint8)
            local = np.sort(at[order[np.repeat(sizes > 1, sizes)]])
            one = order[new]
            by_place = np.argsort(at[one])
            one, flag = one[by_place], flag[by_place]
            out = [chunk_row(number, _ints(chunk.column("doc_id")), _ints(chunk.column("row_key")), first, local)]
            places = at[one].astype(np.int32)
            for b, x in A.pack_by(A.buckets_of(hashes[one], buckets), buckets, rem=(hashes[one] & A.U64(0xFFFFFFFF)).astype(np.uint32), at=places, flag=flag):
                x["at"] = A.deltas(np.frombuffer(x["at"], np.int32)).tobytes()
                x["flag"] = np.packbits(np.frombuffer(x["flag"], np.uint8)).tobytes()
                out.append((b, number, x["rem"], x["at"], x["flag"], None))
            yield packed_batch(out, sent_schema)

    return run


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, starts of equal runs, and each ordered item's run."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def back(hit: np.ndarray, chunk: np.ndarray, sizes: np.ndarray, places: np.ndarray, key: int) -> list[tuple]:
    """The hit places of each packed entry, as rows for its chunk."""
    out, ends = [], np.cumsum(sizes)
    for c, a, z in zip(chunk, ends - sizes, ends):
        got = places[a:z][hit[a:z]]
        if len(got):
            out.append((key, int(c), None, None, None, A.deltas(got).tobytes()))
    return out


def undelta(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(values.astype(np.int64))
    ends = np.cumsum(sizes)
    base = np.where(ends - sizes > 0, total[np.maximum(ends - sizes - 1, 0)], 0) if len(total) else ends
    return total - np.repeat(base, sizes)


def _match_probes(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["bucket", "chunk", "a", "b", "c", "d"]).cast(sent_schema)
    rem, sizes = A.unpack(table.column("a"), np.uint32)
    places = undelta(A.unpack(table.column("b"), np.int32)[0], sizes)
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("c").to_pylist(), sizes)])
    order, new, run = grouped(rem)
    found = (np.diff(np.append(new, len(rem))) > 1) & (np.maximum.reduceat(flags[order], new) > 0)
    hit = np.zeros(len(rem), bool)
    hit[order] = found[run]
    return pa.Table.from_batches([packed_batch(back(hit, _ints(table.column("chunk")), sizes, places, table.column("bucket")[0].as_py()), sent_schema)])


def per_chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A chunk's ids, row keys, first words, and all its hit places."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["bucket"] < 0)
    places = [np.cumsum(np.frombuffer(r["d"], np.int32).astype(np.int64)) for r in rows if r["d"]]
    ids, keys, first = (np.frombuffer(head[c], np.int64) for c in "abc")
    return ids, keys, first, np.concatenate(places) if places else np.zeros(0, np.int64)


def _split_runs(runs: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    row = np.searchsorted(first, runs[:, 0], "right") - 1
    for r, part in zip(row[(cut := np.flatnonzero(np.diff(row, prepend=-1)))], np.split(runs, cut[1:])):
        yield int(r), part - first[r]


def _candidates(block: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        ids, keys, first, hit = per_chunk(table)
        row = np.searchsorted(first, hit, "right") - 1
        low, high = np.maximum(hit - (window - block), first[row]), np.minimum(hit, first[row + 1] - window)
        step = np.zeros(int(first[-1]) + 2, np.int64)
        ok = low <= high
        np.add.at(step, low[ok], 1)
        np.add.at(step, high[ok] + 1, -1)
        runs = A.runs_of(np.cumsum(step) > 0)
        schema = pa.schema([("row_key", pa.int64()), ("runs", pa.binary())])
        return pa.Table.from_batches([packed_batch([(int(keys[r]), part.astype(np.int32).tobytes()) for r, part in _split_runs(runs, first)] if len(runs) else [], schema)])

    return run


def _fingerprints(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in numbered(batches):
            ids, keys = _ints(chunk.column("doc_id")), _ints(chunk.column("row_key"))
            data, offsets = A.text_bytes(chunk.column("text"))
            start, end, first = A.words(data, offsets)
            runs, sizes = A.unpack(chunk.column("runs"), np.int32)
            runs = runs.reshape(-1, 2).astype(np.int64) + np.repeat(first[:-1], sizes // 2)[:, None]
            at = np.arange((n := runs[:, 1] - runs[:, 0]).sum()) + np.repeat(runs[:, 0] - (np.cumsum(n) - n), n)
            hashed = A.word_hashes(data, start, end)
            key = A.spans(A.prefix(hashed, 1), at, at + window, 1)
            side = A.spans(A.prefix(hashed, 2), at, at + window, 2)
            row = np.searchsorted(first, at, "right") - 1
            doc = ids[row]
            order = np.lexsort((doc, key))
            k = key[order]
            new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
            least = np.zeros(len(at), np.int64)
            least[order] = np.repeat(doc[order][new], np.diff(np.append(new, len(k))))
            own = np.flatnonzero(doc == least)
            out = [chunk_row(number, ids, keys, first, at[doc > least])]
            for b, x in A.pack_by(A.buckets_of(side[own], buckets), buckets, rem=key[own], at=at[own].astype(np.int32), row=row[own].astype(np.int32)):
                r = np.frombuffer(x["row"], np.int32)
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                who = np.stack([ids[r[cut]], np.diff(np.append(cut, len(r)))])
                out.append((b, number, x["rem"], A.deltas(np.frombuffer(x["at"], np.int32)).tobytes(), who.tobytes(), None))
            yield packed_batch(out, sent_schema)

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["bucket", "chunk", "a", "b", "c", "d"]).cast(sent_schema)
    rem, sizes = A.unpack(table.column("a"), np.uint64)
    places = undelta(A.unpack(table.column("b"), np.int32)[0], sizes)
    doc = np.concatenate([np.repeat(*np.frombuffer(x, np.int64).reshape(2, -1)) for x in table.column("c").to_pylist()])
    order = np.lexsort((doc, rem))
    r = rem[order]
    new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    least = np.repeat(doc[order][new], np.diff(np.append(new, len(r))))
    hit = np.zeros(len(rem), bool)
    hit[order] = doc[order] > least
    return pa.Table.from_batches([packed_batch(back(hit, _ints(table.column("chunk")), sizes, places, table.column("bucket")[0].as_py()), sent_schema)])


def _merged(window: int):
    def run(table: pa.Table) -> pa.Table:
        ids, keys, first, starts = per_chunk(table)
        row = np.searchsorted(first, starts, "right") - 1
        out = []
        order = np.argsort(starts, kind="stable")
        starts, row = starts[order], row[order]
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        for r, part in zip(row[cut], np.split(starts, cut[1:])) if len(starts) else []:
            local = part - first[r]
            runs = A.runs_of(A.covered(local, window, int(first[r + 1] - first[r])))
            out.append((int(ids[r]), int(keys[r]), [{"start": int(a), "end": int(z)} for a, z in runs]))
        return pa.Table.from_batches([packed_batch(out, _spans)])

    return run


def repeated_spans(docs: DataFrame, *, window: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word ranges of each document that repeat a document with a smaller id.

    Returns (doc_id, row_key, spans): spans are maximal, disjoint and sorted
    word ranges [start, end) covered by windows whose words also occur in a
    document with a smaller id. Documents without any are absent. Rows without
    id or text, and texts shorter than a window, take no part. Equal rows have
    equal results, and neither makes the other a repeat.
    """
    spark, block = docs.sparkSession, window // 2
    small_batches(spark)
    buckets = 4 * partitions(spark)
    keyed = with_row_key(docs, id, text).where("doc_id is not null and text is not null")
    hits = keyed.mapInArrow(_probes(buckets, block), SENT).groupBy("bucket").applyInArrow(_match_probes, SENT)
    runs = stored(hits.groupBy("chunk").applyInArrow(_candidates(block, window), "row_key long, runs binary").dropDuplicates(["row_key"]), "substring-runs")
    sent = join_checked(keyed, runs, ["row_key"]).mapInArrow(_fingerprints(buckets, window), SENT)
    found = sent.groupBy("bucket").applyInArrow(_match_windows, SENT).groupBy("chunk").applyInArrow(_merged(window), SPANS)
    return stored(found.dropDuplicates(["row_key", "doc_id"]), "substring-spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.chunks(batches, "text"):
        kept = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            found, at, out = text.encode().split(), 0, []
            for r in runs:
                out += found[at : r["start"]]
                at = r["end"]
            kept.append(b" ".join(out + found[at:]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(kept, pa.string()), batch.column("spans")], ["doc_id", "row_key", "text", "spans"])


def without_spans(docs: DataFrame, spans: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have spans, with those words gone and the rest joined by one space."""
    both = join_checked(with_row_key(docs, id, text), spans, ["row_key", "doc_id"])
    return both.select("doc_id", "row_key", "text", "spans").mapInArrow(_cut, "doc_id long, row_key long, text string, spans array<struct<start:int,end:int>>")
