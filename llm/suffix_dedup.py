"""Dedup of long strings of tokens by a depth-limited radix sort of suffixes.

Tokens are bytes or words. A suffix is compared through `depth` tokens only, so
equal groups of the sort are exactly the strings that occur twice. The sort runs by most-significant-digit
passes, and a suffix alone in its group leaves at once.

Neighbouring suffixes hold nearly the same tokens, so they travel as one record.
The first digit of a suffix is the k-gram of least hash within its depth; the
adjacent suffixes with the same one form a run (about 190 for 400 bytes), split
once so that each half also shares a core of half the depth. Passes:

1. core: the tokens that all suffixes of a record share. Cores seen once leave.
2. whole: all tokens that the record's suffixes span. Records equal there are
   repeats in full; one of them stays as the partner of the others.
3. depth: the remaining records, few and next to edits, are spread into single
   suffixes, grouped by a fingerprint of all `depth` tokens.

So the digits are not taken from the left: a pass from the left sends an entry
of 5 bytes or more for each byte of text, more than the disk that is allowed.

Each pass is a grouping whose counts are combined before the shuffle, so a group
of copies of any size sends one row from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import arrays as A
from llm.storage import join_checked, partitions, small_batches, stored, with_row_key
from llm.substring_dedup import SENT, back, chunk_row, grouped, numbered, packed_batch, per_chunk, undelta
from llm.substring_dedup import sent_schema as SENT_SCHEMA

SPANS = "id_key long, row_key long, spans array<struct<start:int,end:int>>"
_RECORDS = "id_key long, row_key long, start int, n int, core long, whole long"
_chunk_bytes = 1 << 19
UNITS = ("bytes", "words")


def _tokens(unit: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens, never zero, and each row's first token (one more at the end)."""
    data, offsets = A.text_bytes(texts)
    if unit == "bytes":
        return data.astype(A.U64) + A.U64(1), offsets
    start, end, first = A.words(data, offsets)
    return A.word_hashes(data, start, end), first.astype(np.int64)


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` adjacent values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    block = padded.reshape(-1, width)
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(block, axis=1).ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def _records(depth: int, gram: int, unit: str):
    """One row for each run of suffixes that share the k-gram of least hash and a core."""
    half = (depth - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text", _chunk_bytes):
            ids, keys = _ints(chunk.column("id_key")), _ints(chunk.column("row_key"))
            value, offsets = _tokens(unit, chunk.column("text"))
            at, row = A.window_starts(offsets, depth)
            if not len(at):
                continue
            sums, other = A.prefix(value, 0), A.prefix(value, 1)
            place = np.arange(len(value) - gram + 1)
            del value
            grams = A.spans(sums, place, place + gram)
            # hash above, place below: ties go to the leftmost
            least = _sliding_least((grams & ~A.U64(0xFFFFFFFF)) | place.astype(A.U64), depth - gram + 1)
            anchor = (least[at] & A.U64(0xFFFFFFFF)).astype(np.int64)
            del grams, least, place
            side = at + half > anchor  # the core is half a depth left of the k-gram, or right of it
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (side[1:] != side[:-1]))))
            low, high = at[new], at[np.append(new[1:], len(at)) - 1]
            x, right = anchor[new], side[new]
            core = A.spans(sums, np.where(right, x, x - half), np.where(right, x + gram + half, x + gram))
            whole = A.spans(other, low, high + depth, 1)
            out = [ids[row[new]], keys[row[new]], (low - offsets[row[new]]).astype(np.int32), (high - low + 1).astype(np.int32), (core ^ right.astype(A.U64)).view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["id_key", "row_key", "start", "n", "core", "whole"])

    return run


def _suffixes(depth: int, buckets: int, unit: str):
    """Single suffixes of the open records, packed for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in numbered(batches):
            ids, keys = _ints(chunk.column("id_key")), _ints(chunk.column("row_key"))
            value, offsets = _tokens(unit, chunk.column("text"))
            lists = chunk.column("open")
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            start, n = _ints(flat.field("start")) + np.repeat(offsets[:-1], lengths), _ints(flat.field("n"))
            at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            at.sort()
            key, side = A.spans(A.prefix(value, 0), at, at + depth), A.spans(A.prefix(value, 1), at, at + depth, 1)
            order, new, _ = grouped(key)
            sizes = np.diff(np.append(new, len(at)))
            out = [chunk_row(number, ids, keys, offsets, np.sort(at[order[np.repeat(sizes > 1, sizes)]]))]
            one = np.sort(order[new])
            for b, x in A.pack_by(A.buckets_of(side[one], buckets), buckets, rem=key[one], at=at[one].astype(np.int32)):
                out.append((b, number, x["rem"], A.deltas(np.frombuffer(x["at"], np.int32)).tobytes(), None, None))
            yield packed_batch(out, SENT_SCHEMA)

    return run


def _match(table: pa.Table) -> pa.Table:
    """Fingerprints that two chunks hold."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(SENT_SCHEMA.names).cast(SENT_SCHEMA)
    rem, sizes = A.unpack(table.column("a"), np.uint64)
    places = undelta(A.unpack(table.column("b"), np.int32)[0], sizes)
    order, new, run = grouped(rem)
    hit = np.zeros(len(rem), bool)
    hit[order] = (np.diff(np.append(new, len(rem))) > 1)[run]
    return pa.Table.from_batches([packed_batch(back(hit, _ints(table.column("chunk")), sizes, places, table.column("bucket")[0].as_py()), SENT_SCHEMA)])


def _found(depth: int):
    def run(table: pa.Table) -> pa.Table:
        ids, keys, offsets, starts = per_chunk(table)
        starts = np.unique(starts)
        row = np.searchsorted(offsets, starts, "right") - 1
        new = np.flatnonzero((np.diff(starts, prepend=-2) > 1) | (np.diff(row, prepend=-1) != 0))
        low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(starts) else starts
        at = offsets[row[new]]
        return pa.table({"id_key": ids[row[new]], "row_key": keys[row[new]], "start": (low - at).astype(np.int32), "end": (high - at + depth).astype(np.int32)})

    return run


def _merge(table: pa.RecordBatch) -> list[dict]:
    """Sorted maximal runs of each row's spans."""
    out = []
    for i, key, got in zip(table.column("id_key").to_pylist(), table.column("row_key").to_pylist(), table.column("got").to_pylist()):
        runs: list[dict] = []
        for x in sorted(got, key=lambda x: x["start"]):
            if runs and x["start"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], x["end"])
            else:
                runs.append(dict(x))
        out.append({"id_key": i, "row_key": key, "spans": runs})
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist(_merge(batch), schema=_merged_schema)


_merged_schema = pa.schema([("id_key", pa.int64()), ("row_key", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with a key of id and text, and the id itself with a value for null."""
    return with_row_key(docs, id, text).withColumn("id_key", F.coalesce("doc_id", F.lit(-(1 << 63))))


def repeated_spans(docs: DataFrame, *, depth: int = 400, gram: int = 32, unit: str = "bytes", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of each text covered by strings of `depth` tokens that start twice or more in all texts.

    Returns (id_key, row_key, spans): maximal, disjoint, sorted ranges
    [start, end) of bytes or words; the keys are those that without_spans()
    makes. Texts without any are absent; null and short texts have none. Equal
    rows count as two places, so both are repeats. Matches never cross
    documents; overlapping ones in a document count.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    small_batches(docs.sparkSession)
    rows = keyed(docs, id, text)
    buckets = 4 * partitions(docs.sparkSession)
    records = stored(rows.select("id_key", "row_key", "text").mapInArrow(_records(depth, gram, unit), _RECORDS), "suffix-records")
    # stored, so that a join reads both sides from a scan and a hot core's rows can be split
    twice = stored(records.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core"), "suffix-cores")
    kept = stored(records.join(twice.hint("merge"), "core", "left_semi"), "suffix-kept")
    wholes = kept.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id_key", "row_key", "start", "n")).alias("one"))
    wholes = stored(wholes, "suffix-wholes")
    full = kept.join(wholes.where("times > 1").select("core", "whole").hint("merge"), ["core", "whole"], "left_semi")
    full = full.select("id_key", "row_key", "start", (F.col("start") + F.col("n") - 1 + depth).cast("int").alias("end"))
    mixed = wholes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    mixed = stored(mixed.select("core"), "suffix-mixed")
    partly = wholes.join(mixed.hint("merge"), "core", "left_semi").select("one.*")
    partly = stored(partly.groupBy("id_key", "row_key").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("open")), "suffix-open")
    sent = join_checked(rows, partly, ["id_key", "row_key"]).select("id_key", "row_key", "text", "open").mapInArrow(_suffixes(depth, buckets, unit), SENT)
    single = sent.groupBy("bucket").applyInArrow(_match, SENT).groupBy("chunk").applyInArrow(_found(depth), "id_key long, row_key long, start int, end int")
    every = full.unionByName(single).groupBy("id_key", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("got"))
    return stored(every.mapInArrow(_merged, SPANS), "suffix-spans")


def without_spans(docs: DataFrame, spans: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have spans of bytes: doc_id, id_key, row_key, spans and the bytes that are left.

    A cut may fall inside a character, so what is left is binary.
    """
    both = join_checked(keyed(docs, id, text), spans, ["id_key", "row_key"])
    kind = "doc_id long, id_key long, row_key long, kept binary, spans array<struct<start:int,end:int>>"
    return both.select("doc_id", "id_key", "row_key", "text", "spans").mapInArrow(_cut, kind)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.chunks(batches, "text"):
        kept = []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            at, out = 0, []
            for r in runs:
                out.append(text[at : r["start"]])
                at = r["end"]
            kept.append(b"".join([*out, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id_key"), batch.column("row_key"), pa.array(kept, pa.binary()), batch.column("spans")], ["doc_id", "id_key", "row_key", "kept", "spans"])
