"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows and a rest. Only the number of rests of each
length (at most 4095 numbers) is planned: the largest remaining length opens a
window, and a subset-sum search over a bitset (bit s: sum s can be reached with
the lengths left) picks the multiset of remaining lengths that fills the window
closest to capacity; backtracking gives how often each length is used. The
pattern is applied as often as its counts allow. If some slack is left, one
remaining rest is cut to fill it and its remainder joins the lengths left. The
last tokens become windows whose sizes are powers of two, so nothing is padded.

The plan is a list of patterns over ranks within a length; each task looks up
its own documents in it. Ranks are numbered within salted groups of one length,
so a length that a third of all documents have is no hot group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import arrays as A
from llm.storage import partitions, small_batches, stored
from llm.tokens import word_ids

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the largest one among them, whose sum is closest to capacity from below."""
    top = max(counts)
    room, mask = capacity - top, (1 << (capacity - top + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == top), room // length)
        times = 1
        while left > 0 and not reach >> room:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {top: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple]], int]:
    """What becomes of each rank of each length, and the number of windows used.

    Entries of a length, by first rank: (rank, "place", window, uses, offset),
    (rank, "cut", window, size, offset, rank of the remainder in its length) or
    (rank, "tail", window, place in the tail, sizes of the tail's windows).
    """
    left = {k: v for k, v in counts.items() if k and v}
    made, used = dict(left), dict.fromkeys(left, 0)
    out: dict[int, list[tuple]] = {}
    window = 0

    def use(length: int, n: int, *what) -> None:
        out.setdefault(length, []).append((used[length], *what))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        pattern = fill(left, capacity)
        slack = capacity - sum(k * v for k, v in pattern.items())
        rest = [k for k, v in left.items() if v > pattern.get(k, 0)]
        if slack and not rest:
            break
        times = min(left[k] // v for k, v in pattern.items())
        cut = max(rest) if slack else 0
        if cut:
            times = min(left[k] // (v + (k == cut)) for k, v in (pattern | {cut: pattern.get(cut, 0)}).items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            use(length, n * times, "place", window, n, offset)
            offset += length * n
        if cut:
            child = cut - slack
            use(cut, times, "cut", window, slack, offset, made.get(child, 0))
            made[child] = made.get(child, 0) + times
            left[child] = left.get(child, 0) + times
            used.setdefault(child, 0)
        window += times
    total = sum(k * v for k, v in left.items())
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    at = 0
    for length, n in sorted(left.items(), reverse=True):
        use(length, n, "tail", window, at, sizes)
        at += length * n
    return out, window + len(sizes)


def pieces_of(planned: dict[int, list[tuple]], firsts: dict[int, list[int]], length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the rest, length, window, offset) of each piece of the rest with this length and rank."""
    start = 0
    while length:
        entry = planned[length][bisect_right(firsts[length], rank) - 1]
        i, kind, window = rank - entry[0], entry[1], entry[2]
        if kind == "place":
            uses, offset = entry[3:]
            yield start, length, window + i // uses, offset + i % uses * length
            return
        if kind == "cut":
            size, offset, child = entry[3:]
            yield start, size, window + i, offset
            start, length, rank = start + size, length - size, child + i
            continue
        place, sizes = entry[3] + i * length, entry[4]
        for j, size in enumerate(sizes):
            if place < size and length:
                n = min(length, size - place)
                yield start, n, window + j, place
                start, length, place = start + n, length - n, 0
            else:
                place -= size
        return


def _tokenized(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids = word_ids(path or public_tokenizers.path("word_bpe_49k.json"))
        tail = np.array([end], ids.kind).tobytes()
        for chunk in A.chunks(batches, "text", 1 << 20):
            packed = [x + tail for x in ids.encode([t or "" for t in chunk.column("text").to_pylist()])]
            n = np.array([len(x) for x in packed], np.int64) // ids.kind.itemsize
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(packed, pa.binary()), pa.array(n)], ["doc_id", "packed", "tokens"])

    return run


def _placed(shared, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned, firsts, before, most, windows = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, packed, n, rest, rank in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "tokens", "rest", "rank"))):
                ids = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
                full = n // capacity
                own = windows + (before[rest] + rank) * most
                pieces = [(j * capacity, capacity, own + j, 0) for j in range(full)]
                if rest:
                    pieces += [(full * capacity + s, k, w, o) for s, k, w, o in pieces_of(planned, firsts, rest, rank)]
                for s, k, w, o in pieces:
                    for col, x in zip(cols, (doc, s, k, ids[s : s + k].tobytes(), n, w, o)):
                        col.append(x)
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = 4096, end: int = 2, tokenizer: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each text's ids and the end id are cut into pieces, each id in one piece;
    a sequence holds at most `capacity` ids without gaps. All sequences are full
    but the last few, whose sizes are powers of two. A null text is empty, so it
    is the end id alone; equal rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = docs.mapInArrow(_tokenized(tokenizer, end), "doc_id long, packed binary, tokens long")
    tokens = tokens.withColumn("rest", F.col("tokens") % capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "packed"), F.lit(4 * partitions(spark))))
    tokens = stored(tokens, "packing-tokens")
    groups = stored(tokens.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most")), "packing-groups")
    counts = {r.rest: (r.n, r.most) for r in groups.groupBy("rest").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()}  # at most `capacity` rows
    planned, windows = plan({k: n for k, (n, _) in counts.items()}, capacity)
    firsts = {k: [e[0] for e in v] for k, v in planned.items()}
    before, at = {}, 0
    for k in sorted(counts):
        before[k] = at
        at += counts[k][0]
    most = max([1, *(m // capacity for _, m in counts.values())])
    shared = spark.sparkContext.broadcast((planned, firsts, before, most, windows))
    offsets = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = tokens.withColumn("at", F.row_number().over(Window.partitionBy("rest", "salt").orderBy("doc_id", "packed")))
    ranked = ranked.join(offsets.select("rest", "salt", "before").hint("merge"), ["rest", "salt"]).select("doc_id", "packed", "tokens", "rest", (F.col("before") + F.col("at") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(shared, capacity), PIECES)
