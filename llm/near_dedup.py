"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles has a signature of 48 minima of 16 bits each.
Two sets with similarity 0.8 differ in 23 or more of the 48 with a probability
of about 1 in 300,000; that is the signature-distance threshold. Signatures are
split into 8 chunks of 6 minima. By the pigeonhole principle two signatures
within distance 23 have a chunk with at most 2 differing minima, so a chunk is
indexed under all 15 ways to leave out 2 of its minima: every pair under the
threshold meets under at least one key.

Sets that are equal are one node. A key with g documents gives g - 1 pairs with
its smallest document, never all pairs. Pairs are confirmed on full sets. Where
a confirmed pair is missing inside a key, all of the key's documents, of whatever
chunk, that are not in one component yet are compared with each other, so no
link is lost: those that share one of their rarest shingles, at places that
leave enough to share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm import arrays as A
from llm.components import components
from llm.storage import join_checked, partitions, small_batches, stored

MINIMA, CHUNKS, ERRORS = 48, 8, 2
#: The largest distance for which the pigeonhole principle guarantees a common key.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
_random = np.random.default_rng(20240601)
_factors = _random.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_terms = _random.integers(0, 1 << 63, MINIMA, np.uint64)
_kept = list(combinations(range(MINIMA // CHUNKS), MINIMA // CHUNKS - ERRORS))
KEYS = CHUNKS * len(_kept)
#: A component of so many documents is compared as a whole; a task then holds so
#: many outliers, and so many members pass it. These set costs, never results.
LARGE, OUTLIERS, MEMBERS = 64, 64, 4096
#: Sizes of sets within this factor are one band.
BAND = 1.05
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of n words; with fewer words, of them all."""
    data, offsets = A.text_bytes(texts)
    data = _lower[data]
    start, end, first = A.words(data, offsets)
    sums = A.prefix(A.word_hashes(data, start, end), 1)
    at, row = A.window_starts(first, n)
    hashes = A.spans(sums, at, at + n, 1)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    short = np.flatnonzero((np.diff(first) < n) & (np.diff(first) > 0))
    out = [np.unique(hashes[a:z]) for a, z in zip(cut[:-1], cut[1:])]
    for i, h in zip(short, A.spans(sums, first[short], first[short + 1], 1)):
        out[i] = np.array([h], np.uint64)
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), MINIMA), np.uint16)
    for i in range(MINIMA):
        out[:, i] = (np.minimum.reduceat(every * _factors[i] + _terms[i], starts) >> A.U64(20)).astype(np.uint16)
    return out


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            sets = shingle_sets(chunk.column("text"), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature: list[bytes | None] = [None] * len(sets)
            for i, s in zip(full, _signatures([sets[i] for i in full]) if full else []):
                signature[i] = s.tobytes()
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            high = np.array([A.mix(s ^ A.U64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "low", "high", "signature"],
            )

    return run


#: Minima of a signature by their last 4 bits, 16 to a long.
LANES = MINIMA // 16
_LANE_NAMES = [f"lane{i}" for i in range(LANES)]


def _lanes(signatures: np.ndarray) -> np.ndarray:
    low = (signatures & np.uint16(15)).astype(np.uint64).reshape(len(signatures), LANES, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * A.U64(4)), axis=2).view(np.int64)


def _least_distance(left: list[Column], right: list[Column]) -> Column:
    """Minima that differ in their last 4 bits: never more than differ at all."""
    out = F.lit(0)
    for a, b in zip(left, right):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out + F.bit_count(x)
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """The 120 keys of each signature."""
    parts = signatures.reshape(len(signatures), CHUNKS, -1).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, len(_kept)), np.uint64)
    for j, keep in enumerate(_kept):
        x = parts[:, :, keep[0]]
        for k in keep[1:]:
            x = (x << A.U64(16)) | parts[:, :, k]
        out[:, :, j] = A.mix(A.mix(x) + (np.arange(CHUNKS, dtype=np.uint64)[None, :] * A.U64(len(_kept)) + A.U64(j)))
    return out.reshape(len(signatures), KEYS)


def _read_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


_PAIRS = pa.schema([("bucket", pa.int32()), ("rem", pa.binary()), ("ids", pa.binary()), ("many", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _post(buckets: int, batch: int):
    """Keys packed for their buckets, one for each distinct key of a chunk; the chunk's own pairs are made here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for chunk in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                ids = _ints(chunk.column("id"))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                keys = _keys(_read_signatures(chunk.column("signature"))[order]).ravel()
                who = np.repeat(np.arange(len(ids), dtype=np.int32), KEYS)
                by = np.argsort(keys, kind="stable")  # stable: the smallest id of each key comes first
                k = keys[by]
                new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                sizes = np.diff(np.append(new, len(k)))
                hub, member = np.repeat(who[by[new]], sizes), who[by]
                pair = np.unique(hub[hub != member].astype(np.int64) * len(ids) + member[hub != member])
                one = who[by[new]]
                back = np.argsort(one, kind="stable")
                new, one, sizes = new[back], one[back], sizes[back]
                n = len(pair)
                if n:
                    none = pa.nulls(n, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), none, none, none, pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)])], schema=_PAIRS)
                rows = []
                for b, x in A.pack_by(A.buckets_of(k[new], buckets), buckets, rem=k[new].astype(np.uint32), ids=ids[one], many=(sizes > 1).astype(np.uint8)):
                    rows.append((b, x["rem"], x["ids"], x["many"], None, None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PAIRS)], schema=_PAIRS)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Each key's documents paired with its smallest; many tells that other pairs share the key."""
    rem, sizes = A.unpack(table.column("rem"), np.uint32)
    ids, many = A.unpack(table.column("ids"), np.int64)[0], A.unpack(table.column("many"), np.uint8)[0]
    by = np.lexsort((ids, rem))
    r, ids, many = rem[by], ids[by], many[by]
    new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    sizes = np.diff(np.append(new, len(r)))
    large = (sizes > 2) | (np.maximum.reduceat(many, new) > 0)
    hub = np.repeat(ids[new], sizes)
    off = hub != ids
    return pa.table({"a": hub[off], "b": ids[off], "many": np.repeat(large, sizes)[off]})


def _close(num: int, den: int):
    """Pairs within the signature distance, and with sizes that allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = (_read_signatures(batch.column("sa")) != _read_signatures(batch.column("sb"))).sum(axis=1) > DISTANCE
            na, nb = _ints(batch.column("na")), _ints(batch.column("nb"))
            near = ~far & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("many"), pa.array(near)], ["a", "b", "many", "near"])

    return run


def _confirm(n: int, num: int, den: int):
    """Rows sorted by hub, its own text first: the members that reach the similarity on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for chunk in A.chunks(batches, "text"):
            found: tuple[list, list] = ([], [])
            for a, b, s in zip(chunk.column("a").to_pylist(), chunk.column("b").to_pylist(), shingle_sets(chunk.column("text"), n)):
                if b is None:
                    own = [*(own if a == hub else []), s]
                    hub = a
                    continue
                for h in own if a == hub else []:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and den * both >= num * (len(h) + len(s) - both):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of the stored pairs (a, b), those whose full sets reach the similarity.

    The first text of a pair travels once for each block of 256 or so partners;
    a hub of any number of pairs is spread over its blocks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).alias("blocks"))
    dealt = stored(pairs.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).select("a", "b", "block"), "pairs-dealt")
    members = join_checked(docs.withColumnRenamed("doc_id", "b"), dealt, ["b"]).select("a", "block", "b", "text")
    hubs = stored(dealt.select("a", "block").distinct(), "pairs-hubs")
    hubs = join_checked(docs.withColumnRenamed("doc_id", "a"), hubs, ["a"]).select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(hubs).repartition(partitions(docs.sparkSession), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return stored(rows.select("a", "b", "text").mapInArrow(_confirm(n, num, den), "a long, b long").distinct(), "pairs-links")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the component of each side."""
    for side in "ab":
        named = labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs


def _of_keys(many: DataFrame, apart: DataFrame) -> DataFrame:
    """All documents (id) of each key that has a pair of a hub in `apart` (a).

    A key's smallest document is paired with the smallest of each chunk, and
    those with their chunk's others. So from any pair of a key one step up and
    one down meet all of its hubs, and their pairs have all its documents.
    """
    above = many.join(apart.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    top = stored(apart.union(above).distinct(), "hubs-top")
    below = many.join(top, "a", "left_semi").select(F.col("b").alias("a"))
    hubs = stored(top.union(below).distinct(), "hubs-all")
    around = many.join(hubs, "a", "left_semi")
    return around.select(F.col("a").alias("id")).union(around.select(F.col("b").alias("id"))).distinct()


def _listed_shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            sets = shingle_sets(chunk.column("text"), n)
            ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            lanes = np.zeros((len(sets), LANES), np.int64)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                lanes[full] = _lanes(_signatures([sets[i] for i in full]))
            columns = [chunk.column("id"), pa.array(low), pa.array(np.diff(ends)), *(pa.array(x) for x in lanes.T.copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "low", "n", *_LANE_NAMES, "shingles"])

    return run


def _prefixes(docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(s, id, c, n, at): the shingles of each node, rarest first, among which two linked nodes share one.

    A set that shares num/den with another can't miss all of its first
    n - ceil(n * num / den) + 1 shingles in an order that both follow. Only
    shingles that two of the nodes (id, c) have are listed.
    """
    texts = join_checked(docs.select(F.col("doc_id").alias("id"), "text"), nodes, ["id"]).where("text is not null")
    kind = ", ".join(["id long, low long, n int", *(f"{x} long" for x in _LANE_NAMES), "shingles array<long>"])
    sets = texts.select("id", "text").mapInArrow(_listed_shingles(n), kind).dropDuplicates(["id", "low"])
    listed = stored(sets.select("id", "low", "n", *_LANE_NAMES, F.explode("shingles").alias("s")), "near-listed")
    times = listed.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    alone = F.coalesce("times", F.lit(1))
    ranked = listed.join(times.hint("merge"), "s", "left").withColumn("at", F.row_number().over(Window.partitionBy("id", "low").orderBy(alone, "s")))
    first = F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1
    return ranked.where(first & F.col("times").isNotNull()).select("s", "id", "n", "at", *_LANE_NAMES).join(nodes.hint("merge"), "id")


def _with_signatures(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(s), F.col("signature").alias(f"s{s}"), F.col("n").alias(f"n{s}")), s)
    return stored(pairs.mapInArrow(_close(num, den), "a long, b long, many boolean, near boolean"), "pairs-near")


def _side(prefix: str) -> list[Column]:
    return [F.col(x).alias(f"{prefix}_{x}") for x in ("id", "c", "n", "at", *_LANE_NAMES)]


class _Held:
    """Up to OUTLIERS sets, searched at once for those that a further set reaches."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(x) for x in sets], np.int64)
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def reached(self, other: np.ndarray, num: int, den: int) -> np.ndarray:
        low, high = np.searchsorted(self.values, other), np.searchsorted(self.values, other, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        both = np.bincount(self.owners[at], minlength=len(self.ids))
        return self.ids[(both > 0) & (den * both >= num * (self.sizes + len(other) - both))]


def _reach(n: int, num: int, den: int):
    """Rows sorted by (component, block), the block's outliers first: one link for each outlier that reaches a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, held, done = None, [], [], None, set()
        for chunk in A.chunks(batches, "text"):
            found: tuple[list, list] = ([], [])
            rows = zip(chunk.column("c").to_pylist(), chunk.column("block").to_pylist(), chunk.column("outlier").to_pylist(), chunk.column("id").to_pylist())
            for (c, block, outlier, i), s in zip(rows, shingle_sets(chunk.column("text"), n)):
                if (c, block) != group:
                    group, ids, sets, held, done = (c, block), [], [], None, set()
                if outlier:
                    ids.append(i)
                    sets.append(s)
                elif ids and len(done) < len(ids):
                    held = held or _Held(ids, sets)
                    for x in held.reached(s, num, den).tolist():
                        if x not in done:
                            done.add(x)
                            found[0].append(min(x, i))
                            found[1].append(max(x, i))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return run


def _into_large(docs: DataFrame, members: DataFrame, large: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links of documents with members of a large component (c, size) other than their own.

    A document takes part where a member may share enough with it, by the places
    of a shingle that both have among their rarest. It is compared with all
    members: OUTLIERS documents are held while the members pass, dealt in blocks
    of MEMBERS, so no pair becomes a row.
    """
    inside = join_checked(members, large, ["c"])
    reach = inside.groupBy("s", "c").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("at")).alias("rest")).withColumnRenamed("c", "cc")
    able = (num + den) * (1 + F.least(F.col("n") - F.col("at"), "rest")) >= num * (F.col("n") + F.col("least"))
    outliers = stored(members.join(reach.hint("merge"), "s").where((F.col("c") != F.col("cc")) & able).select(F.col("cc").alias("c"), "id").distinct(), "near-outliers")
    sizes = outliers.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / OUTLIERS).alias("blocks")).join(large.select("c", F.ceil(F.col("size") / MEMBERS).alias("parts")), "c")
    sizes = stored(sizes, "near-dealt")
    held = join_checked(outliers, sizes, ["c"]).select("c", "id", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("outlier"))
    passing = join_checked(inside.select("c", "id").distinct(), sizes, ["c"]).select("c", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.lit(False).alias("outlier"))
    rows = stored(held.unionByName(passing).select("c", "id", "outlier", F.concat_ws("-", "part", "block").alias("block")), "near-blocks")
    texts = join_checked(docs.withColumnRenamed("doc_id", "id"), rows, ["id"]).select("c", "block", "outlier", "id", "text")
    texts = texts.repartition(partitions(docs.sparkSession), "c", "block").sortWithinPartitions("c", "block", F.col("outlier").desc())
    return texts.mapInArrow(_reach(n, num, den), "a long, b long").where("a <> b").distinct()


def _banded(rows: DataFrame, prefix: str, num: int, den: int) -> DataFrame:
    """Entries of a pair's smaller ("x") or larger ("y") set, one for each band of sizes that the other may have.

    Sets of sizes n and m that reach the similarity share num / (num + den) of
    n + m at least, so a shingle at place `at` can't be the first that both have
    if fewer are left from there on. Where all rare shingles of a set are its
    own, its common ones come too late, and it isn't listed under them.
    """
    log = float(np.log(BAND))
    band = lambda n: F.floor(F.log(n) / log)
    own = band(F.col("n"))
    if prefix == "x":
        bands = F.sequence(own, band(F.col("n") * den / num) + 1)
    else:
        bands = F.sequence(F.greatest(F.lit(0).cast("long"), band(F.greatest(F.lit(1), F.col("n") * num / den)) - 1), own)
    least = F.floor(F.pow(F.lit(BAND), F.col("other"))) - 1
    least = F.greatest(least, F.col("n")) if prefix == "x" else least
    rows = rows.withColumn("own", own).withColumn("other", F.explode(bands))
    rows = rows.where((num + den) * (1 + F.col("n") - F.col("at")) >= num * (F.col("n") + least))
    low, high = ("own", "other") if prefix == "x" else ("other", "own")
    return rows.select("s", "turn", F.col(low).alias("low"), F.col(high).alias("high"), *_side(prefix))


def _in_bands(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of entries that share a shingle early enough, in different components, one of them not the shingle's major one.

    Minor entries meet all as the smaller set (turn 0), and are met by major ones
    as the larger (turn 1); so entries of one large component don't meet.
    """
    close = _least_distance([F.col(f"x_{x}") for x in _LANE_NAMES], [F.col(f"y_{x}") for x in _LANE_NAMES]) <= DISTANCE
    # if this is the first shingle that both have, they share it and what follows at most
    able = (num + den) * (1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))) >= num * (F.col("x_n") + F.col("y_n"))
    smaller = _banded(shared.withColumn("turn", F.when(F.col("minor"), 0).otherwise(1)), "x", num, den)
    turns = F.when(F.col("minor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    larger = _banded(shared.withColumn("turn", F.explode(turns)), "y", num, den)
    pairs = smaller.join(larger.hint("merge"), ["s", "low", "high", "turn"])
    pairs = pairs.where((F.col("x_n") <= F.col("y_n")) & (F.col("x_c") != F.col("y_c")) & able & close)
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _across(docs: DataFrame, prefixes: DataFrame, tested: DataFrame, labels: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Labels after all links between the components of `prefixes`.

    Large components take in what reaches one of their members; other documents
    that share a shingle among their rarest, early enough for their sizes, are
    compared pair by pair.
    """
    members = stored(prefixes, "near-prefixes")
    sizes = members.select("c", "id").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.where(F.col("size") >= LARGE), "near-large")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    if not large.isEmpty():
        links = stored(_into_large(docs, members, large, n, num, den), "near-reached")
    small = stored(join_checked(members, large.select("c"), ["c"], how="left_anti"), "near-small")
    shares = small.groupBy("s", "c").agg(F.count(F.lit(1)).alias("times"))
    major = stored(shares.groupBy("s").agg(F.max_by("c", F.struct("times", "c")).alias("major"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("s", "major"), "near-major")
    shared = stored(small.join(major.hint("merge"), "s").withColumn("minor", F.col("c") != F.col("major")).drop("major"), "near-shared")
    found = _in_bands(shared, num, den).join(tested, ["a", "b"], "left_anti")
    links = links.union(_links(docs, stored(found, "pairs-more"), n, num, den))
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text", batch: int = 4000) -> DataFrame:
    """Components of documents linked by a shingle-set similarity of num/den or more.

    Returns one row for each row of `docs`: doc_id, n_shingles (distinct
    shingles), component_id (smallest id reachable) and kept (that is its own).
    A text with fewer words than a shingle has all of them as one; without
    words or text the set is empty and linked with nothing. A row without id is
    kept and has no component. Rows that share an id are one node. `batch` is
    the number of signatures whose keys are made at once.
    """
    small_batches(docs.sparkSession)
    buckets = 4 * partitions(docs.sparkSession)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = stored(docs.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, low long, high long, signature binary"), "near-sketches")
    classes = sketches.where("doc_id is not null and n_shingles > 0").groupBy("low", "high").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n"))
    classes = stored(classes, "near-classes")
    posted = classes.select("id", "signature").mapInArrow(_post(buckets, batch), "bucket int, rem binary, ids binary, many binary, a long, b long")
    posted = stored(posted, "near-posted")
    pairs = posted.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet, "a long, b long, many boolean")
    pairs = pairs.unionByName(posted.where("bucket < 0").select("a", "b", F.lit(True).alias("many"))).groupBy("a", "b").agg(F.max("many").alias("many"))
    texts = docs.where("doc_id is not null")
    pairs = _with_signatures(pairs, classes, num, den)
    near = pairs.where("near")
    first = stored(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs-first")
    links = _links(texts, first, shingle, num, den)
    labels = components(links)
    rest = stored(_labelled(near.join(first, ["a", "b"], "left_anti"), labels).where("ca <> cb").select("a", "b"), "pairs-rest")
    if not rest.isEmpty():
        links = links.union(_links(texts, rest, shingle, num, den))
        labels = components(links)
    apart = stored(_labelled(pairs.where("many"), labels).where("ca <> cb").select("a").distinct(), "pairs-apart")
    if not apart.isEmpty():
        some = stored(_of_keys(pairs.where("many"), apart).join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("c")), "near-some")
        tested = pairs.where("near").select("a", "b")
        labels = _across(texts, _prefixes(texts, some, shingle, num, den), tested, labels, shingle, num, den)
    found = classes.join(labels, "id", "left").select("low", "high", F.coalesce("component", "id").alias("c"))
    full = F.col("n_shingles") > 0
    joined = sketches.where(full).join(found.hint("merge"), ["low", "high"], "left")
    joined = joined.unionByName(sketches.where(~full).withColumn("c", F.col("doc_id")))  # empty sets would all meet in one task
    component = F.when(F.col("doc_id").isNotNull(), F.col("c"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
