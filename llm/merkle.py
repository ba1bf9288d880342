"""Merkle manifests: a tree of hashes for each group of rows, a tree over the groups, and a proof for each row.

Leaves are sorted by ranges into the partitions of an RDD. Each partition tells
its first and last group and their counts; from these the driver, with one entry
for each partition, gets every partition's offset in its first group. A
partition then builds all complete aligned subtrees of its own. Nodes whose run
reaches into another partition are shuffled by coordinate (group, level, run),
and the upper levels are finished there. The roots of the groups are leaves of a
second tree, built in the same way.

Rows travel as runs: the leaves of one run share the path above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.storage import join_checked, lookup, partitions, small_batches, stored

#: Nodes that are hashed together, and leaves of a partition.
ARITY, LEAVES = 16, 50_000
_LEAF = "struct<place: long, ord: long, name: string, leaf: string, altered: string>"
_STEP = "struct<at: int, others: array<string>>"
_BUILT = f"kind string, grp string, leaves array<{_LEAF}>, path array<{_STEP}>, level int, idx long, hash string, total long"


def framed(*values: Column) -> Column:
    """SHA-256 (hexadecimal) of values: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)).cast("binary"), 256)


def _hash(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _edges(number: int, rows: Iterator) -> Iterator[tuple]:
    """Of a partition: its number, first group and count, last group and count; nothing if it is empty."""
    found = None
    for group, some in groupby(rows, lambda r: r[0][0]):
        n = sum(1 for _ in some)
        found = (number, group, n, group, n) if found is None else (*found[:3], group, n)
    if found:
        yield found


def _offsets(edges: list[tuple]) -> dict[int, tuple[int, int, bool, int]]:
    """For each partition: leaves of its first group before it, that group's total, whether its last group goes on, that group's total."""
    edges, total, before = sorted(edges), {}, {}
    for number, first, n, last, m in edges:
        before[number] = total.get(first, 0)
        total[first] = before[number] + n
        if last != first:
            total[last] = m
    later = {a[0]: b[1] == a[3] for a, b in zip(edges, edges[1:])}
    return {number: (before[number], total[first], later.get(number, False), total[last]) for number, first, _, last, _ in edges}


def _segment(group: str, rows: list[tuple], start: int, total: int) -> Iterator[tuple]:
    """Runs, loose nodes and the root of consecutive leaves (ord, name, leaf, altered) from place `start` on; `total` is the group's count."""
    end = start + len(rows)
    leaves = [(start + i, *row) for i, row in enumerate(rows)]
    levels = [(start, [row[2] for row in rows])]
    closed = end == total
    while not (closed and levels[-1][0] == 0 and len(levels[-1][1]) == 1):
        low, nodes = levels[-1]
        high = low + len(nodes)
        first, stop = -(-low // ARITY), -(-high // ARITY) if closed else high // ARITY
        if stop <= first:
            break
        levels.append((first, [_hash(nodes[max(0, i * ARITY - low) : i * ARITY - low + ARITY]) for i in range(first, stop)]))
    rooted = closed and levels[-1][0] == 0 and len(levels[-1][1]) == 1
    if total == 1:
        yield ("run", group, leaves, [], 0, 0, None, total)
        yield ("root", group, None, None, 0, 0, levels[0][1][0], total)
        return
    paths: dict[int, tuple[list, int, int]] = {}  # of the nodes of one level: steps up to the highest node built here, and that node
    for level in range(len(levels) - 1, -1, -1):
        low, nodes = levels[level]
        above, paths = paths, {}
        up = levels[level + 1][0] if level + 1 < len(levels) else None
        for i, node in enumerate(nodes):
            at = low + i
            run = at // ARITY
            if up is not None and up <= run < up + len(levels[level + 1][1]):
                if level:
                    a = max(low, run * ARITY)
                    members = nodes[a - low : run * ARITY + ARITY - low]
                    steps, top, idx = above[run]
                    paths[at] = ([(at - a, members[: at - a] + members[at - a + 1 :]), *steps], top, idx)
                continue
            paths[at] = ([], level, at)
            if rooted and level == len(levels) - 1:
                yield ("root", group, None, None, level, 0, node, total)
            else:
                yield ("loose", group, [leaves[i]] if not level else None, None, level, at, node, total)
        if level == 1:
            for at, (steps, top, idx) in paths.items():
                yield ("run", group, leaves[max(0, at * ARITY - start) : at * ARITY - start + ARITY], steps, top, idx, None, total)


def _builder(offsets: dict):
    def build(number: int, rows: Iterator) -> Iterator[tuple]:
        if number not in offsets:
            return
        before, total, goes_on, last_total = offsets[number]
        first = True
        waiting: tuple | None = None
        for group, some in groupby(rows, lambda r: r[0][0]):
            if waiting:
                yield from _segment(*waiting[:3], total if waiting[3] else waiting[2] + len(waiting[1]))
            waiting = (group, [(ord, name, key[-2], altered) for key, (ord, name, altered) in some], before if first else 0, first)
            first = False
        if waiting:
            yield from _segment(*waiting[:3], total if waiting[3] else last_total if goes_on else waiting[2] + len(waiting[1]))

    return build


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and roots of the trees of a stored table: grp, ord (may be null), name, leaf, altered, salt.

    A group's leaves ascend by ord (null first), name, leaf, and salt for equal
    rows; groups and names are compared by UTF-8 bytes. Of a run: grp, its leaves
    (place, ord, name, leaf, altered), and the path above it, in each step the run's
    place among its siblings and their hashes. Of a root: grp, hash. A group of one
    leaf has that leaf as its root, and a path of null.
    """
    spark = leaves.sparkSession
    parts = max(partitions(spark), -(-leaves.count() // LEAVES))
    keyed = leaves.rdd.map(lambda r: ((r.grp, r.ord is not None, r.ord or 0, r.name or "", r.leaf, r.salt), (r.ord, r.name, r.altered)))
    ranged = keyed.sortByKey(numPartitions=parts)
    offsets = _offsets(ranged.mapPartitionsWithIndex(_edges).collect())  # an entry for each partition
    built = stored(spark.createDataFrame(ranged.mapPartitionsWithIndex(_builder(offsets)), _BUILT, verifySchema=False), "subtrees")
    runs, roots, uppers = _finished(built)
    key = ["grp", "level", "idx"]
    runs = join_checked(runs, uppers, key, "left").withColumn("path", F.expr("IF(total = 1, NULL, concat(path, coalesce(upper, array())))"))
    return runs.select("grp", "leaves", "path"), roots


def _finished(built: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upper levels from loose nodes: all runs, all roots, and the paths of loose nodes (grp, level, idx, upper)."""
    loose = built.where("kind = 'loose'")
    runs = built.where("kind = 'run'").select("grp", "leaves", "path", "level", "idx", "total")
    roots = built.where("kind = 'root'").select("grp", "hash")
    kinds = built.where("kind = 'loose'").agg(F.max("level"), F.max("total")).first()
    top, total = kinds if kinds[0] is not None else (-1, 0)
    made, level, groups = None, 0, []
    while level <= top or ARITY**level < total:
        now = loose.where(F.col("level") == level).select("grp", "idx", "hash", "total", "leaves")
        now = now.unionByName(made) if made is not None else now
        run = F.expr(f"idx div {ARITY}").alias("run")
        some = now.groupBy("grp", run, "total").agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "leaves"))).alias("nodes"))  # a run has ARITY nodes at most
        some = stored(some.withColumn("hash", F.sha2(F.array_join("nodes.hash", "").cast("binary"), 256)), "upper-runs")
        groups.append(some)
        above = some.select("grp", F.col("run").alias("idx"), "hash", "total", F.lit(None).cast(f"array<{_LEAF}>").alias("leaves"))
        over = F.col("total") > ARITY ** (level + 1)
        roots = roots.unionByName(above.where(~over).select("grp", "hash"))
        made = above.where(over)
        level += 1
    if groups:
        low = groups[0].select("grp", F.flatten("nodes.leaves").alias("leaves"), F.array().cast(f"array<{_STEP}>").alias("path"), F.lit(1).alias("level"), F.col("run").alias("idx"), "total")
        runs = runs.unionByName(low)
    uppers = None
    for level in range(len(groups) - 1, -1, -1):
        some = groups[level].select("grp", "run", "nodes.hash", F.posexplode("nodes").alias("at", "node"))
        others = F.filter("hash", lambda _, i: i != F.col("at"))
        step = some.select("grp", F.lit(level).alias("level"), F.col("node.idx").alias("idx"), "run", F.array(F.struct("at", others.alias("others"))).alias("step"))
        if uppers is None:
            now = step.withColumn("upper", F.col("step"))
        else:
            higher = uppers.where(F.col("level") == level + 1).select("grp", F.col("idx").alias("run"), "upper")
            now = step.join(higher, ["grp", "run"], "left").withColumn("upper", F.expr("concat(step, coalesce(upper, array()))"))
        now = now.select("grp", "level", "idx", "upper")
        uppers = now if uppers is None else uppers.unionByName(now)
    if uppers is None:
        uppers = runs.where("false").select("grp", "level", "idx", F.col("path").alias("upper"))
    return runs, roots, stored(uppers, "upper-paths")


def manifest(rows: DataFrame, *, group: str, order: str, leaf: Column, altered: Column) -> DataFrame:
    """Runs of the two-level tree of `rows`: grp, leaves (place, ord, name, leaf, altered), lone, path, subroot, root.

    A tree for each value of `group` has its leaves by `order` (a whole number; null
    first), then by leaf; repeated rows are leaves of their own. The roots, by group
    (null first), are the leaves of the upper tree; a path goes on through it.
    `altered` is another leaf to fold in place of the true one, or null. A run's
    name is null in the lower tree. Without rows there are no runs.
    """
    kept = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(order).cast("long").alias("ord"),
        F.lit(None).cast("string").alias("name"),
        leaf.alias("leaf"),
        altered.alias("altered"),
        F.monotonically_increasing_id().alias("salt"),
    )
    kept = stored(kept, "leaves")
    runs, roots = tree(kept)
    runs, roots = stored(runs, "runs"), stored(roots, "roots")
    tops = roots.select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("ord"), F.col("grp").alias("name"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("altered"), F.lit(0).cast("long").alias("salt"))
    top_runs, top = tree(stored(tops, "group-leaves"))
    top = [r.hash for r in top.collect()]  # one row, none without groups
    each = top_runs.select(F.col("leaves.leaf").alias("hash"), F.posexplode("leaves").alias("at", "one"), "path")
    others = F.filter("hash", lambda _, i: i != F.col("at"))
    first = F.array(F.struct("at", others.alias("others")))
    each = each.select(F.col("one.name").alias("grp"), F.col("one.leaf").alias("subroot"), F.when(F.col("path").isNull(), F.array().cast(f"array<{_STEP}>")).otherwise(F.concat(first, "path")).alias("top_path"))
    uses = runs.groupBy("grp").agg(F.count(F.lit(1)).alias("uses"))
    found = lookup(runs, stored(each.join(uses, "grp"), "group-paths"), ["grp"], "uses")
    lone = F.col("path").isNull()
    return found.select("grp", "leaves", lone.alias("lone"), F.concat(F.coalesce("path", F.array().cast(f"array<{_STEP}>")), "top_path").alias("path"), "subroot", F.lit(top[0] if top else None).cast("string").alias("root"))


def _folded(start: str, path: list[dict]) -> str:
    for step in path:
        others = step["others"]
        start = _hash([*others[: step["at"]], start, *others[step["at"] :]])
    return start


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf: its proof's digest, and the root folded from the altered or true leaf."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("ord", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
        for run in batch.to_pylist():
            leaves, path = [x["leaf"] for x in run["leaves"]], run["path"]
            above = "".join("".join(step["others"]) for step in path)
            true = None
            for i, one in enumerate(run["leaves"]):
                siblings = leaves[:i] + leaves[i + 1 :]
                if one["altered"] is not None:
                    folded = _folded(one["altered"] if run["lone"] else _hash([*leaves[:i], one["altered"], *leaves[i + 1 :]]), path)
                else:
                    folded = true = true or _folded(leaves[0] if run["lone"] else _hash(leaves), path)
                for c, v in zip(out, (one["ord"], one["leaf"], run["subroot"], run["root"], _hash([*siblings, above]), folded)):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["ord"], pa.int64()), *(pa.array(v, pa.string()) for c, v in out.items() if c != "ord")], list(out))


def proofs(runs: DataFrame) -> DataFrame:
    """Each leaf of a manifest with its whole proof: grp, place, leaf, siblings (steps from below, each with the place and the other hashes)."""
    one = runs.select("grp", "lone", "path", "root", "subroot", F.col("leaves.leaf").alias("hash"), F.posexplode("leaves").alias("at", "one"))
    first = F.array(F.struct("at", F.filter("hash", lambda _, i: i != F.col("at")).alias("others")))
    return one.select("grp", F.col("one.place").alias("place"), F.col("one.leaf").alias("leaf"), F.when(F.col("lone"), F.col("path")).otherwise(F.concat(first, "path")).alias("siblings"), "subroot", "root")


def checked(runs: DataFrame) -> DataFrame:
    """Each leaf of a manifest: ord, leaf, subroot, root, proof_sha256 (of all siblings from below) and folded_root."""
    small_batches(runs.sparkSession)
    return runs.mapInArrow(_checked, "ord long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
