"""Prefix tries of conversations: mergeable partial tries, merged by key, rolled up from below.

A path is identified by the exclusive or of hashes of (depth, turn), two of 64
bits, so a conversation that holds a large share of all turns is cut into parts
and the parts' values combine. Each partition's rows give a table of nodes; the
tables of `FAN` neighbouring partitions are merged by node key, then those of
`FAN` merged tables, until one is left. Members are summed, and the lists of
conversations that end at a node are joined, cut by ranges of ids.

The smallest member of a node is its owner, and an owner's nodes are a chain: from
some depth to the conversation's end. Sums over subtrees go up from chain to
chain by pointer doubling, and within a chain by sums from its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.storage import join_checked, lookup, partitions, stored

#: Partial tables that one merge takes in.
FAN = 16
#: Ids of a range in a list of ends, and depths of a chain that are summed in one group.
IDS, DEPTHS = 8_192, 4_096


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a 128-bit digest of role and text, and the text's code points; null role or text is empty.

    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(whole, 1, 32)).alias("digest"), F.char_length(text).cast("long").alias("n"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn's place in its conversation (from 0), and the parts of conversations: conv_id, part, rows before, rows.

    Order is by turn, null first; equal turns are ordered by digest. Rows are dealt
    out by ranges, so a long conversation lies in several parts, and a place is
    the count of rows in earlier parts and within the part.
    """
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("salt")]
    dealt = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *key)
    dealt = dealt.sortWithinPartitions(*key).select("conv_id", "digest", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    dealt = stored(dealt, "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "turn-parts")
    inner = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")) - 1
    rows = dealt.join(parts.select("conv_id", "part", "before"), ["conv_id", "part"])
    return stored(rows.select("conv_id", "part", (F.col("before") + inner).alias("place"), "digest", "n"), "placed"), parts


def spliced(rows: DataFrame, parts: DataFrame, *, other: Column, turns: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: paths (conv_id, part, depth, x, y, n, last) and conversations (conv_id, length).

    `other` names the conversation and `turns` the number of turns (`most` at most)
    that are taken from it: all it has if fewer, none if it is absent. The
    conversation's own first `turns` turns are left out. Every conversation is
    kept, also one without turns.
    """
    convs = parts.groupBy("conv_id").agg(F.sum("rows").alias("rows"), F.min("part").alias("first_part"))
    convs = stored(convs.select("*", other.cast("long").alias("other"), turns.cast("long").alias("own_from")), "convs")
    has = convs.select(F.col("conv_id").alias("other"), F.col("rows").alias("there"))
    taken = F.least("own_from", F.coalesce("there", F.lit(0)))
    convs = convs.join(has, "other", "left").withColumn("taken", taken)
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("rows") - F.col("own_from"), F.lit(0))), "spliced-convs")
    of = parts.select("conv_id", "part").join(convs.select("conv_id", "own_from", "taken", "length"), "conv_id")
    own = rows.join(of, ["conv_id", "part"]).where("place >= own_from")
    own = own.select("conv_id", "part", (F.col("place") - F.col("own_from") + F.col("taken") + 1).alias("depth"), "digest", "n", "length")
    heads = rows.where(F.col("place") < most).select(F.col("conv_id").alias("other"), "place", "digest", "n")
    head = convs.where("taken > 0").join(heads, "other").where("place < taken")
    head = head.select("conv_id", F.col("first_part").alias("part"), (F.col("place") + 1).alias("depth"), "digest", "n", "length")
    both = own.unionByName(head).select("conv_id", "part", "depth", F.xxhash64("depth", "digest").alias("x"), F.xxhash64("digest", "depth", F.lit(1)).alias("y"), "n", (F.col("depth") == F.col("length")).alias("last"))
    return stored(both, "paths"), convs.select("conv_id", "length")


def _keys(paths: DataFrame) -> DataFrame:
    """Paths with the keys of their node (kx, ky) and of its parent (px, py)."""
    parts = paths.groupBy("conv_id", "part").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    several = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("parts", several).where("parts > 1")
    carried = stored(carried.select("conv_id", "part", *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"c{c}") for c in "xy")), "carried")
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = join_checked(paths, carried, ["conv_id", "part"], "left")
    rows = rows.select("conv_id", "part", "depth", "n", "last", "x", "y", *(F.coalesce(f"c{c}", F.lit(0)).bitwiseXOR(F.expr(f"bit_xor({c})").over(here)).alias(f"k{c}") for c in "xy"))
    return rows.select("conv_id", "part", "depth", "n", "last", "kx", "ky", *(F.col(f"k{c}").bitwiseXOR(F.col(c)).alias(f"p{c}") for c in "xy"))


def _merged(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Node table and ends (kx, ky, span, ids) of all partial tables, merged `FAN` at a time."""
    key, lanes = ["kx", "ky"], -(-parts // FAN)
    same = [F.min(c).alias(c) for c in ("px", "py", "depth", "n", "conv_id")]
    rows = rows.withColumn("lane", F.floor(F.col("part") / FAN))
    nodes = rows.groupBy(*key, "lane").agg(*same, F.count(F.lit(1)).alias("n_convs"))
    ends = rows.where("last").groupBy(*key, F.expr(f"conv_id div {IDS}").alias("span"), "lane").agg(F.collect_list("conv_id").alias("ids"))
    while lanes > 1:
        lanes = -(-lanes // FAN)
        upper = F.floor(F.col("lane") / FAN).alias("lane")
        nodes = nodes.groupBy(*key, upper).agg(*same, F.sum("n_convs").alias("n_convs"))
        ends = ends.groupBy(*key, "span", upper).agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return nodes.drop("lane"), ends.drop("lane")


def _with_parents(nodes: DataFrame) -> DataFrame:
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("kx"), F.col("py").alias("ky")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = stored(children.join(nodes.select("kx", "ky", "conv_id"), ["kx", "ky"]).toDF("px", "py", "n_children", "parent_conv_id"), "parents")
    found = lookup(nodes, parents, ["px", "py"], "n_children")
    known = parents.select(F.col("px").alias("kx"), F.col("py").alias("ky"), "n_children")
    return found.join(known, ["kx", "ky"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def _chain_sums(chains: DataFrame) -> DataFrame:
    """Chains (conv_id, parent, saved, leaves) with sums over all chains below, by doubling the distance each step."""
    now = stored(chains.select("conv_id", F.col("parent").alias("above"), "saved", "leaves"), "chains")
    while not now.where("above is not null").isEmpty():
        given = now.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count(F.lit(1)).alias("uses"))
        given = stored(given, "chains-given")
        farther = given.select("conv_id", "uses").join(now.select("conv_id", F.col("above").alias("farther")), "conv_id").select(F.col("conv_id").alias("above"), "uses", "farther")
        moved = lookup(now, stored(farther, "chains-above"), ["above"], "uses").drop("above").withColumnRenamed("farther", "above")
        moved = moved.join(given.drop("uses"), "conv_id", "left")
        now = stored(moved.select("conv_id", "above", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves"))), "chains")
    return now.select("conv_id", "saved", "leaves")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    own = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    chains = own.groupBy("conv_id").agg(F.min("depth").alias("head"), F.min_by("parent_conv_id", "depth").alias("parent"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = stored(chains, "chain-heads")
    sums = _chain_sums(chains)
    below = chains.where("parent is not null").select("conv_id", "parent", (F.col("head") - 1).alias("depth")).join(sums, "conv_id")
    below = below.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    rows = own.join(below, ["conv_id", "depth"], "left")
    for c in ("saved", "leaves"):
        rows = rows.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).drop(f"more_{c}")
    rows = stored(rows.withColumn("level", F.expr(f"depth div {DEPTHS}")), "chain-nodes")
    deep = rows.where("level > 0").groupBy("conv_id", "level").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    deep = deep.unionByName(deep.select("conv_id", F.lit(0).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("leaves")).distinct())
    later = Window.partitionBy("conv_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    deep = stored(deep.select("conv_id", "level", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"deep_{c}") for c in ("saved", "leaves"))), "deep-chains")
    rows = join_checked(rows, deep, ["conv_id", "level"], "left")
    here = Window.partitionBy("conv_id", "level").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(c).over(here) + F.coalesce(f"deep_{c}", F.lit(0)) for c in ("saved", "leaves")}
    return rows.select("kx", "ky", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total["leaves"].alias("n_leaves"), total["saved"].alias("saved_tokens"))


def trie(paths: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and the ids that end at each node in ranges: (kx, ky, span, ids ascending).

    `paths` has a row for each turn of each conversation (see spliced), `convs` the
    conversations and their lengths. A node has its key (kx, ky), conv_id (its
    smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves and saved_tokens. Without conversations there is no node.
    """
    parts = (paths.agg(F.max("part")).first()[0] or 0) + 1
    nodes, ends = _merged(_keys(paths), parts)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("kx"), zero.alias("ky"), none.alias("px"), none.alias("py"), zero.alias("depth"), zero.alias("n"), "conv_id", "n_convs")
    turnless = convs.where("length = 0").groupBy(F.expr(f"conv_id div {IDS}").alias("span")).agg(F.collect_list("conv_id").alias("ids"))
    ends = ends.unionByName(turnless.select(zero.alias("kx"), zero.alias("ky"), "span", "ids"))
    nodes = stored(nodes.unionByName(root), "nodes")
    found = _rolled_up(stored(_with_parents(nodes), "family"))
    return found, stored(ends.withColumn("ids", F.sort_array("ids")), "ends")
