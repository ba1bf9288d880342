"""Queries of the conversation trie and the Merkle manifest, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import merkle, tries
from llm.storage import small_batches

NOTHING = hashlib.sha256(b"").hexdigest()


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a short text, where the one row of `crc_table` is joined."""
    step = "lambda a, x: xor(a >> 8, crc_t[(xor(a, x) & 255) + 1])"
    codes = f"list_transform(range(1, CAST(length({value}) AS BIGINT) + 1), lambda j: CAST(ascii(substr({value}, j, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, {step}, 4294967295), 4294967295)"


CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM (SELECT i,
  list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) AS v FROM range(256) r(i)))"""


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends; rows come by node and range, and only one node's hash is held."""
    node, hashed = None, None
    for batch in batches:
        out: list[tuple] = []
        for kx, ky, ids in zip(*(batch.column(c).to_pylist() for c in ("kx", "ky", "ids"))):
            text = ",".join(map(str, ids)).encode()
            if (kx, ky) == node:
                hashed.update(b"," + text)
                continue
            if node is not None:
                out.append((*node, hashed.hexdigest()))
            node, hashed = (kx, ky), hashlib.sha256(text)
        yield _digest_rows(out)
    if node is not None:
        yield _digest_rows([(*node, hashed.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kx", "ky", "ends_sha256"])


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each with the first turns of the first one of its hundred."""
    small_batches(spark)
    rows, parts = tries.placed(tries.digested(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    conv = F.col("conv_id")
    paths, convs = tries.spliced(rows, parts, other=conv - conv % 100, turns=F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    nodes, ends = tries.trie(paths, convs)
    ends = ends.repartition("kx", "ky").sortWithinPartitions("kx", "ky", "span").select("kx", "ky", "ids")
    ends = ends.mapInArrow(_ends_digest, "kx long, ky long, ends_sha256 string")
    return nodes.join(ends, ["kx", "ky"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


TRIE_SQL = f"""WITH {CRC_TABLE},
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) - 1 AS place FROM (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, left(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS dig
  FROM conversations WHERE conv_id IS NOT NULL)),
cs AS (SELECT c, len, c - c % 100 AS base, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT c, count(*) AS len FROM o GROUP BY c), crc_table),
k AS (SELECT cs.*, least(cs.h, coalesce(b.len, 0)) AS k FROM cs LEFT JOIN cs b ON b.c = cs.base),
p AS (SELECT k.c, o.place - k.h + k.k + 1 AS d, r, t FROM k JOIN o ON o.c = k.c WHERE o.place >= k.h
  UNION ALL SELECT k.c, o.place + 1, r, t FROM k JOIN o ON o.c = k.base AND o.place < k.k),
every AS (SELECT c, d, length(t) AS n, sha256(string_agg(strlen(r) || ':' || strlen(t) || ':' || r || t, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM p
  UNION ALL SELECT c, 0, 0, '' FROM k),
node AS (SELECT key, d, min(c) AS conv, count(*) AS n_convs, any_value(n) AS n FROM every GROUP BY key, d),
link AS (SELECT DISTINCT e.key, f.key AS up FROM every e JOIN every f ON f.c = e.c AND f.d = e.d - 1),
kids AS (SELECT up AS key, count(*) AS n_children FROM link GROUP BY up),
sub AS (SELECT e.key, sum((u.n_convs - 1) * u.n) AS saved, count(*) FILTER (WHERE kids.key IS NULL) AS leaves
  FROM node u LEFT JOIN kids ON kids.key = u.key JOIN every e ON e.c = u.conv AND e.d <= u.d GROUP BY e.key),
ends AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, key FROM every QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY key)
SELECT node.conv AS conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children,
  sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN sub ON sub.key = node.key LEFT JOIN kids ON kids.key = node.key LEFT JOIN ends ON ends.key = node.key
LEFT JOIN link ON link.key = node.key LEFT JOIN node parent ON parent.key = link.up"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest of all documents, and the root folded from its (for a fifth: tampered) leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, merkle.framed(*fields, F.translate("text", UPPER, LOWER)))
    runs = merkle.manifest(docs, group="source", order="doc_id", leaf=merkle.framed(*fields, F.col("text")), altered=tampered)
    found = merkle.checked(runs)
    return found.select(F.col("ord").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _framed_sql(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    """All nodes (grp, level, idx, h) over `leaves` (grp, idx, h)."""
    return f"""{name} AS (SELECT grp, 0 AS level, idx, h FROM {leaves} UNION ALL
  SELECT grp, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY grp, level, idx // 16)"""


#: A leaf's path: itself in its group's tree, then its group's root in the upper tree (levels from 1000 on).
MERKLE_SQL = f"""WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_framed_sql("text")} AS leaf,
  CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_framed_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents, crc_table),
leaves AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
{_levels_sql("low", "leaves")},
subroots AS (SELECT grp AS of, h FROM low QUALIFY level = max(level) OVER (PARTITION BY grp)),
tops AS (SELECT '' AS grp, of, h, row_number() OVER (ORDER BY of) - 1 AS idx FROM subroots),
{_levels_sql("high", "tops")},
node AS (SELECT grp, level, idx, h, count(*) OVER (PARTITION BY grp, level) AS n FROM low
  UNION ALL SELECT 'top', level + 1000, idx, h, count(*) OVER (PARTITION BY level) FROM high),
step AS (SELECT grp, level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM node WHERE n > 1 GROUP BY grp, level, idx // 16),
walk AS (SELECT leaves.grp, leaves.idx AS leaf_idx, 0 AS level, leaves.grp AS tree, leaves.idx AS idx, coalesce(altered, leaf) AS h, '' AS proof, tops.idx AS top_idx
    FROM leaves JOIN tops ON tops.of = leaves.grp
  UNION ALL
  SELECT w.grp, w.leaf_idx, CASE WHEN s.grp IS NULL THEN 1000 ELSE w.level + 1 END, CASE WHEN s.grp IS NULL THEN 'top' ELSE w.tree END,
    CASE WHEN s.grp IS NULL THEN w.top_idx ELSE w.idx // 16 END,
    CASE WHEN s.grp IS NULL THEN w.h ELSE sha256(array_to_string(s.hs[: w.idx % 16], '') || w.h || array_to_string(s.hs[w.idx % 16 + 2 :], '')) END,
    CASE WHEN s.grp IS NULL THEN w.proof ELSE w.proof || array_to_string(s.hs[: w.idx % 16], '') || array_to_string(s.hs[w.idx % 16 + 2 :], '') END, w.top_idx
    FROM walk w LEFT JOIN step s ON s.grp = w.tree AND s.level = w.level AND s.run = w.idx // 16 WHERE s.grp IS NOT NULL OR w.tree <> 'top'),
root AS (SELECT h AS root FROM high QUALIFY level = max(level) OVER ()),
done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY grp, leaf_idx ORDER BY tree = 'top' DESC, level DESC) = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = root.root AS verified
FROM leaves l JOIN subroots s ON s.of = l.grp JOIN done d ON d.grp = l.grp AND d.leaf_idx = l.idx, root"""

QUERIES = {"op12_conversation_prefix_trie": op12_conversation_prefix_trie, "op13_merkle_manifest": op13_merkle_manifest}
SQL = {"op12_conversation_prefix_trie": TRIE_SQL, "op13_merkle_manifest": MERKLE_SQL}
