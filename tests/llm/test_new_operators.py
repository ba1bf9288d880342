"""Language ID, the conversation trie and the Merkle manifest."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm import langid, merkle, tries
from llm.registry import QUERIES, SQL
from pyspark.sql import functions as F

from tests import oracle
from tests.llm import tables

TRIE, TREE, LANG = "op12_conversation_prefix_trie", "op13_merkle_manifest", "op11_bigru_language_id"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- language ID


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], dtype=np.float64)
    x, y = rng.integers(97, 140, (9, 5)).astype(np.int16), np.array([0, 1, 2, 0, 1])
    x[6:, 1] = langid.PAD
    _, grads = net.gradients(x, y)
    for v, g in zip(net.weights(), grads):
        for i in [tuple(rng.integers(0, s) for s in v.shape), tuple(a[0] for a in np.nonzero(g))]:
            kept, losses = v[i], []
            for e in (1e-5, -1e-5):
                v[i] = kept + e
                losses.append(net.gradients(x, y)[0])
            v[i] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - g[i]) < 1e-7


def test_scoring_labels_every_byte_of_whole_texts():
    net = langid.Network(["a", "b", "c"], dtype=np.float64)
    texts = ["", "x", "ünï" * 70, "word " * 1000, "12 !"]
    got = langid.pooled(net.fast(), pa.array(texts))
    for text, p in zip(texts, got):
        data, total, n = np.frombuffer(text.encode(), np.uint8), np.zeros(3), 0
        for a in range(0, len(data), langid.WINDOW):
            x = np.full((langid.WINDOW, 1), langid.PAD)
            x[: len(data[a : a + langid.WINDOW]), 0] = data[a : a + langid.WINDOW]
            states = np.concatenate((langid._forward(net.sides[0], x)[0], langid._forward(net.sides[1], x[::-1])[0][::-1]), 2)
            e = np.exp(states @ net.top["out"] + net.top["bias"])[:, 0]
            letters = [i for i, b in enumerate(x[:, 0]) if b != langid.PAD and (b > 127 or chr(b).isalpha())]
            total += (e / e.sum(1, keepdims=True))[letters].sum(0)
            n += len(letters)
        assert np.allclose(p, total / max(1, n), atol=1e-4)


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in QUERIES[LANG](spark, "/root/testdata/sf0.01").collect()}
    docs = tables.read("/root/testdata/sf0.01")
    assert len(rows) == len(docs)
    right = []
    for d in docs:
        r = rows[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not d["text"] or not any(c.isalpha() for c in d["text"]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and d["lang"]:
            right.append(r.lang_pred == d["lang"])
    assert np.mean(right) > 0.97


def test_languages_of_odd_tables(spark, tmp_path):
    assert QUERIES[LANG](spark, tables.empty_dir(tmp_path)).count() == 0
    sf = tables.odd_dir(tmp_path)
    got = {r.doc_id: r.lang_pred for r in QUERIES[LANG](spark, sf).collect()}
    assert {k for k, v in got.items() if v == "und"} == {20, 21, 22} and set(got.values()) == {"und", "en"}
    sf = tables.write(tmp_path / "twice", tables.DOUBLED)
    assert QUERIES[LANG](spark, sf).count() == len(tables.DOUBLED)
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).collect()[0].lang_pred == "und"


# --- conversation trie


def conversations(tmp_path, rows, name="odd"):
    columns = list(zip(*rows)) if rows else ([], [], [], [])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    table = {c: pa.array(v, k) for c, v, k in zip(("conv_id", "turn", "role", "text"), columns, kinds)}
    table |= {c: pa.array(["x"] * len(rows), pa.string()) for c in ("kx", "depth", "n", "part", "digest", "salt")}
    return tables.write(tmp_path / name, [], columns={"conversations": table})


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), h(f"{len(role.encode())}:{role}{text}")[:32], role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        n = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:n] + mine[n:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        under = [v for v in members if v[: len(node)] == node]
        leaves = [v for v in under if not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in under if v)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(v) == len(node) + 1 for v in under), len(leaves), saved, h(ends)))
    return sorted(out, key=str)


ODD_TURNS = [(100, t, "user", f"t{t}") for t in range(9)] + [(c, t, "user" if t % 2 else None, f"t{t}" if t < 4 else f"{c}") for c in (101, 102, 103, 140, 199) for t in range(c % 7)]
ODD_TURNS += [(207, 1, "a", "same"), (207, 1, "a", "same"), (207, 1, "b", "same"), (207, None, None, None), (250, 0, "ü", "日本"), (None, 0, "a", "b"), (-5, 0, "a", "b"), (-105, 0, "a", "b"), (0, 0, "a", "b")]
ODD_TURNS += [(300, t, "user", "again and again") for t in range(40)] + [(c, t, "user", "again and again") for c in range(301, 330) for t in range(c % 40)]


@pytest.mark.parametrize("small", [False, True])
def test_trie_matches_brute_force_and_sql(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("FAN", 2), ("IDS", 3), ("DEPTHS", 4)):
            monkeypatch.setattr(tries, name, value)
    sf = conversations(tmp_path, ODD_TURNS)
    df = QUERIES[TRIE](spark, sf)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == brute_trie(ODD_TURNS)
    assert oracle.compare(df, oracle.connect(sf), SQL[TRIE]) == ""
    assert QUERIES[TRIE](spark, conversations(tmp_path, [], "none")).count() == 0


def test_trie_of_the_tables_matches_sql(spark):
    assert oracle.compare(QUERIES[TRIE](spark, tables.SF), oracle.connect(tables.SF), SQL[TRIE]) == ""


# --- Merkle manifest


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        run = level[a : a + 16]
        out.append((i - a, run[: i - a] + run[i - a + 1 :]))
        i //= 16
    return out


def brute_manifest(rows):
    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [brute_tree([leaf(r, r["text"]) for r in groups[s]]) for s in order]
    top, out = brute_tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path, folded = brute_path(trees[k], i) + brute_path(top, k), trees[k][0][i]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                folded = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for at, others in path:
                folded = h("".join([*others[:at], folded, *others[at:]]))
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], h("".join(x for _, o in path for x in o)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


@pytest.mark.parametrize("leaves", [50_000, 7, 40])
def test_manifest_matches_brute_force_and_sql(spark, tmp_path, monkeypatch, leaves):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    sf = tables.odd_dir(tmp_path) if leaves > 40 else tables.SF
    df = QUERIES[TREE](spark, sf)
    assert manifest_rows(df) == brute_manifest(tables.read(sf))
    assert oracle.compare(df, oracle.connect(sf), SQL[TREE]) == ""


def test_manifest_of_odd_rows(spark, tmp_path, monkeypatch):
    assert QUERIES[TREE](spark, tables.empty_dir(tmp_path)).count() == 0
    rows = [*tables.DOUBLED, *[(5, "Same Row")] * 100, (None, "A" * 50_000)]
    sf = tables.write(tmp_path / "twice", rows)
    monkeypatch.setattr(merkle, "LEAVES", 20)
    assert manifest_rows(QUERIES[TREE](spark, sf)) == brute_manifest(tables.read(sf))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 1000])
def test_subtrees_of_every_cut(n):
    """Segments at all kinds of cuts: each node that a segment builds has its hash, and what it can't build is loose."""
    leaves = [h(str(i)) for i in range(n)]
    levels = brute_tree(leaves)
    for cuts in ([0, n], [0, n // 2, n], [0, 1, n // 3, n - 1, n], list(range(0, n, 37)) + [n]):
        cuts = sorted(set(cuts))
        runs, roots = {}, []
        for a, z in zip(cuts, cuts[1:]):
            for kind, _, some, path, level, idx, node, total in merkle._segment("g", [(i, None, leaves[i], None) for i in range(a, z)], a, n):
                assert total == n
                if kind == "loose":
                    assert levels[level][idx] == node and (level or some[0][0] == idx)
                elif kind == "root":
                    roots.append(node)
                else:
                    for x in some:
                        runs[x[0]] = path
                    if n > 1:
                        assert path == brute_path(levels, some[0][0])[1 : 1 + len(path)]
        assert all(x == levels[-1][0] for x in roots)
        if len(cuts) == 2:
            assert roots and len(runs) == n


def test_proofs_fold_to_the_root(spark):
    docs = spark.read.parquet(f"{tables.SF}/documents.parquet")
    runs = merkle.manifest(docs, group="source", order="doc_id", leaf=merkle.framed(F.col("text")), altered=F.lit(None).cast("string"))
    rows = merkle.proofs(runs).collect()
    assert len(rows) == docs.count()
    assert all(merkle._folded(r.leaf, [s.asDict() for s in r.siblings]) == r.root for r in rows)
