"""Sharding, neighbours, licences, pseudonyms, quality, decontamination and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm import ann, decontaminate, licenses, pii, sharding
from llm.registry import QUERIES, SQL
from pyspark.sql import functions as F

from tests import oracle
from tests.llm import tables

KEY = bytes(range(32))


def test_sharding_matches_sql(spark, tmp_path):
    for sf in (tables.SF, tables.odd_dir(tmp_path)):
        name = "op1_size_tiered_sharding"
        assert oracle.compare(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == ""


def test_sharding_keeps_old_versions_and_rows(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    assert sharding.append(rows, root, arrival=F.floor(F.col("doc_id") / 100)) == 1
    assert sharding.append(rows, root, arrival=F.floor(F.col("doc_id") / 100) + 100) == 2
    assert sharding.compact(spark, root, base=200_000, fanout=2, tiers=2) == 3
    assert sharding.manifest(spark, root, 2).count() == 60 > sharding.manifest(spark, root).count()
    for at, n in ((1, 3000), (2, 6000), (3, 6000)):
        assert sharding.read(spark, root, at).count() == n
    with pytest.raises(sharding.Conflict):
        sharding.commit(spark, root, sharding.manifest(spark, root), after=2)


def test_sharding_of_repeated_and_distant_arrivals(spark, tmp_path):
    """Arrival numbers that repeat (and nulls) stay shards of their own; a full shard isn't rewritten with a small one; gaps don't keep shards apart."""
    root = f"file://{tmp_path}/shards"
    rows = lambda n, size: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))
    sharding.append(rows(3, 1_000_000), root, arrival=F.lit(7))
    sharding.append(rows(1, 2), root, arrival=F.lit(7))
    sharding.append(rows(1, 2), root, arrival=F.lit(None))
    sharding.append(rows(1, 2), root, arrival=F.lit(None))
    at = sharding.compact(spark, root, base=1_000, fanout=4, tiers=3)
    assert sorted(r.bytes for r in sharding.manifest(spark, root, at).collect()) == [2, 2, 2, 3_000_000]
    sharding.append(rows(4, 1_500), root, arrival=F.col("doc_id") * 1_000_000)
    at = sharding.compact(spark, root, base=1_000, fanout=4, tiers=2)
    found = sharding.manifest(spark, root, at).collect()
    assert sorted(r.bytes for r in found) == [1500, 4506, 3_000_000] and len({(r.shard, r.attempt) for r in found}) == 3
    assert sharding.read(spark, root, at).count() == 10 and len({r.seq for r in found}) == 3


@pytest.mark.parametrize("blocks", [1, 3])
def test_neighbours_recall(spark, monkeypatch, blocks):
    rows = tables.read(tables.SF, "embeddings")
    ok = [r for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, vectors = np.array([r["vec_id"] for r in ok]), np.array([r["embedding"] for r in ok], float)
    monkeypatch.setattr(ann, "BLOCK", -(-len(ok) // blocks))
    got = {}
    for r in QUERIES["op2_permutation_ann"](spark, tables.SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, mine in got.items():
        mine.sort()
        far = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [s for *_, s in mine] == sorted(s for *_, s in mine)
        assert all(abs(far[ids == i][0] - s) < 1e-12 for _, i, s in mine)
        found, total = found + len(want & {i for _, i, _ in mine}), total + 10
    assert found / total >= 0.9


def test_neighbours_of_odd_vectors(spark, tmp_path):
    vectors = [[1.0, 2.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1.0, 2.0], [3.0, 4.0], [1.0], [float("inf"), 0.0]]
    sf = tables.write(tmp_path / "odd", [], columns={"embeddings": {"vec_id": pa.array([0, 1, 2, 3, 4, 100, 5, 6, 200]), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 9, pa.int32())}})
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in QUERIES["op2_permutation_ann"](spark, sf).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, round(8**0.5, 6)), (100, 1, 0, 0.0), (100, 2, 5, round(8**0.5, 6))]
    assert QUERIES["op2_permutation_ann"](spark, tables.empty_dir(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_neighbours(spark, tmp_path):
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (5, [4.0, 0.0])]
    names = {c: pa.array(["x"] * 4) for c in ("v", "row", "block", "part", "score")}
    sf = tables.write(tmp_path / "same", [], columns={"embeddings": {"vec_id": pa.array([i for i, _ in vectors]), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())), **names}})
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in QUERIES["op2_permutation_ann"](spark, sf).collect())
    far, root = 3.0, round(10**0.5, 6)
    assert got == sorted([(0, 1, 0, 1.0), (0, 2, 0, 1.0), (0, 3, 5, far)] + 2 * [(0, 1, 0, 0.0), (0, 2, 0, 1.0), (0, 3, 5, root)])


def test_licences_are_found_and_inherited(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", "some prose"), ("a/b/y", "Licensed under the Apache License, Version 2.0.\n" + "prose of other words " * 9), ("c/z", "prose"), (None, None), ("c/w", ""), ("c/w", "")]
    found = sorted(((r.path, r.license, r.how, r.source_dir) for r in licenses.licenses(spark.createDataFrame(rows, "path string, text string")).collect()), key=str)
    assert found == sorted([("a/LICENSE", "MIT", "file", "a"), ("a/b/x", "MIT", "inherited", "a"), ("a/b/y", "Apache-2.0", "header", None), ("c/z", None, None, None), (None, None, None, None), ("c/w", None, None, None), ("c/w", None, None, None)], key=str)


def test_feistel_permutes_every_range():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.feistel(i, size, KEY, "x") for i in range(size)) == list(range(size))


def test_pseudonyms_keep_formats_and_links(spark):
    text = "Mail ann.lee@example.org, card 4111 1111 1111 1111, born 1980-02-29, call 555-123-4567, from 192.168.0.1, ssn 123-45-6789; order 12345."
    rows = spark.createDataFrame([(1, text, "x"), (2, "again: " + text, "y"), (3, None, None), (4, "", "")], "doc_id long, text string, pii string")
    got = {r.doc_id: r for r in pii.pseudonyms(rows, key=KEY).collect()}
    assert got[3].text is None and got[4].text == "" and got[2].text == "again: " + got[1].text
    assert [x.kind for x in got[1].pii] == ["email", "card", "date", "phone", "ip", "ssn"]
    new = got[1].text
    assert "12345." in new and len(new) >= len(text) - 20
    for x in got[1].pii:
        value = new[x.start : x.end]
        assert value not in text or x.kind == "date"
        if x.kind == "card":
            assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", value) and pii.luhn(value.replace(" ", ""))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in tables.read(sf, "labels")}
    rows = QUERIES["op8_quality_ftrl"](spark, sf).collect()
    assert len(rows) == len(tables.read(sf))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    judged = [(marks[r.doc_id], r) for r in rows if r.held_out and marks.get(r.doc_id) in (0, 1)]
    assert sum(m == r.predicted for m, r in judged) / len(judged) >= 0.85


@pytest.mark.parametrize("name", ["op1_size_tiered_sharding", "op3_license_scan", "op6_pii_feistel", "op8_quality_ftrl", "op9_benchmark_decontamination", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    f = {**QUERIES, "pipeline": corpus_pipeline.run}[name]
    assert f(spark, tables.empty_dir(tmp_path)).count() == 0


def _edits(item: bytes, text: bytes) -> int:
    """Least edits between the item and any region of the text."""
    cost = np.zeros(len(text) + 1, int)
    data = np.frombuffer(text, np.uint8)
    step = np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.concatenate(([i + 1], np.minimum(cost[1:] + 1, cost[:-1] + (data != c))))
        cost = np.minimum.accumulate(new - step) + step
    return int(cost.min())


def test_decontamination_equals_full_alignment(spark):
    items = [(r["item_id"], r["text"]) for r in tables.read(tables.SF, "benchmark")][:8]
    docs = [(r["doc_id"], r["text"]) for r in tables.read(tables.SF) if len(r["text"] or "") < 4000][:40]
    for i, (_, t) in enumerate(items):
        docs += [(1000 + i, f"before it {t} after it"), (2000 + i, "before " + t[: len(t) // 2] + "zz" + t[len(t) // 2 + 3 :].upper()), (3000 + i, t[: len(t) // 2])]
    docs += [(9001, None), (9002, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {h.item_id: h.edits for h in r.benchmark_hits} for r in decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def folded(t):
        data, offsets, _ = decontaminate.fold(pa.array([t]))
        return data.tobytes()

    want = {d: {} for d, _ in docs}
    for i, t in items:
        item = folded(t).rstrip(b" ")
        most = len(item) // 10
        for d, text in docs:
            if text and (e := _edits(item, folded(text))) <= most:
                want[d][i] = e
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}
    assert all(want[1000 + i] for i in range(len(items)))


def test_short_items_are_searched_with_their_whole_budget(spark):
    rng = random.Random(5)
    items = ["abc def", "2 + 2 = 4", "q", "...", "", *("".join(rng.choice("abcd ") for _ in range(n)).strip() + "z" for n in range(8, 48))]
    folded = lambda t: decontaminate.fold(pa.array([t]))[0].tobytes().rstrip(b" ")

    def worn(t, n):
        out = list(t)
        for _ in range(n):
            out[rng.randrange(len(out))] = "y"
        return "".join(out)

    docs = [*items, "xabc defy", "ABC, def!", "we say 2+2=4.", "q q", None, *(f"some words {worn(t, len(folded(t)) // 10)} {worn(t, 3)} at the end" for t in items[5:])]
    long = " ".join(rng.choice(["abcd", "dcba", "aabb"]) for _ in range(20_000)) + " " + items[30]
    docs.append(long)
    found = decontaminate.contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {r.doc_id: {h.item_id: h.edits for h in r.benchmark_hits} for r in found.collect()}
    for i, text in enumerate(docs[:-1]):
        want = {}
        for k, t in enumerate(items):
            item, whole = folded(t), folded(text or "")
            if 0 < len(item) < 8 and b" " + item + b" " in b" " + whole + b" ":
                want[k] = 0
            elif len(item) >= 8 and whole and (e := _edits(item, whole)) <= len(item) // 10:
                want[k] = e
        assert got[i] == want, (text, got[i], want)
    assert got[len(docs) - 1][30] == 0


def test_decontamination_in_passes_equals_one_pass(spark, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in tables.read(tables.SF, "benchmark")][:12]
    docs = [(r["doc_id"], r["text"], "b") for r in tables.read(tables.SF)] + [(9001, None, None), (9002, "", None), (9003, items[0][1] + " and " + items[11][1], None), (9003, items[0][1] + " and " + items[11][1], None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, benchmark_hits string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        out = decontaminate.contamination(frame, bench)
        assert out.columns == ["doc_id", "text", "benchmark_hits"]
        return sorted(((r.doc_id, r.text or "", [tuple(h) for h in r.benchmark_hits]) for r in out.collect()))

    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    assert found() == whole and len(whole) == len(docs)
    assert [[h[0] for h in hits] for d, _, hits in whole if d == 9003] == [[items[0][0], items[11][0]]] * 2


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{tables.SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables.SF)
        assert after.columns == docs.columns
        kept = after.count()
        assert kept == before if name == "pii" else 0 < kept <= before
        docs, before = after, kept
    assert corpus_pipeline.run(spark, tables.SF).select("doc_id").distinct().count() == before
