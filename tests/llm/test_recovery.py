"""Writes that fail or meet, licence texts, and the pipeline's stages on odd tables."""

import pytest
from llm import licenses, sharding, stages
from llm.queries_more import op3_license_scan
from pyspark.sql import functions as F

from tests.llm import tables


def _rows(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))


def test_append_again_after_a_failure(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/shards"
    arrival = F.floor(F.col("doc_id") / 100)
    with monkeypatch.context() as m:
        m.setattr(sharding, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("the driver is lost")))
        with pytest.raises(OSError):
            sharding.append(_rows(spark, 1000), root, arrival=arrival)
    assert sharding.version(spark, root) == 0
    assert sharding.append(_rows(spark, 1000), root, arrival=arrival) == 1
    assert sharding.read(spark, root).count() == 1000 == sharding.manifest(spark, root).agg(F.sum("docs")).first()[0]
    with monkeypatch.context() as m:
        m.setattr(sharding, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("the driver is lost")))
        with pytest.raises(OSError):
            sharding.compact(spark, root, base=20_000, fanout=2, tiers=2)
    assert sharding.compact(spark, root, base=20_000, fanout=2, tiers=2) == 2
    assert sharding.read(spark, root).select("doc_id").distinct().count() == 1000 == sharding.read(spark, root).count()


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/shards"
    arrival = F.floor(F.col("doc_id") / 100)
    sharding.append(_rows(spark, 200), root, arrival=arrival)
    commit = sharding.commit

    def late(spark, root, shards, after):
        monkeypatch.setattr(sharding, "commit", commit)
        sharding.append(_rows(spark, 300), root, arrival=arrival)  # the other writer is first
        return commit(spark, root, shards, after)

    monkeypatch.setattr(sharding, "commit", late)
    with pytest.raises(sharding.Conflict):
        sharding.append(_rows(spark, 700), root, arrival=arrival)
    assert sharding.read(spark, root).count() == 500


def test_license_files_and_headers(spark):
    body = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{licenses._MIT}\n\n{licenses._AS_IS}"
    apache = "\n".join(f"# {line}" for line in licenses._APACHE.split(". ")) + "\n\n" + "some code of words\n" * 200
    rows = [("a/LICENSE", body), ("a/b/c/code", "some prose"), ("d/x", apache), ("d/y", "// SPDX-License-Identifier: GPL-3.0\nint main"), ("d/z", "License to all"), ("e/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"), ("a/long", "word " * 200_000)]
    rows += [("f/1", licenses._ISC), ("f/2", ""), ("f/q", None), ("f/q", None)]
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "path string, text string, n int, words string")
    got = sorted(((r.path, r.license, r.how, r.source_dir, r.kept.n) for r in licenses.licenses(docs, keep=["n"]).collect()), key=lambda r: r[4])
    assert [g[1:4] for g in got] == [("MIT", "file", "a"), ("MIT", "inherited", "a"), ("Apache-2.0", "header", None), ("GPL-3.0", "file", "d"), ("GPL-3.0", "inherited", "d"), ("Apache-2.0", "file", "e"), ("MIT", "inherited", "a"), ("ISC", "file", "f"), *[("ISC", "inherited", "f")] * 3]


def test_license_cosine_equals_brute_force(spark):
    import math
    from collections import Counter

    model = licenses.Model(licenses.TEMPLATES, {"the": 900, "license": 20, "of": 800}, 1000, licenses.THRESHOLD)

    def brute(part):
        weigh = lambda words: {w: c * (math.log(1001 / (1 + {"the": 900, "license": 20, "of": 800}.get(w, 0))) + 1 if w in model.idf else model.most) for w, c in Counter(words).items()}
        v, best = weigh(part), (0.0, "")
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                u = weigh(licenses.tokens(t))
                score = sum(x * u.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
                if score > best[0] + 1e-12:
                    best = (score, name)
        return best

    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        for part in (licenses.tokens(text), licenses.tokens(text)[:-1] + ["other"], licenses.tokens(text)[::2]):
            want, got = brute(part), model.best(part)
            assert (got is None) == (want[0] < licenses.THRESHOLD) and (got is None or abs(got[0] - want[0]) < 1e-9)


def test_license_scan_of_odd_tables(spark, tmp_path):
    rows = op3_license_scan(spark, tables.write(tmp_path / "doubled", tables.DOUBLED)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((d for d, _ in tables.DOUBLED), key=str)
    assert op3_license_scan(spark, tables.empty_dir(tmp_path)).count() == 0
    assert op3_license_scan(spark, tables.odd_dir(tmp_path)).count() == len(tables.odd_texts())


def test_near_dedup_stage_tells_texts_of_one_id_apart(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a", 30)), (1, words("a", 30)), (2, words("b", 30)), (2, words("c", 30)), (None, words("d", 30)), (None, words("e", 30)), (None, None), (None, None), (3, words("a", 30) + " z"), (4, "")]
    docs = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], "doc_id long, text string, score string")
    left = stages.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and left.count() == 8
    assert {(r.doc_id, (r.text or "")[:2]) for r in left.collect()} >= {(2, "b0"), (2, "c0"), (None, "d0"), (None, "e0"), (None, ""), (4, "")}


def test_stages_keep_clashing_columns(spark, tmp_path):
    sf = tables.SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("PII", F.lit("mine")).withColumn("benchmark_hits", F.lit("mine"))
    for stage in (stages.keep_quality, stages.drop_contaminated, stages.pseudonymise):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.where("score <> 'mine' or PII <> 'mine' or benchmark_hits <> 'mine'").count() == 0 < out.count()
