"""Near-duplicate links between documents whose signatures lie in different Arrow chunks."""

import random

from llm import near_dedup


def test_links_across_chunks(spark):
    """Each v is linked with its u alone, and every key that both have has smaller ids in both of their chunks."""
    rng = random.Random(7)
    fresh = iter(range(10**9))

    def changed(words, n):
        """n of the words replaced by words that no other text has."""
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"x{next(fresh)}"
        return out

    base = [f"w{i}" for i in range(100)]
    rows = [(i, changed(base, 4)) for i in range(80)]
    for k in range(12):
        u = changed(base, 6)
        v = list(u)
        for i in rng.sample([i for i, w in enumerate(u) if w[0] == "w"], 10):
            v[i] = f"x{next(fresh)}"
        rows += [(100 + k, u), (200 + k, v)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=1, batch=20).collect()}
    assert got == {i: 0 for i, _ in rows}


def test_large_component_takes_in_what_reaches_it(spark, monkeypatch):
    import random

    from llm import near_dedup

    monkeypatch.setattr(near_dedup, "LARGE", 4)
    monkeypatch.setattr(near_dedup, "OUTLIERS", 3)
    monkeypatch.setattr(near_dedup, "MEMBERS", 5)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(60)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 2]) for i in range(59)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expected = {i: find(i) for i in range(len(texts))}
    assert 1 < len(set(expected.values())) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(docs, shingle=2, batch=7).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
