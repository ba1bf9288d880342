"""The operators on whole texts against brute force: substring, near-duplicate and byte dedup, packing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm.registry import QUERIES

from tests.llm import tables

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALL = ("op4_substring_dedup", "op5_minhash_near_dedup", "op7_suffix_dedup", "op10_minimum_bin_slack_packing")


def dirs(tmp):
    return [tables.odd_dir(tmp), tables.SF]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    first, out = {}, {}
    for d in docs:
        words = WORD.findall((d["text"] or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if first.setdefault(hash(tuple(words[i : i + 50])), d["doc_id"]) != d["doc_id"]:
                gone[i : i + 50] = [True] * 50
        out[d["doc_id"]] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def near(docs):
    sets = {}
    for d in docs:
        words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (d["text"] or "").encode()))
        sets[d["doc_id"]] = {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    shared = Counter()
    for ids in holds.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    least = {}
    for i in sorted(sets):
        least.setdefault(top(i), i)
    return {i: (len(s), least[top(i)], least[top(i)] == i) for i, s in sets.items()}


def suffix(docs):
    times, passages = Counter(), Counter()
    for d in docs:
        w = WORD.findall((d["text"] or "").encode())
        passages.update(hash(tuple(w[i : i + 50])) for i in range(len(w) - 49))
        b = (d["text"] or "").encode()
        times.update(hash(b[i : i + 400]) for i in range(len(b) - 399))
    out = {}
    for d in docs:
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if times[hash(b[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        w = WORD.findall(b)
        held = bytearray(len(w))
        for i in range(len(w) - 49):
            if passages[hash(tuple(w[i : i + 50]))] > 1:
                held[i : i + 50] = b"\1" * 50
        out[d["doc_id"]] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g)), sum(held))
    return out


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("name, brute, columns", [(ALL[0], substring, "n_words n_removed kept_sha256"), (ALL[1], near, "n_shingles component_id kept"), (ALL[2], suffix, "n_bytes n_removed n_spans kept_sha256 n_repeated_words")])
def test_equals_brute_force(spark, tmp_path, which, name, brute, columns):
    sf = dirs(tmp_path)[which]
    want = brute(tables.read(sf))
    rows = QUERIES[name](spark, sf).collect()
    got = {r["doc_id"]: tuple(r[c] for c in columns.split()) for r in rows}
    assert len(rows) == len(want)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


@pytest.mark.parametrize("which", [0, 1])
def test_packing_holds_each_id_once(spark, tmp_path, which):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = dirs(tmp_path)[which]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES[ALL[3]](spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    docs = tables.read(sf)
    total = 0
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces.pop(d["doc_id"]), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    assert not pieces
    padded = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.001 * total


@pytest.mark.parametrize("name", ALL)
def test_empty_and_doubled_rows(spark, tmp_path, name):
    assert QUERIES[name](spark, tables.empty_dir(tmp_path)).count() == 0
    rows = QUERIES[name](spark, tables.write(tmp_path / "doubled", tables.DOUBLED)).collect()
    assert Counter(r.doc_id for r in rows) >= Counter(d for d, _ in tables.DOUBLED)
    if name != ALL[3]:
        assert len(rows) == len(tables.DOUBLED)
    if name == ALL[0]:  # equal rows don't repeat each other; a larger id does; a row without id takes no part
        assert sorted((r.doc_id or 0, r.n_removed) for r in rows if r.n_words == 180) == [(0, 0), (1, 0), (1, 0), (3, 180)]
    if name == ALL[1]:
        assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == 3} == {(1, 1, True), (3, 1, False), (None, None, True)}
    if name == ALL[2]:  # every copy is a place of its own
        assert all(r.n_removed == r.n_bytes for r in rows if r.n_bytes > 400)


def test_links_between_copies_that_miss_their_hub(spark, tmp_path):
    """A chain of copies around 0.8, so that many meet under a key whose smallest document they are not linked with."""
    import random

    rng = random.Random(3)
    base = tables.prose(rng, 60, 40).split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(0, 9)):
            words[at] = f"{rng.choice('xyz')}{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    sf = tables.write(tmp_path / "copies", rows)
    want = near(tables.read(sf))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES[ALL[1]](spark, sf).collect()}
    assert got == want and 1 < len({c for _, c, _ in want.values()}) < 150
