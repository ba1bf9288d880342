"""Token ids by parts against the tokenizer's own ids of whole texts."""

import json
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts, path=PATH):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def by_parts(texts, path=PATH):
    ids = tokens.WordIds(path)
    return [np.frombuffer(x, ids.kind).tolist() for x in ids.encode(texts)]


def odd_texts(n=4000):
    rng = random.Random(5)
    kinds = [
        [chr(c) for c in range(256)],
        [*"'''stmdrevl aS\"5 "],
        [*"aé ÉßµªºÀ×÷²¼½\x85\xa0\n\t'"],
        [*"ab 'ΣσςİıŁłé日本語́ 　Kι½٣🙂 "],
        ["don't", "we've", "they'll", " I'm ", "x'd", "''s", "'s't", "<|endoftext|>", "<|", " ", "\x1c", "\x1f", "Привет", "naïve"],
    ]
    return ["", " ", "'", "'s", "'ll", "'l", "a'"] + ["".join(rng.choices(kind, k=rng.randrange(1, 40))) for kind in kinds for _ in range(n // len(kinds))]


def test_odd_texts_alone_and_together():
    texts = odd_texts()
    want = whole(texts)
    got = by_parts(texts)
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    few = texts[::40]
    assert [by_parts([t])[0] for t in few[:20]] == want[::40][:20]


@pytest.mark.parametrize("block", [1, 7, 100])
def test_texts_longer_than_a_block(monkeypatch, block):
    texts = odd_texts(300) + ["x" * 500, "word " * 200, "日本 don't " * 50, " " * 400, ""]
    monkeypatch.setattr(tokens, "BLOCK", block)
    assert by_parts(texts) == whole(texts)


def test_full_caches_keep_what_is_needed(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 5)
    ids = tokens.WordIds(PATH)
    rng = random.Random(1)
    words = ["one", "two's", "trzyń", "четыре", "5678", "éé", "(seven)", "ośem"]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=6)) for _ in range(3)]
        assert [np.frombuffer(x, ids.kind).tolist() for x in ids.encode(texts)] == whole(texts)
        assert len(ids.parts) <= 5 + 40 and len(ids.words) <= 5 + 40


def test_a_tokenizer_with_other_rules(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = None
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    texts = ["Upper AND lower", "don't", "É é", "ΣΑΣ"]
    assert by_parts(texts, path) == whole(texts, path) != whole(texts)


def test_a_vocabulary_that_lacks_characters(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        rules = json.load(f)
    for token in ("q", "q</w>"):
        del rules["model"]["vocab"][token]
    rules["model"]["merges"] = [m for m in rules["model"]["merges"] if "q" not in "".join(m)]
    path = str(tmp_path / "lacks.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    texts = ["one two", "q", "aq qa q three", "qq don't"]
    assert by_parts(texts, path) == whole(texts, path)


def test_known_parts_take_no_step_for_each_word():
    """20,000 words of few parts: no call for each of them, and no entry in a cache."""
    ids = tokens.WordIds(PATH)
    texts = [" ".join(f"{c}{n}" for c in "abcd" for n in range(5000))]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = ids.encode(texts)
    finally:
        sys.setprofile(None)
    assert np.frombuffer(got[0], ids.kind).tolist() == whole(texts)[0]
    assert len(ids.words) + len(ids.parts) == 14
    assert calls < 1000
