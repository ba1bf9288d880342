"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are hashes of word unigrams and bigrams, of unigrams to trigrams of
word shapes (letters, digits and repeats folded, so noise around unseen words is
seen), and of a word that repeats the one before. Each n-gram adds its share of
the text, so a score is a sparse dot product that doesn't depend on length.

Training takes a sample of about `sample` labelled rows (a documented bound),
dealt to shards by hash. Every shard runs FTRL-Proximal over its own rows in
Spark tasks; the models are averaged by feature. The model has 2**18 weights at
any input size and is the only thing that is sent to the driver and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import arrays as A

BITS = 18
SAMPLE = 16_000
SHARD_ROWS = 2_000
SCALE = 12.0
#: Bytes of text whose features are held at once (about 60 times as much memory, in every worker).
CHUNK = 512 << 10
#: FTRL-Proximal: step size, smoothing, L1, L2, passes over a shard.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.002, 0.002, 6
_shape = np.arange(256, dtype=np.uint8)
_shape[48:58] = 57
_shape[65:91] = _shape[97:123] = _shape[128:] = 97


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of each text, and each text's first one (one more at the end)."""
    data, offsets = A.text_bytes(texts)
    start, end, first = A.words(data, offsets)
    word = A.word_hashes(data, start, end)
    folded = _shape[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[start] = True
    keep = inner[:-1] | np.concatenate(([True], folded[1:] != folded[:-1]))[: len(data)]
    place = np.concatenate(([0], np.cumsum(keep)))
    shape = A.word_hashes(folded[keep], place[start], place[end])
    parts = []
    for which, (base, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        at, row = A.window_starts(first, n)
        parts.append((row, A.mix(A.spans(A.prefix(base, 1), at, at + n, 1) + A.U64(which))))
    again = np.flatnonzero(word[1:] == word[:-1]) + 1
    again = again[~np.isin(again, first)]
    parts.append((np.searchsorted(first, again, "right") - 1, np.full(len(again), A.mix(np.full(1, 99, np.uint64))[0])))
    row = np.concatenate([p[0] for p in parts])
    number = (np.concatenate([p[1] for p in parts]) >> A.U64(64 - BITS)).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return number[order], np.searchsorted(row[order], np.arange(len(texts) + 1))


def _train(table: pa.Table) -> pa.Table:
    """FTRL-Proximal over one shard, rows in the order of their hash; a bias has the last number."""
    table = table.sort_by("at").combine_chunks()
    y = table.column("quality").to_numpy().astype(float)
    rows = []
    for chunk in A.chunks(iter(table.to_batches()), "text", CHUNK):
        number, first = features(chunk.column("text"))
        for a, z in zip(first[:-1], first[1:]):
            i, n = np.unique(number[a:z], return_counts=True)
            rows.append((np.append(i, 1 << BITS), np.append(n * (SCALE / max(1, z - a)), 1.0)))
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (i, x), label in zip(rows, y):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    i = np.flatnonzero(w)
    return pa.table({"feature": i, "weight": w[i]})


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights by feature number, the bias last, from rows of `labels` with a 0 or 1.

    A doc_id labelled twice counts once, with its highest label. Labels without
    document, documents without label, and nulls take no part. Without any
    labelled document all weights are 0, so every score is 0.5.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("quality"))
    total = marked.count()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    marked = marked.withColumn("at", at).where(F.col("at") < int((1 << 40) * min(1.0, sample / max(1, total))))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    shards = max(1, min(sample, total) // SHARD_ROWS)
    rows = texts.join(F.broadcast(marked), "doc_id")  # about `sample` rows at most
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards))).select("shard", "at", "quality", "text")
    mean = rows.groupBy("shard").applyInArrow(_train, "feature long, weight double").groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[mean.column("feature").to_numpy()] = mean.column("weight").to_numpy()
    return weights


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for chunk in A.chunks(batches, "text", CHUNK):
            number, first = features(chunk.column("text"))
            total = np.concatenate(([0.0], np.cumsum(w[number])))
            mean = (total[first[1:]] - total[first[:-1]]) * SCALE / np.maximum(1, np.diff(first))
            score = 1 / (1 + np.exp(-np.clip(mean + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(score)], [*chunk.schema.names, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """`docs` with a column score (0 to 1); null and empty texts have the score of the bias."""
    docs = docs.drop("score") if "score" in docs.columns else docs
    if text != "text":
        docs = docs.withColumn("text", F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scored(shared), f"{fields}, score double")


def held_out(id: str = "doc_id") -> Column:
    """The rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7) of every row."""
    weights = train(docs, labels.where(~held_out()))
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
