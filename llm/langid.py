"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of `WINDOW`; in every window one
recurrence runs forward and one backward, each from a zero state, and the two
states at a byte give its probabilities of the languages. So every byte of the
whole text is labelled, whatever its length, and the windows of many texts run
at once. A text's probabilities are the mean over the bytes that belong to
letters (ASCII letters and all bytes of other characters).

Training takes a sample of at most about `sample` labelled texts (a documented
bound), `cuts` windows of each, and runs backpropagation through time with Adam
in one Spark task. The network has some thousands of weights at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import arrays as A
from llm.storage import small_batches

HIDDEN, WINDOW = 8, 64
#: Labelled texts that teach, windows of each, passes, windows of a step, step size.
SAMPLE, CUTS, EPOCHS, STEP, RATE = 2_000, 6, 5, 256, 0.02
#: Windows whose states are held at once in scoring.
AT_ONCE = 4_096
UNKNOWN = "und"
#: Value 256 stands for the end of a text inside a window.
PAD = 256
_letter = np.zeros(257, bool)
_letter[65:91] = _letter[97:123] = _letter[128:256] = True


def _side(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    """Weights of one direction: byte vectors for update, reset and candidate, and their recurrences."""
    scale = 1 / np.sqrt(hidden)
    return {"byte": rng.normal(0, 0.3, (257, 3 * hidden)), "gates": rng.normal(0, scale, (hidden, 2 * hidden)), "cand": rng.normal(0, scale, (hidden, hidden))}


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, windows, hidden) along x (steps, windows), and what the way back needs.

    An update gate u and a reset gate r are logistic, written as (1 + tanh) / 2.
    """
    hidden = w["cand"].shape[0]
    h = np.zeros((x.shape[1], hidden), w["cand"].dtype)
    out = np.empty((*x.shape, hidden), h.dtype)
    kept = []
    for t in range(len(x)):
        given = w["byte"].take(x[t], axis=0)
        gates = (np.tanh((h @ w["gates"] + given[:, : 2 * hidden]) / 2) + 1) / 2
        u, r = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh((r * h) @ w["cand"] + given[:, 2 * hidden :])
        kept.append((h, u, r, new))
        h = out[t] = h + u * (new - h)
    return out, kept


def _fast(w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Weights of a direction for scoring: single precision, gate by gate, halves of the logistic folded in."""
    hidden = w["cand"].shape[0]
    by_gate = [(w["byte"][:, i * hidden : (i + 1) * hidden], m) for i, m in enumerate((w["gates"][:, :hidden], w["gates"][:, hidden:], w["cand"]))]
    return [np.ascontiguousarray(v * (0.5 if i < 2 else k), np.float32) for i, (byte, m) in enumerate(by_gate) for v, k in ((byte, 1.0), (m, 0.5))]


def _states(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The states of _forward in single precision, with no arrays but these and four for a step."""
    byte_u, u, byte_r, r, byte_c, c = weights
    h = np.zeros((x.shape[1], len(c)), np.float32)
    out = np.empty((*x.shape, len(c)), np.float32)
    up, reset, new, given = (np.empty_like(h) for _ in range(4))
    for t in range(len(x)):
        for side, m, byte in ((up, u, byte_u), (reset, r, byte_r)):
            np.matmul(h, m, out=side)
            byte.take(x[t], 0, out=given, mode="clip")
            side += given
            np.tanh(side, out=side)
            side += 1
        reset *= h
        np.matmul(reset, c, out=new)
        byte_c.take(x[t], 0, out=given, mode="clip")
        new += given
        np.tanh(new, out=new)
        new -= h
        new *= up
        new *= np.float32(0.5)
        h = np.add(h, new, out=out[t])
    return out


def _backward(w: dict[str, np.ndarray], x: np.ndarray, kept: list, given: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction from those of its states."""
    hidden = w["cand"].shape[0]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    later = np.zeros_like(given[0])
    inputs = np.empty((*x.shape, 3 * hidden), later.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, u, r, new = kept[t]
        dh = given[t] + later
        dnew = dh * u * (1 - new * new)
        dreset = dnew @ w["cand"].T
        dgates = np.concatenate((dh * (new - h) * u * (1 - u), dreset * h * r * (1 - r)), 1)
        grad["cand"] += (r * h).T @ dnew
        grad["gates"] += h.T @ dgates
        inputs[t, :, : 2 * hidden], inputs[t, :, 2 * hidden :] = dgates, dnew
        later = dh * (1 - u) + dreset * r + dgates @ w["gates"].T
    order = np.argsort(x, axis=None, kind="stable")
    byte, first = np.unique(x.ravel()[order], return_index=True)
    grad["byte"][byte] = np.add.reduceat(inputs.reshape(-1, 3 * hidden)[order], first, axis=0)
    return grad


class Network:
    """The weights, and the language of each output."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1, dtype: type = np.float32):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = [{k: v.astype(dtype) for k, v in _side(rng, hidden).items()} for _ in range(2)]
        self.top = {"out": rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(dtype), "bias": np.zeros(len(languages), dtype)}

    def weights(self) -> list[np.ndarray]:
        return [d[k] for d in (*self.sides, self.top) for k in sorted(d)]

    def fast(self) -> tuple[list[str], list[list[np.ndarray]], np.ndarray, np.ndarray]:
        """What scoring needs: languages, both directions, and the output's weights and bias."""
        return self.languages, [_fast(w) for w in self.sides], self.top["out"].astype(np.float32), self.top["bias"].astype(np.float32)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes of letters, and gradients in the order of weights()."""
        ahead, kept_ahead = _forward(self.sides[0], x)
        back, kept_back = _forward(self.sides[1], x[::-1])
        states = np.concatenate((ahead, back[::-1]), 2)
        score = states @ self.top["out"] + self.top["bias"]
        score -= score.max(2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(2, keepdims=True)
        counts = _letter[x]
        total = max(1, counts.sum())
        true = np.broadcast_to(label, x.shape)
        loss = -np.log(np.take_along_axis(p, true[..., None], 2)[..., 0] + 1e-30)[counts].sum() / total
        p[np.arange(x.shape[0])[:, None], np.arange(x.shape[1])[None], true] -= 1
        p *= (counts / total).astype(p.dtype)[..., None]
        flat = p.reshape(-1, p.shape[2])
        top = {"out": states.reshape(len(flat), -1).T @ flat, "bias": flat.sum(0)}
        given = p @ self.top["out"].T
        hidden = ahead.shape[2]
        sides = [_backward(self.sides[0], x, kept_ahead, given[..., :hidden]), _backward(self.sides[1], x[::-1], kept_back, given[::-1, :, hidden:])]
        return float(loss), [d[k] for d in (*sides, top) for k in sorted(d)]


def probabilities(sides: list[list[np.ndarray]], out: np.ndarray, bias: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probabilities (languages, steps, windows) of every byte of windows x (steps, windows)."""
    hidden = len(out) // 2
    ahead, back = _states(sides[0], x), _states(sides[1], x[::-1])[::-1]
    p = np.empty((len(bias), *x.shape), np.float32)
    for t in range(len(x)):  # step by step, so that what is transposed stays in the cache
        p[:, t] = (ahead[t] @ out[:hidden] + back[t] @ out[hidden:]).T
    p += bias[:, None, None]
    np.exp(np.minimum(p, 60, out=p), out=p)
    p /= p.sum(0)
    return p


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows (steps, windows) of texts given as bytes and offsets, padded at each text's end, and each window's text."""
    size = np.diff(offsets)
    count = -(-size // width)
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[:-1][row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) * width
    at = start[None, :] + np.arange(width)[:, None]
    inside = at < offsets[1:][row]
    x = np.full(at.shape, PAD, np.int16)
    x[inside] = data[at[inside]]
    return x, row


def pooled(net: tuple, texts: pa.Array) -> np.ndarray:
    """Each text's mean probabilities over its bytes of letters (all 0 without any), from Network.fast()."""
    languages, sides, out, bias = net
    data, offsets = A.text_bytes(texts)
    total, seen = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
    x, row = windows(data, offsets)
    for a in range(0, len(row), AT_ONCE):
        some, of = x[:, a : a + AT_ONCE], row[a : a + AT_ONCE]
        counts = _letter[some]
        p = probabilities(sides, out, bias, some)
        p *= counts
        np.add.at(total, of, p.sum(1).T)
        np.add.at(seen, of, counts.sum(0))
    return total / np.maximum(1, seen)[:, None]


def _fit(table: pa.Table) -> pa.Table:
    """Train on windows (label, cut); all weights as one row of little-endian floats."""
    table = table.sort_by([("at", "ascending"), ("cut", "ascending")]).combine_chunks()
    names = sorted(set(table.column("lang").to_pylist()))
    label = np.array([names.index(v) for v in table.column("lang").to_pylist()])
    data, offsets = A.text_bytes(table.column("text").combine_chunks())
    x, row = windows(data, offsets)
    alive = _letter[x].any(0)
    x, label = x[:, alive], label[row[alive]]
    net, rng = Network(names), np.random.default_rng(7)
    values = net.weights()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, steps = 0, EPOCHS * -(-len(label) // STEP)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            _, grads = net.gradients(x[:, some], label[some])
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            step += 1
            rate = float(RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for v, g, m, s in zip(values, grads, first, second):
                g = g / max(1.0, float(norm))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * m / (np.sqrt(s) + 1e-8)
    return pa.table({"languages": [names], "weights": [np.concatenate([v.ravel() for v in values]).astype("<f4").tobytes()]})


def train(docs: DataFrame, *, sample: int = SAMPLE, cuts: int = CUTS, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from rows with text and language, or None without any.

    Rows are chosen by a hash of id and text, and so are the places of the
    `cuts` windows (64 characters, which are one or two byte windows each).
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("at")).where("lang is not null and text is not null")
    total = rows.count()
    if not total:
        return None
    rows = rows.where(F.pmod("at", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total)))
    rows = rows.withColumn("cut", F.explode(F.array(*(F.lit(i) for i in range(cuts)))))
    begin = F.pmod(F.xxhash64("at", "cut"), F.greatest(F.lit(1), F.char_length("text") - WINDOW // 2)).cast("int") + 1
    some = rows.select(F.col("at").isNull().alias("one"), "lang", "at", "cut", F.substr("text", begin, F.lit(WINDOW)).alias("text"))
    fitted = some.groupBy("one").applyInArrow(_fit, "languages array<string>, weights binary").collect()  # `sample * cuts` short rows at most
    if not fitted:
        return None
    net = Network(list(fitted[0].languages))
    flat, at = np.frombuffer(fitted[0].weights, "<f4"), 0
    for v in net.weights():
        v[...] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return net


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = pa.array(net[0], pa.string())
        for chunk in A.chunks(batches, "text", 1 << 20):
            p = pooled(net, chunk.column("text"))
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([*chunk.columns, names.take(pa.array(best)), pa.array(p[np.arange(len(p)), best].clip(0, 1))], [*chunk.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the mean probability of that language).

    A text that is null or has no letter is `und` with a score of 0, and so is
    every text if there is no network. Ties go to the language that sorts first.
    Input columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if text != "text":
        docs = docs.withColumn("text", F.col(text))
    none = F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
    if net is None:
        return docs.select("*", *none)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net.fast())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = docs.mapInArrow(_scored(shared), f"{fields}, lang_pred string, score double")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letter, F.col("score")).otherwise(0.0)})


def held_out(id: str = "doc_id") -> Column:
    """The rows that never teach: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only rows that aren't held out teach."""
    net = train(docs.where(~held_out()))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), net)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
