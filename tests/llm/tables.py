"""Small tables for the tests of this folder: written as a driver's folder, with odd rows and clashing columns."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
CLASH = ("row_key", "kept", "score", "spans", "component_id", "n", "shard", "pii", "benchmark_hits", "a", "low")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empty, short and very long texts, odd spaces and characters."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (120, 200, 90, 400)]
    passage = prose(rng, 70)
    near = base[1].split()
    near[100] = "changed"
    rows = [*enumerate(base), (10, base[0]), (11, base[0]), (12, " ".join(near)), (13, passage + " " + base[2]), (14, prose(rng, 60) + "\n" + passage), (15, passage)]
    rows += [(20, None), (21, ""), (22, "   \t\n"), (23, "one"), (24, "One"), (25, "two words"), (26, "ünïcode 日本語 text \x1c\x85\xa0 end"), (27, "ab" * 500), (28, "x y " * 300), (29, "x y " * 301)]
    rows += [(30, prose(rng, 20_000, 10**6)), (31, "w" * 30_000)]
    words = prose(rng, 100).split()
    rows += [(40 + i, " ".join(words[: 100 - i])) for i in range(0, 30, 3)]
    return rows


def write(path, rows, *, extra: bool = True, columns: dict | None = None) -> str:
    """A folder with documents.parquet (and other given tables)."""
    n = len(rows)
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * n, pa.string()), "source": pa.array([None if i % 3 else "web" for i in range(n)], pa.string()), "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    if extra:
        table |= {c: pa.array([f"{c}{i}" for i in range(n)], pa.string()) for c in CLASH}
    path.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(table), path / "documents.parquet")
    for name, columns_ in (columns or {}).items():
        pq.write_table(pa.table(columns_), path / f"{name}.parquet")
    return str(path)


def read(sf_dir: str, name: str = "documents") -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def odd_dir(tmp) -> str:
    return write(tmp / "odd", odd_texts())


def empty_dir(tmp) -> str:
    none = {"labels": {"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}, "benchmark": {"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}, "embeddings": {"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}}
    return write(tmp / "empty", [], columns=none)


#: Repeated rows, ids shared by different texts, and rows without id.
DOUBLED = [(1, "alpha beta gamma " * 60), (1, "alpha beta gamma " * 60), (2, "delta " * 5), (2, "other text"), (None, "alpha beta gamma " * 60), (None, None), (3, "alpha beta gamma " * 60)]
