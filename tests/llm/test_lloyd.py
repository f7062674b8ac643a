"""Vector codes by filtering Lloyd against plain integer arithmetic on every edge case."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int"


def make(n=700, length=8, seed=5):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(n, length)) * 0.3)
    x[100:140] = x[7]  # ties
    rows = [(3 * i % 1009, x[i].tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    rows += [rows[4], (rows[5][0], rows[6][1], 1), (None, rows[9][1], 2), (5000, None, 1), (5001, [None] + [0.5] * (length - 1), 1)]
    rows += [(5002, [float("nan")] + [0.5] * (length - 1), None), (5003, [math.inf] * length, None), (5004, [], 1), (5005, [1.0] * (length + 1), 1)]
    return rows + [(5006, [0.0] * length, None), (-4, [-0.0001] * length, 0), (5007, [1e30] * length, 9)]


def plain(rows, length, entries=256, rounds=4, parts=4):
    """The contract word by word, in Python integers."""
    top = lloyd.limit(length // parts)
    kept = []
    for i, v, label in rows:
        if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-top, min(top, math.floor(1024 * c))) for c in v], label, v))
    cut = [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[list(r[1][a:b]) for r in first] for a, b in cut]

    def nearest(p, book):
        return min(range(len(book)), key=lambda e: (sum((c - d) ** 2 for c, d in zip(p, book[e], strict=True)), e))

    for _ in range(rounds):
        for (a, b), book in zip(cut, books, strict=True):
            own = defaultdict(list)
            for r in kept:
                own[nearest(r[1][a:b], book)].append(r[1][a:b])
            for e, ps in own.items():
                book[e] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
    out = []
    for i, x, label, _ in kept:
        codes = [nearest(x[a:b], book) for (a, b), book in zip(cut, books, strict=True)]
        error = sum(sum((c - d) ** 2 for c, d in zip(x[a:b], book[e], strict=True)) for (a, b), book, e in zip(cut, books, codes, strict=True))
        out.append((i, label, "".join(f"{e:02x}" for e in codes), error))
    totals = Counter()
    for _, label, _, error in out:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for z in book for c in z).encode()).hexdigest()
    return Counter((i, code, error, totals[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("labels,block", [(lloyd.LABELS, lloyd.BLOCK), (0, 100)])
def test_query(spark, tmp_path, monkeypatch, labels, block):
    monkeypatch.setattr(lloyd, "LABELS", labels)
    monkeypatch.setattr(lloyd, "BLOCK", block)
    rows = make()
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "codes", "error", "n", "salt", "of")})
    clashing.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = lloyd.op11_filtering_lloyd(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 8)


def test_few_rows_and_none(spark, tmp_path):
    rows = make()[:9]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert Counter(tuple(r) for r in lloyd.op11_filtering_lloyd(spark, f"{tmp_path}/few").collect()) == plain(rows, 8)
    spark.createDataFrame([(1, None, 1)], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    got = lloyd.op11_filtering_lloyd(spark, f"{tmp_path}/none")
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("n,width,size,entries", [(3000, 16, 300, 256), (40, 3, 3, 40), (2000, 4, 5, 30), (900, 2, 1 << 26, 50), (33, 1, 0, 7)])
def test_assign(n, width, size, entries, monkeypatch):
    """Subtrees, leaves and ties agree with measuring every entry, for doubles and for 64-bit integers."""
    monkeypatch.setattr(lloyd, "PAIRS", 999)
    rng = np.random.default_rng(n)
    x = rng.integers(-size, size + 1, (n, width))
    book = x[:entries].copy()
    tree = lloyd.Tree.unpacked(lloyd.Tree.build(x).packed(), n, width)
    code, sums, counts, _ = lloyd.assign(x, tree, book)
    want = np.stack([((x - z) ** 2).sum(1) for z in book], 1).argmin(1)
    total = np.zeros_like(book)
    np.add.at(total, want, x)
    assert (code == want).all() and (sums == total).all() and (counts == np.bincount(want, minlength=entries)).all()


def test_subtrees_are_taken_whole():
    """Around centres that lie apart, most rows are never measured."""
    rng = np.random.default_rng(2)
    book = rng.integers(-1000, 1000, (64, 8))
    x = book[rng.integers(0, 64, 8000)] + rng.integers(-5, 6, (8000, 8))
    code, _, _, whole = lloyd.assign(x, lloyd.Tree.build(x), book)
    assert whole > 0.5 and (code == np.stack([((x - z) ** 2).sum(1) for z in book], 1).argmin(1)).all()
