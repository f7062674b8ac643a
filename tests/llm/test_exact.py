"""Exact copies against texts themselves, also where all fingerprints collide."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutframe.llm import exact

SCHEMA = "doc_id long, text string, n_chars long"


def make():
    rng = random.Random(8)
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "a  ", "a b", "a\tb", "a \n b", "a b", "é è", "é  è"]
    texts += ["".join(rng.choice("ab  \n") for _ in range(5)) for _ in range(60)]
    big = "".join(rng.choice(["word ", "more\n\n", "é", "   "]) for _ in range(3000))
    texts += [big, big.replace("\n\n", " "), big[:-1] + "x", big + " ", " " + big, " " * 2000, "\n" * 3000 + "x", "   x"]
    rows = [(rng.randint(0, 60), t, k) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a", 1), (None, "only here", 1), (None, "twice", 1), (None, "twice", 2)] + [(100 + k, "hot", 0) for k in range(200)]


def plain(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        first = min(ids, key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in ids:
            out[(i, first, len(ids), not kept and i == first, digest)] += 1
            kept |= i == first
    return out


def small(monkeypatch):
    """Chunks of a few bytes, huge texts of a few hundred, many tasks."""
    for name, value in {"CHUNK": 64, "HUGE": 300, "MERGE_BYTES": 50, "MERGE_ROWS": 20, "PART_BYTES": 500, "SALT_TEXTS": 2}.items():
        monkeypatch.setattr(exact, name, value)
    monkeypatch.setattr(exact, "_powers", [])
    slices = exact.slices
    monkeypatch.setattr(exact, "slices", lambda batch, column: slices(batch, column, 200))


@pytest.mark.parametrize("chunks", ["as shipped", "small", "small, and all prints collide"])
def test_query(spark, tmp_path, monkeypatch, chunks):
    rows = make()
    if chunks != "as shipped":
        small(monkeypatch)
    if "collide" in chunks:
        rows = rows[:60] + rows[-40:]
        monkeypatch.setattr(exact, "key_of", lambda found: 7)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "id", "key", "length", "entry", "k", "rows", "kept", "sha256")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = exact.op13_composable_prints(spark, str(tmp_path))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)


def test_filter(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "kept": F.lit(3), "a.b": F.lit(1.5)})
    got = exact.filter_documents(docs)
    assert got.columns == docs.columns and got.where("row = 'x' AND kept = 3 AND `a.b` = 1.5").count() == len({k[-1] for k in plain(rows)})
    assert exact.filter_documents(docs.limit(0)).count() == 0


def test_prints_compose(monkeypatch):
    """The print of a whole is that of its chunks, however they are cut, and follows from the definition."""
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    whole = exact.chunk_print(data)
    for n in (1, 2, 7, 300):
        cuts = np.sort(np.concatenate([[0, 5000], rng.integers(0, 5001, n - 1)]))
        assert exact.joined(exact.chunk_print(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == whole
    want = [sum((c + 1) * pow(r, j, p) for j, c in enumerate(data.tolist())) % p for r, p in zip(exact.BASES, exact.MODULI, strict=True)]
    assert whole == (5000, *want)
    assert exact.chunk_print(data[:0]) == (0, 0, 0)


def test_squeezed(monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 3)
    texts = ["  a  b\n", "", " ", "\t\t", "x", "é   é", "a   \n   b", "          z"]
    data, cut = exact.squeezed(*exact.bytes_of(pa.array(texts)))
    want = [re.sub("[\x20\x09-\x0d]+", " ", t).encode() for t in texts]
    assert [data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] == want
    assert [b"".join(c.tobytes() for c in exact.normal_chunks(np.frombuffer(t.encode(), np.uint8))) for t in texts] == want
