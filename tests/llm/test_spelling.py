"""Spelling variants against all pairs of words, and the words against a regular expression."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutframe.llm import spelling

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def make():
    rng = random.Random(4)
    base = ["straße", "Élanvital", "señorita", "aaaaa", "aaaaaa", "abcde", "abcdé", "xabcde", "abxcde", "abcdef", "bbccdd", "bccdd", "bbcddd", "ÀÉÎÕÜ÷", "z" * 70, "z" * 69 + "y", "z" * 71]
    more = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    rng.shuffle(more)
    weights = [2.0 ** -(k % 9) for k in range(len(base + more))]
    rows = [(k, " ".join(rng.choices(base + more, weights)[0] + rng.choice(["", "", "", ",", "1", "Ā", "\n"]) for _ in range(rng.randint(1, 120)))) for k in range(150)]
    long = " ".join(rng.choice(more) for _ in range(4000))
    rows += [(200, None), (201, ""), (202, "12 34 .."), (203, long), (203, long), (None, long[:300]), (None, "abcde " * 9), (204, "q" * 3000), (205, "q" * 3000), (206, "q" * 3000 + " " + "q" * 2999 + " x")]
    # enough runs that lose a letter
    return rows + [(1000 + k, "wonderful words wander") for k in range(400)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_of(rows, least=5, least_n=3, slips=97):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)), key=lambda v: (-words[v], v))
        form[w] = others[0] if others and words[others[0]] >= 2 * n else None
        out[w] = [form[w], None, n, len(others), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, tmp_path, monkeypatch, small):
    if small:
        # many parts, and texts cut into pieces
        for name, value in {"PART_KEYS": 100, "PART_BYTES": 2000, "WORD_BYTES": 50}.items():
            monkeypatch.setattr(spelling, name, value)
        pieces = spelling.pieces
        monkeypatch.setattr(spelling, "pieces", lambda batch: pieces(batch, 64))
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "id", "part", "key", "form", "root")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in spelling.op12_rolling_deletions(spark, str(tmp_path)).collect()]
    want = plain(words_of(rows))
    assert len(got) == len(want) and set(got) == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[1] and w[1] != w[2] for w in want)


def test_nothing(spark, tmp_path):
    for name, rows in {"empty": [], "wordless": [(1, None), (2, "a b c")]}.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = spelling.op12_rolling_deletions(spark, f"{tmp_path}/{name}")
        assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_collisions_change_nothing(spark, monkeypatch):
    """With keys that are nearly all the same, only words that really differ by one letter are near."""
    keys = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda words: (keys(words)[0] % np.uint64(3), *keys(words)[1:]))
    words = dict(list(words_of(make(), slips=0).items())[:60])
    got = spelling.variant_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain(words)


def test_keys_are_hashes_of_what_is_left():
    """The key of a word without a letter is the key of the shorter word."""
    words = ["abcde", "abde", "aabcé", "aabc", "a", "", "é"]
    key, word, place = spelling.deletion_keys(pa.array(words))
    whole = {words[w]: k for k, w, p in zip(key, word, place, strict=True) if p == -1}
    cut = [(words[w][: -2 - p] + words[w][-1 - p :], k) for k, w, p in zip(key, word, place, strict=True) if p < -1]
    assert len(cut) == 5 + 4 + 4 + 3 + 1 + 1 and all(whole[rest] == k for rest, k in cut if rest in whole)
    assert {rest for rest, _ in cut} >= {"abde", "aabc", ""}


def test_crc32s():
    data = [b"", b"a", b"hello", b"x" * 64, b"y" * 65, b"z" * 1000]
    letters = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(d) for d in data])
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(data))], np.uint32)
    got = spelling.crc32s(letters, np.cumsum(lengths) - lengths, lengths, begun)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + d) for k, d in enumerate(data)]
