"""Toxicity by compression distance.

Text is coded before it is compressed: each word gives four bytes for each of its
beginnings of three bytes or more, and four for its end, so a word that begins like a known one
is partly known, and what zstandard saves grows with what the two share.

Two dictionaries are trained with zstandard's own trainer: one on windows of
ordinary text, one on the text that sets toxic documents apart (words with a
beginning that is several times rarer in ordinary documents).  Toxic documents are written in
the same languages, so the toxic dictionary holds the ordinary segments behind its
own.  Each window of sixteen words is compressed with the ordinary and with the
toxic dictionary, and the difference of the two lengths is the evidence.  A
logistic calibration over the differences of a text gives its score; it is fitted on
documents whose dictionaries were trained without them.

Labels are read from a bounded sample only: ``SAMPLE`` documents of at most
``LONGEST`` characters, the first by a hash of doc_id.  Each fold is trained in a
task of its own; only a few numbers for each sampled document and the dictionaries
reach the driver.  Every document is scored over its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import keeps, only, slices

SAMPLE = 8000
LONGEST = 200_000
WINDOW = 16
#: A word's shortest beginning that counts; longer runs without a space are several words.
BEGIN, LONGEST_WORD = 3, 64
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
#: Windows of ordinary text that the trainer sees.
ORDINARY_WINDOWS = 20_000
#: A beginning sets toxic text apart if it is in so many toxic documents, in so large a share of them, and so many times rarer in ordinary ones.
LEAST_TOXIC, LEAST_SHARE, RARER = 3, 0.04, 100
#: A window is nearer to toxic text if its length falls by so many bytes: each gives features of its own to the calibration.
STEPS = (6, 10, 16)
FEATURES = 2 * len(STEPS) + 3
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 4

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_CACHED = 100_000
_known: dict[bytes, bytes] = {}
keeps("toxicity", _known.clear)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; null has none."""
    found = (text or "").encode().translate(_LETTERS).split()
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[at : at + LONGEST_WORD] for w in found for at in range(0, len(w), LONGEST_WORD)]
    return found


def _code(word: bytes) -> bytes:
    """Four bytes for every beginning of the word, and for its end."""
    if word not in _known:
        if len(_known) >= _CACHED:
            _known.clear()
        crc, out = zlib.crc32(word[: BEGIN - 1]), []
        for at in range(BEGIN - 1, len(word)):
            crc = zlib.crc32(word[at : at + 1], crc)
            out.append(crc.to_bytes(4, "little"))
        out.append(zlib.crc32(b"$", crc).to_bytes(4, "little"))
        _known[word] = b"".join(out)
    return _known[word]


def windows(words: list[bytes]) -> list[bytes]:
    return [b"".join(map(_code, words[at : at + WINDOW])) for at in range(0, len(words), WINDOW)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer; the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _apart(docs: list[list[bytes]], toxic: np.ndarray) -> list[bytes]:
    """Of each toxic document, the coded words with a beginning that sets toxic text apart."""
    seen = [[np.empty(0, np.uint32)], [np.empty(0, np.uint32)]]
    for words, label in zip(docs, toxic, strict=True):
        seen[label].append(np.unique(np.frombuffer(b"".join(map(_code, set(words))), np.uint32)))
    codes, counts = np.unique(np.concatenate(seen[1]), return_counts=True)
    other, times = np.unique(np.concatenate(seen[0]), return_counts=True)
    ordinary = np.zeros(len(codes), np.int64)
    at = np.searchsorted(other, codes)
    hit = at < len(other)
    hit[hit] = other[at[hit]] == codes[hit]
    ordinary[hit] = times[at[hit]]
    n = np.bincount(toxic, minlength=2)
    enough = counts >= max(LEAST_TOXIC, LEAST_SHARE * n[1])
    marks = set(codes[enough & (counts * n[0] >= RARER * ordinary * n[1])].tolist())
    out = []
    for words, label in zip(docs, toxic, strict=True):
        if label:
            own = [c for c in map(_code, words) if not marks.isdisjoint(np.frombuffer(c, np.uint32).tolist())]
            if own:
                out.append(b"".join(own))
    return out


def train_dictionaries(docs: list[list[bytes]], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """The ordinary dictionary and the toxic one."""
    ordinary = [w for words, label in zip(docs, toxic, strict=True) if not label for w in windows(words)]
    picked = np.random.default_rng(5).permutation(len(ordinary))[:ORDINARY_WINDOWS]
    ordinary = _trained([ordinary[i] for i in picked], ORDINARY_BYTES, 64)
    return ordinary, _trained(_apart(docs, toxic), TOXIC_BYTES, 32) + ordinary


class Evidence:
    """Features of a text from the compressed lengths of its windows under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic)

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        if not content:
            return zstandard.ZstdCompressor(compression_params=params).compress
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress

    def of(self, words: list[bytes]) -> list[float]:
        a, b = self.ordinary, self.toxic
        nearer = np.array([len(a(w)) - len(b(w)) for w in windows(words)], np.float64)
        per = 100 / (len(words) + 4)
        shares = [per * float((nearer >= step).sum()) for step in STEPS]
        whole = per * float(np.maximum(nearer, 0).sum())
        return [*shares, *(x**0.5 for x in shares), float(max(0, nearer.max(initial=0))), float(np.log1p(len(words))), whole]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton steps with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries, scaling and weights; a constant score where the sample lacks one of the labels."""

    def __init__(self, toxic: Iterable[int], x: np.ndarray | None = None, dictionaries: tuple[bytes, bytes] | None = None):
        toxic = np.array(list(toxic), np.int64)
        self.constant = None
        if len(set(toxic.tolist())) < 2:
            self.constant = float(toxic.mean()) if len(toxic) else 0.0
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        self.weights = fit_logistic((x - self.mean) / self.scale, toxic)
        self.dictionaries = dictionaries

    def scorer(self):
        """A function from a text to its score."""
        if self.constant is not None:
            return lambda text: self.constant
        evidence = Evidence(*self.dictionaries)

        def score(text):
            x = (np.array(evidence.of(words_of(text))) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))

        return score


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out.

    Null labels and ids are left out; of several labels of a document the highest counts.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    rows = stored(
        docs.where(F.length("text") <= LONGEST)
        .select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")  # at most SAMPLE rows
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(SAMPLE)
        .select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    )
    toxic = dict(rows.groupBy("toxic").count().collect())
    if len(toxic) < 2:
        return Model(toxic)

    def train(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Of fold -1 the dictionaries of all; of any other the features of its documents, by dictionaries of the rest."""
        out = key[0].as_py()
        docs = [words_of(x.as_py()) for x in group.column("text")]
        labels, folds = (group.column(c).to_numpy() for c in ("toxic", "fold"))
        rest = np.flatnonzero(folds != out)
        both = train_dictionaries([docs[i] for i in rest], labels[rest])
        evidence = Evidence(*both)
        own = np.flatnonzero(folds == out)
        x = np.array([evidence.of(docs[i]) for i in own], np.float64).reshape(-1, FEATURES)
        packed = [None] * len(own) if out >= 0 else [both[0], both[1]]
        return pa.table(
            {
                "toxic": pa.array(labels[own] if out >= 0 else [None, None], pa.int32()),
                "x": pa.array(x.tolist() if out >= 0 else [None, None], pa.list_(pa.float64())),
                "content": pa.array(packed, pa.binary()),
                "place": pa.array(range(len(packed)), pa.int32()),
            }
        )

    # each group holds the whole bounded sample
    folds = rows.withColumn("out", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))))
    found = folds.groupBy("out").applyInArrow(train, "toxic int, x array<double>, content binary, place int").collect()
    contents = [bytes(r.content) for r in sorted((r for r in found if r.content is not None), key=lambda r: r.place)]
    known = sorted((r.toxic, r.x) for r in found if r.content is None)
    return Model([t for t, _ in known], np.array([x for _, x in known]), (contents[0], contents[1]))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Adds the score to all other columns of ``docs`` under the name ``into``, in place of a column of that name.

    A null text scores like an empty one.  Every row is scored by itself, repeated rows too, over its
    whole text, however long; an empty table gives an empty result.
    """
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.DoubleType())])
    names = schema.names

    def run(batches):
        only("toxicity")
        scorer = model.scorer()
        for batch in batches:
            for part in slices(batch, "text"):
                out = pa.array([scorer(text.as_py()) for text in part.column("text")], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with the columns that came in; repeated rows share their fate, no row is changed."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    scored = score(docs, fit(docs, labels), "__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).select(*names)


def op5_toxicity_compression(spark, sf_dir: str) -> DataFrame:
    """All documents with their score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_toxicity_compression": op5_toxicity_compression}
ORACLE_SQL: dict[str, str] = {}
