"""Spelling variants: words that differ by one letter, found by rolling hashes of all their deletions.

The polynomial hashes of every prefix and suffix of a word give the hash of the
word without any one letter at once, as an integer key, for all words of a batch.
Two words of one length that differ in one place have the same key at that place
(the place is part of the key); a word that another one becomes by losing a letter
has that deletion's key.  Keys are dealt by their low bits and sorted; what stands
alone under its key goes no further.  Words that share a key meet as strings, and
only equal strings count, so a collision of hashes changes nothing.

No pair is written.  Under one key stand either words that all differ from each
other at one place, or one word and the words that become it: the number of
variants of each and its most frequent one follow from the size of the group and
its first two members.  Such groups are bounded by the alphabet.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._repeats import packed_by_part, unpacked
from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import _LOWER, SLICE_BYTES, SpanHasher, bytes_of, mixed, ragged, slices

#: Keys that one task sorts, and bytes of words that meet in one, about.
PART_KEYS, PART_BYTES = 1 << 20, 16 << 20
#: Bytes of words of which keys are made at a time.
WORD_BYTES = 1 << 18
#: Letters of runs longer than this many bytes are not hashed side by side with those of others.
SIDE_BY_SIDE = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: The first byte of the two of U+00C0 to U+00FF in UTF-8; the second is any that may follow.
_LEAD = 0xC3


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters ``[A-Za-z\\u00C0-\\u00FF]``."""
    lead = data == _LEAD
    return _ASCII[data] | lead | np.concatenate([[False], lead[:-1]])


def pieces(batch: pa.RecordBatch, size: int = SLICE_BYTES):
    """(doc_ids, bytes, cut): texts of about ``size`` bytes at a time; a longer text is cut between two runs of letters."""
    for part in slices(batch, "text", size):
        ids = part.column("doc_id").to_pylist()
        data, cut = bytes_of(part.column("text"))
        if len(data) <= 2 * size:
            yield ids, data, cut
            continue
        # a slice of more than its size holds one long text
        at = 0
        while at < len(data):
            to = min(at + size, len(data))
            while to < len(data):
                ahead = ~_letters(data[to - 1 : to + size])
                if ahead[1:].any():
                    to += int(ahead[1:].argmax())
                    break
                to = min(to + size, len(data))
            yield ids, data[at:to], np.array([0] * len(ids) + [to - at])
            at = to


def crc32s(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, continued from that of what stands before it; all runs one byte at a time."""
    order = np.argsort(-lengths, kind="stable")
    at, state = starts[order], ~begun[order].astype(np.uint32)
    side = np.minimum(lengths[order], SIDE_BY_SIDE)
    for k in range(int(side[0]) if len(side) else 0):
        m = int(np.searchsorted(-side, -k, "left"))  # runs with more than k bytes
        state[:m] = _CRC[(state[:m] ^ letters[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out = np.empty(len(lengths), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
        out[k] = zlib.crc32(letters[starts[k] + SIDE_BY_SIDE : starts[k] + lengths[k]].tobytes(), int(out[k]))
    return out


def _counted(ids: list, data: np.ndarray, cut: np.ndarray, least: int, slips: int) -> pa.StructArray:
    """Values and counts of the words of some texts with ``least`` code points or more."""
    data = _LOWER[data]
    inside = np.concatenate([[False], _letters(data), [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[cut] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    twos = np.concatenate([[0], np.cumsum(data == _LEAD)])
    points = ends - starts - (twos[ends] - twos[starts])
    long = points >= least
    starts, ends, points = starts[long], ends[long], points[long]
    lengths = ends - starts
    letters = data[ragged(starts, lengths)]
    at = np.concatenate([[0], np.cumsum(lengths)])
    slipped = np.zeros(len(starts), bool)
    changed = []
    if slips:
        begun = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else zlib.crc32(b"null:") for i in ids], np.uint32)
        h = crc32s(letters, at[:-1], lengths, np.repeat(begun, np.diff(np.searchsorted(starts, cut))))
        slipped = h % np.uint32(slips) == 0
        for k in np.flatnonzero(slipped).tolist():
            word = letters[at[k] : at[k + 1]].tobytes().decode()
            j = int(h[k]) % len(word)
            if len(word) > least:
                changed.append(word[:j] + word[j + 1 :])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters))
    return pa.concat_arrays([words.filter(pa.array(~slipped)), pa.array(changed, pa.utf8())]).value_counts()


def counted_words(docs: DataFrame, least_points: int = 5, least_n: int = 3, slips: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z in lower case, with enough code points and occurrences.

    With ``slips``, a run of which the crc32 of ``<doc_id>:<run>`` is divisible
    by that number loses one letter first, as given by the same crc32; a null
    doc_id is written ``null``.  A null text has no words.  Rows are judged one
    by one, repeated ones too.
    """

    def run(batches):
        for batch in batches:
            for ids, data, cut in pieces(batch):
                found = _counted(ids, data, cut, least_points, slips)
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


#: Stands for the place of a deletion: the word itself, and (minus the place) that of a word which becomes another.
_WHOLE, _SHORTER = -1, -2


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, place) of all deletions of each word: numbers of words as they stand in ``words``.

    ``place`` of 0 or more: the word but for that letter, which another may
    replace.  ``_SHORTER`` minus a place: the word that is left without that letter; of
    equal letters in a row only the first.  ``_WHOLE``: the word itself.
    """
    data, cut = bytes_of(words)
    letter = data != _LEAD
    # code points fit a byte: the second byte of two lies 64 below
    codes = (data + (np.uint8(64) * np.concatenate([[False], ~letter[:-1]])).astype(np.uint8))[letter]
    cut = np.concatenate([[0], np.cumsum(letter)])[cut]
    lengths = np.diff(cut)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - cut[word]
    hasher = SpanHasher(codes)
    left = hasher.without(cut[word], np.arange(len(codes)), cut[word + 1])
    first = (place == 0) | (codes != np.concatenate([[0], codes[:-1]])) if len(codes) else np.empty(0, bool)
    keys = [mixed(left ^ mixed(place.astype(np.uint64) + np.uint64(1))), left[first], hasher.spans(cut[:-1], cut[1:])]
    places = [place, _SHORTER - place[first], np.full(len(lengths), _WHOLE)]
    return np.concatenate(keys), np.concatenate([word, word[first], np.arange(len(lengths))]), np.concatenate(places)


def shared_keys(words: DataFrame) -> DataFrame:
    """(key, id, place): what stands beside others under its key, of ``words`` (id, word)."""
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    parts = 1 << max(0, math.ceil(math.log2(max(1, total / PART_KEYS))))

    def make(batches):
        for batch in batches:
            for part in slices(batch, "word", WORD_BYTES):
                key, word, place = deletion_keys(part.column("word"))
                own, packed = packed_by_part(key, [key, part.column("id").to_numpy()[word], place.astype(np.int32)], parts)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    def sort(rows: pa.Table) -> pa.Table:
        key, word, place = unpacked(rows.column("packed"), ["u8", "i8", "i4"])
        group = np.maximum(place, _WHOLE)
        order = np.lexsort((group, key))
        key, word, place, group = key[order], word[order], place[order], group[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(key)))
        # words that become another one count only if that one is there
        there = np.add.reduceat(place == _WHOLE, first) > 0 if len(first) else np.empty(0, bool)
        keep = np.repeat((size > 1) & ((group[first] >= 0) | there), size)
        return pa.Table.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(word[keep]), pa.array(place[keep])], names=["key", "id", "place"])

    return words.select("id", "word").mapInArrow(make, "part int, packed binary").groupBy("part").applyInArrow(sort, "key long, id long, place int")


def _judged(rows: pa.Table) -> pa.Table:
    """(id, n_near, best_n, best) for each row of (key, id, place, word, n) that really has variants under its key."""
    words, place = rows.column("word").to_pylist(), rows.column("place").to_numpy()
    cut = np.where(place < _WHOLE, _SHORTER - place, place).tolist()
    rest = pa.array([w if c == _WHOLE else w[:c] + w[c + 1 :] for w, c in zip(words, cut, strict=True)], pa.utf8())
    met = rows.combine_chunks().append_column("rest", rest).append_column("group", pa.array(np.maximum(place, _WHOLE)))
    order = [("key", "ascending"), ("group", "ascending"), ("rest", "ascending"), ("n", "descending"), ("word", "ascending")]
    met = met.take(pc.sort_indices(met, sort_keys=order))
    fresh = np.ones(len(met), bool)
    fresh[1:] = False
    for c in ("key", "group", "rest"):
        column = met.column(c)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(met) - 1)).to_numpy()
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(met)))
    own = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(met))
    whole = met.column("place").to_numpy() == _WHOLE
    star = np.repeat(met.column("group").to_numpy()[first] == _WHOLE, size)
    # among words that differ at one place everyone has all others, the first among them or, for the first itself, the second
    near, best = size[own] - 1, np.where(at == first[own], first[own] + 1, first[own])
    hub = np.full(len(first), -1)
    hub[own[whole]] = at[whole]
    # a word that becomes the hub has the hub alone; without a hub there is none
    leaf = star & ~whole
    near[leaf] = hub[own[leaf]] >= 0
    best[leaf] = hub[own[leaf]]
    kept = np.flatnonzero(near > 0)
    to = pa.array(best[kept])
    columns = [met.column("id").take(pa.array(kept)), pa.array(near[kept]), met.column("n").take(to), met.column("word").take(to)]
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["id", "n_near", "best_n", "best"])


def variant_forms(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n) made of letters ``[A-Za-z\\u00C0-\\u00FF]``.

    Two words are near if one inserted, deleted or replaced letter makes one the
    other.  The form of a word is its near word of the largest n (ties: the first
    in code-point order) if that is twice its own n or more; the root is the
    last that forms lead to, or the word itself.  Words of any length take part;
    no words give an empty result.
    """
    words = stored(counts.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    met = stored(shared_keys(words).join(words, "id"))
    size = met.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    judged = met.groupBy(F.pmod("key", F.lit(parts)).alias("part")).applyInArrow(_judged, "id long, n_near long, best_n long, best string")
    best = judged.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    formed = -F.col("best.n") >= 2 * F.col("n")
    found = stored(
        words.join(best, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")
        )
    )
    # a form has twice the n of its word, so no path is longer than the bits of n; each round doubles what is followed
    roots = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return found.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_rolling_deletions(spark, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents, of which some runs lose a letter."""
    words = counted_words(table(spark, sf_dir, "documents"), 5, 3, 97)
    return variant_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_rolling_deletions": op12_rolling_deletions}
ORACLE_SQL: dict[str, str] = {}
