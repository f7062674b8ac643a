"""Packing by minimum bin slack.

Every text becomes token ids.  Pieces of a whole window stand alone; the rest of
each text is a piece shorter than the window.  How many pieces there are of each
length - at most one number for each length below the window, whatever the input -
goes to the driver.  There a window takes the longest remaining length, and a
bitset subset-sum dynamic program over the remaining lengths, with counts, picks
the multiset that fills it closest to capacity; backtracking gives the counts.
A pattern is repeated as often as the counts allow, so there are about as many
patterns as lengths.  Pieces find their sequence by their rank within their length.
"""

from __future__ import annotations

import json
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import keeps, only, ragged, slices

CAPACITY = 4096
END_ID = 2
#: Pieces of one length beyond this many are ranked in several groups.
RANK_GROUP = 200
RANK_SALTS = 1024
#: Distinct words that a worker keeps encoded.
CACHED_WORDS = 300_000
#: Bytes of text whose distinct words are looked up at once.
PIECE = 8 << 20
#: Letters of two alphabets, then at most one mark: one unit of the tokenizer, or two; each unit's last id is an end of word.
_PLAIN = r"^[A-Za-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?]?$"


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across white space: each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # plain words need no normalizer but lower case, and no pattern
        spec = json.loads(self.tokenizer.to_str())
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.words = pa.array([], pa.utf8())
        self.ids, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _keep(self, at: np.ndarray) -> None:
        """Forgets all words but those with these numbers."""
        starts = np.cumsum(self.sizes) - self.sizes
        self.ids = self.ids[ragged(starts[at], self.sizes[at])]
        self.sizes, self.words = self.sizes[at], self.words.take(pa.array(at))

    def _add(self, new: pa.Array) -> np.ndarray:
        """Encodes words not met before, plain ones many at a time as one text, cut again at the ends of units; returns their numbers."""
        words = new.to_pylist()
        plain = pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)
        pointed = pc.match_substring_regex(new, "[.,;:!?]$").to_numpy(zero_copy_only=False)
        ids_of, sizes_of, order = [self.ids], [self.sizes], [np.empty(0, np.int64)]
        for kind in (True, False):
            at = np.flatnonzero(plain == kind)
            for first in range(0, len(at), 2000):
                own = at[first : first + 2000]
                block = [words[i] for i in own]
                if kind:
                    text = " ".join([f"{w[:-1]} {w[-1]}" if mark else w for w, mark in zip(block, pointed[own].tolist(), strict=True)]).lower()
                    ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    ends = np.flatnonzero(self.ends[ids]) + 1
                    ends = ends[np.cumsum(1 + pointed[own]) - 1]
                    sizes = np.diff(ends, prepend=0)
                else:
                    got = self.tokenizer.encode(block, is_pretokenized=True, add_special_tokens=False)
                    ids = np.array(got.ids, np.uint32)
                    sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(block))
                ids_of.append(ids)
                sizes_of.append(sizes)
                order.append(own)
        order = np.concatenate(order)
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(len(self.words), len(self.words) + len(words))
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.ids, self.sizes = np.concatenate(ids_of), np.concatenate(sizes_of)
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many belong to each."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.utf8())
        at = self._numbers(distinct)
        if len(self.words) > CACHED_WORDS:
            self._keep(at[at >= 0])
            at[at >= 0] = np.arange((at >= 0).sum())
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._add(distinct.take(pa.array(new)))
        # words and ids lie in arrays that are rebuilt where words came, of at most ``CACHED_WORDS`` and a slice's
        starts = np.cumsum(self.sizes) - self.sizes
        at = at[coded.indices.to_numpy()]
        counts = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ragged(starts[at], counts)], np.diff(upto[ends])

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each word that is kept, -1 of the others."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)


_encoders: dict[str, WordEncoder] = {}
keeps("pack", _encoders.clear)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit) and doc_tokens.

    Texts are cut every ``capacity`` ids.  A null or empty text has one piece,
    the end id.  Repeated rows have pieces of their own.
    """

    def pieces(batches):
        only("pack")
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
            only("pack")  # reading a tokenizer leaves much behind
        encoder = _encoders[tokenizer]
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                ids, counts = encoder.encode(part.column("text"))
                upto = np.concatenate([[0], np.cumsum(counts)])
                rows = []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[upto[k] : upto[k + 1]].tobytes() + struct.pack("<I", end_id)
                    n = len(own) // 4
                    rows += [(doc, s, min(capacity, n - s), own[4 * s : 4 * (s + capacity)], n) for s in range(0, n, capacity)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")


def fill_window(counts: Counter, capacity: int) -> Counter:
    """The longest length and the multiset of others that leaves the least slack beside it."""
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left = min(counts[length] - (length == longest), room // length)
        times = 1
        while left > 0 and not reached >> room & 1:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= reached << (length * times) & mask
            left -= times
            times *= 2
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    chosen = Counter({longest: 1})
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += times
            at -= length * times
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Window fillings and how often each is used; together they use every piece once."""
    left, out = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        chosen = fill_window(left, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def runs_of(filled: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces a sequence, first sequence, first offset)."""
    seen: Counter = Counter()
    sequence, out = 0, []
    for chosen, times in filled:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            out.append((length, seen[length], seen[length] + n * times - 1, n, sequence, offset))
            seen[length] += n * times
            offset += length * n
        sequence += times
    return out


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with ``doc_id``, ``start`` and ``length``; keeps all other columns.

    An empty input gives an empty result.  The last window may be left with
    padding; every other one is filled as closely as the lengths allow.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row for each length up to capacity
    runs = spark.createDataFrame(
        runs_of(patterns(counts, capacity)), "__len long, first long, last long, n long, sequence long, base long"
    )
    salts = spark.createDataFrame(
        [(k, min(RANK_SALTS, -(-v // RANK_GROUP))) for k, v in counts.items()], "__l long, __salts int"
    )
    salted = (
        pieces.join(F.broadcast(salts), F.col("length") == F.col("__l"))
        .withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("__salts")))
        .drop("__l", "__salts")
    )
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "start")
    before = Window.partitionBy("__len").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        salted.groupBy(F.col("length").alias("__len"), F.col("__salt").alias("__s"))
        .agg(F.count("*").alias("__n"))
        .select("__len", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    ranked = (
        salted.withColumn("__rank", F.row_number().over(own) - 1)
        .join(groups, (F.col("length") == F.col("__len")) & (F.col("__salt") == F.col("__s")))
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__len", "__s", "__before", "__salt")
    )
    at = F.col("__rank") - F.col("first")
    return ranked.join(
        F.broadcast(runs),
        (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") <= F.col("last")),
    ).select(
        *[F.col(c) for c in pieces.columns],
        (F.col("sequence") + F.expr("(__rank - first) div n")).alias("sequence_id"),
        (F.col("base") + (at % F.col("n")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids, sequence_id and offset.

    A null or empty text is one piece, the end id; a text of any length is whole, in
    pieces of at most ``capacity`` ids; repeated rows and null doc_ids have pieces of their own; an
    empty table gives an empty result.  Strings of special tokens in a text are ordinary text.
    """
    return assign_sequences(stored(tokenized(docs, tokenizer, capacity, end_id)), capacity)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As ``pack_documents``, with a checksum of each piece's ids in their place; the ids are never stored."""
    return assign_sequences(stored(digests(tokenized(docs, tokenizer))))


def op3_pack_min_slack(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    import public_tokenizers

    return packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_pack_min_slack": op3_pack_min_slack}
ORACLE_SQL: dict[str, str] = {}
