"""Byte-level BPE by a global shuffle of distinct words.

1. Texts fall into pre-tokens.  Each chunk of texts (a bounded number of bytes)
   keeps its distinct pre-tokens once and, per text, their numbers in order: the
   explosion into pre-tokens with positions, aggregated before any shuffle.
2. The chunks' distinct pre-tokens are shuffled by a hash of the word, in blocks;
   each distinct word is encoded once and its ids go back to the chunks that hold
   it.  There are as many parts as shuffle partitions.
3. Per chunk, ids are laid out by position again.  Decoding joins the ids of each
   text, in order, with the token-byte table (of the vocabulary's size, whatever the
   input), whose key is dense: a whole text's ids at once, in Arrow.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._shared import shared_dir, table
from scoutframe.llm._text import SpanHasher, bytes_of, ragged, slices

CHUNK_BYTES = 16 << 20
#: White space beyond ASCII: texts that hold any are pre-tokenized whole.
_WIDE_SPACE = "[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
#: A unit of this form is one pre-token.
_PLAIN = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNKS = "chunk long, doc_id long, n int, places binary, part int, block binary"
_NAMES = [x.split()[0] for x in _CHUNKS.split(", ")]
_encodings: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pre_tokens(texts: pa.Array, pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens by falling frequency, the numbers of all in order, and how many each text has.

    The pattern never matches across the start of a run of white space, so a text
    is the same as its units (white space, then a word), and each distinct unit is
    matched once.
    """
    texts = pc.fill_null(texts, "")
    data, cut = bytes_of(texts)
    white = _SPACE[data]
    first = white.copy()
    first[1:] &= ~white[:-1]
    for k in np.flatnonzero(pc.match_substring_regex(texts, _WIDE_SPACE).to_numpy(zero_copy_only=False)):
        first[cut[k] : cut[k + 1]] = False
    first[cut[:-1][cut[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int32)
    units = pa.Array.from_buffers(
        pa.utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    plain = pc.match_substring_regex(units.dictionary, _PLAIN).to_pylist()
    parts = [(u,) if p else pattern.findall(u) for u, p in zip(units.dictionary.to_pylist(), plain, strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array(chain.from_iterable(parts), pa.utf8()).dictionary_encode()
    unit = units.indices.to_numpy()
    flat = coded.indices.to_numpy()[ragged((np.cumsum(sizes) - sizes)[unit], sizes[unit])]
    order = np.argsort(-np.bincount(flat, minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    upto = np.concatenate([[0], np.cumsum(sizes[unit])])
    counts = np.diff(upto[np.searchsorted(starts, cut)])
    return coded.dictionary.take(pa.array(order)), number[flat], counts


def _squeezed(numbers: np.ndarray) -> bytes:
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _spread(places: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(places), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeezed_block(words: list[bytes], numbers: np.ndarray) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    head = np.array([len(words)], "<u4").tobytes()
    return zstandard.compress(head + numbers.astype("<u4").tobytes() + sizes.tobytes() + b"".join(words), 3)


def _block(data: bytes) -> tuple[np.ndarray, pa.Array]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    numbers = np.frombuffer(data, "<u4", n, 4)
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4 + 4 * n), dtype=np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return numbers, pa.Array.from_buffers(pa.utf8(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[4 + 8 * n :])])


def chunked(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """Per text one row with the numbers of its pre-tokens; per chunk and part (a hash of the word) one with its words."""

    def run(batches):
        import regex

        compiled, part_id, k = regex.compile(pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", CHUNK_BYTES):
                words, numbers, counts = pre_tokens(piece.column("text"), compiled)
                upto = np.concatenate([[0], np.cumsum(counts)])
                chunk, k = part_id << 32 | k, k + 1
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * n, pa.int64()),
                        piece.column("doc_id"),
                        pa.array(counts, pa.int32()),
                        pa.array([_squeezed(numbers[upto[i] : upto[i + 1]]) for i in range(n)], pa.binary()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    _NAMES,
                )
                if not len(words):
                    continue
                data, cut = bytes_of(words)
                part = (SpanHasher(data).spans(cut[:-1], cut[1:]) % np.uint64(parts)).astype(np.int64)
                plain = words.cast(pa.binary()).to_pylist()
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                own = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                blocks = []
                for p in own:
                    at = sorted(order[bounds[p] : bounds[p + 1]].tolist(), key=plain.__getitem__)
                    blocks.append(_squeezed_block([plain[i] for i in at], np.array(at, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(own), pa.int64()),
                        pa.nulls(len(own), pa.int64()),
                        pa.nulls(len(own), pa.int32()),
                        pa.nulls(len(own), pa.binary()),
                        pa.array(own, pa.int32()),
                        pa.array(blocks, pa.binary()),
                    ],
                    _NAMES,
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CHUNKS)


def _encoded(blocks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(chunk, numbers, sizes, ids) of (chunk, part, block): each distinct word of a part is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        import tiktoken

        if ranks_path not in _encodings:
            _encodings[ranks_path] = tiktoken.Encoding(
                "own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}
            )
        encode_word = _encodings[ranks_path].encode_ordinary
        read = [_block(b) for b in table.column("block").to_pylist()]
        coded = pa.concat_arrays([words for _, words in read]).dictionary_encode()
        ids = [encode_word(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        at, rows, first = coded.indices.to_numpy(), [], 0
        for numbers, words in read:
            own = at[first : first + len(words)]
            first += len(words)
            rows.append((_squeezed(numbers), _squeezed(sizes[own]), _squeezed(flat[ragged(starts[own], sizes[own])]), len(words)))
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays(
            [table.column("chunk"), *[pa.array(c, pa.binary()) for c in columns[:3]], pa.array(columns[3], pa.int32())],
            names=["chunk", "numbers", "sizes", "ids", "n"],
        )

    return blocks.groupBy("part").applyInArrow(run, "chunk long, numbers binary, sizes binary, ids binary, n int")


def _assembled(docs: DataFrame, entries: DataFrame, emit, schema: str, names: list[str]) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.utf8(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, sizes, ids = [], [], []
        for a, b, c, n in zip(*(right.column(c).to_pylist() for c in ("numbers", "sizes", "ids", "n")), strict=True):
            numbers.append(_spread(a, n))
            sizes.append(_spread(b, n))
            ids.append(_spread(c, int(sizes[-1].sum(dtype=np.int64))))
        numbers, sizes, ids = (np.concatenate([np.empty(0, np.uint32), *x]) for x in (numbers, sizes, ids))
        size, start = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        size[numbers], start[numbers] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
        make, rows = emit(), []
        for doc, n, places in zip(*(left.column(c).to_pylist() for c in ("doc_id", "n", "places")), strict=True):
            at = _spread(places, n)
            rows.append((doc, *make(ids[ragged(start[at], size[at])])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, emit=None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): by default its ids as little-endian unsigned 32-bit integers.

    ``emit()`` gives a function from a text's ids to the columns after doc_id.
    A null or empty text has no ids; an empty table gives an empty result.  Repeated rows have a row each.
    A text longer than ``CHUNK_BYTES`` is a chunk of its own, so a text must fit a task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by chunk, so that the last step finds the texts where they lie
    name = f"bpe_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = chunked(docs, pattern, n)
    rows.write.option("compression", "none").option("path", path).bucketBy(n, "chunk").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files lie in the shared folder
    entries = _encoded(rows.where("block IS NOT NULL").select("chunk", "part", "block"), ranks_path, pattern)
    texts = rows.where("places IS NOT NULL").select("chunk", "doc_id", "n", "places")
    names = [x.split()[0] for x in schema.split(", ")]
    return _assembled(texts, entries, emit or (lambda: lambda ids: (ids.tobytes(),)), schema, names)


class TokenBytes:
    """The token-byte table, joined with ids by its dense key."""

    def __init__(self, ranks_path: str):
        ranks = load_ranks(ranks_path)
        out = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        self.table = pa.array(out, pa.large_binary())

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after another."""
        data, _ = bytes_of(self.table.take(pa.array(ids)))
        return data.tobytes()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids), one row each, repeated rows too; null ids give null, an empty table an empty result."""

    def run(batches):
        known = TokenBytes(ranks_path)
        for batch in batches:
            out = [None if x is None else known.joined(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op7_bpe_words(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digests():
        if path not in _tables:
            _tables[path] = TokenBytes(path)

        def of(ids):
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(_tables[path].joined(ids)).hexdigest()

        return of

    return encode(
        table(spark, sf_dir, "documents"),
        path,
        public_tokenizers.PATTERN,
        digests,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


_tables: dict[str, TokenBytes] = {}

QUERIES = {"op7_bpe_words": op7_bpe_words}
ORACLE_SQL: dict[str, str] = {}
