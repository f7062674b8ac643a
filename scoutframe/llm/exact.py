"""Exact copies up to white space, by composable polynomial fingerprints and a comparison of the texts themselves.

The fingerprint of a text is a polynomial of its bytes, white space squeezed to
one space, modulo two primes.  Texts are cut into chunks, chunks are hashed
apart from each other, and the hash of a whole follows from the hashes and lengths of
its chunks: ``h(ab) = h(a) + r ** len(a) * h(b)``.  So a huge text is cut once and its
chunks are hashed by many tasks.

Texts with one fingerprint and length are then compared chunk by chunk with the first of
them.  Those that differ anywhere are compared with the first among themselves, and
so on, until every text has met one that it equals.  Copies that meet in one task
before they move are merged there, and a group with many texts is dealt to many
tasks, to each of which the first text goes along.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from scoutframe.llm._asked import asked_filter, let_through
from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import _WHITE, bytes_of, slices

#: Fixed primes and bases of the two polynomials.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_812_433_253)
#: Bytes of a chunk at most; chunks of texts of more bytes than ``HUGE`` are hashed by other tasks than the one that cuts them.
CHUNK, HUGE = 1 << 20, 8 << 20
#: Bytes and rows of texts that a task merges before they move, and bytes of chunks that one task compares, about.
MERGE_BYTES, MERGE_ROWS, PART_BYTES = 16 << 20, 50_000, 32 << 20
#: Texts of one fingerprint that are compared in one task.
SALT_TEXTS = 64

_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the bases, as many as a chunk has bytes."""
    if not _powers:
        for r, p in zip(BASES, MODULI, strict=True):
            up = np.ones(1, np.uint64)
            while len(up) < CHUNK:
                up = np.concatenate([up, up * np.uint64(pow(r, len(up), p)) % np.uint64(p)])
            _powers.append(up)
    return _powers


def squeezed(data: np.ndarray, cut: np.ndarray, white_before: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with every run of white space as one space, and where each text begins (and the end).

    ``white_before``: the first text goes on after white space.
    """
    white = _WHITE[data]
    again = np.zeros(len(data), bool)
    again[1:] = white[:-1]
    again[cut[:-1][cut[:-1] < len(data)]] = False
    if white_before and len(data):
        again[0] = True
    keep = ~(white & again)
    return np.where(white, np.uint8(32), data)[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


def normal_chunks(data: np.ndarray):
    """The squeezed bytes of one text, chunk after chunk, of which none but a lone one is empty."""
    before, some = False, False
    for at in range(0, len(data), CHUNK):
        raw = data[at : at + CHUNK]
        out, _ = squeezed(raw, np.array([0, len(raw)]), before)
        before = bool(_WHITE[raw[-1]])
        if len(out):
            some = True
            yield out
    if not some:
        yield np.empty(0, np.uint8)


Print = tuple[int, int, int]


def chunk_print(data: np.ndarray) -> Print:
    """Length and both polynomials of one chunk."""
    wide = data.astype(np.uint64) + np.uint64(1)
    # 2 ** 8 * 2 ** 31 * 2 ** 20 stays below 2 ** 64
    return len(data), *(int((wide * up[: len(wide)]).sum(dtype=np.uint64)) % p for up, p in zip(_tables(), MODULI, strict=True))


def joined(prints) -> Print:
    """The print of texts one after another, from their prints."""
    length, hashes, shifts = 0, [0, 0], [1, 1]
    for n, *own in prints:
        for k, p in enumerate(MODULI):
            hashes[k] = (hashes[k] + shifts[k] * own[k]) % p
            shifts[k] = shifts[k] * pow(BASES[k], n, p) % p
        length += n
    return length, *hashes


def key_of(found: Print) -> int:
    """Both polynomials in one integer."""
    return found[1] << 31 | found[2]


def _texts(batch: pa.RecordBatch):
    """(number in the batch, bytes of one text, already squeezed?) of all texts; huge ones come as they are."""
    at = 0
    for part in slices(batch, "text"):
        data, cut = bytes_of(part.column("text"))
        if len(data) > HUGE:
            # a slice of more than its size holds one text
            yield from ((at + k, data[cut[k] : cut[k + 1]], False) for k in range(part.num_rows))
        else:
            data, cut = squeezed(data, cut)
            yield from ((at + k, data[a:b], True) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)))
        at += part.num_rows


def _chunks(data: np.ndarray, done: bool):
    if not done:
        return normal_chunks(data)
    return (data[a : a + CHUNK] for a in range(0, max(1, len(data)), CHUNK))


def _unique(counter: int) -> int:
    """A number that no other task gives; a task that runs again gives the same ones."""
    return TaskContext.get().partitionId() << 36 | counter


def fingerprints(rows: DataFrame) -> DataFrame:
    """(row, id, sha256, key, length) of every row of (row, id, text): the print of the squeezed text, and its digest.

    ``key`` and ``length`` of a huge text are joined from chunks that other tasks hash.
    """
    kind = rows.schema["row"].dataType
    begin = [StructField("row", kind), StructField("id", LongType()), StructField("sha256", StringType())]
    print_of = [StructField("key", LongType()), StructField("length", LongType())]
    spread = [StructField("text_no", LongType()), StructField("k", IntegerType()), StructField("chunk", BinaryType())]

    def run(batches):
        n = 0
        for batch in batches:
            out: list[tuple] = []
            for i, data, done in _texts(batch):
                if done:
                    found = joined(map(chunk_print, _chunks(data, True)))
                    out.append((i, hashlib.sha256(data).hexdigest(), key_of(found), found[0], None, None, None))
                    continue
                n, digest = n + 1, hashlib.sha256()
                for k, chunk in enumerate(normal_chunks(data)):
                    digest.update(chunk)
                    yield packed(batch, [(i, None, None, None, _unique(n), k + 1, chunk.tobytes())])
                # the digest follows the chunks; its row has none
                out.append((i, digest.hexdigest(), None, None, _unique(n), 0, None))
            if out:
                yield packed(batch, out)

    def packed(batch, out):
        at, *columns = zip(*out, strict=True)
        kinds = (pa.utf8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        at = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [batch.column("row").take(at), batch.column("id").take(at), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
            [f.name for f in (*begin, *print_of, *spread)],
        )

    def hashed(batches):
        for batch in batches:
            found = [chunk_print(np.frombuffer(x.as_buffer(), np.uint8)) if x.is_valid else (0, 0, 0) for x in batch.column("chunk")]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "sha256", "text_no", "k")), *columns], ["row", "id", "sha256", "text_no", "k", "n", "h", "g"])

    def whole(own: pa.Table) -> pa.Table:
        own = own.sort_by("k").combine_chunks()
        found = joined(zip(*(own.column(c).to_pylist() for c in ("n", "h", "g")), strict=True))
        return pa.Table.from_arrays([own.column(c).slice(0, 1).combine_chunks() for c in ("row", "id", "sha256")] + [pa.array([v], pa.int64()) for v in (key_of(found), found[0])], names=[f.name for f in (*begin, *print_of)])

    first = stored(rows.mapInArrow(run, StructType(begin + print_of + spread)))
    apart = first.where("text_no IS NOT NULL").select("row", "id", "sha256", "text_no", "k", "chunk").repartition("text_no", "k")
    chunks = apart.mapInArrow(hashed, StructType([*begin, *spread[:2], *(StructField(c, LongType()) for c in ("n", "h", "g"))]))
    huge = chunks.groupBy("text_no").applyInArrow(whole, StructType(begin + print_of))
    return first.where("text_no IS NULL").select("row", "id", "sha256", "key", "length").unionAll(huge)


def asked_texts(rows: DataFrame, asked) -> DataFrame:
    """(entry, key, length, sha256, k, chunk, rows) of the texts whose key may be among those of a broadcast filter.

    One entry for equal texts that a task meets soon after each other: all their
    ``rows`` (structs of row and id) stand with its first chunk.
    """
    member = StructType([StructField("row", rows.schema["row"].dataType), StructField("id", LongType())])
    schema = StructType([
        StructField("entry", LongType()), StructField("key", LongType()), StructField("length", LongType()), StructField("sha256", StringType()),
        StructField("k", IntegerType()), StructField("chunk", BinaryType()), StructField("rows", ArrayType(member)),
    ])

    def may(found: list[Print]) -> np.ndarray:
        """Which of the prints may be asked for."""
        at = pa.array(range(len(found)))
        batch = pa.RecordBatch.from_arrays([pa.array([key_of(f) for f in found], pa.int64()), at], ["id", "at"])
        return let_through(batch, asked.value).column("at").to_numpy()

    def run(batches):
        n, held, base, size, texts = 0, [], 0, 0, {}

        def flush():
            """All held texts, with their rows."""
            nonlocal n, held, base, size, texts
            pool = pa.concat_arrays(held) if held else None
            for at in range(0, len(own := list(texts.items())), 256):
                now = own[at : at + 256]
                members = pool.take(pa.array([i for _, (_, ids) in now for i in ids]))
                cut = np.concatenate([[0], np.cumsum([len(ids) for _, (_, ids) in now])]).astype(np.int32)
                out, keep = [], []
                for j, (data, (found, _)) in enumerate(now):
                    n += 1
                    for k, a in enumerate(range(0, max(1, len(data)), CHUNK)):
                        out.append((_unique(n), key_of(found), found[0], hashlib.sha256(data).hexdigest() if k == 0 else None, k, data[a : a + CHUNK]))
                        keep.append(j if k == 0 else None)
                yield batch_of(out, pa.ListArray.from_arrays(pa.array(cut), members).take(pa.array(keep, pa.int32())))
            held, base, size, texts = [], 0, 0, {}

        for batch in batches:
            own = pa.StructArray.from_arrays([batch.column("row"), batch.column("id")], ["row", "id"])
            held.append(own)
            waiting: list[tuple[int, np.ndarray, Print]] = []

            def settle():
                nonlocal size, waiting
                for w in may([f for *_, f in waiting]).tolist():
                    i, data, found = waiting[w]
                    text = data.tobytes()
                    if text not in texts:
                        size += len(text)
                    texts.setdefault(text, (found, []))[1].append(base + i)
                waiting = []

            for i, data, done in _texts(batch):
                found = joined(map(chunk_print, _chunks(data, done)))
                if done:
                    waiting.append((i, data, found))
                    if len(waiting) == 4096:
                        settle()
                elif len(may([found])):
                    # chunk after chunk: a huge text is never held squeezed
                    n, digest = n + 1, hashlib.sha256()
                    for chunk in normal_chunks(data):
                        digest.update(chunk)
                    rows_of = pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), own.slice(i, 1))
                    for k, chunk in enumerate(normal_chunks(data)):
                        one = (_unique(n), key_of(found), found[0], digest.hexdigest() if k == 0 else None, k, chunk.tobytes())
                        yield batch_of([one], rows_of.take(pa.array([0 if k == 0 else None], pa.int32())))
            settle()
            base += batch.num_rows
            if size > MERGE_BYTES or base > MERGE_ROWS:
                yield from flush()
        yield from flush()

    def batch_of(out, members):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.utf8(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] + [members], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _differing(rows: pa.Table) -> pa.Table:
    """Entries of which a chunk differs from that of the first text it is compared with."""
    rep, k, salt, entry = (rows.column(c).to_pylist() for c in ("rep", "k", "salt", "entry"))
    chunk = [x.as_buffer() for x in rows.column("chunk")]
    first = {(r, j, s): c for r, j, s, e, c in zip(rep, k, salt, entry, chunk, strict=True) if e == r}
    out = {e for r, j, s, e, c in zip(rep, k, salt, entry, chunk, strict=True) if not c.equals(first[r, j, s])}
    return pa.Table.from_arrays([pa.array(sorted(out), pa.int64())], names=["entry"])


def compared(met: DataFrame) -> DataFrame:
    """(entry, rep, salt, salts): for each entry of ``met`` the first entry that holds the same text."""
    size = met.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    open_, closed = met.where("k = 0").select("entry", "key", "length"), None
    while True:
        groups = open_.groupBy("key", "length").agg(F.min("entry").alias("rep"), F.count("*").alias("n"))
        salts = F.ceil(F.col("n") / SALT_TEXTS).cast("int")
        info = stored(
            open_.join(groups, ["key", "length"])
            .withColumn("salts", salts)
            .withColumn("salt", F.when(F.col("entry") == F.col("rep"), 0).otherwise(F.pmod(F.xxhash64("entry"), F.col("salts")).cast("int")))
        )
        many = info.where("n > 1").select("entry", "rep", "salts", "salt")
        every = F.when(F.col("entry") == F.col("rep"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("salt"))
        chunks = met.select("entry", "k", "chunk").join(many, "entry").select("entry", "rep", "k", "chunk", F.explode(every).alias("salt"))
        dealt = chunks.groupBy(F.pmod(F.xxhash64("rep", "k", "salt"), F.lit(parts)).alias("part"))
        differ = stored(dealt.applyInArrow(_differing, "entry long").distinct())
        same = info.join(differ, "entry", "left_anti").select("entry", "rep", "salt", "salts")
        closed = same if closed is None else closed.unionAll(same)
        if differ.isEmpty():
            return closed
        open_ = info.join(differ, "entry", "left_semi").select("entry", "key", "length")


def exact_copies(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of every row; ``row`` holds the named ``columns``, whatever their names.

    Texts are equal if they are after every run of ASCII white space has become one
    space; a null text is empty.  Of each group one row is kept: the one with the smallest
    doc_id (null is largest), of repeated rows any one.  Texts of any length are whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    prints = stored(fingerprints(rows))
    groups = prints.groupBy("key", "length").agg(F.count("*").alias("n"), F.first(F.struct("row", "id", "sha256")).alias("one"))
    groups = stored(groups.select("key", "length", "n", F.when(F.col("n") == 1, F.col("one")).alias("one")))
    alone = groups.where("n = 1").select(
        "one.row", F.col("one.id").alias("doc_id"), F.col("one.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("one.sha256").alias("text_sha256")
    )
    many = groups.where("n > 1").select("key", "length")
    asked = spark.sparkContext.broadcast(asked_filter(many.select(F.col("key").alias("id"))))  # 32 MB at most
    met = stored(asked_texts(rows, asked))
    # what only looked like a key that is asked for has come as a group of one, and goes
    met = met.join(many, ["key", "length"], "left_semi")
    met = stored(met)
    classes = stored(compared(met))
    entries = met.where("k = 0").select("entry", "sha256", "rows").join(classes, "entry")
    low = F.array_min(F.transform("rows", lambda r, i: F.struct(r["id"].isNull().alias("none"), r["id"].alias("id"), F.col("entry").alias("entry"), i.alias("i"))))
    entries = stored(entries.select("entry", "sha256", "rows", "rep", "salt", low.alias("low"), "salts"))
    totals = entries.groupBy("rep").agg(F.sum(F.size("rows")).cast("long").alias("group_size"), F.min("low").alias("first"), F.max("salts").alias("salts"))
    totals = totals.select("rep", "group_size", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    copies = entries.join(totals, ["rep", "salt"]).select("entry", "sha256", "group_size", "first", F.posexplode("rows").alias("i", "member"))
    return alone.unionAll(
        copies.select(
            "member.row", F.col("member.id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size",
            ((F.col("first.entry") == F.col("entry")) & (F.col("first.i") == F.col("i"))).alias("kept"), F.col("sha256").alias("text_sha256"),
        )
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of copies, all its columns as they were; see ``exact_copies`` for which."""
    return exact_copies(docs, docs.columns).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op13_composable_prints(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_copies(table(spark, sf_dir, "documents"), ["doc_id"]).drop("row")


_SQL = r"""WITH squeezed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM squeezed WINDOW own AS (PARTITION BY t)"""


QUERIES = {"op13_composable_prints": op13_composable_prints}
ORACLE_SQL = {"op13_composable_prints": _SQL}
