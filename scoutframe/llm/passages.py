"""Substring dedup by repeated-phrase automata, over words.

A passage recurs in a text if its 50-word windows also start in a document with a
smaller doc_id.

1. Confirmed phrases: every word gets a code of two letters.  Each window's anchor
   is a run of 16 words in it; a phrase is confirmed if it anchors windows of two
   texts or more.  Only phrases come out of that, no places.
2. Automata: the heads of confirmed phrases are dealt to shards of ``SHARD`` at most; each
   shard is compiled into one Aho-Corasick automaton, and all documents are
   streamed through it to locate every occurrence, wherever it stands.
3. The windows around occurrences, of the texts as they are, are shuffled by hash
   with their document, and the smallest doc_id of each window decides.  A slice of
   texts settles among its own texts what it can, so a frequent window is
   asked for once a slice.

All documents pass every shard, and the number of shards follows that of phrases that recur.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._asked import asked_filter, asked_rows, let_through
from scoutframe.llm._repeats import anchors, by_text, copies_of, dealt_by_text, identified, packed_by_part, places_of, unpacked
from scoutframe.llm._shared import appended, stored, table
from scoutframe.llm._text import SpanHasher, Words, keeps, only, slices

SIZE = 50
REACH = 34
PHRASE = SIZE - REACH
#: Automata hold so many first words of a phrase: what they find beyond whole phrases is judged like the rest.
HEAD = 8
#: Heads in one automaton at most: about 120 MB in each Python worker.
SHARD = 150_000
_LETTER = 48
#: Bytes of text that a task works on at once.
PIECE = 2 << 20


def coded(docs: DataFrame) -> DataFrame:
    """(id, th, code) of texts with a window: two letters of 64 for each word, by its hash.  A slice's copies of a text are one."""

    def run(batches):
        only("passages")
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                words = Words(part.column("text"))
                h = words.hashes()
                letters = (np.column_stack([h & np.uint64(63), (h >> np.uint64(6)) & np.uint64(63)]) + _LETTER).astype(np.uint8)
                th, ids = part.column("th").to_numpy(), part.column("id").to_numpy()
                order = np.lexsort((ids, th))
                first = order[np.concatenate([[True], th[order][1:] != th[order][:-1]])]
                keep = np.sort(first[np.diff(words.cut)[first] >= SIZE])
                codes = [letters[words.cut[k] : words.cut[k + 1]].tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(th[keep]), pa.array(codes, pa.binary())], ["id", "th", "code"])

    return docs.select("text", "th", "id").mapInArrow(run, "id long, th long, code binary")


def _joined(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, one row a word, and the first word of each text."""
    codes = codes.to_pylist()
    cut = np.concatenate([[0], np.cumsum([len(c) // 2 for c in codes])])
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 2), cut


_KEYED = ["u8", "i8", f"V{2 * PHRASE}"]


def confirmed_phrases(codes: DataFrame, parts: int) -> DataFrame:
    """(part, k, n, phrases): blocks of at most ``SHARD`` distinct heads of phrases that anchor windows of two texts or more."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "code", 1 << 20):
                letters, cut = _joined(part.column("code"))
                grams = SpanHasher(letters.astype(np.uint64) @ np.array([64, 1], np.uint64)).windows(PHRASE)
                at = anchors(grams, cut, SIZE, REACH)
                if not len(at):
                    continue
                th = part.column("th").to_numpy()[np.searchsorted(cut, at, "right") - 1]
                order = np.lexsort((th, grams[at]))
                key, th, at = grams[at][order], th[order], at[order]
                # of one phrase, two texts say that it recurs
                first = np.concatenate([[True], key[1:] != key[:-1]])
                keep = np.flatnonzero(first | np.append(first[1:], True))
                key, th, at = key[keep], th[keep], at[keep]
                text = np.ascontiguousarray(letters[at[:, None] + np.arange(PHRASE)].reshape(len(at), -1)).view(f"V{2 * PHRASE}").ravel()
                own, packed = packed_by_part(key, [key, th, text], parts)
                packed = [zstandard.compress(x, 1) for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    def confirm(rows: pa.Table) -> pa.Table:
        raw = pa.chunked_array([pa.array([zstandard.decompress(x.as_py()) for x in rows.column("packed")], pa.binary())])
        key, th, text = unpacked(raw, _KEYED)
        order = np.lexsort((th, key))
        key, th, text = key[order], th[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        text = text[first[np.maximum.reduceat(th, first) != np.minimum.reduceat(th, first)]]
        text = np.unique(np.ascontiguousarray(text.view(np.uint8).reshape(-1, 2 * PHRASE)[:, : 2 * HEAD]).view(f"S{2 * HEAD}").ravel())
        blocks = [text[at : at + SHARD] for at in range(0, len(text), SHARD)]
        k = len(blocks)
        columns = [pa.array([rows.column("part")[0].as_py()] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([len(b) for b in blocks], pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array([b.tobytes() for b in blocks], pa.binary())], names=["part", "k", "n", "phrases"])

    return (
        codes.select("th", "code")
        .mapInArrow(run, "part int, packed binary")
        .groupBy("part")
        .applyInArrow(confirm, "part int, k int, n long, phrases binary")
    )


def shards(sizes: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Blocks (part, k, n) dealt in order to shards of at most ``most`` phrases."""
    out, held = [], most + 1
    for part, k, n in sorted(sizes):
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append((part, k))
        held += n
    return out


_compiled: dict = {}
keeps("passages", _compiled.clear)


def automaton(phrases: bytes):
    """The Aho-Corasick automaton of one shard; a Python worker keeps the last one."""
    import ahocorasick

    name = hashlib.sha256(phrases).digest()
    if name not in _compiled:
        _compiled.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text, width = phrases.decode("latin-1"), 2 * HEAD
        for at in range(0, len(text), width):
            found.add_word(text[at : at + width])
        found.make_automaton()
        _compiled[name] = found
    return _compiled[name]


def located(codes: DataFrame, phrases: bytes) -> DataFrame:
    """(id, th, places) of every text with an occurrence of one of the ``phrases`` (their heads): the first word of each."""
    known = codes.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        only("passages")
        for batch in batches:
            for part in slices(batch, "code", 1 << 20):
                codes = part.column("code").to_pylist()
                # a line end parts texts and is no letter
                ends = np.fromiter((end for end, _ in automaton(known.value).iter(b"\n".join(codes).decode("latin-1"))), np.int64)
                starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])])
                of = np.searchsorted(starts, ends, "right") - 1
                at = ends + 1 - 2 * HEAD - starts[of]
                of, at = of[at % 2 == 0], at[at % 2 == 0] // 2
                bounds = np.searchsorted(of, np.arange(len(codes) + 1))
                hit = np.flatnonzero(np.diff(bounds))
                if len(hit):
                    places = [at[bounds[k] : bounds[k + 1]].astype(np.uint32).tobytes() for k in hit]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(hit)), part.column("th").take(pa.array(hit)), pa.array(places, pa.binary())], ["id", "th", "places"])

    return codes.mapInArrow(run, "id long, th long, places binary")


def occurrences(docs: DataFrame, parts: int) -> DataFrame:
    """(id, th, places): where confirmed phrases occur in texts, one row a text and shard."""
    codes = stored(coded(docs))
    blocks = stored(confirmed_phrases(codes, parts))
    # only how many phrases each block has, and then one shard at a time, are seen by the driver
    sizes = [tuple(r) for r in blocks.select("part", "k", "n").collect()]
    found = None
    for shard in shards(sizes, SHARD):
        (first, _), (last, _) = shard[0], shard[-1]
        own = {(r.part, r.k): r.phrases for r in blocks.where(F.col("part").between(first, last)).where(F.struct("part", "k").isin([F.struct(F.lit(p), F.lit(k)) for p, k in shard])).collect()}
        found = appended(located(codes, b"".join(own[x] for x in shard)), found)
    if found is None:
        return docs.sparkSession.createDataFrame([], "id long, th long, places binary")
    return found.read()


def _windows(texts: DataFrame, parts: int) -> DataFrame:
    """(part, packed) of the windows around all occurrences of phrases: hash, th, place, smallest doc_id of the text, and whether the slice knows that it goes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                words = Words(part.column("text"))
                places = [places_of(b"".join(x)) for x in part.column("places").to_pylist()]
                found = np.concatenate([np.empty(0, np.int64), *(p + c for p, c in zip(places, words.cut[:-1], strict=True))])
                if not len(found):
                    continue
                n = len(words.starts)
                near = np.zeros(n + 1, np.int64)
                np.add.at(near, np.maximum(found - REACH, 0), 1)
                np.add.at(near, found + 1, -1)
                near = np.cumsum(near[:-1]) > 0
                hashes = SpanHasher(words.hashes()).windows(SIZE)
                at = np.flatnonzero(near[: len(hashes)])
                of = np.searchsorted(words.cut, at, "right") - 1
                fit = at + SIZE <= words.cut[of + 1]
                at, of = at[fit], of[fit]
                if len(at):
                    key, low = hashes[at], part.column("id").to_numpy()[of]
                    order = np.lexsort((low, key))
                    at, of, key, low = at[order], of[order], key[order], low[order]
                    first = np.concatenate([[True], key[1:] != key[:-1]])
                    goes = low > low[np.flatnonzero(first)][np.cumsum(first) - 1]
                    th = part.column("th").to_numpy()[of]
                    columns = [key, th, (at - words.cut[of]).astype(np.uint32), low, goes.astype(np.uint8)]
                    # what is settled goes anywhere
                    own, packed = packed_by_part(np.where(goes, th.view(np.uint64), key), columns, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    return texts.mapInArrow(run, "part int, packed binary")


def earlier(windows: DataFrame, parts: int) -> DataFrame:
    """(th, places): the windows that a smaller doc_id holds, one row a text."""

    def judge(rows: pa.Table) -> pa.Table:
        key, th, place, low, goes = unpacked(rows.column("packed"), ["u8", "i8", "u4", "i8", "u1"])
        ask = np.flatnonzero(goes == 0)
        ask = ask[np.argsort(key[ask], kind="stable")]
        if len(ask):
            first = np.flatnonzero(np.concatenate([[True], key[ask][1:] != key[ask][:-1]]))
            least = np.repeat(np.minimum.reduceat(low[ask], first), np.diff(np.append(first, len(ask))))
            goes[ask[low[ask] > least]] = 1
        gone = goes == 1
        return dealt_by_text(th[gone], [place[gone]], parts)

    return by_text(windows.groupBy("part").applyInArrow(judge, "to int, packed binary"), ["u4"], ["places"])


def _filter(wanted: DataFrame):
    return wanted.sparkSession.sparkContext.broadcast(asked_filter(wanted.selectExpr("th AS id")))


def removals(docs: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame, object]:
    """Rows about which there may be a verdict, all rows, and the filter that tells the first from the rest.

    Rows are (doc_id, text, th, copy, places, and columns ``carried`` along): ``places`` are the windows that
    start in a smaller doc_id.  ``copy`` marks a row whose whole text stands in a document with a smaller
    doc_id: there every window does.  A null doc_id is larger than any other.
    Only rows of the first kind move, by doc_id and text, so copies of one text spread.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = identified(docs, *carried)
    docs = identified(docs)
    firsts, many = copies_of(docs)
    firsts = stored(firsts)
    found = occurrences(docs, parts).groupBy("id", "th").agg(F.collect_list("places").alias("places"))
    found = stored(found.join(firsts, ["id", "th"]))
    # dealt anew at every size: two Python steps never run in one stage
    texts = asked_rows(docs, _filter(found), "th").repartition("id", "th").join(found, ["id", "th"])
    gone = earlier(_windows(texts.select("text", "th", "id", "places"), parts), parts)
    verdicts = (
        firsts.join(gone, "th")
        .select("id", "th", "places", F.lit(False).alias("copy"))
        .unionAll(many.where("id > low").select("id", "th", F.lit(None).cast("binary"), F.lit(True)))
    )
    verdicts = stored(verdicts)
    known = _filter(verdicts)
    columns = ["doc_id", "text", "th", "copy", "places", *carried]
    judged = asked_rows(whole, known, "th").repartition("id", "th").join(verdicts, ["id", "th"], "left")
    judged = judged.withColumn("copy", F.coalesce("copy", F.lit(False)))
    whole = whole.withColumns({"copy": F.lit(False), "places": F.lit(None).cast("binary")})
    return judged.select(*columns), whole.select(*columns), known


def _each(found: tuple[DataFrame, DataFrame, object], columns: list[str], cut, schema: str) -> DataFrame:
    """``cut(part, words)`` gives the columns of each slice: of the judged rows, and of the others, which nobody asked for."""
    judged, whole, known = found
    names = [x.split()[0] for x in schema.split(", ")] if "<" not in schema else None

    def run(others: bool):
        def each(batches):
            for batch in batches:
                if others:
                    batch = let_through(batch, known.value, "th", False)
                for part in slices(batch, "text", PIECE):
                    arrays, own = cut(part, Words(part.column("text")))
                    yield pa.RecordBatch.from_arrays(arrays, names or own)

        return each

    rows = [df.select(*columns).mapInArrow(run(others), schema) for df, others in ((judged, False), (whole, True))]
    return rows[0].unionAll(rows[1])


def _kept_words(words: Words, k: int, places: np.ndarray, copy: bool) -> np.ndarray:
    """Numbers of the words of text ``k`` that stay."""
    first, last = int(words.cut[k]), int(words.cut[k + 1])
    if copy and last - first >= SIZE:
        return np.empty(0, np.int64)
    gone = np.zeros(last - first + 1, np.int64)
    np.add.at(gone, places, 1)
    np.add.at(gone, places + SIZE, -1)
    return np.flatnonzero(np.cumsum(gone[:-1]) == 0) + first


_KINDS = {"long": pa.int64(), "string": pa.utf8()}


def _applied(docs: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(doc_id, n_words, n_removed, kept words as bytes)`` for every row."""
    types = [_KINDS[x.split()[1]] for x in schema.split(", ")]

    def cut(part, words):
        data, out = words.data.tobytes(), []
        cols = (part.column(c).to_pylist() for c in ("doc_id", "copy", "places"))
        for k, (doc, copy, places) in enumerate(zip(*cols, strict=True)):
            keep = _kept_words(words, k, places_of(places), copy)
            text = b" ".join([data[a:b] for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
            n = int(words.cut[k + 1] - words.cut[k])
            out.append(emit(doc, n, n - len(keep), text))
        return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], None

    return _each(removals(docs), ["doc_id", "text", "th", "copy", "places"], cut, schema)


def removed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, for every row of ``docs``.

    A null or empty text has no words.  Rows with one doc_id are one document:
    a window is removed only if a smaller doc_id holds it.  An empty table gives
    an empty result.
    """
    return _applied(docs, lambda doc, n, gone, text: (doc, n, gone, text.decode()), "doc_id long, n_words long, n_removed long, kept string")


def filter_documents(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages cut out: their kept words joined by one space; an untouched text stays as it is.

    Each row is cut by itself, whatever rows share its doc_id or have none.  Documents of which nothing is left go.
    ``n_chars`` follows the new text, other columns stay, whatever their names.  An empty table gives an empty result.
    """
    names = docs.columns
    found = removals(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), "row")

    def cut(part, words):
        data = words.data.tobytes()
        new, gone, n = [], [], []
        for k, (copy, places) in enumerate(zip(part.column("copy").to_pylist(), part.column("places").to_pylist(), strict=True)):
            keep = _kept_words(words, k, places_of(places), copy)
            n.append(int(words.cut[k + 1] - words.cut[k]))
            gone.append(n[-1] - len(keep))
            if gone[-1]:
                text = b" ".join([data[a:b] for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                new.append(text.decode())
            else:
                new.append(None)
        columns = [part.column("row"), pa.array(new, pa.utf8()), pa.array(gone, pa.int64()), pa.array(n, pa.int64())]
        return columns, ["row", "kept", "n_removed", "n_words"]

    kind = found[0].schema["row"].dataType.simpleString()
    out = _each(found, ["text", "th", "copy", "places", "row"], cut, f"row {kind}, kept string, n_removed long, n_words long")
    out = out.where("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.coalesce("kept", "row.text"), "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in names else None}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def op2_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """All documents with what is removed of them."""
    return _applied(
        table(spark, sf_dir, "documents"),
        lambda doc, n, gone, text: (doc, n, gone, hashlib.sha256(text).hexdigest()),
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


_ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS p FROM windows x JOIN firsts f ON f.s = x.s AND f.low < x.doc_id)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

QUERIES = {"op2_phrase_automata": op2_phrase_automata}
ORACLE_SQL = {"op2_phrase_automata": _ORACLE}
