"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct five-word shingles.  Documents with equal
sets form one class, so copies never meet each other as pairs.

1. Global order: shingles are ordered by how often they occur, rare first, read
   from a counting sketch of fixed size over all documents, then by hash.  Any
   fixed order gives right results; this one keeps frequent shingles out of reach.
2. Who can link: a set that links shares three quarters of its shingles.  All
   shingles of all documents meet by hash, without a name, and each slice of
   texts gets back how many of each text's shingles stand elsewhere, too.  Only
   texts that share enough go on; this filter loses nothing.
3. Candidates: two sets that link share a shingle among the first quarter (and
   one) of each.  Those prefixes are shuffled by shingle.  All classes that share
   one are first tested against one of them; what then still lies in different
   components is tested pair by pair, where the sizes of fragments allow a link.
4. Vertical partitioning: the global order is cut into fragments that hold about
   as many shingles each; partial overlaps of a pair are counted in each fragment
   separately and summed per pair.
5. Links: what 3 and 4 find joins the components, but isn't all links.  A link never
   leaves its component, so within each of three classes or more all pairs are
   compared, in blocks, and counted per class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm._asked import MERGE, asked_filter, let_through
from scoutframe.llm._graph import components
from scoutframe.llm._repeats import NO_ID
from scoutframe.llm._shared import stored, table
from scoutframe.llm._text import SLICE_BYTES, SpanHasher, lower_words, mixed, only, slices

N = 5
#: Link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
SKETCH_BITS = 20
SKETCH_BLOCKS = 32
FRAGMENTS = 2
#: Shingles of all texts meet in groups of about so many, each in three bytes beside its group.
MEET_TOKENS = 1_000_000
#: Finer fragments, of which only the sizes are kept: they bound the overlap of a pair from above.
#: There are a power of two of them, about one for each two shingles.
LEAST_BOUNDS, MOST_BOUNDS = 64, 1 << 16
#: Classes that share a shingle are compared in blocks of so many.
BLOCK = 512
#: Classes of a component are counted in blocks of about so many, over so many distinct shingles at a time.
LINK_BLOCK = 256
LINK_CHUNK = 4096
#: Sets compared with one hub in one task.
GROUP = 64
#: Shingles move in so many bytes.
MOVED_BYTES = 6


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; with fewer than five words the whole text is one."""
    words = lower_words(texts)
    hasher = SpanHasher(words.hashes())
    full = hasher.windows(N)
    out = []
    for first, last in zip(words.cut[:-1].tolist(), words.cut[1:].tolist(), strict=True):
        if last - first >= N:
            out.append(np.unique(full[first : last - N + 1]))
        elif last > first:
            whole = hasher.spans(np.array([first]), np.array([last]))
            out.append(mixed(whole ^ np.uint64(last - first)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _class_of(shingles: np.ndarray) -> int:
    """A 64-bit identity of a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    parts = np.array([len(shingles), shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles), mixed(shingles).sum(dtype=np.uint64)], np.uint64)
    return int(SpanHasher(parts).spans(np.array([0]), np.array([4])).astype(np.int64)[0])


def _fragment_sizes(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each of the finer fragments; 255 stands for that many or more."""
    bounds = LEAST_BOUNDS
    while bounds < MOST_BOUNDS and 2 * bounds < len(shingles):
        bounds *= 2
    at = (shingles >> np.uint64(64 - bounds.bit_length() + 1)).astype(np.int64)
    return zstandard.compress(np.minimum(np.bincount(at, minlength=bounds), 255).astype(np.uint8).tobytes(), 1)


def _moved(shingles: np.ndarray) -> bytes:
    """Sorted shingles by their first 48 bits: differences, byte by byte of all, compressed."""
    short = shingles >> np.uint64(64 - 8 * MOVED_BYTES)
    steps = np.diff(short, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(steps[:, :MOVED_BYTES].T).tobytes(), 1)


def _arrived(data: bytes) -> np.ndarray:
    """What ``_moved`` packed, as sorted 48-bit values."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(MOVED_BYTES, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :MOVED_BYTES] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


_PROFILE = "doc_id long, th long, id long, n long, class long, block int, merge int, counts binary"
_PROFILE_NAMES = [x.split()[0] for x in _PROFILE.split(", ")]


def profiled(docs: DataFrame) -> DataFrame:
    """One row per document (n, class) and, from each task, the blocks of its counting sketch."""

    def run(batches):
        only("jaccard")
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                if sum(map(len, sets)):
                    at = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    sketch += np.bincount(at, minlength=len(sketch)).astype(np.uint32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("th"),
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_class_of(s) for s in sets], pa.int64()),
                        pa.nulls(k, pa.int32()),
                        pa.nulls(k, pa.int32()),
                        pa.nulls(k, pa.binary()),
                    ],
                    _PROFILE_NAMES,
                )
        if sketch.any():
            blocks = [zstandard.compress(b.tobytes(), 1) for b in np.split(sketch, SKETCH_BLOCKS)]
            k = SKETCH_BLOCKS
            merge = TaskContext.get().partitionId() // MERGE
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64())] * 5 + [pa.array(range(k), pa.int32()), pa.array([merge] * k, pa.int32()), pa.array(blocks, pa.binary())],
                _PROFILE_NAMES,
            )

    return docs.mapInArrow(run, _PROFILE)


def levels_of(profile: DataFrame) -> np.ndarray:
    """The order of magnitude of each sketch cell's count: a table of fixed size, whatever the input."""

    def summed(kind):
        def add(rows: pa.Table) -> pa.Table:
            total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint64)
            for x in rows.column("counts"):
                total += np.frombuffer(zstandard.decompress(x.as_py()), kind)
            packed = zstandard.compress(total.tobytes(), 1)
            return pa.Table.from_arrays([rows.column("block").slice(0, 1), pa.array([packed], pa.binary())], names=["block", "counts"])

        return add

    found = (
        profile.where("block IS NOT NULL")
        .groupBy("block", "merge")
        .applyInArrow(summed(np.uint32), "block int, counts binary")
        .groupBy("block")
        .applyInArrow(summed(np.uint64), "block int, counts binary")
    )
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint8)
    for block, counts in found.collect():
        total = np.frombuffer(zstandard.decompress(counts), np.uint64).astype(np.float64)
        out[block] = np.ceil(np.log2(total + 1)).astype(np.uint8)
    return out.ravel()


def _ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places in the global order: the level of the shingle's cell, then its hash."""
    level = levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(56)) | (shingles >> np.uint64(8))


def pivots_of(levels: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order is cut, so that fragments hold about as many shingles each."""
    cells = np.argsort(levels, kind="stable")
    upto = np.cumsum(2.0 ** levels[cells] - 1)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, fragments) / fragments)
    cells = cells[np.minimum(at, len(cells) - 1)]
    return _ordered(cells.astype(np.uint64) << np.uint64(64 - SKETCH_BITS), levels)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte of all, compressed."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def _unplaned(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_MEET = "slice long, part int, counts binary, tokens binary, known binary, classes binary"
_MEET_NAMES = [x.split()[0] for x in _MEET.split(", ")]


def able_to_link(docs: DataFrame, parts: int) -> DataFrame:
    """Classes (distinct) of which three quarters of the shingles may stand in other texts, too: all that can link, and a few more.

    A slice of texts drops its own copies and counts what its texts share among
    themselves; only the rest asks, 24 bits a shingle beside its group.  A group answers
    with one count a text.  A shingle in many texts is sent once a slice.
    """

    def ask(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets, classes = [], []
                for s in shingle_sets(piece.column("text")):
                    if len(s):
                        sets.append(s)
                        classes.append(_class_of(s))
                if not sets:
                    continue
                classes, first = np.unique(np.array(classes, np.int64), return_index=True)
                sets = [sets[i] for i in first]
                n = np.array([len(s) for s in sets])
                tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
                order = np.argsort(tokens, kind="stable")
                tokens, doc = tokens[order], doc[order]
                same = tokens[1:] == tokens[:-1]
                many = np.zeros(len(tokens), bool)
                many[1:] |= same
                many[:-1] |= same
                known = np.bincount(doc[many], minlength=len(n))
                name = int(SpanHasher(np.append(classes.view(np.uint64), n.astype(np.uint64))).spans(np.array([0]), np.array([2 * len(n)])).astype(np.int64)[0])
                sides = []
                for values, of in ((tokens[~many], doc[~many]), (np.unique(tokens[many]), None)):
                    to = (values % np.uint64(parts)).astype(np.int64)
                    # by part, then by text
                    order = np.argsort(to, kind="stable") if of is None else np.lexsort((of, to))
                    sides.append((values[order] >> np.uint64(40), None if of is None else of[order], np.searchsorted(to[order], np.arange(parts + 1))))
                (own, of, cut), (shared, _, shared_cut) = sides
                rows = []
                for p in range(parts):
                    a, b, c, d = cut[p], cut[p + 1], shared_cut[p], shared_cut[p + 1]
                    if a < b or c < d:
                        rows.append((p, _planes(np.bincount(of[a:b], minlength=len(n)), 4), _planes(own[a:b], 3), _planes(shared[c:d], 3), None))
                head = b"".join(x.astype("<i8").tobytes() for x in (classes, n, known))
                rows.append((-1, None, None, None, zstandard.compress(head, 1)))
                kinds = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], _MEET_NAMES
                )

    def meet(rows: pa.Table) -> pa.Table:
        names = rows.column("slice").to_pylist()
        tokens = [_unplaned(x, 3).astype(np.uint32) for x in rows.column("tokens").to_pylist()]
        shared = [_unplaned(x, 3).astype(np.uint32) for x in rows.column("known").to_pylist()]
        every, times = np.unique(np.concatenate([*tokens, *shared, *shared]), return_counts=True)
        recurs = np.zeros(1 << 24, bool)
        recurs[every[times > 1]] = True
        out = []
        for t, counts in zip(tokens, rows.column("counts").to_pylist(), strict=True):
            counts = _unplaned(counts, 4).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(recurs[t])])
            ends = np.cumsum(counts)
            out.append(_planes(upto[ends] - upto[ends - counts], 4))
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=["slice", "counts", "classes"])

    def total(rows: pa.Table) -> pa.Table:
        k, head = 0, None
        for counts, classes in zip(rows.column("counts").to_pylist(), rows.column("classes").to_pylist(), strict=True):
            if classes is not None:
                head = np.frombuffer(zstandard.decompress(classes), "<i8").reshape(3, -1)
            else:
                k = k + _unplaned(counts, 4).astype(np.int64)
        classes, n, known = head
        return pa.table({"class": pa.array(classes[100 * (k + known) >= THRESHOLD * n], pa.int64())})

    rows = stored(docs.select("text").mapInArrow(ask, _MEET), "none")
    answers = rows.where("part >= 0").groupBy("part").applyInArrow(meet, "slice long, counts binary, classes binary")
    heads = rows.where("part < 0").select("slice", "counts", "classes").dropDuplicates(["slice"])
    return answers.unionAll(heads).groupBy("slice").applyInArrow(total, "class long").distinct()


def _prefixes(docs: DataFrame, levels: np.ndarray, asked: DataFrame, parts: int) -> DataFrame:
    """Of the documents ``asked`` for (id), by part the prefix shingles; and one row each with its class and fragment sizes."""
    known = docs.sparkSession.sparkContext.broadcast(levels)
    bits = docs.sparkSession.sparkContext.broadcast(asked_filter(asked))

    def cut(batches):
        level = known.value
        for batch in batches:
            batch = let_through(batch, bits.value)
            for part in slices(batch, "text"):
                rows, classes = [], {}
                for s in shingle_sets(part.column("text")):
                    name = _class_of(s)
                    if len(s) and name not in classes:
                        size = len(s) - -(-THRESHOLD * len(s) // 100) + 1
                        order = np.argsort(_ordered(s, level), kind="stable")[:size]
                        classes[name] = _fragment_sizes(s)
                        rows.append((s[order], np.full(size, name, np.int64), np.full(size, len(s), np.uint32)))
                if not rows:
                    continue
                tokens, names, sizes = (np.concatenate(c) for c in zip(*rows, strict=True))
                to = (tokens % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                own = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                packed = []
                for p in own:
                    at = order[bounds[p] : bounds[p + 1]]
                    short = (tokens[at] >> np.uint64(32)).astype(np.uint32)
                    packed.append(short.tobytes() + sizes[at].tobytes() + names[at].tobytes())
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], ["part", "packed", "class", "sizes"])
                k = len(classes)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(list(classes), pa.int64()), pa.array(list(classes.values()), pa.binary())], ["part", "packed", "class", "sizes"])

    return docs.select("id", "text").mapInArrow(cut, "part int, packed binary, class long, sizes binary")


def _shared(prefixes: DataFrame) -> DataFrame:
    """(token, class, n) of prefix shingles that several classes share; a token stands for its list of classes."""

    def share(rows: pa.Table) -> pa.Table:
        tokens, sizes, classes = [], [], []
        for x in rows.column("packed"):
            data = x.as_py()
            n = len(data) // 16
            tokens.append(np.frombuffer(data, np.uint32, n))
            sizes.append(np.frombuffer(data, np.uint32, n, 4 * n))
            classes.append(np.frombuffer(data, np.int64, n, 8 * n))
        tokens, sizes, classes = np.concatenate(tokens), np.concatenate(sizes), np.concatenate(classes)
        order = np.lexsort((classes, tokens))
        tokens, sizes, classes = tokens[order], sizes[order], classes[order]
        same = tokens[1:] == tokens[:-1]
        fresh = np.concatenate([[True], ~(same & (classes[1:] == classes[:-1]))])
        tokens, sizes, classes = tokens[fresh], sizes[fresh], classes[fresh]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        lists = SpanHasher(classes).spans(first, first + counts)
        keep = np.zeros(len(first), bool)
        keep[np.unique(lists, return_index=True)[1]] = True
        keep &= counts > 1
        rows_kept = np.repeat(keep, counts)
        name = np.repeat(lists.astype(np.int64), counts)
        return pa.Table.from_arrays(
            [pa.array(name[rows_kept]), pa.array(classes[rows_kept]), pa.array(sizes[rows_kept].astype(np.int64))],
            names=["token", "class", "n"],
        )

    return (
        prefixes.where("part IS NOT NULL")
        .select("part", "packed")
        .groupBy("part")
        .applyInArrow(share, "token long, class long, n long")
        .dropDuplicates(["token", "class"])
    )


def _near(a: str, b: str) -> F.Column:
    return F.expr(f"100 * least({a}, {b}) >= {THRESHOLD} * greatest({a}, {b})")


def _possible(n: np.ndarray, sizes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes of sets and fragments leave room for a link between rows ``a`` and ``b``."""
    out = np.zeros(len(a), bool)
    width = np.array([len(x) for x in sizes])
    wide = width[a] * (MOST_BOUNDS << 1) + width[b]
    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        common = min(width[a[at[0]]], width[b[at[0]]])
        sides = []
        for rows in (a[at], b[at]):
            x = np.stack([sizes[i] for i in rows]).astype(np.int64)
            full = (x == 255).reshape(len(at), common, -1).any(2)
            sides.append((x.reshape(len(at), common, -1).sum(2), full))
        (x, x_full), (y, y_full) = sides
        # a full fragment may hold more than it says
        least = np.where(x_full & y_full, np.iinfo(np.int32).max, np.where(x_full, y, np.where(y_full, x, np.minimum(x, y))))
        bound = np.minimum(least.sum(1), np.minimum(n[a[at]], n[b[at]]))
        out[at] = 100 * bound >= THRESHOLD * (n[a[at]] + n[b[at]] - bound)
    return out


def possible_pairs(placed: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """Distinct (a, b), a < b, of classes that share a token, lie in different components and may link.

    ``placed``: token, class, n, root; ``sizes``: class, sizes.  The classes of a token are cut into
    blocks, and each two blocks meet in a group of their own, so the work on a
    frequent token spreads over many tasks and only pairs that pass the bounds
    leave it.
    """
    # a pair leaves only the group of the first token that both have, so it leaves once
    tokens = placed.groupBy("class").agg(F.collect_list("token").alias("tokens"))
    counts = placed.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        placed.join(counts, "token")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("key", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("part", F.pmod(F.col("key"), F.lit(4 * parts)).cast("int"))
        .join(tokens, "class")
        .join(sizes, "class")
        .select("part", "key", "token", "tokens", "block", F.col("other").alias("with"), "class", "n", "sizes", "root")
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        key, token, block, other, name, n, root = (
            rows.column(c).to_numpy() for c in ("key", "token", "block", "with", "class", "n", "root")
        )
        tokens = rows.column("tokens").to_pylist()
        sizes = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in rows.column("sizes").to_pylist()]
        bounds = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        found = [np.empty((0, 2), np.int64)]
        waiting, held = [], 0

        def flush():
            a, b = (np.concatenate(c) for c in zip(*waiting, strict=True))
            fit = (root[a] != root[b]) & (name[a] != name[b])
            fit &= 100 * np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b])
            a, b = a[fit], b[fit]
            fit = _possible(n, sizes, a, b)
            a, b = a[fit], b[fit]
            first = [min(set(tokens[i]).intersection(tokens[j])) == token[i] for i, j in zip(a, b, strict=True)]
            a, b = a[np.array(first, bool)], b[np.array(first, bool)]
            x, y = name[a], name[b]
            found.append(np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0))
            waiting.clear()

        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            here = np.arange(first, last)
            apart = block[first] != other[first]
            left = here[block[here] < other[here]] if apart else here
            right = here[block[here] > other[here]] if apart else here
            for at in range(0, len(left), 64):
                a, b = np.meshgrid(left[at : at + 64], right, indexing="ij")
                a, b = a.ravel(), b.ravel()
                fit = slice(None) if apart else a < b
                waiting.append((a[fit], b[fit]))
                held += len(waiting[-1][0])
                if held > 4_000:
                    flush()
                    held = 0
        if waiting:
            flush()
        out = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return dealt.groupBy("part").applyInArrow(compare, "a long, b long").distinct()


def asked_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, packed) of the documents that ``wanted`` may ask for, their texts compressed before they move."""
    known = docs.sparkSession.sparkContext.broadcast(asked_filter(wanted))

    def run(batches):
        for batch in batches:
            batch = let_through(batch, known.value)
            if batch.num_rows:
                texts = [zstandard.compress((x.as_py() or "").encode(), 1) for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "packed"])

    return docs.select("id", "text").mapInArrow(run, "id long, packed binary")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, levels: np.ndarray) -> DataFrame:
    """The pairs (a, b) of classes that link, each with its overlap.

    Sets meet by their first class and fragment; where a class has many partners,
    these are dealt to several groups, each with a copy of the one set.  Only texts
    that a filter of fixed size can't rule out move.  Overlaps are counted on the
    first 48 bits of shingles.
    """
    dealt = pairs.select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(Window.partitionBy("a")) / GROUP)).cast("int").alias("salt")
    )
    asked = stored(dealt)
    sides = asked.select(F.col("b").alias("class"), F.col("a").alias("hub"), "salt", F.lit(False).alias("own")).unionAll(
        asked.select(F.col("a").alias("class"), F.col("a").alias("hub"), "salt", F.lit(True).alias("own")).distinct()
    )
    wanted = (
        sides.groupBy("class")
        .agg(F.collect_list(F.struct("hub", "salt", "own")).alias("to"))
        .join(reps, "class")
        .select("id", "class", "to")
    )
    wanted = stored(wanted)
    # dealt by id at every size: what packs texts and what cuts them never run in one stage
    texts = asked_texts(docs, wanted).repartition("id").join(wanted, "id")
    order = docs.sparkSession.sparkContext.broadcast((levels, pivots_of(levels, FRAGMENTS)))

    def spread(batches):
        level, pivots = order.value
        for batch in batches:
            for whole in slices(batch, "packed", SLICE_BYTES // 8):
                texts = pa.array([zstandard.decompress(x.as_py()).decode() for x in whole.column("packed")], pa.large_string())
                whole = pa.RecordBatch.from_arrays([texts, whole.column("class"), whole.column("to")], ["text", "class", "to"])
                for part in slices(whole, "text", SLICE_BYTES // 4):
                    rows = []
                    for s, name, to in zip(shingle_sets(part.column("text")), part.column("class").to_pylist(), part.column("to").to_pylist(), strict=True):
                        if _class_of(s) != name:  # a repeated id with another text
                            continue
                        fragment = np.searchsorted(pivots, _ordered(s, level), "right")
                        for f in range(FRAGMENTS):
                            packed = _moved(s[fragment == f])
                            rows += [(t["hub"], t["salt"], f, None if t["own"] else name, packed, len(s)) for t in to]
                    if rows:
                        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                            ["hub", "salt", "fragment", "class", "shingles", "n"],
                        )

    def overlap(rows: pa.Table) -> pa.Table:
        hub, out = None, []
        sets = [_arrived(x) for x in rows.column("shingles").to_pylist()]
        names, sizes = rows.column("class").to_pylist(), rows.column("n").to_pylist()
        for s, name, n in zip(sets, names, sizes, strict=True):
            if name is None:
                hub = (s, n)
        first = rows.column("hub")[0].as_py()
        seen = set()
        for s, name, n in zip(sets, names, sizes, strict=True):
            if name is not None and hub is not None and name not in seen:
                seen.add(name)
                at = np.searchsorted(hub[0], s)
                at[at == len(hub[0])] = 0
                common = int((hub[0][at] == s).sum()) if len(hub[0]) else 0
                out.append((first, name, common, n + hub[1]))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "common", "total"])

    partial = (
        texts.select("packed", "class", "to")
        .mapInArrow(spread, "hub long, salt int, fragment int, class long, shingles binary, n long")
        .groupBy("hub", "salt", "fragment")
        .applyInArrow(overlap, "a long, b long, common long, total long")
    )
    return (
        partial.groupBy("a", "b")
        .agg(F.sum("common").alias("common"), F.max("total").alias("total"))
        .where(f"100 * common >= {THRESHOLD} * (total - common)")
    )


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, at = row[shared[at]], number[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(shared.sum()), LINK_CHUNK):
        a, b = np.searchsorted(at, [low, low + LINK_CHUNK])
        held = np.zeros((len(sets), LINK_CHUNK), np.float32)
        held[row[a:b], at[a:b] - low] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def link_counts(members: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """(class, n_links): with how many other classes each one of ``members`` (class, id, root) links.

    All pairs of a component are compared.  Its classes are cut into blocks, and each two
    blocks meet in a group of their own, which returns a count for each class, not the pairs.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("k"))
    two = members.join(sizes.where("k = 2"), "root").select("class", F.lit(1).cast("long").alias("n_links"))
    dealt = (
        members.join(sizes.where("k > 2"), "root")
        .withColumn("blocks", F.ceil(F.col("k") / LINK_BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("with", F.expr("sequence(0, blocks - 1)"))
        .select("id", "class", "root", "block", "with")
    )
    wanted = stored(dealt)
    # dealt by id at every size: what packs texts and what cuts them never run in one stage
    texts = asked_texts(docs, wanted).repartition("id").join(wanted, "id")
    met = texts.withColumn("with", F.explode("with")).select(
        F.pmod(F.xxhash64("root", F.least("block", "with"), F.greatest("block", "with")), F.lit(4 * parts)).cast("int").alias("part"),
        "root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "class", "packed",
    )

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("root", "lo", "hi", "class")])
        root, lo, hi, block, name = (rows.column(c).to_numpy() for c in ("root", "lo", "hi", "block", "class"))
        key = np.column_stack([root, lo, hi])
        bounds = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])), len(key))
        names, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            packed = rows.column("packed").slice(first, last - first)
            texts = pa.array([zstandard.decompress(x.as_py()).decode() for x in packed], pa.large_string())
            seen, own, sets = set(), [], []
            for part in slices(pa.RecordBatch.from_arrays([texts, pa.array(range(first, last))], ["text", "at"]), "text", SLICE_BYTES // 4):
                for s, at in zip(shingle_sets(part.column("text")), part.column("at").to_pylist(), strict=True):
                    # a repeated id may have another text, or the same again
                    if name[at] not in seen and _class_of(s) == name[at]:
                        seen.add(name[at])
                        own.append(at)
                        sets.append(s)
            if len(sets) < 2:
                continue
            n = np.array([len(s) for s in sets])
            common = _overlaps(sets)
            linked = 100 * common >= THRESHOLD * (n[:, None] + n[None, :] - common)
            np.fill_diagonal(linked, False)
            if lo[first] != hi[first]:
                linked &= block[own][:, None] != block[own][None, :]
            names.append(name[own])
            links.append(linked.sum(1))
        return pa.Table.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(links))], names=["class", "n_links"])

    found = met.groupBy("part").applyInArrow(count, "class long, n_links long")
    return two.unionAll(found.groupBy("class").agg(F.sum("n_links").alias("n_links")))


def resolved(docs: DataFrame, counted: bool = True) -> DataFrame:
    """(doc_id, th, n_shingles, class, root, n_links, component_id) of every row: ``th`` is the hash of its text, ``root`` names its component."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row without doc_id is found again by its text
    docs = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), "text"
    )
    profile = stored(profiled(docs))
    rows = profile.where("block IS NULL").select("doc_id", "th", "id", "n", "class")
    reps = stored(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("id").alias("id"), F.max("n").alias("n")))
    levels = levels_of(profile)
    shingles = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    able = stored(able_to_link(docs, max(parts, shingles // MEET_TOKENS + 1)).join(reps, "class").select("id", "class"))
    prefixes = stored(_prefixes(docs, levels, able, parts))
    shared = stored(_shared(prefixes))
    sizes = prefixes.where("part IS NULL").select("class", "sizes").dropDuplicates(["class"])

    # the hub of a token is the class that shares most tokens: of edited copies, the text they were made from
    degree = shared.groupBy("class").agg(F.count("*").alias("degree"))
    hubs = (
        shared.join(degree, "class").groupBy("token").agg(F.max(F.struct("degree", "class", "n")).alias("hub")).select("token", "hub")
    )
    first = (
        shared.join(hubs, "token")
        .select(F.col("hub.class").alias("a"), F.col("class").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
        .where("a <> b")
        .where(_near("na", "nb"))
        .groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .agg(F.min(F.struct("a", "b")).alias("pair"))
        .select("pair.a", "pair.b", "lo", "hi")
    )
    tried = stored(first)
    first = tried.select("a", "b")
    links = stored(verified(first, docs, reps, levels))
    roots = stored(components(links.select("a", "b")))
    # what shares a shingle but not yet a component
    placed = shared.join(roots, F.col("class") == F.col("node"), "left").select(
        "token", "class", "n", F.coalesce("root", "class").alias("root")
    )
    open_tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    placed = stored(placed.join(open_tokens, "token"))
    tested = tried.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    rest = possible_pairs(placed, sizes, parts).join(tested, ["a", "b"], "left_anti")
    links = links.unionAll(stored(verified(stored(rest), docs, reps, levels)))
    roots = components(links.select("a", "b"))
    named = stored(
        reps.join(roots, F.col("class") == F.col("node"), "left")
        .select("class", "id", "doc_id", F.coalesce("root", "class").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    counts = link_counts(named.select("class", "id", "root"), docs, parts) if counted else spark.createDataFrame([], "class long, n_links long")
    named = stored(
        named.join(smallest, "root").join(counts, "class", "left").select("class", "root", "component_id", "n_links")
    )
    return rows.join(named, "class", "left").select(
        "doc_id",
        "th",
        F.col("n").alias("n_shingles"),
        "class",
        "root",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )

def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, n_links, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links; ``n_links`` is the
    number of other classes that the row's class links with: all of
    them.  Texts without words link with nothing.  Rows with equal sets are in one
    component; a null doc_id takes part but never names one if another can.
    """
    return resolved(docs).select("doc_id", "n_shingles", "class", "n_links", "component_id")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null is larger than any other), then the smallest hash of its text.

    Rows without words are in no component and all stay.
    """
    found = resolved(docs, counted=False)
    apart = found.where("n_shingles = 0").select("doc_id", "th", F.lit(False).alias("__one")).distinct()
    least = (
        found.where("n_shingles > 0").groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("kept"))
        .select("kept.doc_id", "kept.th", F.lit(True).alias("__one"))
    )
    kept = stored(apart.unionAll(least).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("th").alias("__th"), "__one"))
    id_ = F.col("doc_id").cast("long")
    keys = ["__id", "__none", "__th"]
    rows = docs.withColumns({"__id": F.coalesce(id_, F.lit(NO_ID)), "__none": id_.isNull(), "__th": F.xxhash64("text")}).join(kept, keys)
    # of rows with one doc_id and text, one
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__id"))
    return rows.withColumn("__nth", nth).where("NOT __one OR __nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_jaccard_vertical(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their set and their component."""
    return jaccard_components(table(spark, sf_dir, "documents"))


_ORACLE = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts)),
sizes AS (SELECT t.doc_id, count(s) AS n FROM texts t LEFT JOIN shingles USING (doc_id) GROUP BY t.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM texts UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b)
SELECT s.doc_id, s.n AS n_shingles, r.root AS component_id FROM sizes s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = s.doc_id"""


def op1_digest(spark, sf_dir: str) -> DataFrame:
    return op1_jaccard_vertical(spark, sf_dir).select("doc_id", "n_shingles", "component_id")


def op1_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """``op1_jaccard_vertical`` with each row's class and its number of links; class and n_links have no twin in SQL."""
    return op1_jaccard_vertical(spark, sf_dir)


QUERIES = {"op1_jaccard_vertical": op1_digest, "op1_jaccard_links": op1_jaccard_links}
ORACLE_SQL = {"op1_jaccard_vertical": _ORACLE}
