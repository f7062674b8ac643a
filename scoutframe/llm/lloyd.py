"""Product codes of vectors: one codebook for each part position, trained by the filtering variant of Lloyd's rounds.

Every component becomes the integer ``floor(1024 * x)``, so distances, sums and
ties are exact, in any order of work.  Rows are cut into blocks once; a block
builds a kd-tree over its parts of each position, whose nodes keep the bounding
box, the sum and the number of their parts, and the trees are written to the
shared folder.  A round walks every tree from its root with all entries: a box
drops the entries that none of its points can be nearest to, and where one entry
is left the whole subtree is added to it by its cached sum.  Only leaves measure
single parts, against the entries that are left there.

A round leaves one sum and count for each entry and task; they are added up by
entry, and the driver holds the codebooks alone, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._shared import stored, table

SCALE = 1024
#: Rows of a block, which one task holds with its trees.
BLOCK = 16_384
#: Parts in a leaf of a tree at most.
LEAF = 32
#: Labels up to this many have their sums broadcast; beyond it the join is salted.
LABELS = 50_000
SALTS = 16
#: Pairs of a node and an entry that are measured at a time.
PAIRS = 1 << 18


def widths(length: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part; parts are equal where ``parts`` divides ``length``, else they differ by one."""
    cuts = [k * length // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def limit(width: int) -> int:
    """Integers up to this size have exact squared distances in 64 bits, also between doubled points."""
    return math.isqrt((1 << 62) // max(width, 1)) // 8


def integers(v: np.ndarray, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` as 64-bit integers, held within ``limit(width)`` on both sides."""
    top = limit(width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v.astype(np.float64) * SCALE), -top, top).astype(np.int64)


def exact_kind(x: np.ndarray, book: np.ndarray) -> type:
    """Doubles where they hold every value that comes up exactly (products are then quick), else 64-bit integers."""
    top = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    return np.float64 if x.shape[1] * (8 * top) ** 2 < 1 << 53 else np.int64


def _halvings(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin among ``n`` points (and the end): nodes are halved until none has more than ``LEAF``."""
    levels = [np.array([0, n])]
    while np.diff(cuts := levels[-1]).max() > LEAF:
        levels.append(np.append(np.stack([cuts[:-1], (cuts[:-1] + cuts[1:]) // 2], 1).ravel(), n))
    return levels


@dataclass
class Tree:
    """A kd-tree: ``order`` sorts the points; of each level, ``levels`` has where nodes begin in that order, and the rest is kept for each node."""

    order: np.ndarray
    levels: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def build(x: np.ndarray) -> "Tree":
        """Nodes are halved across the widest side of their box."""
        tree = Tree(np.arange(len(x)), _halvings(len(x)), [], [], [])
        for k, cuts in enumerate(tree.levels):
            own = x[tree.order]
            tree.low.append(np.minimum.reduceat(own, cuts[:-1]))
            tree.high.append(np.maximum.reduceat(own, cuts[:-1]))
            tree.sums.append(np.add.reduceat(own, cuts[:-1]))
            if k + 1 < len(tree.levels):
                node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                across = own[np.arange(len(x)), (tree.high[k] - tree.low[k]).argmax(1)[node]]
                tree.order = tree.order[np.lexsort((across, node))]
        return tree

    def packed(self) -> bytes:
        """Order, boxes and sums, one after another."""
        return b"".join([self.order.astype(np.int32).tobytes(), *(np.concatenate(c).astype(k).tobytes() for c, k in ((self.low, "i4"), (self.high, "i4"), (self.sums, "i8")))])

    @staticmethod
    def unpacked(data: bytes, n: int, width: int) -> "Tree":
        levels = _halvings(n)
        nodes = np.cumsum([len(cuts) - 1 for cuts in levels])
        at, kept = 4 * n, []
        for kind in ("i4", "i4", "i8"):
            whole = np.frombuffer(data, kind, nodes[-1] * width, at).reshape(-1, width)
            at += whole.nbytes
            kept.append(np.split(whole, nodes[:-1]))
        return Tree(np.frombuffer(data, np.int32, n), levels, *kept)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of each row of ``x`` with the same row of ``y``."""
    return np.einsum("ij,ij->i", x, y)


def _left(low: np.ndarray, high: np.ndarray, node: np.ndarray, entry: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which pairs (node, entry), sorted by both, stay: those whose entry may be nearest to a point of the node's box.

    Against the entry nearest to the middle of the box, the corner that favours
    an entry most is looked at.  An entry that is no nearer there is no nearer to
    any point of the box; where it is as near, ties go to the lower index.
    """
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
    z, norm = book[entry], _dots(book, book)
    middle = (low + high)[node]
    # four times the distance to the middle, but for what is the same for all entries of a node
    far = norm[entry] - _dots(z, middle)
    least = np.minimum.reduceat(far, first)
    # pairs are sorted by entry within a node: the first of the nearest has the lowest index
    hit = np.flatnonzero(far == least[run])
    best = entry[hit[np.searchsorted(run[hit], np.arange(len(first)))]]
    rival = best[run]
    # by how much the rival is farther from the corner where z is ahead most
    ahead = z - book[rival]
    gain = norm[rival] - norm[entry] + _dots(ahead, middle)
    gain += _dots(np.abs(ahead, out=ahead), (high - low)[node])
    return (gain > 0) | ((gain == 0) & (entry <= rival))


def assign(x: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Nearest entry of each row of ``x`` (ties: lowest index), sums and counts by entry, and the share of rows that whole subtrees took."""
    kind = exact_kind(x, book)
    own, centres = x[tree.order].astype(kind), book.astype(kind)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    code = np.full(len(x), -1, np.int64)
    node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
    for level, cuts in enumerate(tree.levels):
        low, high = tree.low[level].astype(kind), tree.high[level].astype(kind)
        # blocks of pairs end where a node ends
        ends = np.flatnonzero(np.concatenate([node[1:] != node[:-1], [True]])) + 1
        keep, at = [], 0
        while at < len(node):
            to = int(ends[max(np.searchsorted(ends, at + PAIRS, "right") - 1, np.searchsorted(ends, at, "right"))])
            keep.append(_left(low, high, node[at:to], entry[at:to], centres))
            at = to
        if keep:
            keep = np.concatenate(keep)
            node, entry = node[keep], entry[keep]
        many = np.bincount(node, minlength=len(cuts) - 1)
        alone = many[node] == 1
        if alone.any():
            done, to = node[alone], entry[alone]
            np.add.at(sums, to, tree.sums[level][done])
            np.add.at(counts, to, np.diff(cuts)[done])
            for a, b, e in zip(cuts[done].tolist(), cuts[done + 1].tolist(), to.tolist(), strict=True):
                code[a:b] = e
            node, entry = node[~alone], entry[~alone]
        if level + 1 < len(tree.levels):
            # both halves of a node take over its entries
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(node)))
            of = np.repeat(np.arange(len(first)), 2 * size)
            at = np.arange(2 * len(node)) - np.repeat(2 * first, 2 * size)
            half = at >= size[of]
            entry = entry[first[of] + at - half * size[of]]
            node = 2 * node[first[of]] + half
    whole = float((code >= 0).mean()) if len(x) else 0.0
    cuts, norms = tree.levels[-1], _dots(centres, centres)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first, len(node))[1:].tolist(), strict=True):
        left, points = entry[a:b], slice(cuts[node[a]], cuts[node[a] + 1])
        # |p - z|^2 without |p|^2, which is the same for all entries
        code[points] = left[(norms[left] - 2 * (own[points] @ centres[left].T)).argmin(1)]
        np.add.at(sums, code[points], own[points].astype(np.int64))
        counts += np.bincount(code[points], minlength=len(book))
    out = np.empty(len(x), np.int64)
    out[tree.order] = code
    return out, sums, counts, whole


def sound_vectors(rows: DataFrame, id_col: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, label, v array<double>) of the rows whose vector is not null and holds neither null nor non-finite components.

    Empty vectors, and vectors of another length than most (of equally many: than the longest), take no part.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda a: a.cast("double"))
    found = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), v.alias("v")
    ).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))))
    length = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.where(F.size("v") == (length.n if length else 0))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def grown_trees(rows: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """One row a block, written: vec_ids, labels, the integers of all rows (``x``) and one tree for each part position."""
    kind = dict(rows.dtypes)["label"]
    length, width = spans[-1][1], max(b - a for a, b in spans)

    def grow(batches):
        held, n = [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks()
            x = integers(_matrix(whole.column("v").chunk(0), length), width)
            trees = [Tree.build(np.ascontiguousarray(x[:, a:b])).packed() for a, b in spans]
            ids, labels = (whole.column(c).chunk(0) for c in ("vec_id", "label"))
            one = pa.array([0, len(x)], pa.int32())
            columns = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([x.astype(np.int32).tobytes()]), pa.array([trees])]
            return pa.RecordBatch.from_arrays(columns, ["vec_ids", "labels", "x", "trees"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return stored(rows.mapInArrow(grow, f"vec_ids array<long>, labels array<{kind}>, x binary, trees array<binary>"))


def _blocks(batch: pa.RecordBatch, spans: list[tuple[int, int]]):
    """Of each row of a batch of trees: its number, and integers and tree of each part."""
    for k in range(batch.num_rows):
        x = np.frombuffer(batch.column("x")[k].as_buffer(), np.int32).reshape(-1, spans[-1][1]).astype(np.int64)
        yield k, [(np.ascontiguousarray(x[:, a:b]), Tree.unpacked(t.as_py(), len(x), b - a)) for (a, b), t in zip(spans, batch.column("trees")[k], strict=True)]


def moved(trees: DataFrame, spans: list[tuple[int, int]], books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floor of the mean of its parts; an entry without parts stays."""
    width = max(b - a for a, b in spans)

    def run(batches):
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, parts in _blocks(batch, spans):
                for p, (x, tree) in enumerate(parts):
                    _, s, c, _ = assign(x, tree, books[p])
                    sums[p] += s
                    counts[p] += c
        out = [(p, e, int(c[e]), s[e].tolist() + [0] * (width - s.shape[1])) for p, (s, c) in enumerate(zip(sums, counts, strict=True)) for e in np.flatnonzero(c).tolist()]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "entry", "n", "s"])

    found = trees.mapInArrow(run, "part int, entry int, n long, s array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(width)]).alias("s"))
    books = [b.copy() for b in books]
    # one row for each entry: as many as the codebooks have
    for r in total.collect():
        at = books[r.part]
        at[r.entry] = [s // r.n for s in r.s[: at.shape[1]]]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes array<int>, error long), codebooks): codes of every sound vector, one row a row.

    The codebooks begin as the parts of the ``entries`` smallest vec_ids (a null
    one is largest; of one vec_id, the smaller vector first).  Fewer rows give
    fewer entries, no rows an empty result and no codebooks.  Repeated rows each
    have a code.  Components beyond ``limit`` (for 16 of a part: 65,536) count as
    that limit.  Other columns, whatever their names, take no part.
    """
    spark = rows.sparkSession
    sound = stored(sound_vectors(rows, id_col, vector, label))
    kind = dict(sound.dtypes)["label"]
    firsts = sound.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not firsts:
        return spark.createDataFrame([], f"vec_id long, label {kind}, codes array<int>, error long"), []
    length = len(firsts[0].v)
    spans = widths(length, min(parts, length))
    begin = integers(np.array([r.v for r in firsts]), max(b - a for a, b in spans))
    books = [np.ascontiguousarray(begin[:, a:b]) for a, b in spans]
    trees = grown_trees(sound, spans)
    for _ in range(rounds):
        books = moved(trees, spans, books)

    def run(batches):
        for batch in batches:
            for k, own in _blocks(batch, spans):
                codes = np.stack([assign(x, tree, book)[0] for (x, tree), book in zip(own, books, strict=True)], 1)
                error = sum(((x - book[codes[:, p]]) ** 2).sum(1) for p, ((x, _), book) in enumerate(zip(own, books, strict=True)))
                cut = pa.array(np.arange(0, codes.size + 1, len(spans), dtype=np.int32))
                columns = [batch.column("vec_ids")[k].values, batch.column("labels")[k].values, pa.ListArray.from_arrays(cut, pa.array(codes.ravel().astype(np.int32))), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "error"])

    return stored(trees.mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over equal labels, nulls together, held within 64 bits."""
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    totals = stored(totals)
    if totals.count() <= LABELS:
        # at most LABELS rows
        return coded.join(F.broadcast(totals), coded.label.eqNullSafe(totals.label), "left").drop(totals.label)
    salted = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left").drop("of", "salt", "salt_of")


def op11_filtering_lloyd(spark, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the codebooks of all embeddings."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES = {"op11_filtering_lloyd": op11_filtering_lloyd}
ORACLE_SQL: dict[str, str] = {}
