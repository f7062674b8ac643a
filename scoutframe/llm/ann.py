"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a
small classifier (one softmax layer over the direction of a vector and its
similarities to the parts' centres) learns which part a vector belongs to.  Every
row is indexed in its most probable part.  A query visits its most probable
parts, as many as a piece of the sample that neither the parts nor the classifier
have seen needs for ``TARGET`` recall, and all rows found there are ranked by the
exact measure in double precision.

Parts are cut into blocks of about ``BLOCK`` rows and their queries into blocks of
as many, so a crowded part spreads over many tasks; every block of queries meets
every block of rows of its part.  The sample bounds how many parts can be learned, so from
some 60,000 rows parts grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm._shared import stored, table

#: Rows that the partitions are learned from, the first by a hash of vec_id.
SAMPLE = 6000
#: Sampled rows for each part at least.
PART_ROWS = 40
GRAPH_NEIGHBOURS = 10
TARGET = 0.96
#: Share of the sample that is held back to find the number of visits.
HELD_BACK = 0.2
BLOCK = 2000


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square over- or underflows; their cosines stay as they are."""
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -power[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` (scaled) with the same row of ``b``: the same bits for the same two vectors, wherever they stand."""
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row (all, where there are fewer), in blocks of rows."""
    out, k = [], min(k, len(x) - 1)
    for at in range(0, len(x), 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        out.append(np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.empty((len(sims), 0), np.int64))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row: few graph edges cut, no part larger than its share and a tenth.

    Spherical k-means seeds the parts; then each row moves to the part that holds
    most of its neighbours, those with the most to gain first, while there is room.
    """
    rng = np.random.default_rng(11)
    centres = x[rng.permutation(len(x))[:parts]].copy()
    room = int(np.ceil(1.1 * len(x) / parts))
    label = np.zeros(len(x), np.int64)
    for step in range(rounds):
        gain = x @ centres.T
        if step >= rounds // 2 and graph.shape[1]:
            votes = np.zeros((len(x), parts))
            for column in graph.T:
                votes[np.arange(len(x)), label[column]] += 1
            gain = gain + 2 * votes / graph.shape[1]
        order = np.argsort(np.partition(-gain, 1, axis=1)[:, 0] if parts > 1 else -gain[:, 0], kind="stable")
        left = np.full(parts, room)
        wish = np.argsort(-gain, axis=1, kind="stable")
        for i in order:
            for p in wish[i]:
                if left[p]:
                    label[i] = p
                    left[p] -= 1
                    break
        for p in range(parts):
            own = x[label == p]
            if len(own):
                centre = own.mean(0)
                centres[p] = centre / max(np.linalg.norm(centre), 1e-12)
    return label


def train_router(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights by full-batch gradient descent with momentum."""
    weights, bias = np.zeros((x.shape[1], parts)), np.zeros(parts)
    for p in range(parts):
        if (label == p).any():
            weights[:, p] = 10 * x[label == p].mean(0)
    pace = [np.zeros_like(weights), np.zeros_like(bias)]
    onehot = np.eye(parts)[label]
    for _ in range(steps):
        z = x @ weights + bias
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - onehot) / len(x)
        for moved, grad in zip(pace, (x.T @ error + 1e-5 * weights, error.sum(0)), strict=True):
            moved *= 0.9
            moved -= 20 * grad
        weights += pace[0]
        bias += pace[1]
    return weights, bias


class Router:
    """Part of a vector, and the parts that a query visits, most probable first."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        x = _unit(sample) if len(sample) else sample.reshape(0, 1)
        x = x[np.random.default_rng(3).permutation(len(x))]
        held = int(HELD_BACK * len(x))
        seen = x[held:]
        self.parts = int(min(max(1, len(seen) // PART_ROWS), max(1, round(rows**0.5 / 2))))
        self.visits = 1
        if self.parts == 1:
            return
        label = balanced_parts(seen, neighbour_graph(seen, GRAPH_NEIGHBOURS), self.parts)
        self.weights, self.bias = train_router(seen, label, self.parts)
        # the rows held back ask for their nearest in the whole sample
        own = self.order(x)[:, 0]
        asked = x[: max(1, held)]
        sims = asked @ x.T
        sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        place = np.argsort(self.order(asked), axis=1)
        needed = np.take_along_axis(place, own[near], axis=1)
        reached = [(needed < v).mean() for v in range(1, self.parts + 1)]
        self.visits = next(v for v, share in enumerate(reached, 1) if share >= TARGET)

    def order(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is neither null, empty, zero nor holds null or non-finite values.

    Vectors of another length than most (of equally many: than the longest) can't be compared and take no part either.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda a: a.cast("double"))
    sound = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    found = (
        rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id IS NOT NULL AND v IS NOT NULL")
        .where(sound & F.exists("v", lambda a: a != 0))
    )
    length = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.where(F.size("v") == (length.n if length else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))


def nearest(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest by cosine; both inputs are ``usable`` rows of one dimension.

    A row never answers the query of the same vec_id.  Ties go to the smaller
    vec_id; of repeated vec_ids each row is a candidate, and repeated queries of one vec_id are one question.
    Fewer candidates than ``k`` give fewer rows, an empty index none.  Scores have the same bits
    whatever the blocks: equal vectors tie.
    """
    index = stored(index)
    n = index.count()
    picked = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    router = Router(np.array([r[0] for r in picked], np.float64), n, k)
    parts, visits = router.parts, router.visits

    def route(many):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("v"))
                if not len(x):
                    continue
                to = router.order(_unit(x))[:, :many].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(x)), to.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(to.ravel())], ["vec_id", "v", "part"]
                )

        return run

    schema = "vec_id long, v array<double>, part int"
    homes, asked = stored(index.mapInArrow(route(1), schema)), stored(queries.mapInArrow(route(visits), schema))

    def blocks(rows: DataFrame):
        """How many blocks the rows of each part make: one number for each part."""
        sizes = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
        counts = F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // BLOCK))) for p in range(parts)])
        return F.element_at(counts, F.col("part") + 1)

    of_rows, of_queries = blocks(homes), blocks(asked)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    homes = homes.withColumn("block", dealt(of_rows)).withColumn("query_block", every(of_queries))
    asked = asked.withColumn("query_block", dealt(of_queries)).withColumn("block", every(of_rows))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = scaled(_matrix(left.column("v"))), scaled(_matrix(right.column("v")))
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(q) and len(c):
            ids, asking = right.column("vec_id").to_numpy(), left.column("vec_id").to_numpy()
            units, asked_units = c / np.linalg.norm(c, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
            for at in range(0, len(q), 256):
                rough = asked_units[at : at + 256] @ units.T
                rough[asking[at : at + 256, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(rough, at):
                    low = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    # what rounding could bring among the nearest is measured exactly
                    near = np.flatnonzero((row >= low - 1e-9) & (row > -np.inf))
                    score = cosines(np.broadcast_to(q[i], (len(near), q.shape[1])), c[near])
                    first = np.lexsort((ids[near], -score))[:k]
                    for into, values in zip(found, (np.full(len(first), asking[i]), ids[near][first], score[first]), strict=True):
                        into.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "score"])

    keys = ("part", "block", "query_block")
    pairs = asked.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op8_ann_learned_parts(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50, among all others."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 5)


QUERIES = {"op8_ann_learned_parts": op8_ann_learned_parts}
ORACLE_SQL: dict[str, str] = {}
