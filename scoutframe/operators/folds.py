"""Fits of all expanding folds at once, from sums that merge.

A fold trains on all years before its test year.  Every row becomes a vector of
its features (0 where missing), of flags that say what is missing, of its
position, and a 1.  One scan sums the products of these vectors by year; sums of
years give the sums of every fold.  Imputing by a fold's medians, centring and
scaling are linear in that vector, so ridge solutions follow from the sums alone.
Logistic fits take Newton steps: each is one scan, in which every row adds to the
gradients and curvatures of all folds that train on it.

Tasks give one row of sums for each year or fold, which merge in groups of ``MERGE`` until
one is left; the driver holds a few small matrices a fold, whatever the number of rows.
A fitted fold is a row of a table, so scoring is a join and an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators.quantiles import from_counts
from scoutframe.sources.sinks import stored

LEVELS = ("G", "F", "C", "UNKNOWN")
#: Rows of sums that one task merges.
MERGE = 64
PARAMETERS = (
    "names array<string>, medians array<double>, means array<double>, scales array<double>, coefficients array<double>,"
    " levels array<double>, intercept double, n_train long"
)


def fold_years(years: list[int], first_test: int, held_out: tuple[int, ...] = ()) -> dict[int, list[int]]:
    """Test year to its training years: all earlier ones; a year without earlier ones is no test year, a held-out one is in no fold."""
    years = sorted(set(years) - set(held_out))
    return {t: [y for y in years if y < t] for t in years if t >= first_test and years[0] < t}


@dataclass
class Fit:
    """What scores a row: medians, centres and scales of the training rows, and weights on the target's own scale."""

    names: list[str]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    levels: np.ndarray
    intercept: float
    n_train: int

    def row(self) -> tuple:
        return (self.names, *(x.tolist() for x in (self.medians, self.means, self.scales, self.coefficients, self.levels)), float(self.intercept), self.n_train)


def _merged(partial: DataFrame, key: str, pieces: int) -> dict[int, np.ndarray]:
    """Sums by key of (key, piece, sums): rows of binary doubles merge ``MERGE`` at a time until one for each key is left."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
        return pa.Table.from_arrays([rows.column(key).slice(0, 1), pa.array([rows.column("piece")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[key, "piece", "sums"])

    while True:
        pieces = -(-pieces // MERGE)
        partial = partial.withColumn("piece", (F.col("piece") / MERGE).cast("int"))
        partial = partial.groupBy(key, "piece").applyInArrow(add, f"{key} int, piece int, sums binary")
        if pieces <= 1:
            return {r[0]: np.frombuffer(r[2]).copy() for r in partial.collect()}


@dataclass
class Rows:
    """Typed rows of a fit, written once and read by every pass: year, features as one array, position, target."""

    df: DataFrame
    names: list[str]
    width: int = field(init=False)

    def __post_init__(self):
        self.width = 2 * len(self.names) + len(LEVELS) + 1

    @staticmethod
    def of(df: DataFrame, names: list[str], year: str, target: str, position: str | None = None) -> "Rows":
        """Rows with a target; values that are no finite number are missing, a position that is no level is UNKNOWN."""
        label = F.coalesce(F.col(position), F.lit("UNKNOWN")) if position else F.lit(None).cast("string")
        label = F.when(label.isin(*LEVELS), label).otherwise("UNKNOWN") if position else label
        x = F.array(*[X.num(n) for n in names])
        typed = df.select(F.col(year).cast("int").alias("year"), x.alias("x"), label.alias("level"), X.num(target).alias("y"))
        return Rows(stored(typed.where("year IS NOT NULL AND y IS NOT NULL")), names)

    def summed(self, sums_of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """Sums over all rows of what ``sums_of`` (years, vectors, targets) gives for a batch, by its keys."""
        p, width = len(self.names), self.width

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p).astype(np.float64)
                there = ~np.isnan(x)
                v = np.zeros((len(x), width))
                v[:, :p], v[:, p : 2 * p] = np.where(there, x, 0.0), ~there
                for k, name in enumerate(LEVELS):
                    v[:, 2 * p + k] = pc.equal(batch.column("level"), name).fill_null(False).to_numpy(zero_copy_only=False)
                v[:, -1] = 1.0
                for key, s in sums_of(batch.column("year").to_numpy(zero_copy_only=False), v, batch.column("y").to_numpy(zero_copy_only=False)).items():
                    total[key] = total[key] + s if key in total else s
            if total:
                piece = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.int32()), pa.array([piece] * len(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["key", "piece", "sums"]
                )

        pieces = self.df.rdd.getNumPartitions()
        return _merged(self.df.mapInArrow(run, "key int, piece int, sums binary"), "key", pieces)

    def medians(self, folds: dict[int, list[int]]) -> dict[int, np.ndarray]:
        """True medians of each feature over each fold's training rows; 0 where it is always missing."""
        named = self.df.select("year", F.posexplode("x").alias("j", "v")).where("v IS NOT NULL")
        # values become counts by year before they are told to folds
        counts = named.groupBy("year", "j", "v").agg(F.count("*").alias("c"))
        told = counts.withColumn("fold", F.explode(F.array(*[F.lit(t) for t in folds]))).where("year < fold")
        told = told.groupBy("fold", "j", "v").agg(F.sum("c").alias("n"))
        out = {t: np.zeros(len(self.names)) for t in folds}
        for r in from_counts(told, ["fold", "j"], "v", [0.5]).collect():  # a number for each fold and feature
            out[r.fold][r.j] = r.quantiles[0]
        return out


def _shape(p: int, medians: np.ndarray, total: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, means, scales): ``T @ vector`` is the row as the fit sees it: imputed, centred and scaled features, then levels.

    ``total``: sums of products of the vectors of the training rows.
    """
    width = len(total)
    impute = np.zeros((p, width))
    impute[:, :p], impute[:, p : 2 * p] = np.eye(p), np.diag(medians)
    means = impute @ total[:, -1] / n
    centred = impute.copy()
    centred[:, -1] -= means
    spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", centred, total, centred) / n, 0.0))
    # what rounding leaves of a constant feature is no spread
    scales = np.where(spread > 1e-9 * np.maximum(np.abs(means), 1.0), spread, 1.0)
    shaped = np.zeros((p + len(LEVELS), width))
    shaped[:p] = centred / scales[:, None]
    shaped[p:, 2 * p : 2 * p + len(LEVELS)] = np.eye(len(LEVELS))
    return shaped, means, scales


def _of_folds(by_year: dict[int, np.ndarray], folds: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """Sums over the training years of each fold, by one running sum; folds without rows are left out."""
    out, running, at = {}, None, 0
    years = sorted(by_year)
    for t in sorted(folds):
        while at < len(years) and years[at] < t:
            running = by_year[years[at]] if running is None else running + by_year[years[at]]
            at += 1
        if running is not None:
            out[t] = running
    return out


def ridge_folds(rows: Rows, folds: dict[int, list[int]], alpha: float = 10.0) -> dict[int, Fit]:
    """Ridge on the z-scored target of every fold: one scan for the sums of products, one for the medians."""
    p, width = len(rows.names), rows.width

    def products(year, v, y):
        both = np.column_stack([v, y])
        return {int(t): (both[year == t].T @ both[year == t]).ravel() for t in np.unique(year)}

    medians, out = rows.medians(folds), {}
    for t, flat in _of_folds(rows.summed(products), folds).items():
        sums = flat.reshape(width + 1, width + 1)
        total, n = sums[:-1, :-1], sums[-2, -2]
        shaped, means, scales = _shape(p, medians[t], total, n)
        mean = sums[-1, -2] / n
        spread = np.sqrt(max(sums[-1, -1] / n - mean**2, 0.0)) or 1.0
        # centring every column makes the intercept free of the penalty
        centres = shaped @ total[:, -1] / n
        gram = shaped @ total @ shaped.T - n * np.outer(centres, centres)
        with_target = shaped @ (sums[:-1, -1] - mean * total[:, -1]) / spread
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), with_target)
        out[t] = Fit(rows.names, medians[t], means, scales, w[:p] * spread, w[p:] * spread, (mean - spread * centres @ w), int(round(n)))
    return out


def logit_folds(rows: Rows, folds: dict[int, list[int]], c: float = 0.25, steps: int = 100, close: float = 1e-10) -> dict[int, Fit]:
    """L2 logistic regression with balanced classes of every fold (target 0 or 1): each Newton step is one scan for all folds.

    A fold whose training rows lack a class is left out.
    """
    p, width = len(rows.names), rows.width

    def products(year, v, y):
        return {int(t): np.concatenate([(v[year == t].T @ v[year == t]).ravel(), [(y[year == t] == 1).sum()]]) for t in np.unique(year)}

    medians, shapes, weights = rows.medians(folds), {}, {}
    for t, flat in _of_folds(rows.summed(products), folds).items():
        total, hits = flat[:-1].reshape(width, width), flat[-1]
        n = total[-1, -1]
        if 0 < hits < n:
            shaped, means, scales = _shape(p, medians[t], total, n)
            # the constant comes last
            shapes[t] = (np.vstack([shaped, np.eye(width)[-1]]), means, scales, n)
            weights[t] = (n / (2 * (n - hits)), n / (2 * hits))
    dims = p + len(LEVELS) + 1
    w = {t: np.zeros(dims) for t in shapes}
    open_ = set(shapes)
    penalty = np.append(np.ones(dims - 1), 0.0) / c

    def loss_sums(at: dict[int, np.ndarray]):
        def sums(year, v, y):
            out = {}
            for t, own in at.items():
                train = year < t
                z = v[train] @ shapes[t][0].T
                score = z @ own
                chance = 0.5 * (1 + np.tanh(score / 2))
                hit = y[train] == 1
                weight = np.where(hit, weights[t][1], weights[t][0])
                loss = weight * (np.logaddexp(0.0, score) - hit * score)
                curve = (z * (weight * chance * (1 - chance))[:, None]).T @ z
                out[t] = np.concatenate([[loss.sum()], z.T @ (weight * (chance - hit)), curve.ravel()])
            return out

        return sums

    tried, best, step_of = dict(w), {}, {}
    for _ in range(steps):
        if not open_:
            break
        for t, s in rows.summed(loss_sums({t: tried[t] for t in open_})).items():
            value = s[0] + 0.5 * penalty @ tried[t] ** 2
            if t in best and value > best[t] * (1 + 1e-12) and np.abs(step_of[t]).max() > close:
                # too far: half the step
                step_of[t] = step_of[t] / 2
                tried[t] = w[t] + step_of[t]
                continue
            w[t], best[t] = tried[t], value
            gradient, curve = s[1 : 1 + dims] + penalty * w[t], s[1 + dims :].reshape(dims, dims) + np.diag(penalty)
            # a level that no row has leaves its weight at 0
            step_of[t] = -np.linalg.solve(curve, gradient)
            if np.abs(step_of[t]).max() <= close:
                open_.discard(t)
            tried[t] = w[t] + step_of[t]
    if open_:
        raise ArithmeticError(f"no optimum within {steps} steps: {sorted(open_)}")
    return {t: Fit(rows.names, medians[t], shapes[t][1], shapes[t][2], w[t][:p], w[t][p:-1], w[t][-1], int(round(shapes[t][3]))) for t in shapes}


def parameters(spark, fits: dict[int, Fit], key: str = "fold") -> DataFrame:
    """Fits as a table, one row each: what a scoring plan joins."""
    return spark.createDataFrame([(t, *fit.row()) for t, fit in sorted(fits.items())], f"{key} int, {PARAMETERS}")


def scored(df: DataFrame, table: DataFrame, key: str, names: list[str], position: str | None, into: str) -> DataFrame:
    """Adds the linear score of each row by the fit of its key, NULL without one; nobody is dropped.

    ``table``: ``parameters``, a row for each fold or class, so it is broadcast.  ``names`` are the features in the order of the fit.
    """
    x = F.array(*[X.num(n) for n in names])
    level = F.coalesce(F.col(position), F.lit("UNKNOWN")) if position else F.lit(None).cast("string")
    if position:
        level = F.when(level.isin(*LEVELS), level).otherwise("UNKNOWN")
    side = table.select(F.col(key).alias("__key"), F.struct(*[c for c in table.columns if c != key]).alias("__fit"))
    out = df.join(F.broadcast(side), F.col(key) == F.col("__key"), "left").withColumn("__x", x)
    filled = F.zip_with("__x", "__fit.medians", lambda v, m: F.coalesce(v, m))
    centred = F.zip_with(filled, "__fit.means", lambda v, u: v - u)
    # in the order in which the formula is written, so that a sum that ends on a tie of decimals rounds as there
    weighted = F.zip_with(F.zip_with("__fit.coefficients", centred, lambda w, v: w * v), "__fit.scales", lambda v, s: v / s)
    total = F.aggregate(weighted, F.col("__fit.intercept"), lambda a, b: a + b)
    by_level = F.lit(0.0)
    if position:
        by_level = F.element_at("__fit.levels", F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int"))
    return out.withColumn(into, total + by_level).drop("__key", "__fit", "__x")


def out_of_fold(df: DataFrame, fits: dict[int, Fit], year: str, position: str | None, into: str) -> DataFrame:
    """Rows of every test year with the score of its own fold; a year without a fit has none."""
    names = next(iter(fits.values())).names if fits else []
    rows = df.where(F.col(year).isin(*fits))
    return scored(rows, parameters(df.sparkSession, fits, year), year, names, position, into)
