"""Fits on MLlib with imputation and scaling by the training rows, and inference as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X

POSITIONS = ("G", "F", "C")


@dataclass
class Prepared:
    names: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]

    def columns(self) -> list[Column]:
        """Imputed and scaled columns; a spread of 0 divides by 1."""
        return [(F.coalesce(F.col(n), F.lit(m)) - u) / (s or 1.0) for n, m, u, s in zip(self.names, self.medians, self.means, self.scales, strict=True)]


def prepare(train: DataFrame, names: list[str]) -> Prepared:
    """True medians, then mean and population deviation of the imputed columns: two passes, one row each."""
    row = train.agg(*[F.percentile(n, 0.5).alias(n) for n in names]).first()
    medians = [float(row[n]) if row[n] is not None else 0.0 for n in names]
    filled = [F.coalesce(F.col(n), F.lit(m)) for n, m in zip(names, medians, strict=True)]
    row = train.agg(*[F.avg(c).alias(f"u{k}") for k, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(filled)]).first()
    n = range(len(names))
    return Prepared(names, medians, [row[f"u{k}"] or 0.0 for k in n], [row[f"s{k}"] or 0.0 for k in n])


def _assembled(df: DataFrame, prepared: Prepared, position: str | None) -> DataFrame:
    cols = prepared.columns() + ([(F.col(position) == p).cast("double") for p in POSITIONS] if position else [])
    out = df.withColumns({f"__f{k}": F.coalesce(c, F.lit(0.0)) for k, c in enumerate(cols)})
    return VectorAssembler(inputCols=[f"__f{k}" for k in range(len(cols))], outputCol="features").transform(out)


@dataclass
class Linear:
    prepared: Prepared
    coefficients: list[float]
    intercept: float
    position: str | None

    def score(self) -> Column:
        """The linear score as one expression: no model object at inference."""
        cols = self.prepared.columns() + ([F.coalesce((F.col(self.position) == p).cast("double"), F.lit(0.0)) for p in POSITIONS] if self.position else [])
        return X.dot(cols, self.coefficients, self.intercept)


def fit_chance(train: DataFrame, names: list[str], label: str, position: str | None = None, c: float = 0.25) -> Linear:
    """L2 logistic regression with balanced classes; the penalty is 1 / c over the summed weights."""
    prepared = prepare(train, names)
    n, pos = train.agg(F.count("*"), F.sum(label)).first()
    if not pos or pos == n:
        raise ValueError("both labels are needed")
    weighted = _assembled(train, prepared, position).withColumn("__w", F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    model = LogisticRegression(labelCol=label, weightCol="__w", standardization=False, elasticNetParam=0.0, regParam=1 / (c * n), maxIter=500, tol=1e-10).fit(weighted)
    return Linear(prepared, [float(x) for x in model.coefficients], float(model.intercept), position)


def fit_order(train: DataFrame, names: list[str], target: str, position: str | None = None, alpha: float = 10.0) -> Linear:
    """Ridge on the z-scored target; the score is back on the target's scale."""
    prepared = prepare(train, names)
    n, u, s = train.agg(F.count("*"), F.avg(target), F.stddev_pop(target)).first()
    s = s or 1.0
    rows = _assembled(train, prepared, position).withColumn("__z", (F.col(target) - u) / s)
    model = LinearRegression(labelCol="__z", solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n).fit(rows)
    return Linear(prepared, [float(x) * s for x in model.coefficients], float(model.intercept) * s + u, position)


def to_target(pick: Column, size: Column, kind: str) -> Column:
    return {"raw": pick, "log": F.ln(pick), "percentile": (pick - 1) / (size - 1), "value": (size + 1 - pick) / size}[kind]


def from_target(t: Column, size: Column, kind: str) -> Column:
    return {"raw": t, "log": F.exp(t), "percentile": t * (size - 1) + 1, "value": size + 1 - t * size}[kind]


def folds(years: list[int], first_test: int) -> list[tuple[list[int], int]]:
    """Expanding window: all earlier years train, the next one tests."""
    years = sorted(set(years))
    return [([y for y in years if y < t], t) for t in years if t >= first_test and any(y < t for y in years)]
