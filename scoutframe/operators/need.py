"""Team need: dimensions from peer percentiles, archetypes, weighted fits and their reasons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators.rank import numbered, top_columns

#: Attempts below which a shooting percentage says nothing.
LEAST_ATTEMPTS = 20
LOWER_IS_BETTER = ("tov_pct",)


class UnsupportedNeed(ValueError):
    """Weights that can't be scored."""


def reliable(percentile: Column, attempts: Column, least: int = LEAST_ATTEMPTS) -> Column:
    return F.when(attempts >= least, percentile)


def oriented(metric: str, percentile: Column) -> Column:
    return 100 - percentile if metric in LOWER_IS_BETTER else percentile


def dimensions(df: DataFrame, parts: dict[str, list[str]], share: float = 0.5) -> DataFrame:
    """Adds each dimension (mean of its components, NULL with fewer than half), its coverage, and ``data_coverage``."""
    out = {}
    for name, columns in parts.items():
        cols = [F.col(c) for c in columns]
        count = X.row_count(*cols)
        out[name] = F.when(count >= math.ceil(share * len(columns)), X.row_mean(*cols))
        out[f"{name}_coverage"] = count / len(columns)
    df = df.withColumns(out)
    return df.withColumn("data_coverage", X.row_mean(*[F.col(f"{n}_coverage") for n in parts]))


def eligibility(position: Column, allowed: tuple[str, ...]) -> Column:
    return (
        F.when(position.isNull() | (position == "UNKNOWN"), "UNKNOWN_POSITION")
        .when(position.isin(*allowed), "ELIGIBLE")
        .otherwise("OUT_OF_POSITION")
    )


def archetype(pillars: list[Column]) -> Column:
    """One pillar as it is, several as their geometric mean; NULL unless all are there."""
    return pillars[0] if len(pillars) == 1 else X.geo_mean(*pillars)


def check_weights(weights: dict[str, float], known: tuple[str, ...], unsupported: tuple[str, ...] = ("athleticism",)) -> None:
    if not weights:
        raise UnsupportedNeed("no weights")
    for name, w in weights.items():
        if name in unsupported and w > 0:
            raise UnsupportedNeed(f"{name} is not measured")
        if name not in known and name not in unsupported:
            raise UnsupportedNeed(f"unknown dimension {name}")
        if not w >= 0:
            raise UnsupportedNeed(f"weight of {name} is negative")
    if not any(w > 0 for w in weights.values()):
        raise UnsupportedNeed("all weights are zero")


def custom_fit(df: DataFrame, weights: dict[str, float], known: tuple[str, ...]) -> DataFrame:
    """Adds fit_raw, fit_status and fit_score; NULL and UNAVAILABLE below half of the weight."""
    check_weights(weights, known)
    used = {k: w for k, w in weights.items() if w > 0}
    df = df.withColumn("fit_raw", X.weighted_mean([F.col(k) for k in used], list(used.values())))
    return with_score(df)


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("fit_status", F.when(F.col("fit_raw").isNull(), "UNAVAILABLE").otherwise("OK")).withColumn(
        "fit_score", X.half_even(X.clamp(F.col("fit_raw"), 0.0, 100.0))
    )


def rank_fit(df: DataFrame, keys: list[str], ident: str, eligible: str | None = None) -> DataFrame:
    """Adds ``fit_rank``: missing fits last, then those out of position (an unknown position is in none), then by the unrounded fit."""
    order = [F.col("fit_raw").isNull()]
    if eligible:
        order.append((F.col(eligible) == "OUT_OF_POSITION").cast("int"))
    return numbered(df, keys, [*order, F.col("fit_raw").desc_nulls_last(), F.col(ident)], "fit_rank")


def explained(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds the two best metrics from 60 up, the two worst up to 40, and what is missing."""
    scores = [(m, F.col(m)) for m in metrics]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]), lambda m: m.isNotNull()), ",")
    return df.withColumns(
        {"strengths": top_columns(scores, 2, least=60), "limiters": top_columns(scores, 2, most=40), "missing": missing}
    )
