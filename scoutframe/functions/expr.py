"""Column builders: rates, clamps, means, interpolation, distances.  Undefined is NULL, never 0 and never infinite."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"
#: Fixed value: weight of a free-throw attempt in possessions.
FT_WEIGHT = 0.44


def num(c) -> Column:
    """Numeric or NULL; text that is no number, NaN and infinities are NULL."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast(D)
    return F.when(F.abs(x) < float("inf"), x)


def to_id(c: Column) -> Column:
    """Whole-number id from any numeric or text form."""
    return c.try_cast(D).try_cast("bigint")


def safe_div(a: Column, b: Column) -> Column:
    """a / b where b is positive, else NULL."""
    return F.when(b > 0, a / b)


def per_game(total: Column, games: Column) -> Column:
    return safe_div(total, games)


def per_40(total: Column, minutes: Column) -> Column:
    return safe_div(40 * total, minutes)


def per_100(total: Column, possessions: Column) -> Column:
    return safe_div(100 * total, possessions)


def possessions(fga: Column, fta: Column, oreb: Column, tov: Column) -> Column:
    return fga + F.lit(FT_WEIGHT) * fta - oreb + tov


def efg(fgm: Column, tpm: Column, fga: Column) -> Column:
    return safe_div(fgm + 0.5 * tpm, fga)


def true_shooting(points: Column, fga: Column, fta: Column) -> Column:
    return safe_div(points, 2 * (fga + F.lit(FT_WEIGHT) * fta))


def usage(fga, fta, tov, mp, team_mp, team_fga, team_fta, team_tov) -> Column:
    own = fga + F.lit(FT_WEIGHT) * fta + tov
    team = team_fga + F.lit(FT_WEIGHT) * team_fta + team_tov
    return 100 * safe_div(own * (team_mp / 5), mp * team)


def turnover_pct(tov, fga, fta) -> Column:
    return 100 * safe_div(tov, fga + F.lit(FT_WEIGHT) * fta + tov)


def assist_pct(ast, mp, team_mp, team_fgm, fgm) -> Column:
    return 100 * safe_div(ast, safe_div(mp, team_mp / 5) * team_fgm - fgm)


def rebound_pct(reb, mp, team_mp, team_reb, opp_reb) -> Column:
    return 100 * safe_div(reb * (team_mp / 5), mp * (team_reb + opp_reb))


def steal_pct(stl, mp, team_mp, opp_possessions) -> Column:
    return 100 * safe_div(stl * (team_mp / 5), mp * opp_possessions)


def block_pct(blk, mp, team_mp, opp_fga, opp_tpa) -> Column:
    return 100 * safe_div(blk * (team_mp / 5), mp * (opp_fga - opp_tpa))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def half_even(x: Column) -> Column:
    """Whole number, ties to the even one."""
    return F.rint(x).cast("bigint")


def nine_places(x: Column) -> Column:
    """To nine places, ties away from zero, where ties are those of the product with ``1e9``, as SQL engines round; ``F.round`` looks at the shortest decimal."""
    return F.round(x * 1e9) / 1e9


def rounded_exactly(x: Column, places: int) -> Column:
    """To ``places``, half to even, by the number's exact binary value: 2.675 is below its tie and gives 2.67.

    The product with the power of ten is split into what a double holds and the rest, so ties are told apart exactly;
    for sizes up to 2**52 after that product.
    """
    scale, split = float(10**places), 134217729.0
    p = x * scale
    xh, sh = x * split - (x * split - x), F.lit(scale * split - (scale * split - scale))
    xl, sl = x - xh, F.lit(scale) - sh
    rest = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p)
    over = p - low
    odd = F.pmod(low, F.lit(2)) == 1
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & odd)))
    return F.when(x.isNotNull(), (low + up.cast("int")) / scale)


def row_mean(*cols: Column) -> Column:
    """Mean of what is there; NULL if nothing is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def row_count(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def geo_mean(*cols: Column) -> Column:
    """Geometric mean; NULL unless all are there.  Values below a billionth count as that."""
    total = reduce(lambda a, b: a + b, [F.ln(F.greatest(c, F.lit(1e-9))) for c in cols])
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(present, F.exp(total / len(cols)))


def weighted_mean(values: list[Column], weights: list[float], least_share: float = 0.5) -> Column:
    """Weighted mean over what is there, NULL if that holds less than ``least_share`` of the weight."""
    top = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights, strict=True)])
    held = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(values, weights, strict=True)])
    return F.when((held > 0) & (held >= least_share * sum(weights)), top / held)


def interpolate(grid: Column, v: Column) -> Column:
    """Place of ``v`` on a sorted grid of 101 knots, 0 to 100; between knots linear, equal knots give the upper one."""
    k = F.size(F.filter(grid, lambda g: g <= v))
    lo, hi = F.get(grid, k - 1), F.get(grid, k)
    return (
        F.when(v.isNull() | grid.isNull(), None)
        .when(k == 0, 0.0)
        .when(k >= F.size(grid), 100.0)
        .otherwise(k - 1 + (v - lo) / (hi - lo))
    )


def interpolated(grid: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``interpolate`` for many values of one grid inside a task; NaN where the value is missing."""
    k = np.searchsorted(grid, v, side="right")
    inside = (k > 0) & (k < len(grid)) & ~np.isnan(v)
    at = k[inside]
    out = np.where(np.isnan(v), np.nan, np.where(k == 0, 0.0, 100.0))
    out[inside] = at - 1 + (v[inside] - grid[at - 1]) / (grid[at] - grid[at - 1])
    return out


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log2_discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of fixed width; values outside count into the first and the last."""
    return F.least(F.floor((clamp(v, lo, hi) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")


def euclid(a: Column, b: Column) -> Column:
    """Root mean square difference over the dimensions that both have."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(_mean(sq))


def manhattan(a: Column, b: Column) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column, centre: float = 50.0) -> Column:
    """1 - cosine of the vectors around ``centre``; NULL if either is zero there."""
    def total(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p - centre) * (q - centre)), F.lit(0.0), lambda s, z: s + F.coalesce(z, F.lit(0.0)))

    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norm > 0, 1 - total(a, b) / norm)


def _mean(xs: Column) -> Column:
    there = F.filter(xs, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def dot(values: list[Column], coefficients: list[float], intercept: float) -> Column:
    return reduce(lambda a, b: a + b, [v * c for v, c in zip(values, coefficients, strict=True)], F.lit(float(intercept)))


def linear_inference(values: list[Column], medians, means, scales, coefficients, intercept: float) -> Column:
    """Impute, scale, dot product: a fitted linear model as one expression."""
    ready = [(F.coalesce(v, F.lit(float(m))) - float(u)) / float(s if s > 0 else 1) for v, m, u, s in zip(values, medians, means, scales, strict=True)]
    return dot(ready, list(coefficients), intercept)
