"""Boosted trees against a brute-force search of every split, and exact rounding against Python's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions import text as T
from scoutframe.operators import boosting as G


def make(n=240, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 8, n).astype(float), rng.normal(0, 1, n).round(2), np.full(n, 3.0)])
    x[rng.random(n) < 0.2, 0] = np.nan
    y = np.where(np.nan_to_num(x[:, 0], nan=6.0) > 4, 3.0, 0.0) + x[:, 1] + rng.normal(0, 0.1, n)
    return x, y


def plain(x, y, edges, trees, depth, rate, ridge, least, logistic):
    """Every split of every node by summing its rows."""
    bins = np.column_stack([np.where(np.isnan(c), -1, (c[:, None] > np.array(e, float)[None]).sum(1) if e else 0) for c, e in zip(x.T, edges, strict=True)]).astype(int)
    base = np.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    total = np.full(len(y), base)
    for _ in range(trees):
        now = 1 / (1 + np.exp(-total)) if logistic else total
        g, h = now - y, now * (1 - now) if logistic else np.ones(len(y))
        step = np.zeros(len(y))

        def grow(rows, level):
            value = -rate * g[rows].sum() / (h[rows].sum() + ridge)
            best = None
            for f in range(x.shape[1]) if level < depth else ():
                for missing_left in (True, False):
                    for b in range(max(len(e) for e in edges) + 1):
                        left = (bins[rows, f] <= b) & ((bins[rows, f] >= 0) | missing_left)
                        a, c = rows[left], rows[~left]
                        if h[a].sum() < least or h[c].sum() < least:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[c].sum() ** 2 / (h[c].sum() + ridge) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                            best = (gain, a, c)
            if best is None:
                step[rows] = value
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(np.arange(len(y)), 0)
        total = total + step
    return 1 / (1 + np.exp(-total)) if logistic else total


@pytest.mark.parametrize("logistic", [False, True])
def test_boosting_is_the_brute_force_search(spark, logistic):
    x, y = make()
    y = (y > 1).astype(float) if logistic else y
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + [(999, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double").repartition(3)
    model = G.fit(df, ["a", "b", "c"], "y", trees=3, depth=2, rate=0.5, most_bins=6, least=2.0, logistic=logistic)
    got = {r.id: r.s for r in df.select("id", model.score().alias("s")).collect()}
    want = plain(x, y, model.edges, 3, 2, 0.5, 1.0, 2.0, logistic)
    assert len(got) == 241 and got[999] is not None
    assert [got[i] for i in range(240)] == pytest.approx(want.tolist(), rel=1e-9)
    # the middle of three features says the most, the constant one nothing
    used = {n.feature for t in model.trees for n in t.values() if n.feature is not None}
    assert used == {0, 1} and model.edges[2] == [3.0]
    error = ((y - want) ** 2).mean()
    assert error < 0.5 * y.var()


def test_boosting_without_labels(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, y double")
    with pytest.raises(ValueError, match="target"):
        G.fit(df, ["a"], "y")
    with pytest.raises(ValueError, match="labels"):
        G.fit(df.withColumn("y", F.lit(1.0)), ["a"], "y", logistic=True)


def test_rounding_by_the_exact_value(spark):
    rng = random.Random(1)
    values = [2.675, 0.12345, 1.005, 2.5, 0.5, 1.5, -2.675, -0.5, -1.5, 0.0, 1e-9, 123456.785, 0.285, 1.115, 2.665] + [rng.randint(-(10**6), 10**6) / 1000 for _ in range(600)] + [rng.uniform(-100, 100) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (0, 1, 2, 3, 4):
        got = df.select("v", X.rounded_exactly(F.col("v"), k).alias("r")).collect()
        assert all(r.r == round(r.v, k) for r in got if r.v is not None) and got[-1].r is None


def test_texts(spark):
    row = spark.createDataFrame([("draft_pick_value", " nan ", "  a ", "", 0.1234, 81.0)], "a string, b string, c string, d string, e double, f double").select(
        T.camel(F.col("a")).alias("a"), T.cleaned(F.col("b")).alias("b"), T.cleaned(F.col("c")).alias("c"), T.cleaned(F.col("d")).alias("d"), T.percent(F.col("e")).alias("e"), T.of_hundred(F.col("f")).alias("f"), T.percent(F.lit(None).cast("double")).alias("g"), T.camel(F.lit("one")).alias("h"),
    ).first()
    assert tuple(row) == ("draftPickValue", None, "a", None, "12.3%", "81 / 100", "—", "one")
