"""Fits of all folds at once against a fit of each fold by itself, and exact quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.operators import folds as D
from scoutframe.operators.quantiles import bucket, exact_quantiles

NAMES = ["a", "b", "constant", "missing"]


def make(n=600, seed=3):
    rng = np.random.default_rng(seed)
    year = rng.integers(2014, 2021, n)
    x = np.column_stack([rng.normal(30, 8, n), rng.gamma(2, 1, n).round(1), np.full(n, 4.0), np.full(n, np.nan)])
    x[rng.random((n, 4)) < 0.15] = np.nan
    x[:5, 0] = np.inf
    level = rng.choice(["G", "F", "C", "UNKNOWN", "??", None], n)
    chance = 1 / (1 + np.exp(-(np.nan_to_num(x[:, 0], posinf=30.0) - 30) / 6 - (level == "C")))
    drafted = (rng.random(n) < chance).astype(int)
    drafted[year == 2014] = 1
    pick = np.where(drafted == 1, np.clip(np.round(60 - 50 * chance + rng.normal(0, 8, n)), 1, 60), np.nan)
    return year, x, level, drafted, pick


@pytest.fixture(scope="module")
def table(spark):
    year, x, level, drafted, pick = make()
    cells = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    rows = [(i, int(y), *c, l, int(d), None if np.isnan(p) else float(p)) for i, (y, c, l, d, p) in enumerate(zip(year, cells, level, drafted, pick, strict=True))]
    return spark.createDataFrame(rows, "id long, year int, a double, b double, constant double, missing double, position string, drafted int, pick double").repartition(5)


def design(x, level, train):
    """Imputed and scaled by the training rows, and the four levels."""
    x = np.where(np.isfinite(x), x, np.nan)
    with np.errstate(all="ignore"):
        medians = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x[train].T])
    x = np.where(np.isnan(x), medians, x)
    mean, std = x[train].mean(0), x[train].std(0)
    known = np.array([v if v in D.LEVELS else "UNKNOWN" for v in level])
    return np.column_stack([(x - mean) / np.where(std > 1e-9, std, 1.0), *[known == k for k in D.LEVELS]]).astype(float)


@pytest.mark.parametrize("merge", [D.MERGE, 2])
def test_ridge_is_a_refit_of_each_fold(spark, table, monkeypatch, merge):
    monkeypatch.setattr(D, "MERGE", merge)
    year, x, level, drafted, pick = make()
    years = D.fold_years([int(y) for y in year], 2016)
    assert sorted(years) == [2016, 2017, 2018, 2019, 2020] and years[2017] == [2014, 2015, 2016]
    fits = D.ridge_folds(D.Rows.of(table, NAMES, "year", "pick", "position"), years)
    got = {r.id: r.predicted for r in D.out_of_fold(table, fits, "year", "position", "predicted").collect()}
    assert len(got) == (year >= 2016).sum()
    for t in years:
        train = (year < t) & ~np.isnan(pick)
        z = design(x, level, train)
        mean, std = pick[train].mean(), pick[train].std()
        full = np.column_stack([z, np.ones(len(z))])
        penalty = np.diag([10.0] * z.shape[1] + [0.0])
        w = np.linalg.lstsq(full[train].T @ full[train] + penalty, full[train].T @ ((pick[train] - mean) / std), rcond=None)[0]
        want = full @ w * std + mean
        for i in np.flatnonzero(year == t):
            assert got[i] == pytest.approx(want[i], abs=1e-8)
        assert fits[t].n_train == train.sum()


def test_logit_is_the_optimum_of_each_fold(spark, table):
    year, x, level, drafted, _ = make()
    years = D.fold_years([int(y) for y in year], 2015)
    fits = D.logit_folds(D.Rows.of(table, NAMES, "year", "drafted", "position"), years)
    assert sorted(fits) == [2016, 2017, 2018, 2019, 2020]  # 2014 has one class
    out = D.out_of_fold(table, fits, "year", "position", "score").collect()
    assert len(out) == (year >= 2016).sum()
    score = {r.id: r.score for r in out}
    for t in fits:
        train = year < t
        z = design(x, level, train)
        full, y = np.column_stack([z, np.ones(len(z))]), drafted.astype(float)
        weight = np.where(y == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (1 - y[train]).sum()))
        w = np.concatenate([fits[t].coefficients, fits[t].levels, [fits[t].intercept]])
        p = 1 / (1 + np.exp(-full @ w))
        # where the gradient of the penalised loss is 0 stands its only optimum
        gradient = 0.25 * full[train].T @ ((weight * (p - y))[train]) + np.append(w[:-1], 0.0)
        assert np.abs(gradient).max() < 1e-8
        for i in np.flatnonzero(year == t):
            assert score[i] == pytest.approx(full[i] @ w, abs=1e-9)


def test_no_fold_sees_its_own_year(spark, table):
    """Other outcomes in a test year and after it change nothing; a held-out year is in no fold."""
    years = {2018: [2014, 2015, 2016, 2017]}
    changed = table.withColumn("pick", F.when(F.col("year") >= 2018, 61 - F.col("pick")).otherwise(F.col("pick")))
    a, b = (D.ridge_folds(D.Rows.of(t, NAMES, "year", "pick", "position"), years)[2018] for t in (table, changed))
    assert a.intercept == pytest.approx(b.intercept, rel=1e-12) and a.coefficients == pytest.approx(b.coefficients, rel=1e-9, abs=1e-12) and (a.medians == b.medians).all()
    assert D.fold_years([2014, 2015, 2016, 2026], 2015, (2026,)) == {2015: [2014], 2016: [2014, 2015]}


def test_rows_without_a_fit(spark, table):
    fits = D.ridge_folds(D.Rows.of(table.where("year > 2016"), NAMES, "year", "pick"), {2016: [2015], 2018: [2016, 2017]})
    assert sorted(fits) == [2018]
    params = D.parameters(spark, fits, "year")
    got = D.scored(table, params, "year", NAMES, None, "predicted")
    assert got.count() == table.count() and got.where("predicted IS NOT NULL").select("year").distinct().collect() == [(2018,)]
    assert D.ridge_folds(D.Rows.of(table.limit(0), NAMES, "year", "pick"), {2016: [2015]}) == {}
    assert D.out_of_fold(table, {}, "year", None, "p").count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 1e3, 900), "b": rng.integers(-3, 4, 400).astype(float), None: np.array([5.0]), "tiny": rng.normal(0, 1e-300, 51), "two": np.array([-1.5, 2.5])}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("none", None)]
    f = [0.0, 0.01, 0.1, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", f).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert got[k].n == len(own) and got[k].quantiles == pytest.approx(np.quantile(own, f).tolist(), rel=1e-12, abs=1e-310)
    whole = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", [0.5]).collect()
    assert len(whole) == 1 and whole[0].quantiles == pytest.approx([np.median(np.concatenate(list(groups.values())))])


def test_buckets_keep_the_order(spark):
    v = np.sort(np.concatenate([np.random.default_rng(2).normal(0, 1, 2000), [0.0, -0.0, 1e-308, -1e-308, 5e-324, 1.7e308, -1.7e308], 2.0 ** np.arange(-30, 30)]))
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in v], "v double").select("v", bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 500
