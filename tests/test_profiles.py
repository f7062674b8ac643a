"""Team need from a long specification: peers whose percentile is the value itself make every rule exact."""

import math

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import profiles as N

METRICS = N.Specification().metrics()


def people(spark, *rows):
    """Prospects of 2020 with every metric at 50 and enough attempts, but for what a row says."""
    base = {"season": 2020, "id": 0, "position_3": "G", "three_points_attempted": 100.0, "free_throws_attempted": 100.0, "shot_records": 300.0, **dict.fromkeys(METRICS, 50.0)}
    data = [{**base, "id": i, **r} for i, r in enumerate(rows)]
    kinds = {"season": "int", "id": "long", "position_3": "string"}
    return spark.createDataFrame([tuple(r[c] for c in base) for r in data], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in base))


@pytest.fixture(scope="module")
def grid(spark):
    """The grid of all gives a value as its percentile, that of centres a place ten lower; forwards have none."""
    same, lower = [float(q) for q in range(101)], [float(q + 10) for q in range(101)]
    rows = [(2020, g, m, knots) for m in METRICS for g, knots in (("GLOBAL", same), ("G", same), ("C", lower))]
    return spark.createDataFrame(rows, "season int, reference_group string, metric string, grid array<double>")


def run(spark, grid, *rows, spec=None):
    got = N.evaluated(people(spark, *rows), grid, ["season", "id"], "season", "position_3", spec)
    dims = {(r.id, r.dimension): r for r in got.dimensions.collect()}
    fits = {(r.id, r.profile): r for r in got.profiles.collect()}
    return dims, fits, got


def test_dimensions_and_profiles(spark, grid):
    rows = [
        {"three_point_pct": 90.0, "ft_pct": 70.0, "efg_pct": 80.0, "three_point_attempt_rate": 20.0, "tov_pct": 10.0},
        {"position_3": "C", "blk_pct": 60.0, "drb_pct": 90.0, "orb_pct": 30.0},
        {"position_3": "F", "three_points_attempted": 19.0, "three_point_pct": 99.0},
        {"position_3": "UNKNOWN", "weight": None, "height": None},
        {"position_3": None, "three_points_attempted": None, "free_throws_attempted": 5.0, "three_point_attempt_rate": None},
        {"season": 1999},
    ]
    dims, fits, got = run(spark, grid, *rows)
    assert len(dims) == 6 * 6 and len(fits) == 6 * 6
    # a mean of what is there; a lower turnover rate is better
    assert dims[0, "SHOOTING"].score == pytest.approx(65) and dims[0, "PLAYMAKING"].score == pytest.approx(70)
    # conjunctive: the geometric mean of the means
    assert fits[0, "SHOOTER"].fit_raw == pytest.approx(math.sqrt(80 * 20)) and fits[0, "SHOOTER"].fit_score == 40
    # a centre is measured among centres, but for the blocks of a rim protector
    assert dims[1, "REBOUNDING"].score == pytest.approx(50) and dims[1, "BOX_SCORE_DEFENSIVE_PRODUCTION"].score == pytest.approx(45)
    assert fits[1, "RIM_PROTECTOR"].fit_raw == pytest.approx((60 * 50 * 50) ** (1 / 3)) and fits[1, "RIM_PROTECTOR"].eligibility == "ELIGIBLE"
    # a position without a grid falls back on all; few attempts are missing, not low
    assert dims[2, "REBOUNDING"].score == pytest.approx(50) and dims[2, "SHOOTING"].score == pytest.approx(50) and dims[2, "SHOOTING"].coverage == 0.75
    assert dims[3, "SIZE"].score is None and fits[3, "STRETCH_BIG"].fit_raw is None and fits[3, "STRETCH_BIG"].fit_status == "UNAVAILABLE"
    # half of four is enough, less is not; a pillar that is missing takes its profile along
    assert dims[4, "SHOOTING"].score is None and dims[4, "SHOOTING"].coverage == 0.25 and fits[4, "SHOOTER"].fit_raw is None and fits[4, "SLASHER"].fit_raw == 50
    # a season without peers has no percentile, never 50
    assert all(dims[5, d].score is None for d in N.Specification().dimensions())
    assert fits[3, "THREE_AND_D"].eligibility == "UNKNOWN_POSITION" == fits[4, "THREE_AND_D"].eligibility and fits[1, "THREE_AND_D"].eligibility == "OUT_OF_POSITION"
    assert fits[3, "SLASHER"].eligibility == "ELIGIBLE"
    raw = {(r.id, r.metric): r for r in got.components.collect()}
    assert (raw[0, "tov_pct"].raw, raw[0, "tov_pct"].oriented) == (pytest.approx(10), pytest.approx(90))


def test_rank(spark, grid):
    """Missing fits are last, then those out of position; an unknown position is not out of it."""
    rows = [{"position_3": "C", "three_point_pct": 99.0}, {"position_3": "UNKNOWN"}, {"three_point_pct": 60.0}, {"three_point_pct": 60.0}, {"stl_pct": None, "blk_pct": None, "three_point_pct": 99.0}]
    _, fits, _ = run(spark, grid, *rows)
    assert [fits[i, "THREE_AND_D"].fit_rank for i in range(5)] == [4, 3, 1, 2, 5]


def test_a_metric_means_one_thing(spark, grid):
    spec = N.Specification()
    assert N.conflicts(spec.component_table(spark)).count() == 0
    spec.components.append(("REBOUNDING", "blk_pct", "GLOBAL", True))
    found = N.conflicts(spec.component_table(spark)).collect()
    assert [tuple(r) for r in found] == [("blk_pct", "BOX_SCORE_DEFENSIVE_PRODUCTION,REBOUNDING", "GLOBAL,POSITION")]
    with pytest.raises(ValueError, match="blk_pct"):
        run(spark, grid, {}, spec=spec)
    with pytest.raises(KeyError, match="NOWHERE"):
        run(spark, grid, {}, spec=N.Specification(pillars=[("X", "a", "DIMENSION", "NOWHERE", None)]))
    with pytest.raises(KeyError, match="usage_pct"):
        run(spark, grid, {}, spec=N.Specification(pillars=[("X", "a", "METRIC", "usage_pct", None)]))


def test_a_metric_in_two_dimensions_counts_once_in_a_pillar(spark, grid):
    spec = N.Specification(components=[("A", "ft_pct", "GLOBAL", True), ("B", "ft_pct", "GLOBAL", True), ("B", "efg_pct", "GLOBAL", True)], pillars=[("P", "x", "METRIC", "ft_pct", None), ("P", "x", "METRIC", "efg_pct", None)], eligible=[])
    dims, fits, _ = run(spark, grid, {"ft_pct": 20.0, "efg_pct": 80.0}, spec=spec)
    assert dims[0, "A"].score == pytest.approx(20) and dims[0, "B"].score == pytest.approx(50) and fits[0, "P"].fit_raw == pytest.approx(50)


def test_size_in_position(spark, grid):
    got = {r.id: r.size_in_position for r in N.position_relative_size(people(spark, {"height": 70.0}, {"position_3": "C", "weight": None}), grid, ["season", "id"], "season", "position_3").collect()}
    assert got == {0: pytest.approx(60), 1: pytest.approx(40)}


def test_percentiles_of_the_ends(spark, grid):
    rows = N.percentile_frame(people(spark, {"ft_pct": -5.0}, {"ft_pct": 0.0}, {"ft_pct": 100.0}, {"ft_pct": 99.25}, {"ft_pct": None}), grid, ["season", "id"], "season", "position_3", [("ft_pct", "GLOBAL"), ("ft_pct", "POSITION")])
    got = {(r.id, r.reference_group): r.percentile for r in rows.collect()}
    assert [got[i, "GLOBAL"] for i in range(5)] == [0, 0, 100, pytest.approx(99.25), None] and got[3, "POSITION"] == pytest.approx(99.25) and len(got) == 10
    assert rows.where(F.col("percentile").isNull()).count() == 2


def test_evaluation_moves_no_rows(spark):
    """Everything is read from the prospect's own row: no plan of the scores has a shuffle (the rank of fits apart), none carries grids."""
    grid = spark.createDataFrame([(2020, "GLOBAL", m, [float(q) for q in range(101)]) for m in N.Specification().metrics()], "season int, reference_group string, metric string, grid array<double>")
    frame = spark.range(8).selectExpr("2020 AS season", "id", "'G' AS position_3", *[f"id * 10.5D AS {m}" for m in N.Specification().metrics()], "30 AS three_points_attempted", "30 AS free_throws_attempted", "30 AS shot_records")
    got = N.evaluated(frame, grid, ["season", "id"], "season", "position_3")
    for df in (got.dimensions, got.components, got.profiles.drop("fit_rank")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "grid" not in plan
    assert {(r.id, r.score) for r in got.dimensions.where("dimension = 'SIZE'").collect()} == {(k, k * 10.5) for k in range(8)}
    assert {(r.id, round(r.score, 9)) for r in got.dimensions.where("dimension = 'PLAYMAKING'").collect()} == {(k, 50.0) for k in range(8)}
