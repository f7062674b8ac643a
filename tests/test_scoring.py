"""A class scored end to end: nobody is dropped or doubled, nothing is fitted, and parts agree with what they are made of."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators import assembly as D
from scoutframe.operators import bundles, folds, peers, profiles, scoring

METRICS = list(dict.fromkeys([m for own in scoring.ROLES.values() for m in own] + profiles.Specification().metrics() + ["usage_pct", "ts_pct"]))
NAMES, RELATIVE = ["points_per_40", "ts_pct", "usage_pct", "height"], ["points_per_40", "ts_pct"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        x = {m: float(rng.normal(50, 12)) if rng.random() > 0.05 else None for m in METRICS}
        x["height"] = float(rng.integers(70, 86)) if rng.random() > 0.03 else None
        drafted = int(rng.random() < 0.5)
        rows.append((2018 + i % 5, i, ["G", "F", "C", "UNKNOWN", None][rng.choice(5, p=[0.4, 0.3, 0.2, 0.07, 0.03])], 900.0, 32, 50.0, 50.0, 100, drafted, float(rng.integers(1, 61)) if drafted else None, *x.values()))
    names = ["season int", "person_id long", "position_3 string", "minutes double", "games_played long", "tpa double", "fta double", "fg_attempts long", "drafted int", "pick double", *(f"{m} double" for m in METRICS)]
    return spark.createDataFrame(rows, ", ".join(names)).cache()


@pytest.fixture(scope="module")
def frozen(spark, frame):
    features = frame.drop("drafted", "pick")
    moments = peers.moments(features, ["season", "position_3"], RELATIVE)
    chance, order = scoring.frozen_fits(frame, moments, NAMES, RELATIVE, "season", "position_3", 2022)
    metrics = [m for own in scoring.ROLES.values() for m in own]
    pros = features.where("person_id % 3 = 0").withColumn("athlete_id", F.col("person_id") + 10_000)
    pool = scoring.pro_pool(pros.select("athlete_id", "season", "minutes", "position_3", *metrics), pros.select("athlete_id", "height"), "athlete_id", "position_3")
    grid = peers.grids(features, "season", "position_3", profiles.Specification().metrics(), 30)
    return scoring.Frozen(chance, order, moments, grid, features, pool, None, NAMES, NAMES, RELATIVE, profiles.Specification(denominators=D.DENOMINATORS))


def test_scored_class(spark, frame, frozen):
    new = frame.where("season = 2022").drop("drafted", "pick")
    scored = scoring.scored_class(new, frozen, "season", "position_3", "person_id", F.lit(60.0)).cache()
    got = scored.collect()
    ids = {r.person_id for r in new.collect()}
    assert {r.person_id for r in got} == ids and len(got) == len(ids)
    assert sorted(r.board_rank for r in got) == list(range(1, len(ids) + 1))
    by_rank = sorted(got, key=lambda r: r.board_rank)
    assert all(a.signal >= b.signal for a, b in zip(by_rank, by_rank[1:]))
    n = len(got)
    for r in got:
        assert 0 < r.chance < 1 and r.utility == pytest.approx((61 - min(max(r.pick, 1), 60)) / 60) and r.signal == pytest.approx(r.chance * r.utility)
        below = sum(x.signal < r.signal for x in got) + (sum(x.signal == r.signal for x in got) - 1) / 2
        assert r.score == round(100 * ((below + 0.5) / n))
        assert len(r.comparables) in (0, 3) and (r.comparables_status == "OK") == (len(r.comparables) == 3)
    assert any(r.comparables_status == "UNAVAILABLE" for r in got) and any(r.SHOOTING is not None for r in got)
    docs = bundles.class_payload(scored, "season", "person_id", ["score", "board_rank"], ["SHOOTING", "SIZE"], ["SHOOTER", "THREE_AND_D"]).collect()
    payload = json.loads(docs[0].doc)
    assert len(docs) == 1 and [p["board"]["board_rank"] for p in payload["prospects"]] == list(range(1, n + 1)) and payload["season"] == 2022
    first = payload["prospects"][0]
    assert first["id"] == by_rank[0].person_id and first["profiles"]["SHOOTER"]["score"] == by_rank[0].SHOOTER_score and len(first["comparables"]) in (0, 3)
    assert first["dimensions"]["SIZE"] is None or first["dimensions"]["SIZE"] == pytest.approx(by_rank[0].SIZE, abs=0.051)
    # the same rows score the same beside others
    both = {r.person_id: r for r in scoring.board(frame.where("season >= 2021").drop("drafted", "pick"), frozen, "season", "position_3", "person_id", F.lit(60.0)).where("season = 2022").collect()}
    assert all(both[r.person_id].score == r.score and both[r.person_id].board_rank == r.board_rank for r in got)


def test_frozen_fits_are_those_of_the_past(spark, frame, frozen):
    """Frozen parameters are a fit of the earlier seasons, and later outcomes change nothing."""
    changed = frame.withColumns({"drafted": F.when(F.col("season") == 2022, 1 - F.col("drafted")).otherwise(F.col("drafted")), "pick": F.when(F.col("season") == 2022, 1.0).otherwise(F.col("pick"))})
    chance, order = scoring.frozen_fits(changed, frozen.moments, NAMES, RELATIVE, "season", "position_3", 2022)
    for a, b in ((chance, frozen.chance), (order, frozen.order)):
        a, b = a.first(), b.first()
        assert a.coefficients == pytest.approx(b.coefficients, abs=1e-9) and a.intercept == pytest.approx(b.intercept, abs=1e-9) and a.n_train == b.n_train
    assert frozen.order.first().n_train == frame.where("season < 2022 AND drafted = 1").count()
    apart = peers.season_relative(frame.where("season < 2022"), frozen.moments, "season", "position_3", RELATIVE)
    fit = folds.logit_folds(folds.Rows.of(apart, NAMES, "season", "drafted", "position_3"), {2022: []})[2022]
    row = scoring.signals(frame.where("person_id = 4").drop("drafted", "pick"), frozen, "season", "position_3").first()
    z = peers.season_relative(frame.where("person_id = 4"), frozen.moments, "season", "position_3", RELATIVE)
    want = folds.scored(z.withColumn("model", F.lit(0)), folds.parameters(spark, {0: fit}, "model"), "model", NAMES, "position_3", "z").select(X.logistic(F.col("z")).alias("p")).first().p
    assert row.chance == pytest.approx(want) and row.points_per_40 is not None
    with pytest.raises(ValueError, match="undrafted"):
        scoring.frozen_fits(frame.where("drafted = 1"), frozen.moments, NAMES, RELATIVE, "season", "position_3", 2022)


def test_scored_population(spark, frame, frozen):
    """Who has no record stays with the reason."""
    some = frame.where("season = 2022 AND person_id < 60").drop("drafted", "pick").withColumns({"athlete_id": F.col("person_id"), "method": F.lit("NAME")})
    games = F.when(F.col("person_id") % 4 > 0, F.col("games_played"))
    athlete = F.when(F.col("person_id") % 8 > 0, F.col("athlete_id"))
    some = some.withColumns({"games_played": F.when(athlete.isNotNull(), games), "athlete_id": athlete, "method": F.when(athlete.isNull(), "AMBIGUOUS").otherwise("NAME")})
    got = {r.person_id: r for r in scoring.scored_population(some, frozen, "season", "position_3", "person_id", F.lit(60.0)).collect()}
    assert len(got) == some.count()
    for i, r in got.items():
        want = "AMBIGUOUS" if i % 8 == 0 else "INSUFFICIENT_DATA" if i % 4 == 0 else "SCORED"
        assert r.population_status == want and (r.board_rank is not None) == (want == "SCORED")


def test_watchlist(spark, frame, frozen):
    """Named by two sources and played: scored; named but unknown, or named once: not."""
    rows = [("A", "Al Bee", "Duke"), ("B", "Al Bee Jr.", "Duke"), ("A", "Cy Dee", "State"), ("B", "Cy Dee", "State"), ("A", "Once Only", "Duke")]
    seen = spark.createDataFrame([(*r, "2026-01-01", "u") for r in rows], "source string, player_name string, school string, publication_date string, url string")
    index = spark.createDataFrame([(2022, 4, "al bee", ["duke"])], "season int, ident long, name_key string, schools array<string>")
    none = spark.createDataFrame([], "person_id string, ident long")
    known = frame.where("season = 2022").drop("drafted", "pick").withColumnRenamed("person_id", "athlete_id")
    got = {r.player_name: r for r in scoring.scored_watchlist(seen, index, none, known, frozen, 2027, 2022, F.lit(60.0)).collect()}
    assert {k: r.population_status for k, r in got.items()} == {"Al Bee": "SCORED", "Cy Dee": "UNMATCHED"}
    assert got["Al Bee"].board_rank == 1 and got["Al Bee"].athlete_id == 4 and got["Cy Dee"].chance is None and got["Al Bee"].sources == "A,B"


def test_commands(spark, tmp_path, capsys):
    from scoutframe import __main__ as command
    from scoutframe import api

    assert all(hasattr(api, name) for name in api.__all__)
    assert command.main(["list"]) == 0 and "class_boards" in capsys.readouterr().out.split()
    folder = "/root/testdata/sf0.001"
    assert command.main(["run", "scan_projection", folder, f"{tmp_path}/out"]) == 0 and spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert command.main(["validate", folder]) == 0
    for name in command.TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0 if name == "nation" else 5).write.parquet(f"{tmp_path}/bad/{name}.parquet")
    capsys.readouterr()
    assert command.main(["validate", f"{tmp_path}/bad"]) == 1 and "FAILED: nation has rows" in capsys.readouterr().out


def test_nobody_is_doubled(spark):
    """Two bios, two rows of totals, two overrides or two statuses of one athlete leave one row a prospect."""
    people = spark.createDataFrame([(2020, 1, "a bee", "x"), (2020, 2, "c dee", "y"), (2020, 3, "no body", "z")], "season int, person_id long, name_key string, school string")
    index = spark.createDataFrame([(2020, 11, "a bee", ["x"]), (2020, 12, "c dee", ["y"]), (2019, 13, "no body", ["z"])], "season int, ident long, name_key string, schools array<string>")
    overrides = spark.createDataFrame([(2, 11), (2, 12)], "person_id long, ident long")
    frame = spark.createDataFrame([(2020, 11, 5), (2020, 12, 6)], "season int, athlete_id long, games_played int")
    got = {r.person_id: r for r in D.prospect_frame(people, index, overrides, frame).collect()}
    assert {k: (r.athlete_id, r.method, r.games_played) for k, r in got.items()} == {1: (11, "NAME", 5), 2: (11, "OVERRIDE", 5), 3: (None, "UNMATCHED", None)}
    bio = spark.createDataFrame([(11, "G", 70.0), (11, "F", None)], "athlete_id long, label string, height_inches double")
    assert [tuple(r) for r in D.one_each(bio, ["athlete_id"]).collect()] == [(11, "F", None)]
    status = spark.createDataFrame([(1, "B"), (1, "A")], "person_id long, status string")
    assert {r.person_id: r.status for r in D.with_status(people, status, "person_id").collect()} == {1: "A", 2: "UNKNOWN", 3: "UNKNOWN"}
    targets = spark.createDataFrame([(1, "True", "5"), (2, "False", ""), (9, "False", "")], "person_id long, drafted string, pick string")
    built = D.build_dataset(D.prospect_frame(people, index, overrides, frame).withColumns({c: F.lit(1) for c in ("fg_attempts", "n_teams")}), targets, held_out=(2021,), expected={2020: 3})
    assert built.failed() == ["features have targets", "most prospects are matched", "targets have features"]
    assert "method" not in built.features.columns and built.targets.count() == 2 and built.crosswalk.count() == 3


def test_ties_of_decimals_round_as_in_sql(spark):
    """Scores are summed in the written order and rounded to nine places as DuckDB does, where a value ends on a tie of the tenth."""
    import duckdb

    from scoutframe.plans import classes as C

    rows = [(0, i, *r) for i, r in enumerate([(150.407362963, 0.464285714, 72.0, "F"), (43.338917647, 0.370926878, 72.0, "UNKNOWN"), (46.0, 3.5, None, "G")])]
    kinds = "model int, id int, points_per_40 double, blk_pct double, height double, position_3 string"
    table = spark.createDataFrame([(0, *C._ORDER_FIT)], f"model int, {C.PARAMETERS}")
    got = folds.scored(spark.createDataFrame(rows, kinds), table, "model", C._ORDER, "position_3", "pick").select("id", "pick", X.nine_places(F.col("pick")).alias("nine"))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE x (model INT, id INT, points_per_40 DOUBLE, blk_pct DOUBLE, height DOUBLE, position_3 VARCHAR)")
    duck.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = duck.execute(f"SELECT id, pick, round(pick, 9) FROM (SELECT id, {C._linear(C._ORDER_FIT, C._ORDER)} AS pick FROM x)").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    ties = [(k + 0.5) / 1e9 for k in range(33_862_713_000, 33_862_713_400)]
    some = spark.createDataFrame([(v,) for v in ties], "v double").select("v", X.nine_places(F.col("v"))).collect()
    assert [tuple(r) for r in some] == duck.execute("SELECT v, round(v, 9) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [ties]).fetchall()
