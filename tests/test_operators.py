"""Operators on micro tables."""

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import aggregate as A
from scoutframe.operators import board as B
from scoutframe.operators import metrics as M
from scoutframe.operators import model, need, rank, similar, validate
from scoutframe.operators import similar as S

BOX = [("season", 2020), ("athlete_id", 1), ("game_id", 100), ("team_id", 10), ("game_date", "2020-01-01"), ("did_not_play", False), ("starter", True)]


def box(spark, *rows):
    names = [k for k, _ in BOX] + A.SUMS
    data = [tuple({**dict(BOX), **dict.fromkeys(A.SUMS, 1.0), **r}[n] for n in names) for r in rows]
    kinds = ["int", "long", "long", "long", "string", "boolean", "boolean"] + ["double"] * len(A.SUMS)
    return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def test_season_box(spark):
    rows = box(spark, {"points": 10.0}, {"points": 10.0}, {"game_id": 101, "points": 5.0, "starter": None}, {"game_id": 200, "team_id": 20, "points": 7.0, "game_date": "2020-02-01"}, {"game_id": 201, "did_not_play": True, "points": 9.0})
    got = A.season_box(rows).first()
    assert (got.points, got.games_played, got.games_started, got.n_teams, got.primary_team) == (22.0, 3, 2, 2, 20)
    assert tuple(A.duplicate_report(rows).first()) == (2020, 5, 1)


def test_season_box_of_nothing(spark):
    assert A.season_box(box(spark)).count() == 0


def test_shot_profile(spark):
    shots = [(1, 5, "LayUpShot", True, 2), (1, None, "LayUpShot", True, 2), (1, 6, "DunkShot", True, 2), (1, None, "LayUpShot", False, 2), (1, None, "MadeFreeThrow", True, 1), (1, None, "JumpShot", None, 3)]
    got = A.shot_profile(spark.createDataFrame(shots, "athlete_id int, assister int, type_text string, made boolean, score_value int"), ["athlete_id"]).first()
    assert (got.fg_attempts, got.assisted_makes, got.unassisted_makes, got.layup_attempts, got.layup_assisted, got.dunk_assisted, got.three_attempts, got.three_makes) == (5, 2, 1, 3, 1, 1, 1, 0)


def test_class_percentile(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None)], "id int, v double").withColumn("k", F.lit(1))
    got = {r.id: r.p for r in df.select("id", rank.class_percentile(F.col("v"), ["k"]).alias("p")).collect()}
    assert got == {1: 0.125, 2: 0.375, 3: 0.625, 4: 0.875, 5: 0.5}


def test_slot_utility(spark):
    got = spark.createDataFrame([(1.0,), (60.0,), (-5.0,), (999.0,), (None,)], "p double").select(B.slot_utility(F.col("p"), F.lit(60.0)).alias("u")).collect()
    assert [r.u for r in got] == [1.0, pytest.approx(1 / 60), 1.0, pytest.approx(1 / 60), None]


def test_general_board_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.8, 20.0), (3, 1.0, None), (4, None, 50.0)], "id int, chance double, pick double").withColumn("k", F.lit(1))
    got = B.general_board(df, ["k"], "chance", "pick", F.lit(60.0), "id").collect()
    assert sorted(r.board_rank for r in got) == [1, 2, 3, 4] and all(0 <= r.score <= 100 for r in got)


def test_need_weights():
    need.check_weights({"a": 1.0}, ("a",))
    for bad in ({}, {"b": 1.0}, {"a": -1.0}, {"a": 0.0}, {"a": 1.0, "athleticism": 1.0}):
        with pytest.raises(need.UnsupportedNeed):
            need.check_weights(bad, ("a",))


def test_auc_and_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double").withColumn("k", F.lit(1))
    assert M.roc_auc(df, ["k"], "p", "y").first().auc == 1.0
    assert M.at_k(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "p", "y", "id", 2).first().precision_at_k == 1.0
    one = df.where("y = 1")
    assert M.roc_auc(one, ["k"], "p", "y").first().auc is None


def test_height_gate_and_unavailable(spark):
    mine = spark.createDataFrame([(1, [50.0] * 6, 72.0), (2, [50.0, None, None, None, None, None], 72.0)], "id int, vec array<double>, height double")
    pool = spark.createDataFrame([(10 + i, [50.0 + i] * 6, 72.0 if i % 2 else 84.0) for i in range(12)], "oid int, other_vec array<double>, other_height double")
    got = similar.comparables(mine, pool, "id", "oid", 6).collect()
    assert sorted(r.oid for r in got if r.id == 1) == [11, 13, 15]
    assert [(r.status, r.oid) for r in got if r.id == 2] == [("UNAVAILABLE", None)]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_of_all(spark, monkeypatch, block):
    """Every row meets the whole other side but itself, however both are dealt."""
    import random

    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    rng = random.Random(3)
    cell = lambda: None if rng.random() < 0.08 else float(rng.randint(0, 4))
    mine = [(s, i, [cell() for _ in range(6)], rng.choice([60.0, 70.0, 71.0, 75.0, None])) for s in (1, 2) for i in range(20)]
    pool = [(i, [cell() for _ in range(6)], rng.choice([69.0, 70.0, 73.0, 74.0, None])) for i in range(40)]
    want = []
    for s, i, v, h in mine:
        near = []
        for o, w, oh in pool:
            d = [(a - b) ** 2 for a, b in zip(v, w) if a is not None and b is not None]
            if o != i and len(d) >= 5 and h is not None and oh is not None:
                near.append(((sum(d) / len(d)) ** 0.5, o, abs(h - oh)))
        gate = next((g for g in (2.0, 3.0, 4.0) if sum(x[2] <= g for x in near) >= 3), None)
        best = sorted(x for x in near if gate and x[2] <= gate)[:3]
        want += [(s, i, o, round(d, 9), gate, k + 1, "OK") for k, (d, o, _) in enumerate(best)] or [(s, i, None, None, None, None, "UNAVAILABLE")]
    df = spark.createDataFrame(mine, "season int, id long, vec array<double>, height double")
    others = spark.createDataFrame(pool, "oid long, other_vec array<double>, other_height double")
    got = similar.nearest_of_all(df, others, ["season", "id"], "id", "oid", 6).collect()
    got = [(r.season, r.id, r.oid, r.distance if r.distance is None else round(r.distance, 9), r.gate, r.nth, r.status) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nearest_of_all_meets_copies_once(spark, monkeypatch):
    """Copies of both sides under other ids and names: what brute force gives, though each vector moves once; own ids and names stay out."""
    import random

    monkeypatch.setattr(similar, "BLOCK_ROWS", 6)
    rng = random.Random(5)
    cell = lambda: None if rng.random() < 0.08 else float(rng.randint(0, 3))
    base = [(i, [cell() for _ in range(6)], rng.choice([69.0, 70.0, 73.0, 78.0]), rng.choice(["a", "b", ""])) for i in range(14)]
    pool = [(i + 100 * c, v, h, n) for c in range(7) for i, v, h, n in base]
    mine = [*pool, (5000, *base[0][1:]), (5001, base[1][1], 71.0, "b")]
    want = []
    for i, v, h, name in mine:
        near = []
        for o, w, oh, called in pool:
            d = [(a - b) ** 2 for a, b in zip(v, w) if a is not None and b is not None]
            if o != i and len(d) >= 5 and (not name or name != called):
                near.append((round((sum(d) / len(d)) ** 0.5, 9), o, abs(h - oh)))
        gate = next((g for g in (2.0, 3.0, 4.0) if sum(x[2] <= g for x in near) >= 3), None)
        best = sorted(x for x in near if gate and x[2] <= gate)[:3]
        want += [(i, o, d, gate, k + 1) for k, (d, o, _) in enumerate(best)] or [(i, None, None, None, None)]
    df = spark.createDataFrame(mine, "id long, vec array<double>, height double, name string")
    others = spark.createDataFrame(pool, "oid long, other_vec array<double>, other_height double, called string")
    sides, banded = [], similar.banded
    monkeypatch.setattr(similar, "banded", lambda left, right, *rest: sides.extend((left.count(), right.count())) or banded(left, right, *rest))
    got = similar.nearest_of_all(df, others, ["id"], "id", "oid", 6, own_name="name", other_name="called").collect()
    assert sorted([(r.id, r.oid, r.distance, r.gate, r.nth) for r in got], key=str) == sorted(want, key=str)
    assert sides[0] <= len(base) + 1 and sides[1] <= len(base)


def test_nearest_by_cosine(spark, monkeypatch):
    """Against all pairs, in several chunks and blocks: ties, lists of several lengths, what is missing, and no length, which comes last."""
    import numpy as np

    monkeypatch.setattr(similar, "COSINE_ROWS", 9)
    monkeypatch.setattr(similar, "COSINE_QUERIES", 3)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(40)]
    rows += [(40, [1.0, None, 2.0]), (41, [0.0, 0.0]), (42, None), (43, rows[0][1])]
    full = {i: np.array([0.0 if x is None else x for x in [*(v or []), 0.0, 0.0, 0.0, 0.0][:4]]) for i, v in rows}

    def distance(a, b):
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - float(a @ b) / norm, 9) if norm > 0 else None

    want = []
    for i in (0, 7, 14, 21, 40, 41):
        met = sorted(((d is None, d or 0.0, j, d) for j in full if j != i for d in [distance(full[i], full[j])]))
        want += [(i, j, d) for _, _, j, d in met[:3]]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    others = df.select(F.col("id").alias("oid"), F.col("v").alias("w"))
    got = similar.nearest_by_cosine(df.where("id IN (0, 7, 14, 21, 40, 41)"), others, "id", "oid", "v", "w").collect()
    assert sorted(((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in got), key=str) == sorted(want, key=str)


def test_knn_cosine_asks_for_every_vector(spark, tmp_path):
    """No id is left out as a query, whatever it is divisible by; floats are compared as doubles."""
    import numpy as np

    from scoutframe.plans.more import knn_cosine

    x = np.random.default_rng(9).random((12, 4)).astype(np.float32)
    rows = [(i + 95, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    far = np.round(1 - y @ y.T, 9)
    want = [(i + 95, j + 95) for i in range(12) for _, j in sorted((far[i, j], j) for j in range(12) if j != i)[:3]]
    assert sorted((r.vec_id, r.other) for r in knn_cosine(spark, str(tmp_path)).collect()) == sorted(want)


def test_ridge_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    fitted = model.fit_order(df, ["a", "b"], "y", alpha=10.0)
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ t) * y.std()
    assert fitted.coefficients == pytest.approx(want.tolist(), rel=1e-6)


def test_validation(spark):
    df = spark.createDataFrame([(1, "12.4", "X"), (2, "1,200", "G"), (3, None, "G")], "row int, n string, pos string")
    got = validate.row_issues(df, "row", validate.field_checks([validate.Field("n", True, 0, 2000, True), validate.Field("pos", choices=("G", "F"))])).collect()
    assert sorted((r.row, r.field, r.message) for r in got) == [(1, "n", "must be a whole number"), (1, "pos", "must be one of G, F"), (3, "n", "is required")]
    assert validate.column_issues(["actual_pick", "fg_pct", "grade", "n"], ["n"])[0][0] == "error"
    guard = validate.Guard()
    guard.expect("always", True)
    guard.expect("never", False)
    with pytest.raises(AssertionError):
        guard.check()


def test_folds():
    assert model.folds([2014, 2015, 2016], 2015) == [([2014], 2015), ([2014, 2015], 2016)]


def test_chance_fit_is_the_penalised_optimum(spark):
    """The gradient of the balanced, penalised log loss is nothing at what the fit returns."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    fitted = model.fit_chance(df, ["a", "b"], "y", c=0.25)
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ np.array(fitted.coefficients) + fitted.intercept)))
    assert np.allclose(z.T @ (w * (p - y)) + np.array(fitted.coefficients) / 0.25, 0, atol=1e-3)
    assert abs((w * (p - y)).sum()) < 1e-3
    chance = [r.c for r in df.select((1 / (1 + F.exp(-fitted.score()))).alias("c")).collect()]
    assert np.allclose(chance, p)


def test_kendall_by_counting(spark, monkeypatch):
    """Tau-b over ties, constants, missing values and a group of many blocks, against all pairs."""
    import numpy as np

    monkeypatch.setattr(M, "KENDALL_BLOCK", 3)
    rng = np.random.default_rng(4)
    groups = {"ties": (rng.integers(0, 5, 60), rng.integers(0, 4, 60)), "plain": (rng.permutation(50), rng.permutation(50)), "constant": (np.ones(5), np.arange(5)), "two": (np.array([1, 2]), np.array([5, -5]))}
    rows = [(k, i, float(a), float(b)) for k, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + [("ties", 99, None, 1.0), ("ties", 98, 1.0, None)], "k string, id long, a double, b double")
    got = {r.k: r.kendall for r in M.kendall(df, ["k"], "a", "b", "id").collect()}
    for k, (x, y) in groups.items():
        upper = np.triu_indices(len(x), 1)
        p, q = np.sign(x[:, None] - x)[upper], np.sign(y[:, None] - y)[upper]
        bound = np.sqrt((p != 0).sum()) * np.sqrt((q != 0).sum())
        assert got[k] == (pytest.approx((p * q).sum() / bound) if bound else None)


def test_distances_by_rank(spark, monkeypatch):
    """Places and cuts of all distances, over several passes and blocks, against a sort of them; scores against their definition."""
    import numpy as np

    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    a, b = np.round(rng.random((30, 3)) * 100, 1), np.round(rng.random((25, 3)) * 100, 1)
    a[rng.random(a.shape) < 0.2] = np.nan
    a[3] = np.nan
    b[:5] = b[0]
    cell = lambda x: [None if np.isnan(v) else float(v) for v in x]
    left = spark.createDataFrame([(i, cell(x)) for i, x in enumerate(a)], "id long, vec array<double>")
    right = spark.createDataFrame([(i, cell(x)) for i, x in enumerate(b)], "other long, other_vec array<double>")
    far, _ = S.distances(a, b)
    want = np.sort([far[i, j] for i in range(30) for j in range(25) if i != j and not np.isnan(far[i, j])])
    for fine in (S.FINE, 20):
        monkeypatch.setattr(S, "FINE", fine)
        n, at = S.ranked_distances(left, right, "id", "other", 3, lambda n: [0, 17, n // 2, n - 1, n, -1])
        assert n == len(want) and at == {r: want[r] for r in (0, 17, n // 2, n - 1)}
    cuts = S.thresholds(left, right, "id", "other", 3)
    values = spark.createDataFrame([(float(v),) for v in [0.0, *want[::37], *(want[::41] + 1e-9), 1e6]], "v double").crossJoin(cuts)
    for r in values.select("v", S.score_from_thresholds(F.col("v"), F.col("cuts")).alias("s")).collect():
        between = round(100 * (n - (want < r.v).sum()) / n)
        assert r.s == between or r.v in want
    assert S.score_ranks(2) == {100: 0, 50: 1, 0: 1} and S.score_ranks(1)[100] == 0
    none = S.thresholds(left.limit(0), right, "id", "other", 3).select("n", S.score_from_thresholds(F.lit(1.0), F.col("cuts")).alias("s")).first()
    assert (none.n, none.s) == (0, None)


def test_distances_by_rank_count_copies_once(spark, monkeypatch):
    """Copies of both sides under other ids: the same as a sort of all distances, but equal vectors meet once, also beside a lone row."""
    import numpy as np

    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(7)
    a, b = np.round(rng.random((12, 3)) * 9), np.round(rng.random((9, 3)) * 9)
    a[2], a[4][1] = b[1], np.nan
    copies = 5
    mine = [(i + 100 * c, x) for c in range(copies) for i, x in enumerate(a)] + [(7000, a[0] + 0.5)]
    theirs = [(i + 100 * c, x) for c in range(copies) for i, x in enumerate(b)]
    cell = lambda x: [None if np.isnan(v) else float(v) for v in x]
    left = spark.createDataFrame([(i, cell(x)) for i, x in mine], "id long, vec array<double>")
    right = spark.createDataFrame([(i, cell(x)) for i, x in theirs], "other long, other_vec array<double>")
    want = np.sort([S.distances(x[None], y[None])[0][0, 0] for i, x in mine for j, y in theirs if i != j])
    met, counts = [], S.distance_counts
    monkeypatch.setattr(S, "distance_counts", lambda *args: met.append(counts(*args)) or met[-1])
    places = [0, 40, len(want) // 2, len(want) - 1]
    n, at = S.ranked_distances(left, right, "id", "other", 3, lambda n: places)
    assert n == len(want) and at == {r: want[r] for r in places}
    different = [len({tuple(cell(x)) for _, x in side}) for side in (mine, theirs)]
    assert met[0].agg(F.sum("pairs")).first()[0] == different[0] * different[1]


def test_season_sums_have_one_outcome(spark):
    """However rows are dealt, to the last bit: numbers whose sum hangs on its order."""
    import random

    rng = random.Random(4)
    rows = [(2020, a, 40 * a % 17 + g, 1 + g % 2, "2020-01-01", False, True, *[rng.random() * 10 ** rng.randint(-6, 6) for _ in A.SUMS]) for a in range(30) for g in range(40)]
    kinds = "season int, athlete_id long, game_id long, team_id long, game_date string, did_not_play boolean, starter boolean, " + ", ".join(f"{c} double" for c in A.SUMS)
    found, usual = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in ("1", "3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            box = spark.createDataFrame(rng.sample(rows, len(rows)), kinds).repartition(int(partitions) + 1)
            found.append(sorted(tuple(r) for r in A.season_in_context(box).select("athlete_id", *A.SUMS, *A.CONTEXT).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2]


def test_games_in_context_are_the_joined_ones(spark):
    """Windows over a game give what joining its teams gives: several teams, one team, no team, rows that count twice."""
    import random

    rng = random.Random(2)
    names = [*A.SUMS]
    rows = []
    for game in range(12):
        for athlete in range(8):
            team = None if athlete == 7 else rng.randint(1, 1 + game % 4)
            rows.append((2020, athlete, game, team, "2020-01-01", rng.random() < 0.1, rng.random() < 0.5, *[None if rng.random() < 0.1 else rng.randint(0, 30) / 2 for _ in names]))
    rows += rows[:5]
    kinds = "season int, athlete_id long, game_id long, team_id long, game_date string, did_not_play boolean, starter boolean, " + ", ".join(f"{c} double" for c in names)
    box = spark.createDataFrame(rows, kinds)
    pairs = A.opponents(A.team_games(box))
    own = A.played(A.deduped_games(box)).select("season", "athlete_id", "game_id", "team_id")
    want = own.join(pairs, ["season", "game_id", "team_id"], "left").groupBy("season", "athlete_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in A.CONTEXT])
    key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    assert key(A.team_context(box)) == key(want)
    both = A.season_in_context(box)
    assert key(both.select(*want.columns)) == key(want) and key(both.select("athlete_id", *A.SUMS)) == key(A.season_box(box).select("athlete_id", *A.SUMS))


def test_match_meets_equal_names_once(spark, monkeypatch):
    """Many people and players of few names: counts are those of all players, but names meet once."""
    from scoutframe.operators import identity

    names, schools = ["ann lee", "annie lee", "bob ray"], ["north", "south", None]
    people = [(i, names[i % 3], schools[i // 3 % 3]) for i in range(90)] + [(900, "anna lee", "north"), (901, "cy poe", "north")]
    players = [(i, names[i % 2], ["north"] if i % 4 else ["south state"]) for i in range(40)] + [(77, "bob ray", ["east"])]
    found, told = [], identity._told
    monkeypatch.setattr(identity, "_told", lambda *args: found.append(args[2]) or told(*args))
    df = spark.createDataFrame(people, "person_id long, name_key string, school string")
    index = spark.createDataFrame(players, "ident long, name_key string, schools array<string>")
    got = {r.person_id: (r.matched_id, r.method) for r in identity.match(df, index, spark.createDataFrame([], "person_id long, ident long")).collect()}
    want = {i: (77, "NAME") if n == "bob ray" else (None, "AMBIGUOUS") for i, n, _ in people[:90]} | {900: (None, "UNMATCHED"), 901: (None, "UNMATCHED")}
    assert got == want
    assert [f.agg(F.max("n" if k == 0 else "n_near")).first()[0] for k, f in enumerate(found)] == [20, 30]
    assert all(f.count() <= 10 for f in found)


@pytest.mark.parametrize("name", ["league_percentiles", "college_space", "board_methods", "grid_interpolate", "fold_metrics", "logit_fit"])
def test_seasons_are_summed_once(spark, name):
    """Sums of games are written once, so no later step reads games again, and no class is ranked or summed up in one window over its rows."""
    from scoutframe.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "rank(" not in plan and "percentile(" not in plan


def test_class_percentile_by_counts(spark):
    """The join with counts gives what the window gives: ties, missing values and a missing key; the same to the last bit."""
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", -1.0), ("a", None), ("a", 7.0), (None, 2.0), (None, None), (None, 0.0)], "k string, v double")
    got = rank.with_class_percentile(df, "v", ["k"], "p").select("k", "v", "p").collect()
    want = df.withColumn("p", rank.class_percentile(F.col("v"), ["k"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_average_precision_with_missing_scores(spark):
    """Missing scores come last; the sums run over buckets of scores."""
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.9, 0), ("a", 0.4, 1), ("a", None, 1), ("b", 0.5, 0)], "k string, p double, y int")
    got = {r.k: r.average_precision for r in M.average_precision(df, ["k"], "p", "y").collect()}
    assert got["b"] is None and abs(got["a"] - (0.5 + 2 / 3 + 3 / 4) / 3) < 1e-12
    plan = M.average_precision(df, ["k"], "p", "y")._jdf.queryExecution().executedPlan().toString()
    assert "__b" in plan  # no window over all scores of a key


def test_metrics_of_large_groups(spark):
    """NDCG by sums of discounts over places equals a count of every place, cut or not; later places follow from an integral."""
    import numpy as np

    rng = np.random.default_rng(3)
    score, gain = rng.integers(0, 40, 9000), rng.integers(0, 6, 9000).astype(float)
    df = spark.createDataFrame([("a", float(s), float(g)) for s, g in zip(score, gain)], "k string, s double, g double")
    share = 1 / np.log2(np.arange(1, 9001) + 1.0)
    for k in (None, 14):
        d = share * (np.arange(9000) < (k or 9000))
        order = np.argsort(-score, kind="stable")
        tied = np.array([gain[score == s].mean() for s in score[order]])
        want = (tied * d).sum() / (np.sort(gain)[::-1] * d).sum()
        plan = M.ndcg(df, ["k"], "s", "g", k)
        assert abs(plan.first().ndcg - want) < 1e-10
        assert "row_number" not in plan._jdf.queryExecution().executedPlan().toString()


def test_recall_goes_through_ties_by_id(spark):
    df = spark.createDataFrame([("a", 1.0 if i < 10 else 2.0, float(i + 1), i) for i in range(40)], "k string, p double, pick double, id long")
    got = M.class_recall(df, ["k"], "p", "pick", "id").first()
    assert (got.lottery_recall, got.first_round_recall, got.top_half_concentration) == (1.0, 1.0, 1.0)


def test_games_are_dealt_once(spark, monkeypatch):
    """Rows and pool of a query come from season rows that are written once; the pool doesn't go back to the games."""
    from scoutframe.plans import extra, more

    folder, made = "/root/testdata/sf0.001", []
    for module in (more, extra):
        monkeypatch.setattr(module, "rates", lambda *args, usual=module.rates: made.append(args) or usual(*args))
    for run in (extra._cuts, more._comparables, more.comparables_whole):
        made.clear()
        run(spark, folder)
        assert len(made) == 1
    assert not [f for f in more._pool(more._seasons(spark, folder)).inputFiles() if "lineitem" in f]


def test_nearest_of_all_keeps_rows_without_joining_them_back(spark):
    """Rows that have nobody stay as they are: one join with the others, one with what was found, and none that deals all results again."""
    df = spark.createDataFrame([(1, [1.0, 2.0], 70.0), (2, [1.0, None], 70.0), (3, [2.0, 2.0], None)], "id long, vec array<double>, height double")
    others = spark.createDataFrame([(7 + i, [float(i), 2.0], 70.0) for i in range(4)], "oid long, other_vec array<double>, other_height double")
    out = similar.nearest_of_all(df, others, ["id"], "id", "oid", 2, coverage=1.0)
    assert sorted((r.id, r.oid, r.status) for r in out.where("oid IS NOT NULL").collect()) == [(1, 7, "OK"), (1, 8, "OK"), (1, 9, "OK")]
    assert sorted((r.id, r.gate, r.status) for r in out.where("oid IS NULL").collect()) == [(2, None, "UNAVAILABLE"), (3, None, "UNAVAILABLE")]
    # two of the sides with their bands, one of what was found with its rows, and the two named above
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 5


def test_first_names_meet_by_their_first_letters(spark):
    """Names of one surname meet only where the first three letters agree; two letters are too few, and the longer begins with the shorter."""
    from scoutframe.operators import identity

    people = spark.createDataFrame([(1, "jon doe", "ohio"), (2, "jonathan doe", "ohio"), (3, "jo doe", "ohio"), (4, "joan roe", "ohio")], "person_id long, name_key string, school string")
    index = spark.createDataFrame([(11, "jonath doe", ["ohio"]), (12, "joanna roe", ["iowa"])], "ident long, name_key string, schools array<string>")
    out = identity.match(people, index, spark.createDataFrame([], "person_id long, ident long"))
    assert {r.person_id: (r.matched_id, r.method) for r in out.collect()} == {1: (11, "SURNAME_SCHOOL"), 2: (11, "SURNAME_SCHOOL"), 3: (None, "UNMATCHED"), 4: (None, "UNMATCHED")}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "surname#" in line]
    assert joins and all("start#" in line for line in joins)
