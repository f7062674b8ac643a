"""Assembly, readers and writers, guards, views and the common space on micro tables."""

import json

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import assembly as D
from scoutframe.operators import guards as G
from scoutframe.operators import metrics as M
from scoutframe.operators import space as C
from scoutframe.operators import validate as V
from scoutframe.operators import views as W
from scoutframe.sources import sinks, tables


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "athlete_id long, fga double, athlete_id_sh string")
    assert D.without_prefix(df, "athlete_id").columns == ["fga"]
    assert D.with_missing(df, ["fga", "steals"]).first().steals is None
    assert D.feature_columns(df, ("athlete_id",)) == ["fga"]
    sets = {"all": {"features": ["a", "b", "c"]}, "less": {"extends": "all", "features": ["d", "a"], "remove": ["b"]}}
    assert D.feature_set(sets, "less") == ["a", "c", "d"]
    with pytest.raises(KeyError):
        D.feature_set({"x": {"features": ["a"], "remove": ["z"]}}, "x")


def test_prospect_features_keep_everyone(spark):
    people = spark.createDataFrame([(2021, 7, "a"), (2021, None, "b"), (2020, 9, "c")], "season int, athlete_id long, prospect string")
    box = spark.createDataFrame([(2021, 7, 5, 1, 10.0, 4.0, 6.0, 3.0)], "season int, athlete_id long, games_played long, n_teams long, fga double, fgm double, tpa double, tpm double")
    shots = spark.createDataFrame([(7, 11)], "athlete_id long, fg_attempts long")
    bio = spark.createDataFrame([(7, "PG"), (9, "C")], "athlete_id long, label string")
    out = D.prospect_features(people, box, shots, bio)
    rows = {r.prospect: r for r in out.collect()}
    assert len(rows) == 3 and (rows["a"].two_points_made, rows["a"].two_points_attempted, rows["a"].fg_attempts, rows["a"].short_season) == (1.0, 4.0, 11, 1)
    assert rows["b"].games_played is None and rows["c"].label == "C"
    stats = D.build_stats(out, "season", "athlete_id")
    assert {r.season: (r.prospects, r.matched, r.with_box) for r in stats.collect()} == {2021: (2, 1, 1), 2020: (1, 1, 0)}
    assert D.gates(out, "prospect", stats, 0.9) == ["most prospects are matched"] and D.gates(out, "prospect", stats, 0.5) == []
    back, new = D.returning_and_incoming(people, box.drop("season"))
    assert [r.prospect for r in back.collect()] == ["a"] and sorted(r.prospect for r in new.collect()) == ["b", "c"]


def test_targets_and_status(spark):
    people = spark.createDataFrame([(2021, "a"), (2021, "b"), (2022, "c")], "y int, n string")
    targets = spark.createDataFrame([("a", "True", "3"), ("b", "False", "")], "n string, drafted string, pick string")
    got = {r.n: (r.drafted, r.pick) for r in D.with_targets(people, targets, ["n"], "left").collect()}
    assert got == {"a": (1, 3.0), "b": (0, None), "c": (None, None)}
    assert {r.n: r.draft_size for r in D.with_size(people, {2021: 60}, "y").collect()} == {"a": 60, "b": 60, "c": None}
    status = D.with_status(people, spark.createDataFrame([("a", "WITHDRAWN")], "n string, status string"), "n")
    assert {r.n: r.status for r in status.collect()} == {"a": "WITHDRAWN", "b": "UNKNOWN", "c": "UNKNOWN"}


def test_readers(spark, tmp_path):
    (tmp_path / "targets.csv").write_text("draft_year,normalized_name,player_name,wikipedia_title,drafted,pick,round,drafting_team\n2020,a b,A B,t,True,5,1,X\n2020,c,C,t,False,,,\n2020,z,Z,t,True,x,1,Y\n")
    known = spark.createDataFrame([("a b",), ("c",)], "normalized_name string")
    got = tables.targets(spark, str(tmp_path / "targets.csv"), known).orderBy("normalized_name").collect()
    assert [(r.drafted, r.pick) for r in got] == [(1, 5), (0, None)]
    assert tables.declared(spark, str(tmp_path / "none.csv")) is None and tables.overrides(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "o.csv").write_text("draft_year,normalized_name,athlete_id,player_name,expected_school,hoopr_name,reason\n2020,a b,12.0,A,S,H,r\n2020,c,,C,S,H,r\n")
    assert [r.athlete_id for r in tables.overrides(spark, str(tmp_path / "o.csv")).collect()] == [12]
    with pytest.raises(FileNotFoundError):
        tables.built(spark, str(tmp_path / "pool"), "the pool")
    feats = spark.createDataFrame([(2020, "a b", 1.0), (2026, "q", 2.0)], "draft_year int, normalized_name string, v double")
    known = tables.targets(spark, str(tmp_path / "targets.csv"), known)
    assert tables.labelled(feats, known, range(2019, 2022)).count() == 1
    with pytest.raises(ValueError):
        tables.labelled(feats, known, range(2020, 2027), (2026,))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan"), "x"), (1, 1.5, None)], "id int, v double, t string")
    sinks.write_json(df, str(tmp_path / "j"), "id")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("*.json")) for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "t": None, "v": 1.5}, {"id": 2, "t": "x", "v": None}]
    sinks.write_csv(df, str(tmp_path / "c"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "t", "v"]
    sinks.write_parquet(df, str(tmp_path / "p"), ["t"])
    assert tables.built(spark, str(tmp_path / "p"), "p").count() == 2
    a = sinks.write_document({"b": 1, "a": 2}, str(tmp_path / "d.json"))
    assert sinks.read_document(str(tmp_path / "d.json")) == {"a": 2, "b": 1} and a == sinks.write_document({"a": 2, "b": 1}, str(tmp_path / "e.json"))
    with pytest.raises(FileNotFoundError):
        sinks.read_document(str(tmp_path / "none.json"))
    assert sinks.upsert_manifest({"x": {"rows": 1}}, "x", {"sha": "s"}) == {"x": {"rows": 1, "sha": "s"}}
    assert sinks.template(["a", "b"], {"a": 1}, 2027)["prospects"] == [{"a": 1, "b": None}]


def test_guards(spark):
    df = spark.createDataFrame([(1, 2020, 5.0), (2, 2026, 6.0), (2, 2020, 7.0)], "id int, year int, v double")
    with pytest.raises(AssertionError):
        G.assert_no_holdout(df, "year", [2026])
    G.assert_no_holdout(df.where("year = 2020"), "year", [2026])
    with pytest.raises(AssertionError):
        G.assert_target_free(df.withColumn("pick", F.lit(1)), "features")
    nested = df.select("id", F.array(F.struct(F.struct(F.lit(1).alias("drafted"), F.lit(2).alias("v")).alias("deep"))).alias("rows"))
    assert G.payload_leaks(nested) == ["rows.deep.drafted"]
    assert G.frozen(df, "id") == G.frozen(df.repartition(3), "id") != G.frozen(df.where("id = 1"), "id")
    report = G.audit(df, "id", "year", [2026]).report()
    assert sum(x.startswith("FAILED") for x in report) == 2


def test_import_rules():
    good = {"schemaVersion": 1, "dataset_name": "x", "season": 2026, "population_type": "custom", "draft_size": 60}
    assert V.metadata_issues(good, (2026,)) == []
    assert [i[:2] for i in V.metadata_issues({**good, "season": 2030}, (2026,))] == [("warning", "season")]
    bad = {"schemaVersion": 2, "dataset_name": " ", "season": True, "population_type": "?", "draft_size": 0}
    assert {i[1] for i in V.metadata_issues(bad, (2026,))} == set(bad)
    assert V.row_limit_issues(4) and V.row_limit_issues(2001) and not V.row_limit_issues(5)


def test_views(spark):
    df = spark.createDataFrame([(1, "Ann Bo", 1, "G"), (2, "Bob", None, "G"), (3, "Bonny", 2, "C")], "id int, name string, rank int, position string")
    assert [r.id for r in W.board_list(df, "name", "rank", " BO ").collect()] == [1, 3]
    assert [r.id for r in W.board_list(df, "name", "rank", "bo", "C").collect()] == [3]
    assert W.detail(df, "id", 2).first().name == "Bob"
    issues = spark.createDataFrame([(1, "warning", "a", "m"), (2, "error", "b", "m")], "row int, severity string, field string, message string")
    assert [r.row for r in W.first_issues(issues, "row", 1).collect()] == [2]
    assert W.sampled(df, "id", 2, 5).collect() == W.sampled(df.repartition(3), "id", 2, 5).collect()


def test_space(spark):
    pool = spark.createDataFrame([(i, "G" if i < 40 else "C", float(i)) for i in range(50)], "id int, position string, v double")
    out = {r.id: r.d for r in C.pro_space(pool, ["id"], {"d": ["v"]}, (), "position").collect()}
    assert out[0] == pytest.approx(100 * 1 / 80) and out[45] == pytest.approx(100 * (45 + 46) / 100)  # ten centres are too few to be peers
    heights = spark.createDataFrame([(0, 80.0), (0, 78.0), (1, None)], "id int, height_inches double")
    named = C.prepared_pool(pool.withColumn("name", F.lit("J. Doe Jr.")), heights, "id", "name")
    row = {r.id: r for r in named.collect()}
    assert len(row) == 50 and row[0].height_inches == 78.0 and row[1].height_inches is None and row[2].name_key == "j doe"
    met = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("", "", 3), (None, "b", 4)], "k string, o string, id int")
    assert sorted(r.id for r in C.without_self(met, "k", "o").collect()) == [2, 3, 4]


def test_constant_prediction_has_no_rank_metrics(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 2, 5.0, 2.0), ("a", 3, 5.0, 3.0)], "g string, id int, pred double, pick double").withColumn("size", F.lit(60.0))
    got = M.order_metrics(df, ["g"], "pred", "pick", "size", "id").first()
    assert got.spearman is None and got.ndcg is None and got.mae == pytest.approx(3.0) and got.lottery_recall == 1.0


def test_names_join_after_schools(spark):
    """The index of rows without names is that of rows with them; who has no name is not in it."""
    from scoutframe.operators import identity as I

    rows = spark.createDataFrame([(1, 7, "ohio"), (1, 7, "iowa"), (1, 7, "iowa"), (2, 7, "utah"), (1, 8, "ohio"), (1, None, "ohio"), (1, 9, "ohio")], "season int, athlete long, school string")
    names = spark.createDataFrame([(7, "ann b"), (7, "ann a"), (8, "cy d")], "athlete long, name_key string")
    got = I.named_index(rows, names, "athlete", "name_key", "school", ("season",))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, "ann a", ["iowa", "ohio"], 3), (1, 8, "cy d", ["ohio"], 1), (2, 7, "ann a", ["utah"], 1)]


def test_stats_and_gates_write_what_they_read(spark, monkeypatch):
    """A build writes seven columns for its stats and gates; features keep all their columns, and gates look at all their names."""
    from scoutframe.operators import assembly

    wrote, usual = [], assembly.stored
    monkeypatch.setattr(assembly, "stored", lambda df: wrote.append(df.columns) or usual(df))
    rows = [(2020, 1, "ann", "ohio", 5, "NAME", 9, 3, 1, 0.5, 4), (2020, 2, "bob", "ohio", None, "UNMATCHED", None, None, None, None, None)]
    people = spark.createDataFrame(rows, "season int, person_id long, name_key string, school string, athlete_id long, method string, games_played long, fg_attempts long, n_teams long, ts_pct double, pick long")
    targets = spark.createDataFrame([(1, "True", "4")], "person_id long, drafted string, pick string")
    built = assembly.build_dataset(people, targets, expected={2020: 2}, least_matched=0.4)
    assert wrote == [["season", "person_id", "athlete_id", "method", "games_played", "fg_attempts", "n_teams"]]
    assert built.features.columns == [c for c in people.columns if c not in ("method", "school", "name_key")]
    assert built.failed() == ["features have targets", "no outcome among the features"]
