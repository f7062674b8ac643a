"""Readers: seasons from file names, populations with their ids, import files."""

import json

from scoutframe.operators import space, validate
from scoutframe.sources import tables


def test_seasons_of_files(spark, tmp_path):
    for year, n in ((2019, 2), (2020, 3)):
        spark.range(n).toPandas().to_parquet(f"{tmp_path}/player_box_{year}.parquet")
    rows = tables.seasons(spark, f"{tmp_path}/player_box_*.parquet")
    assert sorted((r.season, r.id) for r in rows.collect()) == [(2019, 0), (2019, 1), (2020, 0), (2020, 1), (2020, 2)]
    one = tables.seasons(spark, [f"{tmp_path}/player_box_2020.parquet"], "id long")
    assert one.count() == 3 and one.columns == ["id", "season"]


def test_population_has_ids(spark, tmp_path):
    lines = ["draft_year,player_name,normalized_name,college,position,class,population_source,early_entrant,wikipedia_title", "2020,Al B. Cee,al b cee,X,G,so,s,True,T", "2020,No One,no one,Y,F,sr,s,False,T"]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    rows = tables.population(spark, f"{tmp_path}/p.csv").collect()
    assert [(r.canonical_prospect_id, r.player_name) for r in rows] == [("2020-al_b_cee", "Al B. Cee")]


def test_import_file(spark, tmp_path):
    doc = {"schemaVersion": 1, "metadata": {"dataset_name": "d", "season": 2020, "population_type": "custom", "draft_size": 60}, "prospects": [{"prospect_id": "a", "games": 3, "extra": 1}, {"prospect_id": "b"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    rows = tables.imported(spark, f"{tmp_path}/d.json", "prospect_id: string, games: double").orderBy("row").collect()
    assert [(r.row, r.prospect_id, r.games, r.metadata.season) for r in rows] == [(0, "a", 3.0, 2020), (1, "b", None, 2020)]


def test_same_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (2,), (1,)], "k long")
    assert validate.same_keys(a, b, "k") and not validate.same_keys(a, b.distinct(), "k") and not validate.same_keys(a.limit(0), b, "k")


def test_league_reference(spark):
    rows = [(2020, 1, "G", 300.0, 12, 0.5), (2020, 2, "F", 199.0, 12, 0.6), (2020, 3, "C", 300.0, 9, 0.7), (2019, 4, "G", 300.0, 12, 0.8)]
    frame = spark.createDataFrame(rows, "season int, athlete_id long, position_3 string, minutes double, games_played long, ts_pct double")
    got = space.league_reference(frame, [2020], ["ts_pct", "absent"])
    assert got.columns == ["season", "athlete_id", "position_3", "ts_pct"] and [r.athlete_id for r in got.collect()] == [1]
