"""Seals, nested differences, imports in one scan, incremental seasons and canonical documents."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import bundles as B
from scoutframe.operators import imports as M
from scoutframe.operators import parity as P
from scoutframe.operators import sealed as S
from scoutframe.operators import validate as V
from scoutframe.sources import incremental as N


def predictions(spark, n=2000):
    return spark.range(n).select(F.col("id"), (F.col("id") * 0.37).alias("score"), F.when(F.col("id") % 3 > 0, "x").alias("name"))


def test_a_root_is_of_the_rows_alone(spark):
    rows = predictions(spark, 700).unionAll(predictions(spark, 5)).unionAll(spark.createDataFrame([(None, 1.0, None), (-400, 2.0, "y")], "id long, score double, name string"))
    root = lambda df: S.roots(S.tree(S.leaves(df, [], "id", width=8), [], 4), []).first()
    first = root(rows)
    assert first.n == 707 and first == root(rows.repartition(7, "score")) == root(rows.orderBy(F.desc("score")).coalesce(1))
    others = [rows.unionAll(rows.limit(1)), rows.where("id IS NOT NULL"), rows.withColumn("name", F.when(F.col("id") != 4, F.col("name"))), rows.withColumn("score", F.when(F.col("id") == 600, 0.0).otherwise(F.col("score")))]
    assert len({first.root, *(root(o).root for o in others)}) == 5
    assert S.tree(S.leaves(rows.limit(0), [], "id"), []).count() == 0


def test_evaluation_refuses_what_changed(spark, tmp_path):
    asked = []

    def targets():
        asked.append(1)
        return spark.createDataFrame([(1, 1), (2, 0)], "id long, drafted int")

    path = f"{tmp_path}/predictions"
    sealed = S.seal(predictions(spark), path, "id", {"config": "abc"})
    out = S.gated_evaluation(spark, sealed, "id", targets, lambda df: df.agg(F.count("*").alias("n"), F.sum("drafted").alias("drafted")), {"config": "abc"})
    assert tuple(out.first()) == (2000, 1) and asked == [1]
    with pytest.raises(S.Tampered, match="config"):
        S.gated_evaluation(spark, sealed, "id", targets, lambda df: df, {"config": "other"})
    with pytest.raises(AssertionError, match="drafted"):
        S.seal(predictions(spark).withColumn("drafted", F.lit(1)), f"{tmp_path}/leaky", "id")
    # one row of two thousand is another one
    changed = predictions(spark).withColumn("score", F.when(F.col("id") == 1234, 0.5).otherwise(F.col("score")))
    changed.write.mode("overwrite").parquet(path)
    with pytest.raises(S.Tampered) as error:
        S.gated_evaluation(spark, sealed, "id", targets, lambda df: df)
    assert error.value.ranges == [(1024, 1279, "changed")] and asked == [1]  # targets were not read again
    predictions(spark).where("id < 1900").write.mode("overwrite").parquet(path)
    with pytest.raises(S.Tampered) as error:
        S.unbroken(spark, sealed, "id")
    assert error.value.ranges == [(1792, 1999, "changed")]
    predictions(spark).write.mode("overwrite").parquet(path)
    assert S.unbroken(spark, sealed, "id").count() == 2000

    def meddles(df):
        changed.write.mode("overwrite").parquet(path)
        return spark.range(1)

    with pytest.raises(S.Tampered):
        S.gated_evaluation(spark, sealed, "id", targets, meddles)
    spark.read.parquet(sealed.tree_path).withColumn("digest", F.lit("0")).write.mode("overwrite").parquet(f"{tmp_path}/other.tree")
    with pytest.raises(S.Tampered, match="tree"):
        S.unbroken(spark, S.Seal(path, f"{tmp_path}/other.tree", sealed.root, sealed.n, {}), "id")


def test_differences_at_any_depth(spark):
    kind = "id long, a struct<b: array<struct<c: double, d: string>>, e: map<string, array<double>>>, f: double, g: boolean"
    base = [(1, ([(1.0, "x"), (2.0, None)], {"k": [1.0, 2.0], "l": []}), 0.5, True), (2, None, None, None), (3, ([], {}), float("nan"), False), (4, ([(1.0, "x")], {"k": [1.0]}), 1.0, True)]
    other = [(1, ([(1.0 + 1e-12, "x"), (2.5, "new")], {"k": [1.0, 2.0, 3.0], "m": [7.0]}), 0.5, False), (2, None, None, None), (3, ([], {}), float("nan"), False), (5, ([(1.0, "x")], {"k": [1.0]}), 1.0, True)]
    left, right = (spark.createDataFrame(rows, kind) for rows in (base, other))
    found = P.differences(left, right, ["id"])
    got = {(r.id, r.path, r.kind) for r in found.where("id < 4").collect()}
    assert got == {
        (1, "a.b[1].c", "changed"), (1, "a.b[1].d", "changed"), (1, "a.e{k}[2]", "only_right"), (1, "a.e{l}", "only_left"), (1, "a.e{m}[0]", "only_right"), (1, "g", "changed"),
    }
    assert {r.kind for r in found.where("id = 4").collect()} == {"only_left"} and {r.kind for r in found.where("id = 5").collect()} == {"only_right"}
    assert P.differences(left, left, ["id"]).count() == 0
    assert {(r.column, r.changed, r.largest) for r in P.summary(found).where("changed > 0").collect()} == {("a.b.c", 1, 0.5), ("a.b.d", 1, None), ("g", 1, None)}
    wide = P.differences(left, right, ["id"], tolerances={"a.b.c": 0.6})
    assert wide.where("path = 'a.b[1].c'").count() == 0


def test_import_in_one_scan(spark, tmp_path):
    rows = [(k, None if k == 3 else f"p{k % 9}", "1,250" if k == 1 else "x" if k == 2 else str(k), None, "  ") for k in range(12)]
    spark.createDataFrame(rows, "row long, id string, games string, height double, weight string").write.parquet(f"{tmp_path}/in")
    schema = M.Schema([V.Field("id", True), V.Field("games", True, 0, 100, True), V.Field("height"), V.Field("weight"), V.Field("absent", True)], {"box": ["games"], "size": ["height", "weight"], "none": ["absent"]})
    df = spark.read.parquet(f"{tmp_path}/in")
    got = M.analysed(df, "row", "id", schema, V.field_checks(schema.fields[:2]), {"stats": ["box"], "fit": ["box", "size", "none"]})
    assert got.rows == 12 and got.present == {"id": 11, "games": 12, "height": 0, "weight": 0, "absent": 0} and got.groups == {"box": 12, "size": 0, "none": 0}
    assert got.never_present() == ["height", "weight", "absent"] and got.capabilities == {"stats": "", "fit": "size,none"} and got.failed()
    separate = V.row_issues(df, "row", V.field_checks(schema.fields[:2])).unionAll(V.duplicate_issues(df, "row", "id").select("row", "severity", "field", "message"))
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(got.issues) == key(separate) and len(key(separate)) == 2 + 1 + 3
    assert sorted(r.row for r in got.clean.collect()) == [0, 4, 5, 6, 7, 8] and ("error", "absent", "is required") in got.general
    # what comes after reads what the scan left behind, not the input
    for part in (got.issues, got.clean):
        assert f"{tmp_path}/in" not in part._jdf.queryExecution().toString()
    assert schema.required() == ["id", "games", "absent"] and schema.document()["fields"][1]["group"] == "box" and schema.group_fields("size") == ["height", "weight"]


def test_only_changed_seasons_are_read(spark, tmp_path):
    def put(year, n, part=""):
        rows = spark.range(n).select(F.col("id"), F.lit(year).alias("y")).toPandas()
        rows.to_parquet(f"{tmp_path}/box{part}_{year}.parquet")

    read = []

    def transform(df):
        read.append(sorted(os.path.basename(f) for f in df.inputFiles()))
        return df.groupBy("season").agg(F.count("*").alias("n"))

    def run():
        return N.refreshed(spark, f"{tmp_path}/box*.parquet", f"{tmp_path}/out", transform)

    def out():
        return {r.season: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    for year, n in ((2020, 3), (2021, 4), (2022, 5)):
        put(year, n)
    put(2021, 10, "_more")
    assert run() == [(2020, "new"), (2021, "new"), (2022, "new")] and out() == {2020: 3, 2021: 14, 2022: 5}
    assert run() == [] and len(read) == 1
    put(2021, 6)
    assert run() == [(2021, "changed")] and out() == {2020: 3, 2021: 16, 2022: 5}
    # all files of the season, and of no other
    assert read[1:] == [["box_2021.parquet", "box_more_2021.parquet"]]
    os.remove(f"{tmp_path}/box_2022.parquet")
    put(2023, 1)
    assert run() == [(2022, "gone"), (2023, "new")] and out() == {2020: 3, 2021: 16, 2023: 1} and run() == []


def test_documents_are_the_same_bytes(spark):
    rng = random.Random(5)
    rows = [(2020 + k % 2, f"g{k % 5}", f'm"{k // 10}é', rng.choice([None, float("nan"), float("inf"), -0.0, 1e-9, 2.5, 123456.7890125]), k) for k in range(100)]
    long = spark.createDataFrame(rows, "season int, position string, metric string, mean double, n long").dropDuplicates(["season", "position", "metric"])
    make = lambda df: {r.season: r.doc for r in B.document(B.nested(df, ["season"], "position", "metric", ["n", "mean"], "moments"), ["season"]).collect()}
    kept = long.cache()
    a, b = make(kept.repartition(1)), make(kept.repartition(9, "n"))
    assert a == b and set(a) == {2020, 2021}
    for season, text in a.items():
        doc = json.loads(text)
        assert doc["season"] == season and list(doc) == ["moments", "season"] and list(doc["moments"]) == sorted(doc["moments"])
        for r in kept.where(f"season = {season}").collect():
            value = doc["moments"][r.position][r.metric]
            finite = r.mean is not None and abs(r.mean) < float("inf")
            assert value["n"] == r.n and (value["mean"] == pytest.approx(r.mean, abs=1e-6) if finite else value["mean"] is None)
        assert "-0.0" not in text and "E" not in text.replace("é", "")
    both = B.supported_seasons(kept.where("season = 2020"), kept, kept)
    assert [r.season for r in both.collect()] == [2020]


def test_bundle_files(spark, tmp_path):
    moments = spark.createDataFrame([(2020, "G", "a", 1.0, 2.0), (2021, "G", "a", 1.5, None)], "season int, position string, metric string, mean double, std double")
    grid = spark.createDataFrame([(2020, "GLOBAL", "a", [0.0, 1.0], 60)], "season int, reference_group string, metric string, grid array<double>, n long")
    docs = B.season_bundle(moments, grid, "season", "position")
    assert [r.doc for r in docs.collect()] == ['{"grids":{"GLOBAL":{"a":{"grid":[0.000000,1.000000],"n":60}}},"moments":{"G":{"a":{"mean":1.000000,"std":2.000000}}},"season":2020}']
    B.write_documents(B.season_documents(moments.withColumn("n", F.lit(1)), "season", "position"), f"{tmp_path}/docs", "season")
    files = [f for d, _, names in os.walk(f"{tmp_path}/docs") for f in names if f.endswith(".txt")]
    assert len(files) == 2
