"""Audits of data sets, populations and payloads; each gives the rows or names that break a rule."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from scoutframe.operators.validate import PROHIBITED, Guard, denied_columns


def held_out_rows(df: DataFrame, year: str, held_out: Iterable[int]) -> DataFrame:
    """Rows of a year that no fit may see."""
    return df.where(F.col(year).isin(*held_out))


def assert_no_holdout(df: DataFrame, year: str, held_out: Iterable[int]) -> None:
    if not held_out_rows(df, year, held_out).isEmpty():
        raise AssertionError("rows of a held-out year")


def assert_target_free(df: DataFrame, what: str, names: tuple[str, ...] = PROHIBITED) -> None:
    if found := denied_columns(df.columns, names):
        raise AssertionError(f"{what} tells outcomes: {', '.join(found)}")


def temporal_audit(df: DataFrame, year: str, season: str) -> DataFrame:
    """Rows whose season ends after their draft year, or that lack either."""
    return df.where(F.col(year).isNull() | F.col(season).isNull() | (F.col(season) > F.col(year)))


def count_differences(df: DataFrame, year: str, expected: dict[int, int]) -> DataFrame:
    """(year, expected, found) where the counts of a population differ from what was announced, missing years included."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{year} int, expected long")
    found = df.groupBy(F.col(year).cast("int").alias(year)).agg(F.count("*").alias("found"))
    both = want.join(found, year, "full").select(year, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def fold_differences(predictions: DataFrame, rows: DataFrame, fold: str, ident: str) -> DataFrame:
    """(fold, missing, repeated): rows of a fold without a prediction, and with several."""
    n = predictions.groupBy(fold, ident).agg(F.count("*").alias("__n"))
    both = rows.select(fold, ident).distinct().join(n, [fold, ident], "left")
    out = both.groupBy(fold).agg(F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__n") > 1).alias("repeated"))
    return out.where("missing > 0 OR repeated > 0")


def id_stability(df: DataFrame, ident: str, season: str, name: str) -> DataFrame:
    """One row: ids, ids in several seasons, ids under several names, names under several ids."""
    per_id = df.groupBy(ident).agg(F.countDistinct(season).alias("s"), F.countDistinct(name).alias("n"))
    per_name = df.groupBy(name).agg(F.countDistinct(ident).alias("i"))
    a = per_id.agg(F.count("*").alias("ids"), F.count_if(F.col("s") > 1).alias("in_several_seasons"), F.count_if(F.col("n") > 1).alias("under_several_names"))
    return a.crossJoin(per_name.agg(F.count_if(F.col("i") > 1).alias("names_of_several_ids")))  # two rows of one


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of ``a``, how many of them ``b`` has, and their share."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct()
    hit = x.join(b.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("n"), F.count("__hit").alias("covered")).withColumn("share", F.when(F.col("n") > 0, F.col("covered") / F.col("n")))


def nested_names(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all fields of a schema, through structs, arrays and maps."""
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *nested_names(f.dataType, path)]
        return out
    if isinstance(kind, ArrayType):
        return nested_names(kind.elementType, prefix)
    if isinstance(kind, MapType):
        return nested_names(kind.valueType, prefix)
    return []


def payload_leaks(df: DataFrame, names: tuple[str, ...] = PROHIBITED) -> list[str]:
    """Fields of a nested payload, at any depth, that tell outcomes."""
    return [p for p in nested_names(df.schema) if denied_columns([p.rpartition(".")[2]], names)]


def text_leaks(df: DataFrame, column: str, tokens: tuple[str, ...] = PROHIBITED) -> DataFrame:
    """Rows whose JSON text has a key of these names."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.coalesce(F.col(column).rlike(rf'"{t}"\s*:'), F.lit(False))
    return df.where(hit)


def frozen(df: DataFrame, ident: str) -> str:
    """A digest of all rows, whatever their order: it tells whether a stored table changed between two phases."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    # sums of pieces of the row digests: merged in any order, one row for the driver
    parts = df.select(row.alias("h")).agg(F.count("*"), *[F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]).first()
    return hashlib.sha256("/".join(map(str, parts)).encode()).hexdigest()


def audit(df: DataFrame, ident: str, year: str, held_out: Iterable[int]) -> Guard:
    """The rules that every built data set keeps, collected."""
    guard = Guard()
    guard.expect("no outcome among the features", not denied_columns(df.columns))
    guard.expect_none("no held-out year", held_out_rows(df, year, held_out))
    guard.expect_none("ids are unique", df.groupBy(ident).count().where("count > 1"))
    guard.expect_none("ids are there", df.where(F.col(ident).isNull()))
    return guard
