"""Differences of nested tables: structs, arrays and maps become rows of path and value, and two tables meet by key and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

_ENTRY = "array<struct<path:string,text:string,number:double>>"


def _flat(value: Column, kind: DataType, path: Column) -> Column:
    """All leaves of a value as (path, text, number); an empty array or map, and a NULL, is a leaf."""
    leaf = lambda text, number: F.array(F.struct(path.alias("path"), text.cast("string").alias("text"), number.cast("double").alias("number"))).cast(_ENTRY)
    none = leaf(F.lit(None), F.lit(None))
    if isinstance(kind, StructType):
        parts = [_flat(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(value.isNull(), none).otherwise(F.concat(*parts) if parts else leaf(F.lit("{}"), F.lit(None)))
    if isinstance(kind, ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: _flat(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), none).when(F.size(value) == 0, leaf(F.lit("[]"), F.lit(None))).otherwise(inner)
    if isinstance(kind, MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda e: _flat(e["value"], kind.valueType, F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")))))
        return F.when(value.isNull(), none).when(F.size(value) == 0, leaf(F.lit("{}"), F.lit(None))).otherwise(inner)
    return leaf(value, value if isinstance(kind, NumericType) else F.lit(None))


def flattened(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, text, number): every leaf of every other column of a row; ``column.field[0]{key}`` says where it stands."""
    own = [_flat(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name not in keys]
    whole = F.concat(*own) if own else F.array().cast(_ENTRY)
    return df.select(*keys, F.explode(whole).alias("e")).select(*keys, "e.path", "e.text", "e.number")


def column_of(path: Column) -> Column:
    """A path without indexes and keys: what it is a value of."""
    return F.regexp_replace(path, r"\[\d+\]|\{[^}]*\}", "")


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9, tolerances: dict[str, float] | None = None) -> DataFrame:
    """(keys, path, left, right, gap, kind): leaves that differ, of two tables with unique keys.

    Numbers agree within ``tolerance``, or that of ``tolerances`` for their path without indexes; all else must be equal, and a missing
    value agrees with a missing value alone.  ``kind``: "changed", or "only_left" and "only_right" for what one side lacks.
    """
    a = flattened(left, keys).select(*[F.col(k).alias(f"__l_{k}") for k in keys], F.col("path").alias("__l_path"), F.struct("text", "number").alias("a"))
    b = flattened(right, keys).select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("path").alias("__r_path"), F.struct("text", "number").alias("b"))
    on = F.col("__l_path") == F.col("__r_path")
    for k in keys:
        on = on & F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}"))
    both = a.join(b, on, "full")
    path = F.coalesce("__l_path", "__r_path")
    limit = F.lit(float(tolerance))
    for name, own in (tolerances or {}).items():
        limit = F.when(column_of(path) == name, F.lit(float(own))).otherwise(limit)
    gap = F.abs(F.col("a.number") - F.col("b.number"))
    same = F.when(gap.isNotNull() & ~F.isnan(gap), gap <= limit).otherwise(F.col("a.text").eqNullSafe(F.col("b.text")))
    kind = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").otherwise("changed")
    out = both.select(*[F.coalesce(f"__l_{k}", f"__r_{k}").alias(k) for k in keys], path.alias("path"), F.col("a.text").alias("left"), F.col("b.text").alias("right"), gap.alias("gap"), kind.alias("kind"), same.alias("__same"))
    return out.where((F.col("kind") != "changed") | ~F.col("__same")).drop("__same")


def summary(found: DataFrame) -> DataFrame:
    """(column, changed, only_left, only_right, largest): differences by path without indexes."""
    return found.groupBy(column_of(F.col("path")).alias("column")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("changed", "only_left", "only_right")], F.max("gap").alias("largest")
    )
