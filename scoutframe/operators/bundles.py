"""Documents for publication: nested maps from long tables, and a text of them that is the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, MapType, NumericType, StructType

#: Places of a number in a document.
PLACES = 6


def quoted(text: Column) -> Column:
    """Text as JSON writes it."""
    return F.substr(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def canonical(value: Column, kind: DataType, places: int = PLACES) -> Column:
    """The one JSON text of a value: keys in order at any depth, broken numbers to fixed places, what is missing or no finite number as null."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType, places)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, places)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType, places).alias("v")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, DoubleType | FloatType | DecimalType):
        finite = F.when(F.abs(value) < float("inf"), value) if not isinstance(kind, DecimalType) else value
        fixed = F.round(finite.cast("decimal(38,9)"), places).cast(f"decimal(38,{places})")
        text = F.when(fixed == 0, F.lit(0).cast(f"decimal(38,{places})").cast("string")).otherwise(fixed.cast("string"))
    elif isinstance(kind, NumericType | BooleanType):
        text = value.cast("string")
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def document(df: DataFrame, keys: list[str], into: str = "doc", places: int = PLACES) -> DataFrame:
    """(keys, doc): every row as one canonical document of all its columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(*keys, canonical(whole, StructType(df.schema.fields), places).alias(into))


def nested(df: DataFrame, keys: list[str], outer: str, inner: str, values: list[str], into: str) -> DataFrame:
    """(keys, into): a map of maps, from ``outer`` to ``inner`` to the ``values``, by aggregating twice; rows without a key of a map are left out."""
    rows = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull())
    one = F.struct(F.col(inner).cast("string").alias("key"), F.struct(*values).alias("value"))
    own = rows.groupBy(*keys, F.col(outer).cast("string").alias("__outer")).agg(F.map_from_entries(F.collect_list(one)).alias("__inner"))
    return own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__outer", "__inner"))).alias(into))


def season_documents(moments: DataFrame, season: str, group: str) -> DataFrame:
    """(season, doc): the moments of all groups and metrics of a season, as one document."""
    whole = nested(moments, [season], group, "metric", ["mean", "n", "std"], "moments")
    return document(whole, [season])


def season_bundle(moments: DataFrame, grid: DataFrame, season: str, group: str) -> DataFrame:
    """(season, doc): moments and grids of the seasons that have both, one document each."""
    a = nested(moments, [season], group, "metric", ["mean", "std"], "moments")
    b = nested(grid, [season], "reference_group", "metric", ["grid", "n"], "grids")
    return document(a.join(b, season), [season])


def supported_seasons(*references: DataFrame, season: str = "season") -> DataFrame:
    """(season): seasons that all of the references have."""
    out = references[0].select(season).distinct()
    for other in references[1:]:
        out = out.intersect(other.select(season))
    return out


def class_payload(scored: DataFrame, season: str, ident: str, board: list[str], dimensions: list[str], archetypes: list[str]) -> DataFrame:
    """(season, doc): a class as pages read it: prospects by rank with board, dimensions, archetypes and comparables, in one document a season.

    ``scored`` as ``scoring.scored_class`` gives it; dimensions go out to one place, and who has no board rank comes last.
    """
    dims = F.struct(*[F.round(F.col(d).cast("decimal(38,9)"), 1).cast("double").alias(d) for d in dimensions])
    fits = F.struct(*[F.struct(F.col(f"{p}_score").alias("score"), F.col(f"{p}_eligibility").alias("eligibility")).alias(p) for p in archetypes])
    one = F.struct(F.col(ident).alias("id"), F.struct(*board).alias("board"), dims.alias("dimensions"), fits.alias("profiles"), F.col("comparables"), F.col("comparables_status"))
    order = F.struct(F.col("board_rank").isNull().alias("__last"), F.col("board_rank").alias("__rank"), F.col(ident).alias("__id"), one.alias("p"))
    rows = scored.groupBy(season).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]).alias("prospects"))
    return document(rows, [season])


def write_documents(docs: DataFrame, path: str, by: str) -> None:
    """One text file for each value of ``by``, below a folder of its name."""
    docs.select(by, "doc").repartition(by).write.mode("overwrite").partitionBy(by).text(path)
