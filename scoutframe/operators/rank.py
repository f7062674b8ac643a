"""Ranks and choices within a class; every order ends with a key, so ties have one outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.operators.peers import joined_on, running


def class_percentile(value: Column, keys: list[str]) -> Column:
    """(average rank - 0.5) / n within the class, strictly inside 0 and 1; NULL is 0.5 and moves nobody."""
    ranked = F.rank().over(Window.partitionBy(*keys).orderBy(value.asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    n = F.count(value).over(Window.partitionBy(*keys))
    return F.when(value.isNull(), 0.5).otherwise((ranked + (ties - 1) / 2 - 0.5) / n)


def with_class_percentile(df: DataFrame, value: str, keys: list[str], into: str) -> DataFrame:
    """Adds ``class_percentile`` of a column, by running counts of its distinct values: no task holds or sorts a class."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    placed = running(counts, keys, value, ["__c"])
    placed = placed.select(*keys, value, ((2 * F.col("__upto___c") - F.col("__c")) / (2 * F.col("__all___c"))).alias("__p"))
    out = joined_on(df, placed, [*keys, value])
    return out.withColumn(into, F.coalesce("__p", F.lit(0.5))).drop("__p")


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return numbered(df, keys, order, "__n").where(F.col("__n") <= n).drop("__n")


def best_label(scores: list[tuple[str, Column]], least: float) -> Column:
    """Label of the highest score at or above ``least``; of equal ones the first declared."""
    entries = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("label")) for k, (name, s) in enumerate(scores)])
    return F.array_max(F.filter(entries, lambda e: e["score"] >= least))["label"]


def top_columns(scores: list[tuple[str, Column]], n: int, least: float | None = None, most: float | None = None) -> Column:
    """Labels of the ``n`` highest columns at or above ``least``, or lowest at or below ``most``, as one text."""
    sign = 1 if most is not None else -1
    entries = F.array(*[F.struct((s * sign).alias("v"), F.lit(k).alias("k"), F.lit(name).alias("label"), s.alias("s")) for k, (name, s) in enumerate(scores)])
    kept = F.filter(entries, lambda e: e["s"].isNotNull() & (e["s"] >= least if most is None else e["s"] <= most))
    return F.array_join(F.transform(F.slice(F.array_sort(kept), 1, n), lambda e: e["label"]), ",")


def quantile_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Adds ``bin`` by quantile edges, equal edges dropped; the lowest edge belongs to the first bin."""
    from scoutframe.operators.quantiles import exact_quantiles

    edges = exact_quantiles(df, [], value, [k / bins for k in range(bins + 1)]).select(F.array_distinct("quantiles").alias("edges"))
    joined = df.crossJoin(F.broadcast(edges))  # one row
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return joined.withColumn("bin", F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0))).cast("long")).drop("edges")
