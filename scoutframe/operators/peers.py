"""Peer populations: moments, quantile grids, z-scores and percentiles of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators.quantiles import bucket, exact_quantiles, from_counts

STEPS = [q / 100 for q in range(101)]


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value").where("value IS NOT NULL")


def spreads(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Count, mean and sample deviation of every group and metric."""
    return long_metrics(df, keys, metrics).groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def moments(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Count, mean, sample deviation, median and four more quantiles of every group and metric."""
    steps = (50, 10, 25, 75, 90)
    rows, found = long_metrics(df, keys, metrics), spreads(df, keys, metrics)
    placed = exact_quantiles(rows, [*keys, "metric"], "value", [q / 100 for q in steps])
    quantiles = [F.col("quantiles")[k].alias("median" if q == 50 else f"p{q}") for k, q in enumerate(steps)]
    return joined_on(found, placed.drop("n"), [*keys, "metric"]).select(*keys, "metric", "n", "mean", "std", *quantiles)


def joined_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which a null key is a key like any other."""
    side = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    whole = on[0]
    for c in on[1:]:
        whole = whole & c
    return left.join(side, whole, "left").drop(*[f"__r_{k}" for k in keys])


def grids(df: DataFrame, season: str, group: str, metrics: list[str], least: int = 50) -> DataFrame:
    """101-point quantile grids for each group and for all (GLOBAL); groups with fewer values have none."""
    rows = long_metrics(df, [season, group], metrics)
    scopes = F.when(F.col(group).isNotNull() & (F.col(group) != "UNKNOWN"), F.array(F.lit("GLOBAL"), F.col(group))).otherwise(F.array(F.lit("GLOBAL")))
    # each value is counted once for its group before it is told to both
    counts = rows.groupBy(season, scopes.alias("__scopes"), "metric", "value").agg(F.count("*").alias("c"))
    keys = [season, "reference_group", "metric"]
    told = counts.withColumn("reference_group", F.explode("__scopes")).groupBy(*keys, "value").agg(F.sum("c").alias("n"))
    placed = from_counts(told, keys, "value", STEPS).where(F.col("n") >= least)
    return placed.select(*keys, F.col("quantiles").alias("grid"), "n")


def grid_percentiles(df: DataFrame, grid: DataFrame, season: str, group: str, metric: str) -> DataFrame:
    """Adds ``percentile`` of one metric: from the group's own grid, else from GLOBAL."""
    # a hundred numbers for each season and group, so no row carries them through a shuffle
    g = grid.where(F.col("metric") == metric)
    own = g.select(F.col(season), F.col("reference_group").alias(group), F.col("grid").alias("__own"))
    every = g.where("reference_group = 'GLOBAL'").select(F.col(season), F.col("grid").alias("__all"))
    return (
        df.join(F.broadcast(own), [season, group], "left")
        .join(F.broadcast(every), [season], "left")
        .withColumn("percentile", X.interpolate(F.coalesce("__own", "__all"), F.col(metric)))
        .drop("__own", "__all")
    )


def season_relative(df: DataFrame, reference: DataFrame, season: str, group: str, metrics: list[str], fallback: str = "G") -> DataFrame:
    """Replaces metrics by z-scores of (season, group); a missing group takes the fallback's, no spread gives NULL."""
    table = reference.groupBy(season, group).agg(
        *[F.max(F.when(F.col("metric") == m, F.struct("mean", "std"))).alias(f"__{m}") for m in metrics]
    )
    other = table.where(F.col(group) == fallback).drop(group)
    for m in metrics:
        other = other.withColumnRenamed(f"__{m}", f"__{m}_fallback")
    out = df.join(table, [season, group], "left").join(other, [season], "left")
    for m in metrics:
        ref = F.coalesce(f"__{m}", f"__{m}_fallback")
        out = out.withColumn(m, F.when(ref["std"] > 0, (F.col(m) - ref["mean"]) / ref["std"]))
    return out.drop(*[f"__{m}{x}" for m in metrics for x in ("", "_fallback")])


def midrank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``midrank``: 100 * (below + at or below) / 2n within its own keys; NULL values have none and count nowhere."""
    own = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    present = F.col(value).isNotNull()
    upto = F.sum(present.cast("long")).over(own)
    same = F.count(value).over(Window.partitionBy(*keys, value))
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn("midrank", F.when(present, 100.0 * (2 * upto - same) / (2 * n)))


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``__upto_<s>`` (of this and smaller values of the keys) and ``__all_<s>`` for each of ``sums``; ``counts`` has a value of a key once.

    Values fall into buckets that keep their order: a running sum over the buckets of a key and one within each bucket,
    so no task sorts all values of a key.  NULL comes before all values.
    """
    rows = counts.withColumn("__b", bucket(F.col(value).cast("double")))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__m_{s}") for s in sums])
    held = [x for s in sums for x in (F.coalesce(F.sum(f"__m_{s}").over(before), F.lit(0)).alias(f"__before_{s}"), F.sum(f"__m_{s}").over(whole).alias(f"__all_{s}"))]
    upto = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined_on(rows, totals.select(*keys, "__b", *held), [*keys, "__b"])
    return placed.withColumns({f"__upto_{s}": F.sum(s).over(upto) + F.col(f"__before_{s}") for s in sums}).drop("__b", *[f"__before_{s}" for s in sums])


def external_percentiles(values: DataFrame, reference: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Adds to ``values`` ``midrank`` (100 (lo + hi) / 2n) and ``left_percentile`` ((lo + 0.5) / (n + 1)) in ``reference``.

    lo counts smaller reference values, hi those at or below; with ``weight``, a row of the reference stands for so many.  Rows become counts of
    distinct values, and values fall into buckets that keep their order: a running count over
    the buckets of a key and one within each bucket place every value, so no task sorts all values of a key.
    """
    counts = (
        values.select(*keys, value, F.lit(0).cast("long").alias("__own"))
        .unionAll(reference.select(*keys, value, F.col(weight).cast("long") if weight else F.lit(1)))
        .where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum("__own").alias("__own"))
    )
    placed = running(counts, keys, value, ["__own"]).withColumnsRenamed({"__upto___own": "__hi", "__all___own": "__n"})
    lo, n = F.col("__hi") - F.col("__own"), F.col("__n")
    return (
        values.join(placed, [*keys, value], "left")
        .withColumn("midrank", F.when(n > 0, 100.0 * (lo + F.col("__hi")) / (2 * n)))
        .withColumn("left_percentile", F.when(F.col(value).isNotNull(), (lo + 0.5) / (n + 1)))
        .drop("__own", "__hi", "__n")
    )
