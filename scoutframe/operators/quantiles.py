"""Exact quantiles of groups of any size: counts of distinct values, then only the buckets that hold a wanted rank.

Values fall into buckets that keep their order (some sixty between a number and its double).  Bucket
totals say where every rank lies; only values of those buckets are sorted, bucket
by bucket.  No task holds the values of a group, and totals and values come from one shuffle of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets between a number and its double.
STEPS = 64


def bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises; 0 for 0."""
    size = F.floor(F.log2(F.abs(v)) * STEPS) + 1100 * STEPS
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * size)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) of the values that are there, counted before they move."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))


def from_counts(counts: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, n, quantiles): see ``exact_quantiles``; ``counts`` has each value of a key once, with its number ``n``."""
    named = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    own = [f"__k{i}" for i in range(max(1, len(keys)))]
    rows = counts.select(*named, F.col(f"`{value}`").alias("__v"), F.col("n").alias("__n"), bucket(F.col(f"`{value}`")).alias("__b"))
    whole = Window.partitionBy(*own)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # a few thousand buckets a key
    totals = rows.groupBy(*own, "__b").agg(F.sum("__n").alias("__m"))
    totals = totals.withColumns({"__before": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__total": F.sum("__m").over(whole)})
    steps = F.array(*[F.lit(float(f)) for f in fractions])
    last = F.col("__total") - 1
    ranks = F.array_distinct(F.flatten(F.transform(steps, lambda f: F.array(F.floor(f * last), F.ceil(f * last)))))
    inside = F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__m")))
    wanted = totals.withColumn("__ranks", inside).where(F.size("__ranks") > 0)
    # a null key is a key
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in own] + [F.col("__b") == F.col("__b_")]
    side = wanted.select(*[F.col(c).alias(f"{c}_") for c in [*own, "__b"]], "__before", "__total", "__ranks")
    joined = on[0]
    for c in on[1:]:
        joined = joined & c
    fine = rows.join(side, joined)
    upto = F.sum("__n").over(Window.partitionBy(*own, "__b").orderBy("__v")) + F.col("__before")
    at = fine.withColumn("__upto", upto)
    hit = F.filter("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n")))
    found = at.withColumn("__hit", hit).where(F.size("__hit") > 0)
    merged = found.groupBy(*own).agg(
        F.max("__total").alias("n"), F.map_from_entries(F.flatten(F.collect_list(F.transform("__hit", lambda r: F.struct(r.alias("r"), F.col("__v").alias("v")))))).alias("__at")
    )

    def quantile(f: Column) -> Column:
        p = f * (F.col("n") - 1)
        low, high = F.element_at("__at", F.floor(p)), F.element_at("__at", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return merged.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "n", F.transform(steps, quantile).alias("quantiles"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, n, quantiles array<double>) of the values that are there, linear between the two nearest; a key without any has no row."""
    return from_counts(value_counts(df, keys, value), keys, value, fractions)
