"""The general board: chance times slot utility, as a class percentile, a whole-number score and a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.operators.peers import external_percentiles, joined_on
from scoutframe.operators.quantiles import exact_quantiles
from scoutframe.operators.rank import class_percentile, numbered, with_class_percentile

METHODS = ("chance", "order", "product", "geometric", "bands", "equal")


def slot_utility(pick: Column, size: Column) -> Column:
    """1 for the first slot, 1/size for the last; picks outside are moved to the nearest slot."""
    return (size + 1 - F.when(pick.isNotNull(), F.least(F.greatest(pick, F.lit(1.0)), size))) / size


def order_signal(df: DataFrame, utility: str, keys: list[str]) -> DataFrame:
    """The column ``utility``, where it is missing as the class median, or a half; a class is never in one task."""
    middle = exact_quantiles(df, keys, utility, [0.5]).select(*keys, F.col("quantiles")[0].alias("__middle"))
    out = joined_on(df, middle, keys)
    return out.withColumn(utility, F.coalesce(utility, "__middle", F.lit(0.5))).drop("__middle")


def all_methods(df: DataFrame, chance: str, order: str, keys: list[str], methods: tuple[str, ...]) -> DataFrame:
    """Adds a column for each method, from percentiles that are found once."""
    a, b, pa, pb = F.col(chance), F.col(order), F.col("__pa"), F.col("__pb")
    if {"geometric", "bands", "equal"} & set(methods):
        df = with_class_percentile(with_class_percentile(df, chance, keys, "__pa"), order, keys, "__pb")
    signal = {
        "chance": lambda: a,
        "order": lambda: b,
        "product": lambda: a * b,
        "geometric": lambda: F.sqrt(pa * pb),
        "bands": lambda: F.least(F.floor(pa * 10), F.lit(9)) + 0.999 * pb,
        "equal": lambda: 0.5 * pa + 0.5 * pb,
    }
    return df.select("*", *[signal[m]().alias(m) for m in methods]).drop("__pa", "__pb")


def combined(df: DataFrame, chance: str, order: str, keys: list[str], method: str = "product") -> DataFrame:
    """Adds ``signal``."""
    return all_methods(df.withColumnsRenamed({chance: "__chance", order: "__order"}), "__chance", "__order", keys, (method,)).withColumnsRenamed({method: "signal", "__chance": chance, "__order": order})


def general_board(df: DataFrame, keys: list[str], chance: str, pick: str, size: Column, ident: str, method: str = "product") -> DataFrame:
    """Adds utility, signal, class percentile, score 0 to 100 (ties to even) and a unique rank; no row is dropped."""
    out = df.withColumn("utility", slot_utility(F.col(pick), size))
    out = order_signal(out, "utility", keys)
    out = combined(out, chance, "utility", keys, method)
    out = out.withColumn("percentile", class_percentile(F.col("signal"), keys))
    out = out.withColumn("score", X.half_even(100 * X.clamp(F.col("percentile"), 0.0, 1.0)))
    return numbered(out, keys, [F.col("signal").desc_nulls_last(), F.col(ident)], "board_rank")


def graded_relevance(drafted: Column, pick: Column, size: Column) -> Column:
    """0 if not drafted or without a pick; else linear in the slot and cut to 0 and 1, so a pick past the last slot has 0."""
    return F.when(drafted & pick.isNotNull(), X.clamp((size + 1 - pick) / size, 0.0, 1.0)).otherwise(0.0)


def strength(pick: Column) -> Column:
    """Larger is better: the only place where the sign of a pick turns."""
    return -pick


def historical_percentile(df: DataFrame, reference: DataFrame, keys: list[str], pick: str, name: str = "quality") -> DataFrame:
    """Adds where each predicted pick stands among reference picks of the same keys: (weaker + 0.5) / (n + 1); a half without any."""
    turned = df.withColumn("__s", strength(F.col(pick)))
    out = external_percentiles(turned, reference.select(*keys, strength(F.col(pick)).alias("__s")), keys, "__s")
    return out.withColumn(name, F.coalesce("left_percentile", F.lit(0.5))).drop("__s", "midrank", "left_percentile")


def slot_signal(df: DataFrame, keys: list[str], pick: str, size: Column, method: str, reference: DataFrame | None = None) -> DataFrame:
    """Adds ``quality`` of a predicted pick by class percentile, slot utility or a historical reference; what is missing is neutral."""
    if method == "class_percentile":
        return df.withColumn("quality", class_percentile(strength(F.col(pick)), keys))
    if method == "slot_utility":
        out = df.withColumn("quality", slot_utility(F.col(pick), size))
        return order_signal(out, "quality", keys)
    if method == "historical":
        if reference is None:
            raise ValueError("a reference of earlier predictions is needed")
        return historical_percentile(df, reference, keys, pick)
    raise ValueError(method)


def overall_score(df: DataFrame, keys: list[str], signal: str, reference: DataFrame | None = None) -> DataFrame:
    """Adds ``overall_score`` 0 to 100: from the class percentile of the signal, or from its place among reference signals."""
    if reference is None:
        out = df.withColumn("__p", class_percentile(F.col(signal), keys))
    else:
        out = external_percentiles(df, reference.select(*keys, signal), keys, signal)
        out = out.withColumn("__p", F.col("left_percentile")).drop("midrank", "left_percentile")
    return out.withColumn("overall_score", X.half_even(100 * X.clamp(F.col("__p"), 0.0, 1.0))).drop("__p")
