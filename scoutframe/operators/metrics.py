"""Exact rank-quality metrics per group: score and label columns, ties by their average."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.operators.peers import joined_on, running
from scoutframe.operators.quantiles import exact_quantiles


def with_average_rank(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Adds the average rank, ascending, within the keys, by running counts of distinct values: no task sorts the rows of a key."""
    placed = running(df.groupBy(*keys, value).agg(F.count("*").alias("__c")), keys, value, ["__c"])
    placed = placed.select(*keys, value, (F.col("__upto___c") - (F.col("__c") - 1) / 2).alias(into))
    return joined_on(df, placed, [*keys, value])


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve: the mean share of rows labelled 0 that a row labelled 1 is above, ties half; NULL unless both labels occur."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("__one"), F.count_if(F.col(label) != 1).alias("__zero"))
    # pairs as doubles: their number passes a long's range
    won = F.sum(F.col("__one").cast("double") * (2 * F.col("__upto___zero") - F.col("__zero")))
    both = 2.0 * F.sum("__one") * F.sum("__zero")
    return running(counts, keys, score, ["__zero"]).groupBy(*keys).agg(F.when(both > 0, won / both).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Step sum of precision over distinct scores."""
    per = running(df.groupBy(*keys, score).agg(F.sum(label).alias("tp"), F.count("*").alias("n")), keys, score, ["tp", "n"])
    above = lambda c: F.col(f"__all_{c}") - F.col(f"__upto_{c}") + F.col(c)
    return per.groupBy(*keys).agg(F.when(F.sum("tp") > 0, F.sum(F.col("tp") * above("tp") / above("n")) / F.sum("tp")).alias("average_precision"))


def probability_losses(df: DataFrame, keys: list[str], p: str, label: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(y.cast("double")).alias("base_rate"),
        (F.count_if(y == 0) < 5).alias("low_negative_support"),
    )


def at_k(df: DataFrame, keys: list[str], score: str, label: str, ident: str, k: int) -> DataFrame:
    """Precision, recall and NDCG of the ``k`` highest scores; ties by a hash of the id, then the id."""
    own = Window.partitionBy(*keys).orderBy(F.desc(score), F.md5(F.col(ident).cast("string")), F.col(ident))
    ranked = df.withColumns({"__k": F.row_number().over(own), "__i": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(label)))})

    def within(place: str, value: Column) -> Column:
        return F.sum(F.when(F.col(place) <= k, value).otherwise(0))

    hit = within("__k", F.col(label))
    return ranked.groupBy(*keys).agg(
        (hit / F.least(F.count("*"), F.lit(k))).alias("precision_at_k"),
        F.when(F.sum(label) > 0, hit / F.sum(label)).alias("recall_at_k"),
        F.when(F.sum(label) > 0, within("__k", F.col(label) / F.log2(F.col("__k") + 1.0)) / within("__i", F.col(label) / F.log2(F.col("__i") + 1.0))).alias("ndcg_at_k"),
    )


def calibration(df: DataFrame, keys: list[str], p: str, label: str, bins: int = 10) -> DataFrame:
    """Bins between the deciles of the group's own predictions, equal edges dropped: n, mean prediction, observed share, gap."""
    edges = exact_quantiles(df, keys, p, [k / bins for k in range(bins + 1)]).select(*keys, F.array_distinct("quantiles").alias("__edges"))
    b = F.greatest(F.size(F.filter("__edges", lambda e: e < F.col(p))) - 1, F.lit(0)).cast("long")
    g = df.join(edges, keys).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"))
    return g.withColumn("gap", F.abs(F.col("mean_pred") - F.col("observed")))


def expected_calibration_error(df: DataFrame, keys: list[str], p: str, label: str) -> DataFrame:
    g = calibration(df, keys, p, label)
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks per group; NULL where either side is constant."""
    r = with_average_rank(with_average_rank(df.select(*keys, F.col(a).alias("__x"), F.col(b).alias("__y")), keys, "__x", "__ra"), keys, "__y", "__rb")
    spread = F.nullif(F.stddev_pop("__ra") * F.stddev_pop("__rb"), F.lit(0.0))
    return r.groupBy(*keys).agg((F.covar_pop("__ra", "__rb") / spread).alias("spearman"))


def _dense(value: str, keys: list[str]) -> Column:
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1


#: Places of the first order that are counted together before they are counted one by one.
KENDALL_BLOCK = 4096


def discordant(cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, discordant): pairs of ``cells`` (keys, a, b whole numbers from 0, n) with a smaller ``a`` and a larger ``b``.

    Two values of ``b`` first differ in one bit, so a pair is counted at that bit: among cells that agree in all higher
    bits, those with a 1 there that come before those with a 0.  A cell gives a row for each bit, and a running count
    over blocks of ``a``, then within each, counts the pairs: no pair is made, and no task holds a group.
    """
    top = cells.withColumn("__top", F.max(b).over(Window.partitionBy(*keys)))
    bits = top.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.length(F.bin("__top")) - 1)))
    one = F.expr(f"shiftright(`{b}`, __bit) & 1") == 1
    at = [*keys, "__bit", "__prefix"]
    placed = (
        bits.withColumn("__prefix", F.expr(f"shiftright(`{b}`, __bit + 1)"))
        .groupBy(*at, F.col(a).alias("__a"))
        .agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("__ones"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("__zeros"))
        .withColumn("__block", F.floor(F.col("__a") / KENDALL_BLOCK))
    )
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*at, "__block").agg(F.sum("__ones").alias("__ones"), F.sum("__zeros").alias("__zeros"))
    apart = blocks.withColumn("__d", F.coalesce(F.sum("__ones").over(before(at, "__block")), F.lit(0)) * F.col("__zeros"))
    inside = placed.withColumn("__d", F.coalesce(F.sum("__ones").over(before([*at, "__block"], "__a")), F.lit(0)) * F.col("__zeros"))
    both = apart.select(*keys, "__d").unionAll(inside.select(*keys, "__d"))
    return both.groupBy(*keys).agg(F.sum("__d").alias("discordant"))


def kendall(df: DataFrame, keys: list[str], a: str, b: str, ident: str) -> DataFrame:
    """Tau-b per group, from counts of discordant and tied pairs; rows without both values play no part, NULL where a side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(*keys, F.col(a).alias("__va"), F.col(b).alias("__vb")).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"__a": _dense("__va", keys), "__b": _dense("__vb", keys)})
    pairs = lambda n: F.sum(n * (n - 1) / 2)

    def tied(c: str) -> DataFrame:
        return cells.groupBy(*keys, c).agg(F.sum("n").alias("__t")).groupBy(*keys).agg(pairs(F.col("__t")).alias(f"__tied{c}"))

    whole = cells.groupBy(*keys).agg(pairs(F.col("n")).alias("__same"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("__all"))
    out = _joined(keys, whole, tied("__a"), tied("__b"), discordant(cells, keys, "__a", "__b"))
    ties = F.col("__tied__a") + F.col("__tied__b") - F.col("__same")
    concordant = F.col("__all") - ties - F.coalesce("discordant", F.lit(0))
    bound = F.sqrt(F.col("__all") - F.col("__tied__a")) * F.sqrt(F.col("__all") - F.col("__tied__b"))
    return out.select(*keys, F.when(bound > 0, (concordant - F.coalesce("discordant", F.lit(0))) / bound).alias("kendall"))


def ndcg(df: DataFrame, keys: list[str], score: str, gain: str, k: int | None = None, name: str = "ndcg") -> DataFrame:
    """Tied scores share their average gain over the discounts of their places; with ``k``, later places count nothing."""

    def summed(by: str, gains: Column, name: str) -> DataFrame:
        # rows of one value hold the places from those above it on
        per = running(df.groupBy(*keys, F.col(by).alias("__by")).agg(F.count("*").alias("__n"), gains.alias("__gain")), keys, "__by", ["__n"])
        above = F.col("__all___n") - F.col("__upto___n")
        upto = [F.least(c, F.lit(k)) if k else c for c in (above, above + F.col("__n"))]
        return per.groupBy(*keys).agg(F.sum(F.col("__gain") * (discounts(upto[1]) - discounts(upto[0]))).alias(name))

    both = joined_on(summed(score, F.avg(gain), "__dcg"), summed(gain, F.avg(gain), "__ideal"), keys)
    return both.select(*keys, F.when(F.col("__ideal") > 0, F.col("__dcg") / F.col("__ideal")).alias(name))


#: Places whose discounts are added one by one; the sum over later ones is an integral with corrections.
ADDED = 4096


def discount_sums(places: np.ndarray) -> np.ndarray:
    """Sum of 1 / log2(i + 1) over the places 1 to each of ``places``."""
    m = np.asarray(places, dtype=np.int64)
    table = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(1, ADDED + 1) + 1.0))])

    def smooth(x):
        # Euler and Maclaurin for 1 / ln x: the logarithmic integral by its series, half of the end, a twelfth of the slope
        y = np.log(x)
        total, term = np.log(y), np.ones_like(y)
        for j in range(1, 160):
            term = term * y / j
            total = total + term / j
        return total + 1 / (2 * y) - 1 / (12 * x * y * y)

    late = m > ADDED
    out = table[np.minimum(m, ADDED)]
    out[late] += np.log(2.0) * (smooth(m[late] + 1.0) - smooth(np.array([ADDED + 1.0])))
    return out


def discounts(places: Column) -> Column:
    @F.pandas_udf("double")
    def sums(m: pd.Series) -> pd.Series:
        return pd.Series(discount_sums(m.to_numpy()))

    return sums(places.cast("long"))


def class_recall(df: DataFrame, keys: list[str], pred: str, pick: str, ident: str) -> DataFrame:
    """Of the first 14 and 30 actual picks, the share among as many best predictions; and how many of the better predicted half are in the better half."""
    middle = exact_quantiles(df, keys, pick, [0.5]).select(*keys, F.col("quantiles")[0].alias("__m"))
    half = F.greatest(F.lit(1), F.floor(F.col("__n") / 2))
    placed = running(df.groupBy(*keys, pred).agg(F.count("*").alias("__c")), keys, pred, ["__c"])
    placed = placed.select(*keys, pred, (F.col("__upto___c") - F.col("__c")).alias("__before"), F.col("__upto___c").alias("__upto"), F.col("__all___c").alias("__n"))
    rows = joined_on(df.select(*keys, pred, pick, ident), placed, [*keys, pred])
    # only predictions that a cut goes through are told apart by their ids
    through = reduce(lambda a, b: a | b, [(F.col("__before") < c) & (F.col("__upto") > c) for c in (F.lit(14), F.lit(30), half)])
    apart = F.row_number().over(Window.partitionBy(*keys, pred).orderBy(ident)) + F.col("__before")
    rows = rows.where(through).withColumn("__k", apart).unionByName(rows.where(~through).withColumn("__k", F.col("__upto")))
    rows = rows.join(middle, keys, "left")

    def recall(cut: int) -> Column:
        actual = F.col(pick) <= cut
        return F.when(F.count_if(actual) > 0, F.count_if(actual & (F.col("__k") <= cut)) / F.count_if(actual))

    return rows.groupBy(*keys).agg(
        recall(14).alias("lottery_recall"),
        recall(30).alias("first_round_recall"),
        (F.count_if((F.col("__k") <= half) & (F.col(pick) <= F.col("__m"))) / F.max(half)).alias("top_half_concentration"),
    )


def _joined(keys: list[str], first: DataFrame, *rest: DataFrame) -> DataFrame:
    for other in rest:
        first = first.join(other, keys, "left")
    return first


def order_metrics(df: DataFrame, keys: list[str], pred: str, pick: str, size: str, ident: str) -> DataFrame:
    """Rank metrics of predicted against actual picks, NULL for a constant prediction or fewer than three rows; then errors and recalls."""
    rows = df.withColumns({"__p": -F.col(pred), "__a": -F.col(pick), "__g": F.col(size) + 1 - F.col(pick)})
    sound = rows.groupBy(*keys).agg(F.count("*").alias("n"), ((F.count("*") >= 3) & (F.min("__p") < F.max("__p"))).alias("__ok"))
    ranks = _joined(
        keys, sound, spearman(rows, keys, "__p", "__a"), kendall(rows, keys, "__p", "__a", ident), ndcg(rows, keys, "__p", "__g"),
        *[ndcg(rows, keys, "__p", "__g", k, f"ndcg_at_{k}") for k in (5, 10, 14)],
    )
    names = ["spearman", "kendall", "ndcg", "ndcg_at_5", "ndcg_at_10", "ndcg_at_14"]
    ranks = ranks.withColumns({c: F.when(F.col("__ok"), F.col(c)) for c in names}).drop("__ok")
    return _joined(keys, ranks, errors(df, keys, pred, pick), class_recall(df, keys, pred, pick, ident))


def board_metrics(df: DataFrame, keys: list[str], signal: str, drafted: str, pick: str, size: str, ident: str) -> DataFrame:
    """A board as a ranking: drafted above undrafted, graded relevance over the whole, and the order among the drafted."""
    from scoutframe.operators.board import graded_relevance

    rows = df.withColumn("__rel", graded_relevance(F.col(drafted) == 1, F.col(pick), F.col(size)))
    taken = rows.where(F.col(drafted) == 1).withColumn("__a", -F.col(pick))
    support = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(drafted).alias("drafted"), (F.least(F.count_if(F.col(drafted) == 1), F.count_if(F.col(drafted) == 0)) < 5).alias("low_support")
    )
    order = taken.groupBy(*keys).agg(((F.count("*") >= 3) & (F.min(signal) < F.max(signal))).alias("__ok"))
    out = _joined(
        keys, support, roc_auc(rows, keys, signal, drafted), average_precision(rows, keys, signal, drafted), ndcg(rows, keys, signal, "__rel", None, "graded_ndcg"),
        ndcg(rows, keys, signal, "__rel", 14, "graded_ndcg_at_14"), order, spearman(taken, keys, signal, "__a"), kendall(taken, keys, signal, "__a", ident),
    )
    return out.withColumns({c: F.when(F.col("__ok"), F.col(c)) for c in ("spearman", "kendall")}).drop("__ok")


def over_folds(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, macro, sd, low): mean, population deviation and minimum of a metric over its folds, one row a fold."""
    long = per_fold.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "v"))
    return long.groupBy("metric").agg(F.avg("v").alias("macro"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"))


def fold_report(rows: DataFrame, fold: str, p: str, label: str) -> DataFrame:
    """(metric, macro, sd, low, pooled): over the folds of out-of-fold rows, and over all of these rows together."""
    names = ["auc", "average_precision", "log_loss", "brier"]

    def measured(df: DataFrame, key: str) -> DataFrame:
        return _joined([key], probability_losses(df, [key], p, label), roc_auc(df, [key], p, label), average_precision(df, [key], p, label))

    pooled = over_folds(measured(rows.withColumn("__all", F.lit("all")), "__all"), names).select("metric", F.col("macro").alias("pooled"))
    return over_folds(measured(rows, fold), names).join(pooled, "metric")


def top_overlap(df: DataFrame, keys: list[str], predicted: str, actual: str, k: int = 14) -> DataFrame:
    """How many rows are among the first ``k`` of both orders; two ranks from 1, the actual one NULL if not drafted."""
    both = (F.col(predicted) <= k) & (F.col(actual) <= k)
    return df.groupBy(*keys).agg(F.count_if(both).alias("overlap"), F.least(F.count_if(F.col(actual) <= k), F.lit(k)).alias("possible"))


def surprises(df: DataFrame, keys: list[str], predicted: str, actual: str, ident: str, n: int = 5) -> DataFrame:
    """The ``n`` rows that went the most earlier and the most later than predicted: (kind, place, gap)."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).withColumn("gap", F.col(predicted) - F.col(actual))
    out = None
    for kind, order in (("earlier", F.desc("gap")), ("later", F.asc("gap"))):
        part = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, ident))).where(F.col("place") <= n)
        part = part.select(*keys, F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), ident, "gap")
        out = part if out is None else out.unionAll(part)
    return out


def errors(df: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    rows = df.withColumn("__e", F.abs(F.col(pred) - F.col(truth)))
    middle = exact_quantiles(rows, keys, "__e", [0.5]).select(*keys, F.col("quantiles")[0].alias("median_ae"))
    e = F.col("__e")
    return rows.groupBy(*keys).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).join(middle, keys, "left")
