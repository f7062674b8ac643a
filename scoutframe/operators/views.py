"""What pages and reports show: lists, leaderboards, summaries of a class, weights and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.operators.rank import numbered

#: Fixed value: fewer attempts are flagged on a leaderboard.
LOW_SAMPLE = 20


def board_list(df: DataFrame, name: str, rank: str, query: str = "", position: str | None = None, position_col: str = "position") -> DataFrame:
    """Rows on the board whose name holds the query (any case, blanks around it ignored), in one position if one is given, by rank."""
    out = df.where(F.col(rank).isNotNull() & F.lower(name).contains(query.strip().lower()))
    if position is not None:
        out = out.where(F.col(position_col) == position)
    return out.orderBy(rank)


def leaderboard(df: DataFrame, keys: list[str], metric: str, ident: str, higher: bool = True, attempts: str | None = None, least: int = LOW_SAMPLE) -> DataFrame:
    """Rows with a value, numbered by it in its direction; few attempts are flagged, not dropped."""
    order = F.desc(metric) if higher else F.asc(metric)
    out = numbered(df.where(F.col(metric).isNotNull()), keys, [order, F.col(ident)], "place")
    low = F.coalesce(F.col(attempts) < least, F.lit(True)) if attempts else F.lit(False)
    return out.withColumn("low_sample", low)


def leaders(df: DataFrame, keys: list[str], metric: str, ident: str, higher: bool = True, n: int = 5) -> DataFrame:
    return leaderboard(df, keys, metric, ident, higher).where(F.col("place") <= n)


def top_averages(df: DataFrame, keys: list[str], rank: str, dimensions: list[str], n: int = 10) -> DataFrame:
    """Averages of the dimensions over the first ``n`` of each class."""
    return df.where(F.col(rank) <= n).groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dimensions])


def strengths_and_watch(scores: list[tuple[str, Column]], best: int = 3, worst: int = 2) -> tuple[Column, Column]:
    """Labels of the ``best`` highest scores, and of the ``worst`` lowest of the others, as texts; ties as declared."""
    entries = F.array(*[F.struct((-s).alias("v"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (label, s) in enumerate(scores)])
    down = F.array_sort(F.filter(entries, lambda e: e["v"].isNotNull()))
    rest = F.slice(down, best + 1, len(scores))
    label = lambda c: F.array_join(F.transform(c, lambda e: e["label"]), ",")
    return label(F.slice(down, 1, best)), label(F.slice(F.reverse(rest), 1, worst))


def weight_shares(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Adds ``share``: weight over the sum of weights; NULL where they sum to nothing."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return weights.withColumn("share", F.when(total > 0, F.col(weight) / total))


def class_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"),
        F.max(value).alias("high"), F.countDistinct(value).alias("n_distinct"),
    )


def fit_summary(df: DataFrame, profile: str, fit: str, eligible: str) -> DataFrame:
    """Per profile: available and unavailable fits, their mean, and how many are eligible."""
    return df.groupBy(profile).agg(
        F.count(fit).alias("available"), F.count_if(F.col(fit).isNull()).alias("unavailable"), F.avg(fit).alias("mean_fit"),
        F.count_if(F.col(eligible) == "ELIGIBLE").alias("eligible"),
    )


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(status), F.lit("NONE")).alias("status")).agg(F.count("*").alias("n"))


def never_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature) of which no row has a value: what a fit would impute for everyone."""
    one = df.agg(*[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).where("p.n = 0").select("p.feature")


def photo_index(df: DataFrame, ident: str, needed: tuple[str, ...] = ("license", "attribution", "thumbnail")) -> DataFrame:
    """Photos that may be shown: status OK, and nothing needed is blank."""
    whole = F.lit(True)
    for c in needed:
        whole = whole & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df.where((F.col("status") == "OK") & whole).select(ident, *needed)


def detail(df: DataFrame, ident: str, value) -> DataFrame:
    return df.where(F.col(ident) == value)


def first_issues(issues: DataFrame, row: str, n: int = 40) -> DataFrame:
    """The first ``n`` issues for a report, errors before warnings."""
    return issues.orderBy(F.col("severity") != "error", row, "field", "message").limit(n)


def sampled(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows that a hash of their id and the seed picks: the same ones at every run."""
    return df.orderBy(F.md5(F.concat_ws("/", F.col(ident).cast("string"), F.lit(str(seed)))), ident).limit(n)
