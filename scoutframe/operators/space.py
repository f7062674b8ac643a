"""The common space of two leagues: percentiles among own peers, role dimensions, prepared pools and the scale of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions.text import name_key
from scoutframe.operators.peers import external_percentiles
from scoutframe.sources.sinks import stored

#: A group with fewer reference rows is measured against the whole league.
LEAST_GROUP = 30


def _scopes(season: Column, group: Column) -> list[Column]:
    """Own season and group, own season, own group of all seasons, all: as names of reference populations."""
    every = F.lit("*")
    return [F.concat_ws("/", a, b) for a, b in ((season, group), (season, every), (every, group), (every, every))]


def league_percentiles(df: DataFrame, reference: DataFrame, keys: list[str], metrics: list[str], season: str, group: str, least: int = LEAST_GROUP) -> DataFrame:
    """Adds ``<metric>_pct``: mid-rank 0 to 100 among the row's own peers in ``reference``.

    Peers are those of the same season and group; of the season where the group has fewer than ``least``
    rows; of all seasons where the season has none.  ``keys`` name a row.
    """
    s, g = F.col(season).cast("string"), F.coalesce(F.col(group), F.lit(""))
    own, year, kind, every = _scopes(s, g)
    by_both = reference.groupBy(season, F.coalesce(F.col(group), F.lit("")).alias("__g")).agg(F.count("*").alias("__both"))
    by_year = reference.groupBy(season).agg(F.count("*").alias("__year"))
    by_kind = reference.groupBy(F.coalesce(F.col(group), F.lit("")).alias("__g")).agg(F.count("*").alias("__kind"))
    sized = df.withColumn("__g", g).join(by_both, [season, "__g"], "left").join(by_year, [season], "left").join(by_kind, ["__g"], "left")
    scope = (
        F.when((F.col("__year") > 0) & (F.col("__both") >= least), own)
        .when(F.col("__year") > 0, year)
        .when(F.col("__kind") >= least, kind)
        .otherwise(every)
    )
    rows = stored(sized.select(*keys, scope.alias("__scope"), *metrics))
    # values of the reference are counted for their group and season, then told to the scopes that somebody is measured in
    asked = rows.select("__scope").distinct()
    counts = reference.select(F.array(own, year, kind, every).alias("__scopes"), *metrics).unpivot(["__scopes"], metrics, "metric", "value")
    counts = counts.where("value IS NOT NULL").groupBy("__scopes", "metric", "value").agg(F.count("*").alias("__w"))
    peers = counts.withColumn("__scope", F.explode("__scopes")).join(asked, "__scope", "left_semi")
    ranked = external_percentiles(rows.unpivot([*keys, "__scope"], metrics, "metric", "value"), peers, ["__scope", "metric"], "value", "__w")
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("midrank"))).alias(f"{m}_pct") for m in metrics])
    return df.join(wide, keys, "left")


def role_dimensions(df: DataFrame, dimensions: dict[str, list[str]], inverted: tuple[str, ...] = ()) -> DataFrame:
    """Adds each dimension: the mean of its percentiles that are there, turned round where less is better; NULL without any."""

    def part(metric: str) -> Column:
        p = F.col(f"{metric}_pct")
        return 100 - p if metric in inverted else p

    return df.withColumns({name: X.row_mean(*[part(m) for m in metrics]) for name, metrics in dimensions.items()})


def league_reference(frame: DataFrame, seasons: list[int], metrics: list[str], minutes: float = 200, games: int = 10, group: str = "position_3") -> DataFrame:
    """(season, athlete_id, group, metrics): the season rows that prospects are ranked among, with enough minutes and games; metrics that the frame lacks are left out."""
    rows = frame.where(F.col("season").isin(seasons) & (F.col("minutes") >= minutes) & (F.col("games_played") >= games))
    return rows.select("season", "athlete_id", group, *[m for m in metrics if m in frame.columns])


def college_space(df: DataFrame, reference: DataFrame, keys: list[str], dimensions: dict[str, list[str]], inverted: tuple[str, ...], season: str, group: str) -> DataFrame:
    """Prospects among their own season's peers."""
    metrics = [m for own in dimensions.values() for m in own]
    return role_dimensions(league_percentiles(df, reference, keys, metrics, season, group), dimensions, inverted)


def pro_space(pool: DataFrame, keys: list[str], dimensions: dict[str, list[str]], inverted: tuple[str, ...], group: str) -> DataFrame:
    """A pool that is its own reference, over all of its seasons."""
    whole = pool.withColumn("__season", F.lit(0))
    metrics = [m for own in dimensions.values() for m in own]
    return role_dimensions(league_percentiles(whole, whole, keys, metrics, "__season", group), dimensions, inverted).drop("__season")


def prepared_pool(pool: DataFrame, heights: DataFrame, ident: str, name: str, height: str = "height_inches") -> DataFrame:
    """The pool with a name key and heights by id: one height an id, none is made up; a pool that has heights keeps them."""
    out = pool.withColumn("name_key", name_key(F.col(name)))
    if height in pool.columns:
        return out.withColumn(height, X.num(height))
    one = heights.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(X.num(height)).alias(height))
    return out.join(one, ident, "left")


def without_self(met: DataFrame, key: str, other_key: str) -> DataFrame:
    """Pairs of which the two are not the same person by name key; an empty or missing key is nobody's."""
    mine = F.coalesce(F.col(key), F.lit(""))
    return met.where((mine == "") | ~mine.eqNullSafe(F.col(other_key)))


def within_pool_percentile(df: DataFrame, keys: list[str], distance: str, ident: str) -> DataFrame:
    """Adds ``within_pool``: 100 (n - 1 - rank) / (n - 1) among the rows of the keys that have a distance."""
    own = Window.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy(F.col(distance).asc_nulls_last(), ident)) - 1
    n = F.count(distance).over(own)
    return df.withColumn("within_pool", F.when(F.col(distance).isNotNull(), 100.0 * (n - 1 - rank) / F.greatest(n - 1, F.lit(1))))


def neighbour_gap(df: DataFrame, keys: list[str], distance: str, ident: str, k: int = 3) -> DataFrame:
    """(keys, gap): how much farther the neighbour after the ``k``-th is; NULL without one."""
    own = Window.partitionBy(*keys).orderBy(distance, ident)
    rows = df.where(F.col(distance).isNotNull()).withColumns({"__n": F.row_number().over(own), "__next": F.lead(distance).over(own)})
    return rows.where(F.col("__n") == k).select(*keys, (F.col("__next") - F.col(distance)).alias("gap"))
