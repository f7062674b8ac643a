"""A class scored end to end by a frozen methodology: parameters, peers and pool are tables, so the plan has joins and expressions and no fit.

``frozen_fits`` makes the parameters from a development population, once; ``scored_class`` takes engineered rows of any
number of classes to chance, predicted pick, board, team need and comparables in one plan, where nobody is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions.text import school_key
from scoutframe.operators import folds, peers, profiles, similar, space
from scoutframe.operators.assembly import consensus_population, prospect_frame
from scoutframe.operators.board import general_board
from scoutframe.sources.sinks import stored

#: Dimensions of the space of comparables and their metrics, and the metric of which less is more.
ROLES = {
    "SHOOTING_EFFICIENCY": ["three_point_pct", "ft_pct", "efg_pct"],
    "SCORING_ROLE": ["points_per_40", "fga_per_40"],
    "CREATION": ["assists_per_40"],
    "REBOUNDING": ["oreb_per_40", "dreb_per_40"],
    "DEFENSIVE_ACTIVITY": ["steals_per_40", "blocks_per_40"],
    "PERIMETER_ORIENTATION": ["three_point_attempt_rate", "free_throw_rate"],
}
INVERTED = ("free_throw_rate",)


@dataclass
class Frozen:
    """What a class is scored by.

    ``chance`` and ``order``: one row of ``folds.parameters`` each, under the key ``model``; ``moments`` and ``grid``: peers by season as
    ``peers`` gives them; ``league``: season rows that college percentiles are taken among; ``pool``: other_id, other_vec,
    other_height (and other_key); ``cuts``: one row of ``similar.thresholds``, or None.
    """

    chance: DataFrame
    order: DataFrame
    moments: DataFrame
    grid: DataFrame
    league: DataFrame
    pool: DataFrame
    cuts: DataFrame | None = None
    chance_names: list[str] = field(default_factory=list)
    order_names: list[str] = field(default_factory=list)
    relative: list[str] = field(default_factory=list)
    specification: profiles.Specification = field(default_factory=profiles.Specification)


def frozen_fits(development: DataFrame, moments: DataFrame, names: list[str], relative: list[str], season: str, group: str, before: int, alpha: float = 10.0, c: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Parameters of chance and order from all seasons earlier than ``before``; ``development`` has drafted (0 or 1) and pick.

    Chances are fitted on metrics relative to the season's peers, picks on the metrics as they are, over those drafted.
    """
    spark, past = development.sparkSession, development.where(F.col(season) < before)
    apart = peers.season_relative(past, moments, season, group, [m for m in relative if m in names])
    chance = folds.logit_folds(folds.Rows.of(apart, names, season, "drafted", group), {before: []}, c)
    order = folds.ridge_folds(folds.Rows.of(past.where("drafted = 1"), names, season, "pick", group), {before: []}, alpha)
    if not chance or not order:
        raise ValueError("a development population needs drafted and undrafted rows, and picks")
    return folds.parameters(spark, {0: chance[before]}, "model"), folds.parameters(spark, {0: order[before]}, "model")


def pro_pool(seasons: DataFrame, heights: DataFrame, ident: str, group: str, last: int | None = 3) -> DataFrame:
    """(other_id, other_group, other_vec, other_height): means of the last seasons by minutes, as percentiles among the pool itself.

    ``seasons``: eligible season rows with minutes, the metrics of ``ROLES`` and ``group``, of which the latest counts; ``heights``: ident, height.
    """
    metrics = [m for own in ROLES.values() for m in own]
    latest = seasons.groupBy(ident).agg(F.max_by(group, "season").alias(group))
    # written once, to nine places: a player is measured among the very same values
    pool = stored(similar.pool(seasons, ident, metrics, last).join(latest, ident).select(ident, group, *[X.nine_places(F.col(m)).alias(m) for m in metrics]))
    placed = space.pro_space(pool, [ident], ROLES, INVERTED, group)
    return placed.join(heights.groupBy(ident).agg(F.min("height").alias("other_height")), ident, "left").select(
        F.col(ident).alias("other_id"), F.col(group).alias("other_group"), F.array(*ROLES).alias("other_vec"), "other_height"
    )


def signals(frame: DataFrame, frozen: Frozen, season: str, group: str) -> DataFrame:
    """Adds ``chance`` and ``pick``: the frozen linear scores, relative to the season's peers and as they are."""
    whole = frame.withColumn("model", F.lit(0))
    picked = folds.scored(whole, frozen.order, "model", frozen.order_names, group, "pick")
    # z-scores replace the metrics, so the originals wait beside them
    held = [F.col(m).alias(f"__plain_{m}") for m in frozen.relative]
    apart = peers.season_relative(picked.select("*", *held), frozen.moments, season, group, frozen.relative)
    out = folds.scored(apart, frozen.chance, "model", frozen.chance_names, group, "__z").withColumn("chance", X.logistic(F.col("__z")))
    return out.withColumns({m: F.col(f"__plain_{m}") for m in frozen.relative}).drop("__z", "model", *[f"__plain_{m}" for m in frozen.relative])


def board(frame: DataFrame, frozen: Frozen, season: str, group: str, ident: str, size: Column) -> DataFrame:
    """(season, ident, chance, pick, utility, signal, percentile, score, board_rank) of each class; signals agree to nine places."""
    rows = signals(frame, frozen, season, group).select(season, ident, X.nine_places(F.col("chance")).alias("chance"), X.nine_places(F.col("pick")).alias("pick"))
    return general_board(rows, [season], "chance", "pick", size, ident)


def needs(frame: DataFrame, frozen: Frozen, season: str, group: str, ident: str) -> DataFrame:
    """(season, ident, each dimension, data_coverage, each archetype's fit, score and eligibility), one row for each prospect."""
    spec = frozen.specification
    found = profiles.evaluated(frame, frozen.grid, [season, ident], season, group, spec)
    pick = lambda name, is_, value: F.max(F.when(F.col(name) == is_, F.col(value)))
    dims = found.dimensions.groupBy(season, ident).agg(*[pick("dimension", d, "score").alias(d) for d in spec.dimensions()], F.avg("coverage").alias("data_coverage"))
    columns = {"fit_raw": "fit", "fit_score": "score", "eligibility": "eligibility"}
    fits = found.profiles.groupBy(season, ident).agg(*[pick("profile", p, c).alias(f"{p}_{name}") for p in spec.archetypes() for c, name in columns.items()])
    return dims.join(fits, [season, ident], "left")


def nearest(frame: DataFrame, frozen: Frozen, season: str, group: str, ident: str, k: int = 3, own_key: str | None = None) -> DataFrame:
    """(season, ident, comparables array<struct>, comparables_status): the ``k`` nearest of the pool with their distance, gate and score."""
    placed = space.college_space(frame, frozen.league, [season, ident], ROLES, INVERTED, season, group)
    mine = placed.select(season, ident, F.array(*ROLES).alias("vec"), "height", *([own_key] if own_key else []))
    near = similar.nearest_of_all(mine, frozen.pool, [season, ident], ident, "other_id", len(ROLES), k, own_name=own_key, other_name="other_key" if own_key else None)
    if frozen.cuts is not None:
        near = near.crossJoin(F.broadcast(frozen.cuts.select("cuts")))  # one row
        near = near.withColumn("similarity", similar.score_from_thresholds(F.col("distance"), F.col("cuts")))
    else:
        near = near.withColumn("similarity", F.lit(None).cast("long"))
    one = F.struct("nth", "other_id", "distance", "gate", "similarity")
    return near.groupBy(season, ident).agg(F.sort_array(F.collect_list(F.when(F.col("other_id").isNotNull(), one))).alias("comparables"), F.min("status").alias("comparables_status"))


def scored_class(frame: DataFrame, frozen: Frozen, season: str, group: str, ident: str, size: Column) -> DataFrame:
    """Board, team need and comparables of every row of ``frame``, joined by key; ``frame`` tells no outcomes."""
    out = board(frame, frozen, season, group, ident, size)
    for other in (needs(frame, frozen, season, group, ident), nearest(frame, frozen, season, group, ident)):
        out = out.join(other, [season, ident], "left")
    return out


def scored_population(prospects: DataFrame, frozen: Frozen, season: str, group: str, ident: str, size: Column) -> DataFrame:
    """A declared population: those with a played record are scored, the others stay with their reason.

    Adds ``population_status``: SCORED, INSUFFICIENT_DATA (matched, but no games) or the method that found nobody.
    """
    ready = F.col("games_played").isNotNull()
    done = scored_class(prospects.where(ready), frozen, season, group, ident, size)
    status = F.when(ready, "SCORED").when(F.col("athlete_id").isNotNull(), "INSUFFICIENT_DATA").otherwise(F.col("method"))
    return prospects.select(season, ident, "athlete_id", status.alias("population_status")).join(done, [season, ident], "left")


def scored_watchlist(appearances: DataFrame, index: DataFrame, overrides: DataFrame, frame: DataFrame, frozen: Frozen, year: int, season: int, size: Column, least: int = 2) -> DataFrame:
    """Players whom at least ``least`` sources name: those who played in ``season`` scored, the others with their reason.

    One row each with name, college, sources and ``population_status``; ``appearances``: source, player_name, school; ``index`` and
    ``overrides`` as ``identity.match`` takes them, with whole-number idents and ``person_id`` the id that the consensus gives.
    """
    named = consensus_population(appearances, year, least)
    people = named.select(F.lit(season).alias("season"), F.col("prospect_id").alias("person_id"), F.col("normalized_name").alias("name_key"), school_key(F.col("college")).alias("school"))
    people = prospect_frame(stored(people), index, overrides, frame)
    out = scored_population(people, frozen, "season", "position_3", "person_id", size)
    return named.join(out.withColumnRenamed("person_id", "prospect_id"), "prospect_id", "left")
