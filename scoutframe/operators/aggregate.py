"""Season aggregates of games and shots, team context, engineered features, pivots and audits.

``season`` is a key of every group, so any number of seasons is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.functions import expr as X

SUMS = [
    "minutes", "points", "fgm", "fga", "tpm", "tpa", "ftm", "fta", "oreb", "dreb", "rebounds", "assists", "turnovers",
    "steals", "blocks", "fouls",
]
TEAM = ["minutes", "fgm", "fga", "tpa", "fta", "oreb", "dreb", "rebounds", "turnovers"]
#: Order that decides which of several rows of a key is the first.
FIRST = ["team_id", "game_date", "points", "minutes", "tpa", "fta", "tpm", "starter", "did_not_play"]


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def deduped_games(box: DataFrame, *by: str) -> DataFrame:
    """One row per season, athlete and game; rows without an athlete or a game go.

    ``by`` names the columns, season among them, that the rows are dealt by: groups of these and more need no further shuffle.
    """
    keyed = box.where("athlete_id IS NOT NULL AND game_id IS NOT NULL")
    return first_rows(keyed.repartition(*by) if by else keyed, ["season", "athlete_id", "game_id"], FIRST)


def played(games: DataFrame) -> DataFrame:
    return games.where(~F.coalesce("did_not_play", F.lit(False)))


def in_order(games: DataFrame) -> DataFrame:
    """Games dealt by season and athlete, each athlete's in the order of the games: sums of doubles then have one outcome, however rows arrive."""
    return games.repartition("season", "athlete_id").sortWithinPartitions("season", "athlete_id", "game_id")


def _season_totals() -> list[Column]:
    return [
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS],
        F.count("*").alias("games_played"),
        F.sum(F.coalesce("starter", F.lit(False)).cast("long")).alias("games_started"),
        F.countDistinct("team_id").alias("n_teams"),
        F.max_by("team_id", F.struct("game_date", "game_id", "team_id")).alias("primary_team"),
    ]


def season_box(box: DataFrame) -> DataFrame:
    """Totals per season and athlete over games played; all-null totals are 0.  One shuffle, by season and athlete."""
    return played(deduped_games(box, "season", "athlete_id")).groupBy("season", "athlete_id").agg(*_season_totals())


def duplicate_report(box: DataFrame) -> DataFrame:
    """Rows before, and rows that the dedupe removes, per season."""
    per = box.where("athlete_id IS NOT NULL AND game_id IS NOT NULL").groupBy("season", "athlete_id", "game_id").count()
    return per.groupBy("season").agg(F.sum("count").alias("rows_before"), F.sum(F.col("count") - 1).alias("dupes_removed"))


def team_games(box: DataFrame) -> DataFrame:
    return (
        played(deduped_games(box))
        .groupBy("season", "game_id", "team_id")
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"tm_{c}") for c in TEAM])
    )


def opponents(teams: DataFrame) -> DataFrame:
    """Team games with the totals of each other team of the same game; aggregated before the join."""
    other = teams.select("season", "game_id", F.col("team_id").alias("opp_team_id"), *[F.col(f"tm_{c}").alias(f"opp_{c}") for c in TEAM])
    return teams.join(other, ["season", "game_id"]).where("team_id <> opp_team_id")


CONTEXT = [f"{side}_{c}" for side in ("tm", "opp") for c in TEAM]


def games_in_context(box: DataFrame) -> DataFrame:
    """Games played, each with the totals of the own team (once for each other team of the game) and of the other teams.

    What ``opponents`` gives by joins, by windows over the rows of a game: one shuffle, by season and game.  A row without
    a team has no context, and is nobody's opponent.
    """
    games = played(deduped_games(box, "season", "game_id"))
    game = Window.partitionBy("season", "game_id")
    there = F.col("team_id").isNotNull()
    games = games.withColumn("__t", F.dense_rank().over(game.orderBy(F.col("team_id").asc_nulls_last())))
    others = F.max(F.when(there, F.col("__t"))).over(game) - 1
    by_team = game.orderBy("__t")
    own, before, after = by_team.rangeBetween(0, 0), by_team.rangeBetween(Window.unboundedPreceding, -1), by_team.rangeBetween(1, Window.unboundedFollowing)
    out = {}
    for c in TEAM:
        mine = F.when(there, F.col(c))
        out[f"tm_{c}"] = F.when(there, F.coalesce(F.sum(mine).over(own), F.lit(0.0)) * others)
        out[f"opp_{c}"] = F.when(there, F.coalesce(F.sum(mine).over(before), F.lit(0.0)) + F.coalesce(F.sum(mine).over(after), F.lit(0.0)))
    return games.withColumns(out).drop("__t")


def team_context(box: DataFrame) -> DataFrame:
    """Per season and athlete, team and opponent totals over the games played."""
    return in_order(games_in_context(box)).groupBy("season", "athlete_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in CONTEXT])


def season_in_context(box: DataFrame) -> DataFrame:
    """``season_box`` and ``team_context`` of the same games in one pass: a shuffle by game, then one by athlete."""
    return in_order(games_in_context(box)).groupBy("season", "athlete_id").agg(*_season_totals(), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in CONTEXT])


#: Shot types and their names.
CATEGORIES = {"LayUpShot": "layup", "DunkShot": "dunk", "TipShot": "tip", "JumpShot": "jump"}


def shot_profile(shots: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of field-goal attempts by kind in one pass; free throws play no part.

    ``shots``: keys, assister, type_text, made (boolean) and score_value.
    """
    kind = F.coalesce(*[F.when(F.col("type_text") == raw, F.lit(name)) for raw, name in CATEGORIES.items()], F.lit("other"))
    s = shots.where(~F.col("type_text").contains("FreeThrow")).withColumn("kind", kind).withColumn(
        "made", F.coalesce("made", F.lit(False))
    )
    made, three, helped = F.col("made"), F.col("score_value") == 3, F.col("assister").isNotNull()

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    out = [
        F.count("*").alias("fg_attempts"), n(made, "fg_makes"), n(three, "three_attempts"), n(three & made, "three_makes"),
        n(made & helped, "assisted_makes"), n(made & ~helped, "unassisted_makes"),
    ]
    for name in CATEGORIES.values():
        own = F.col("kind") == name
        out += [n(own, f"{name}_attempts"), n(own & made, f"{name}_makes")]
    for name in ("layup", "dunk"):
        own = (F.col("kind") == name) & made
        out += [n(own & helped, f"{name}_assisted"), n(own & ~helped, f"{name}_unassisted")]
    return s.groupBy(*keys).agg(*out)


def features(d: DataFrame) -> DataFrame:
    """Adds the engineered rates to season totals with team context."""
    c = F.col
    team_poss = X.possessions(c("tm_fga"), c("tm_fta"), c("tm_oreb"), c("tm_turnovers"))
    opp_poss = X.possessions(c("opp_fga"), c("opp_fta"), c("opp_oreb"), c("opp_turnovers"))
    two_m, two_a = c("fgm") - c("tpm"), c("fga") - c("tpa")
    out = {
        "team_possessions": team_poss,
        "opp_possessions": opp_poss,
        "minutes_per_game": X.per_game(c("minutes"), c("games_played")),
        "start_share": X.safe_div(c("games_started"), c("games_played")),
        "fg_pct": X.safe_div(c("fgm"), c("fga")),
        "two_point_pct": X.safe_div(two_m, two_a),
        "three_point_pct": X.safe_div(c("tpm"), c("tpa")),
        "ft_pct": X.safe_div(c("ftm"), c("fta")),
        "efg_pct": X.efg(c("fgm"), c("tpm"), c("fga")),
        "ts_pct": X.true_shooting(c("points"), c("fga"), c("fta")),
        "three_point_attempt_rate": X.safe_div(c("tpa"), c("fga")),
        "two_point_attempt_rate": X.safe_div(two_a, c("fga")),
        "free_throw_rate": X.safe_div(c("fta"), c("fga")),
        "assist_to_turnover_ratio": X.safe_div(c("assists"), c("turnovers")),
        "ast_pct": X.assist_pct(c("assists"), c("minutes"), c("tm_minutes"), c("tm_fgm"), c("fgm")),
        "tov_pct": X.turnover_pct(c("turnovers"), c("fga"), c("fta")),
        "orb_pct": X.rebound_pct(c("oreb"), c("minutes"), c("tm_minutes"), c("tm_oreb"), c("opp_dreb")),
        "drb_pct": X.rebound_pct(c("dreb"), c("minutes"), c("tm_minutes"), c("tm_dreb"), c("opp_oreb")),
        "trb_pct": X.rebound_pct(c("rebounds"), c("minutes"), c("tm_minutes"), c("tm_rebounds"), c("opp_rebounds")),
        "stl_pct": X.steal_pct(c("steals"), c("minutes"), c("tm_minutes"), opp_poss),
        "blk_pct": X.block_pct(c("blocks"), c("minutes"), c("tm_minutes"), c("opp_fga"), c("opp_tpa")),
        "usage_pct": X.usage(c("fga"), c("fta"), c("turnovers"), c("minutes"), c("tm_minutes"), c("tm_fga"), c("tm_fta"), c("tm_turnovers")),
    }
    for name in ("points", "assists", "turnovers", "rebounds", "steals", "blocks"):
        out[f"{name}_per_game"] = X.per_game(c(name), c("games_played"))
        out[f"{name}_per_40"] = X.per_40(c(name), c("minutes"))
        out[f"{name}_per_100"] = X.per_100(c(name), team_poss)
    for name, col in (("fga", "fga"), ("three_pa", "tpa"), ("fta", "fta"), ("oreb", "oreb"), ("dreb", "dreb"), ("personal_fouls", "fouls")):
        out[f"{name}_per_40"] = X.per_40(c(col), c("minutes"))
    return d.withColumns(out)


def shot_features(d: DataFrame) -> DataFrame:
    """Adds shares and make rates to a shot profile."""
    c = F.col
    rim_a = c("layup_attempts") + c("dunk_attempts") + c("tip_attempts")
    rim_m = c("layup_makes") + c("dunk_makes") + c("tip_makes")
    out = {f"{k}_attempt_share": X.safe_div(c(f"{k}_attempts"), c("fg_attempts")) for k in ("layup", "dunk", "tip", "three")}
    out |= {f"{k}_make_pct": X.safe_div(c(f"{k}_makes"), c(f"{k}_attempts")) for k in ("layup", "dunk", "tip")}
    out |= {
        "rim_attempt_share": X.safe_div(rim_a, c("fg_attempts")),
        "rim_make_pct": X.safe_div(rim_m, rim_a),
        "assisted_share": X.safe_div(c("assisted_makes"), c("fg_makes")),
        "unassisted_share": X.safe_div(c("unassisted_makes"), c("fg_makes")),
    }
    for k in ("layup", "dunk"):
        out[f"assisted_{k}_share"] = X.safe_div(c(f"{k}_assisted"), c(f"{k}_makes"))
    return d.withColumns(out)


def weighted_means(df: DataFrame, keys: list[str], metrics: list[str], weight: str) -> DataFrame:
    """Means weighted over the rows that have the metric; NULL where none has."""
    return df.groupBy(*keys).agg(
        *[
            X.safe_div(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m)
            for m in metrics
        ]
    )


def widened(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide over a stated list of names; of several values the smallest."""
    return df.groupBy(*keys).pivot(name, names).agg(F.min(value))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, present, fill_rate)."""
    one = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.select("rows", F.expr(f"stack({len(columns)}, {pairs}) AS (column, present)")).select(
        "column", "rows", "present", X.safe_div(F.col("present"), F.col("rows")).alias("fill_rate")
    )


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin of fixed width, empty bins included."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, X.bin_index(F.col(value), lo, hi, bins).alias("bin")).count()
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("count", F.lit(0)).alias("n"))


def consensus(df: DataFrame, name: str, source: str, least: int = 2) -> DataFrame:
    """Names that at least so many sources list, with their sources in order."""
    return (
        df.groupBy(name)
        .agg(F.countDistinct(source).alias("n_sources"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))
        .where(F.col("n_sources") >= least)
    )
