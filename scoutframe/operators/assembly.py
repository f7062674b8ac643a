"""A prospect data set from its parts: populations, identity, totals, shots and bios, targets, imports and audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scoutframe.functions import expr as X
from scoutframe.functions.text import name_key, position_group, row_id
from scoutframe.operators.aggregate import features, first_rows, season_in_context, shot_features, shot_profile, widened
from scoutframe.operators.identity import match
from scoutframe.operators.validate import denied_columns
from scoutframe.sources.sinks import stored

#: Seasons whose schedules were cut.
SHORT_SEASONS = (2020, 2021)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drops the columns that begin with ``prefix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def joined_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which a column that both sides have comes from the left."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, how)


def one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the first by all other columns: what may be joined without doubling anybody."""
    return first_rows(df, keys, [F.col(f"`{c}`") for c in sorted(df.columns) if c not in keys])


def with_missing(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Adds the columns that aren't there, as NULL."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def feature_columns(df: DataFrame, apart: tuple[str, ...]) -> list[str]:
    """Numeric columns that are neither identity, denominators nor audits."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in apart]


def feature_set(sets: dict[str, dict], name: str) -> list[str]:
    """A named list of features: its own, after those of the set that it extends, without what it removes."""
    spec = sets[name]
    base = feature_set(sets, spec["extends"]) if "extends" in spec else []
    out = [*base, *(f for f in spec.get("features", []) if f not in base)]
    gone = set(spec.get("remove", []))
    if unknown := gone - set(out):
        raise KeyError(f"{name} removes what it doesn't have: {', '.join(sorted(unknown))}")
    return [f for f in out if f not in gone]


def prospect_features(population: DataFrame, box: DataFrame, shots: DataFrame, bio: DataFrame, season: str = "season", athlete: str = "athlete_id") -> DataFrame:
    """One row for each prospect, matched or not: season totals, shots and bio of the athlete, with two-point counts and the short-season flag.

    ``population`` has ``season``, ``athlete_id`` (NULL where nobody was matched) and its own columns; nobody is dropped or doubled,
    whatever the other sides hold several times.
    """
    out = joined_once(population, one_each(box, [season, athlete]), [season, athlete])
    out = joined_once(joined_once(out, one_each(shots, [athlete]), [athlete]), one_each(bio, [athlete]), [athlete])
    return out.withColumns(
        {
            "two_points_made": F.col("fgm") - F.col("tpm"),
            "two_points_attempted": F.col("fga") - F.col("tpa"),
            "short_season": F.col(season).isin(*SHORT_SEASONS).cast("int"),
        }
    )


#: Column of the engineered frame that each reliability rule counts in.
DENOMINATORS = {"three_points_attempted": "tpa", "free_throws_attempted": "fta", "shot_records": "fg_attempts"}


def engineered(d: DataFrame) -> DataFrame:
    """Adds all engineered columns to totals with team context, shots and bio: rates, shot shares, position, size and the share of shots on file."""
    out = shot_features(features(d))
    return out.withColumns(
        {
            "position_3": position_group(F.col("label")),
            "height": X.num("height_inches"),
            "weight": X.num("weight_pounds"),
            "unassisted_made_fg_share": F.col("unassisted_share"),
            "assisted_made_fg_share": F.col("assisted_share"),
            "shot_fga_coverage_ratio": X.safe_div(F.col("fg_attempts"), F.col("fga")),
        }
    )


def season_frame(box: DataFrame, shots: DataFrame, bio: DataFrame) -> DataFrame:
    """Every athlete of every season on the definitions of the features: one row for each, whatever the bios hold.

    ``shots`` has ``season`` and ``athlete_id``; a row of games without shots or a bio has NULL there.
    """
    own = joined_once(season_in_context(box), shot_profile(shots, ["season", "athlete_id"]), ["season", "athlete_id"])
    return engineered(joined_once(own, one_each(bio, ["athlete_id"]), ["athlete_id"]))


def prospect_frame(population: DataFrame, index: DataFrame, overrides: DataFrame, frame: DataFrame) -> DataFrame:
    """Population with identity, then the engineered row of the athlete's own season: everyone stays, once.

    ``population``: season, person_id, name_key, school and its own columns, none of them telling outcomes; ``index`` as
    ``identity.season_index`` by season; ``frame`` as ``season_frame``.
    """
    found = match(population, index, overrides, ("season",)).withColumnRenamed("matched_id", "athlete_id")
    return joined_once(found, frame, ["season", "athlete_id"]).withColumn("short_season", F.col("season").isin(*SHORT_SEASONS).cast("int"))


@dataclass
class Built:
    """A built data set: features without outcomes, targets, who was matched how, counts a year, and gates."""

    features: DataFrame
    targets: DataFrame
    crosswalk: DataFrame
    stats: DataFrame
    gates: DataFrame

    def failed(self) -> list[str]:
        return [r.gate for r in self.gates.where("NOT passed").orderBy("gate").collect()]


def build_dataset(prospects: DataFrame, targets: DataFrame, ident: str = "person_id", held_out: tuple[int, ...] = (), expected: dict[int, int] | None = None, least_matched: float = 0.9) -> Built:
    """The data set of all years with its gates, each a count of what breaks it.

    ``prospects`` as ``prospect_frame``; ``targets``: ident, drafted, pick.  ``expected`` announces prospects by year.
    """
    # stats and gates read these alone; whatever else a feature needs is neither dealt nor written for them
    told = stored(prospects.select("season", ident, "athlete_id", "method", "games_played", "fg_attempts", "n_teams"))
    typed = with_targets(told.select(ident, "season"), targets, [ident])
    stats = build_stats(told, "season", "athlete_id", "method").join(
        typed.groupBy("season").agg(F.sum("drafted").alias("drafted"), F.count_if(F.col("drafted") == 0).alias("undrafted")), "season", "left"
    )
    kept = [c for c in prospects.columns if c not in ("method", "school", "name_key")]
    feats = prospects.select(*kept)
    spark = prospects.sparkSession
    one = lambda name, df: df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("gate"), "broken")
    rows = [
        one("ids are unique", told.groupBy(ident).count().where("count > 1")),
        one("features have targets", told.select(ident).distinct().join(targets.select(ident), ident, "left_anti")),
        one("targets have features", targets.select(ident).distinct().join(told.select(ident), ident, "left_anti")),
        one("no held-out year", told.where(F.col("season").isin(*held_out)) if held_out else told.limit(0)),
        one("most prospects are matched", stats.where(F.col("matched") < least_matched * F.col("prospects"))),
        one("no outcome among the features", spark.createDataFrame([(c,) for c in denied_columns(kept)], "c string")),
    ]
    if expected is not None:
        want = spark.createDataFrame(list(expected.items()), "season int, expected long")
        found = stats.select(F.col("season").cast("int").alias("season"), "prospects")
        rows.append(one("as many prospects as announced", want.join(found, "season", "full").where(~F.col("expected").eqNullSafe(F.col("prospects")))))
    gates_table = rows[0]
    for other in rows[1:]:
        gates_table = gates_table.unionAll(other)
    crosswalk = prospects.select("season", ident, "name_key", "school", "athlete_id", "method")
    return Built(feats, typed, crosswalk, stats, gates_table.withColumn("passed", F.col("broken") == 0))


def build_stats(df: DataFrame, year: str, matched: str, method: str | None = None) -> DataFrame:
    """Per year: prospects, matched and not, with totals, with shots, of several teams; counts by method where there is one."""
    c = F.col
    counts = [
        F.count("*").alias("prospects"), F.count(matched).alias("matched"), F.count_if(c(matched).isNull()).alias("unmatched"),
        F.count("games_played").alias("with_box"), F.count("fg_attempts").alias("with_shots"), F.count_if(c("n_teams") > 1).alias("multi_team"),
    ]
    if method:
        counts += [F.count_if(c(method) == m).alias(m.lower()) for m in ("OVERRIDE", "AMBIGUOUS")]
    return df.groupBy(year).agg(*counts)


def gates(df: DataFrame, ident: str, stats: DataFrame, least_matched: float = 0.9) -> list[str]:
    """Names of the gates that a built data set fails: one row an id, a match for most."""
    failed = []
    if not df.groupBy(ident).count().where("count > 1").isEmpty():
        failed.append("ids are unique")
    if not stats.where(F.col("matched") < least_matched * F.col("prospects")).isEmpty():
        failed.append("most prospects are matched")
    return failed


def with_targets(df: DataFrame, targets: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Features with what became of the prospects: ``drafted`` 0 or 1, ``pick`` a number or NULL.  With "left", who has no target stays."""
    typed = targets.withColumns({"drafted": (F.col("drafted").cast("string").isin("True", "true", "1")).cast("int"), "pick": X.num("pick")})
    return df.join(typed.select(*keys, "drafted", "pick"), keys, how)


def with_size(df: DataFrame, sizes: dict[int, int], year: str) -> DataFrame:
    """Adds ``draft_size`` of each year, NULL for a year without one."""
    if not sizes:
        return df.withColumn("draft_size", F.lit(None).cast("int"))
    table = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    return df.withColumn("draft_size", F.try_element_at(table, F.col(year)))


def with_status(df: DataFrame, status: DataFrame, key: str, other: str = "UNKNOWN") -> DataFrame:
    """Adds the status found for a key (of several the first), or ``other``."""
    return df.join(status.groupBy(key).agg(F.min("status").alias("__s")), key, "left").withColumn("status", F.coalesce("__s", F.lit(other))).drop("__s")


def sources_summary(appearances: DataFrame) -> DataFrame:
    """(source, url, publication_date, listed): the first url and date of each source, by date and url, and its rows."""
    first = F.min(F.struct("publication_date", "url"))
    out = appearances.groupBy("source").agg(first.alias("f"), F.count("*").alias("listed"))
    return out.select("source", "f.url", "f.publication_date", "listed")


def consensus_population(appearances: DataFrame, year: int, least: int = 2) -> DataFrame:
    """Players whom at least ``least`` sources name, one row each: the appearance in the first source, all sources and an id."""
    rows = appearances.withColumn("normalized_name", name_key(F.col("player_name")))
    found = rows.groupBy("normalized_name").agg(F.sort_array(F.collect_set("source")).alias("__sources"))
    named = found.where(F.size("__sources") >= least)
    first = first_rows(rows, ["normalized_name"], ["source", "player_name", "school"])
    return first.join(named, "normalized_name").select(
        row_id(F.lit(year), F.col("normalized_name")).alias("prospect_id"), F.lit(year).alias("draft_year"), "player_name", "normalized_name",
        F.col("school").alias("college"), F.array_join("__sources", ",").alias("sources"), F.size("__sources").cast("long").alias("n_sources"),
    )


def returning_and_incoming(population: DataFrame, box: DataFrame, athlete: str = "athlete_id") -> tuple[DataFrame, DataFrame]:
    """Those with a played record, with its totals, and those without one."""
    return joined_once(population, box, [athlete], "inner"), population.join(box, [athlete], "left_anti")


def declared_audit(matched: DataFrame, athlete: str, games: str) -> DataFrame:
    """One row: declared, matched, unmatched, scoreable and insufficient."""
    ok = F.col(athlete).isNotNull() & F.col(games).isNotNull()
    return matched.agg(
        F.count("*").alias("declared"), F.count(athlete).alias("matched"), F.count_if(F.col(athlete).isNull()).alias("unmatched"),
        F.count_if(ok).alias("scoreable"), F.count_if(~ok).alias("insufficient"),
    )


def player_seasons(identity: DataFrame, long: DataFrame, key: str, totals: list[str], averages: list[str]) -> DataFrame:
    """Identity with wide totals and averages of a long table (key, category, stat_name, value): who lacks any of the three is left out; of several values the smallest."""

    def wide(category: str, names: list[str], suffix: str) -> DataFrame:
        one = long.where(F.col("category") == category).groupBy(key, "stat_name").agg(F.min("value").alias("value"))
        out = widened(one, [key], "stat_name", "value", names)
        return out.select(key, *[F.col(n).alias(f"{n}{suffix}") for n in names])

    return identity.join(wide("totals", totals, ""), key).join(wide("averages", averages, "_average"), key)


def to_primitives(df: DataFrame, renamed: dict[str, str], needed: list[str], season: Column) -> DataFrame:
    """An imported table under the names that the features read: renamed, numeric, with what is missing as NULL, two-point counts and the year."""
    out = df.withColumnsRenamed({k: v for k, v in renamed.items() if k in df.columns})
    out = with_missing(out, [*needed, "fgm", "tpm", "fga", "tpa"])
    out = out.withColumns({c: X.num(c) for c in dict.fromkeys([*needed, "fgm", "tpm", "fga", "tpa"])})
    return out.withColumns({"two_points_made": F.col("fgm") - F.col("tpm"), "two_points_attempted": F.col("fga") - F.col("tpa"), "draft_year": season})


def roster_match(names: DataFrame, roster: DataFrame, name: str, school: str) -> DataFrame:
    """(name, school, candidates, confirmed): roster rows of the same name key, and of those with the same first word of the school."""
    first = lambda c: F.lower(F.split(F.trim(F.col(c)), r"\s+")[0])
    a = names.select(name, school, name_key(F.col(name)).alias("__k"), first(school).alias("__s"))
    b = roster.select(name_key(F.col(name)).alias("__k"), first(school).alias("__t"))
    return a.join(b, "__k", "left").groupBy(name, school).agg(
        F.count("__t").alias("candidates"), F.count_if(F.col("__s") == F.col("__t")).alias("confirmed")
    )
