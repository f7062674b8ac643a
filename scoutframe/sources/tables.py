"""Typed readers, and the roles that the driver's tables play for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions.text import row_id

#: Schema of one player-game row.
PLAYER_BOX = (
    "athlete_id double, game_id bigint, team_id bigint, team_location string, game_date string, did_not_play boolean,"
    " starter boolean, minutes double, points double, field_goals_made double, field_goals_attempted double,"
    " three_point_field_goals_made double, three_point_field_goals_attempted double, free_throws_made double,"
    " free_throws_attempted double, offensive_rebounds double, defensive_rebounds double, rebounds double, assists double,"
    " turnovers double, steals double, blocks double, fouls double"
)
SHOTS = "athlete_id_1 double, athlete_id_2 double, type_text string, scoring_play boolean, score_value int"
POPULATION = (
    "draft_year int, player_name string, normalized_name string, college string, position string, class string,"
    " population_source string, early_entrant string, wikipedia_title string"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seasons(spark: SparkSession, pattern: str | list[str], schema: str | None = None) -> DataFrame:
    """One scan over files that carry their year in the name, by a pattern or by their paths, with a ``season`` column."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([pattern] if isinstance(pattern, str) else pattern)).withColumn(
        "season", F.regexp_extract(F.input_file_name(), r"_(\d{4})\.parquet", 1).try_cast("int")
    )


def population(spark: SparkSession, path: str) -> DataFrame:
    """Early entrants of a population file, each with an id of its year and name."""
    rows = _csv(spark, path, POPULATION).where(F.col("early_entrant") == "True")
    return rows.withColumn("canonical_prospect_id", row_id(F.col("draft_year"), F.col("normalized_name")))


TARGETS = (
    "draft_year int, normalized_name string, player_name string, wikipedia_title string, drafted string, pick string, round string,"
    " drafting_team string"
)
OVERRIDES = "draft_year int, normalized_name string, athlete_id string, player_name string, expected_school string, hoopr_name string, reason string"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def optional(read_rows, *args):
    """What a reader gives, or None where its file is not there."""
    from pyspark.errors import AnalysisException

    try:
        return read_rows(*args)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def declared(spark: SparkSession, path: str) -> DataFrame | None:
    """A declared pool; None before it was acquired."""
    return optional(_csv, spark, path, POPULATION)


def targets(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Targets of the names in a population: drafted 0 or 1, pick and round whole numbers or NULL."""
    rows = _csv(spark, path, TARGETS).join(known.select("normalized_name"), "normalized_name", "left_semi")
    return rows.select(
        "draft_year", "normalized_name", (F.col("drafted") == "True").cast("int").alias("drafted"), X.to_id(F.col("pick")).alias("pick"),
        X.to_id(F.col("round")).alias("round"), "drafting_team",
    )


def overrides(spark: SparkSession, path: str) -> DataFrame | None:
    """Reviewed exceptions with an athlete id; None without the file."""
    rows = optional(_csv, spark, path, OVERRIDES)
    return None if rows is None else rows.withColumn("athlete_id", X.to_id(F.col("athlete_id"))).where("athlete_id IS NOT NULL")


def labelled(features: DataFrame, known: DataFrame, years: range, held_out: tuple[int, ...] = ()) -> DataFrame:
    """Features of some years with their targets; a held-out year among them is an error."""
    if bad := sorted(set(years) & set(held_out)):
        raise ValueError(f"held out: {bad}")
    return features.where(F.col("draft_year").isin(*years)).join(known, ["draft_year", "normalized_name"])


def built(spark: SparkSession, path: str, what: str) -> DataFrame:
    """A table that another step writes; says so where it is not there."""
    found = optional(spark.read.parquet, path)
    if found is None:
        raise FileNotFoundError(f"{what} is not built yet: {path}")
    return found


def imported(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Prospects of an imported dataset file: metadata and one row for each prospect."""
    doc = spark.read.schema(
        f"schemaVersion int, metadata struct<dataset_name: string, season: int, population_type: string, draft_size: int>,"
        f" prospects array<struct<{fields}>>"
    ).option("multiLine", True).json(path)
    return doc.select("metadata", F.posexplode("prospects").alias("row", "p")).select("metadata", "row", "p.*")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` in the role of player-game rows."""
    return read(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"),
        F.col("l_partkey").alias("athlete_id"),
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("team_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("game_date"),
        (F.col("l_returnflag") == "R").alias("did_not_play"),
        (F.col("l_linestatus") == "O").alias("starter"),
        F.col("l_quantity").alias("minutes"),
        F.col("l_quantity").alias("fga"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("fgm"),
        F.col("l_linenumber").cast("double").alias("tpa"),
        (F.col("l_linenumber") * (1 - F.col("l_discount"))).alias("tpm"),
        (F.col("l_quantity") * F.col("l_tax")).alias("fta"),
        (F.col("l_quantity") * F.col("l_tax") * (1 - F.col("l_discount"))).alias("ftm"),
        (F.col("l_extendedprice") / 1000).alias("points"),
        F.col("l_linenumber").cast("double").alias("oreb"),
        (F.col("l_quantity") * F.col("l_discount")).alias("dreb"),
        (F.col("l_quantity") * F.col("l_discount") + F.col("l_linenumber")).alias("rebounds"),
        (F.col("l_quantity") * F.col("l_tax") * 2).alias("assists"),
        (F.col("l_linenumber") * F.col("l_tax")).alias("turnovers"),
        (F.col("l_linenumber") * F.col("l_discount")).alias("steals"),
        (F.col("l_quantity") * F.col("l_tax") / 2).alias("blocks"),
        F.col("l_linenumber").cast("double").alias("fouls"),
    )


#: The same role in DuckDB.
BOX_SQL = """box AS (SELECT year(l_shipdate) AS season, l_partkey AS athlete_id, l_orderkey AS game_id, l_suppkey AS team_id,
  strftime(l_shipdate, '%Y-%m-%d') AS game_date, l_returnflag = 'R' AS did_not_play, l_linestatus = 'O' AS starter,
  l_quantity AS minutes, l_quantity AS fga, l_quantity * (1 - l_discount) AS fgm, l_linenumber::DOUBLE AS tpa,
  l_linenumber * (1 - l_discount) AS tpm, l_quantity * l_tax AS fta, l_quantity * l_tax * (1 - l_discount) AS ftm,
  l_extendedprice / 1000 AS points, l_linenumber::DOUBLE AS oreb, l_quantity * l_discount AS dreb,
  l_quantity * l_discount + l_linenumber AS rebounds, l_quantity * l_tax * 2 AS assists, l_linenumber * l_tax AS turnovers,
  l_linenumber * l_discount AS steals, l_quantity * l_tax / 2 AS blocks, l_linenumber::DOUBLE AS fouls FROM lineitem)"""

SHOT_TYPES = {"view": "JumpShot", "click": "LayUpShot", "purchase": "DunkShot", "signup": "TipShot", "error": "MadeFreeThrow"}


def bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` in the role of athlete bios."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("athlete_id"),
        F.col("p_name").alias("display_name"),
        F.element_at(F.array(*map(F.lit, ("PG", "SG", "SF", "PF", "C", "ATH"))), (F.col("p_partkey") % 6 + 1).cast("int")).alias("label"),
        X.num(F.col("p_size")).alias("size"),
        (F.col("p_size") % 20 + 68).cast("double").alias("height_inches"),
        (F.col("p_partkey") * 7 % 120 + 160).cast("double").alias("weight_pounds"),
    )


BIO_SQL = """bio AS (SELECT p_partkey AS athlete_id, p_name AS display_name, ['PG', 'SG', 'SF', 'PF', 'C', 'ATH'][(p_partkey % 6 + 1)::INT] AS label,
  p_size::DOUBLE AS size, (p_size % 20 + 68)::DOUBLE AS height_inches, (p_partkey * 7 % 120 + 160)::DOUBLE AS weight_pounds FROM part)"""
