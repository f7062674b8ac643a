"""Team need as data: dimensions, archetypes and their rules are long tables, and one plan evaluates all of them.

A prospect stays one row: its metrics are looked up in the peers' grids, dimensions are
means of these columns, archetypes geometric means; what is asked is then told as rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scoutframe.functions import expr as X
from scoutframe.operators.assembly import with_missing

GLOBAL, POSITION = "GLOBAL", "POSITION"
#: Fixed values: (dimension, metric, reference group, whether higher is better).
COMPONENTS = [
    ("SHOOTING", "three_point_pct", GLOBAL, True),
    ("SHOOTING", "three_point_attempt_rate", GLOBAL, True),
    ("SHOOTING", "ft_pct", GLOBAL, True),
    ("SHOOTING", "efg_pct", GLOBAL, True),
    ("PLAYMAKING", "ast_pct", GLOBAL, True),
    ("PLAYMAKING", "tov_pct", GLOBAL, False),
    ("BOX_SCORE_DEFENSIVE_PRODUCTION", "stl_pct", POSITION, True),
    ("BOX_SCORE_DEFENSIVE_PRODUCTION", "blk_pct", POSITION, True),
    ("REBOUNDING", "orb_pct", POSITION, True),
    ("REBOUNDING", "drb_pct", POSITION, True),
    ("SIZE", "height", GLOBAL, True),
    ("SIZE", "weight", GLOBAL, True),
    ("RIM_PRESSURE", "rim_attempt_share", GLOBAL, True),
    ("RIM_PRESSURE", "free_throw_rate", GLOBAL, True),
    ("RIM_PRESSURE", "rim_make_pct", GLOBAL, True),
    ("RIM_PRESSURE", "unassisted_made_fg_share", GLOBAL, True),
]
#: Fixed values: (archetype, pillar, what it is the mean of: one dimension, or metrics; the group of peers, where it isn't the metric's own).
PILLARS = [
    ("SHOOTER", "efficiency", "METRIC", "three_point_pct", None),
    ("SHOOTER", "efficiency", "METRIC", "ft_pct", None),
    ("SHOOTER", "efficiency", "METRIC", "efg_pct", None),
    ("SHOOTER", "volume", "METRIC", "three_point_attempt_rate", None),
    ("SLASHER", "RIM_PRESSURE", "DIMENSION", "RIM_PRESSURE", None),
    ("PLAYMAKER", "PLAYMAKING", "DIMENSION", "PLAYMAKING", None),
    ("THREE_AND_D", "shooting", "DIMENSION", "SHOOTING", None),
    ("THREE_AND_D", "defense", "DIMENSION", "BOX_SCORE_DEFENSIVE_PRODUCTION", None),
    ("RIM_PROTECTOR", "shot_blocking", "METRIC", "blk_pct", GLOBAL),
    ("RIM_PROTECTOR", "rebounding", "DIMENSION", "REBOUNDING", None),
    ("RIM_PROTECTOR", "size", "DIMENSION", "SIZE", None),
    ("STRETCH_BIG", "shooting", "DIMENSION", "SHOOTING", None),
    ("STRETCH_BIG", "size", "DIMENSION", "SIZE", None),
]
#: Positions of an archetype; one that isn't named is open to all.
ELIGIBLE = [("THREE_AND_D", "G"), ("THREE_AND_D", "F"), ("RIM_PROTECTOR", "F"), ("RIM_PROTECTOR", "C"), ("STRETCH_BIG", "F"), ("STRETCH_BIG", "C")]
#: Fixed values: (metric, what it is counted over, the least of it).
RELIABLE = [("three_point_pct", "three_points_attempted", 20), ("ft_pct", "free_throws_attempted", 20), ("rim_make_pct", "shot_records", 20)]
#: Share of its metrics that a dimension needs.
LEAST_SHARE = 0.5


@dataclass
class Specification:
    """The rules as rows; ``denominators`` names the columns that reliability is counted in, where they are called otherwise."""

    components: list[tuple] = field(default_factory=lambda: list(COMPONENTS))
    pillars: list[tuple] = field(default_factory=lambda: list(PILLARS))
    eligible: list[tuple] = field(default_factory=lambda: list(ELIGIBLE))
    reliable: list[tuple] = field(default_factory=lambda: list(RELIABLE))
    denominators: dict[str, str] = field(default_factory=dict)

    def dimensions(self) -> list[str]:
        return list(dict.fromkeys(c[0] for c in self.components))

    def archetypes(self) -> list[str]:
        return list(dict.fromkeys(p[0] for p in self.pillars))

    def metrics_of(self, dimension: str) -> list[str]:
        return [m for d, m, *_ in self.components if d == dimension]

    def metrics(self) -> list[str]:
        return list(dict.fromkeys([c[1] for c in self.components] + [p[3] for p in self.pillars if p[2] == "METRIC"]))

    def component_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.components, "dimension string, metric string, reference_group string, higher boolean")

    def pillar_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.pillars, "profile string, pillar string, source string, name string, reference_group string")

    def check(self) -> None:
        """Every pillar names a dimension or metric that there is, and no metric means two things."""
        if unknown := [p[3] for p in self.pillars if p[2] == "DIMENSION" and p[3] not in self.dimensions()]:
            raise KeyError(f"unknown dimension {unknown[0]}")
        own = {c[1] for c in self.components}
        if unknown := [p[3] for p in self.pillars if p[2] == "METRIC" and p[4] is None and p[3] not in own]:
            raise KeyError(f"{unknown[0]} is in no dimension, so its pillar must name a group of peers")
        for metric in own:
            if len({c[2:] for c in self.components if c[1] == metric}) > 1:
                raise ValueError(f"{metric} is measured in two ways: a metric must mean one thing")


def conflicts(components: DataFrame) -> DataFrame:
    """(metric, dimensions, reference_groups) of a long specification that one metric has several of, in order."""
    found = components.groupBy("metric").agg(
        F.array_join(F.sort_array(F.collect_set("dimension")), ",").alias("dimensions"), F.sort_array(F.collect_set("reference_group")).alias("__groups"), F.countDistinct("higher").alias("__ways")
    )
    return found.where("size(__groups) > 1 OR __ways > 1").select("metric", "dimensions", F.array_join("__groups", ",").alias("reference_groups"))


def placed(df: DataFrame, grid: DataFrame, held: list[str], season: str, group: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """``held`` and a column ``__p0``, ``__p1``, ... for each (metric, GLOBAL or POSITION) of ``wanted``: the place on the grid.

    POSITION takes the grid of the row's own group, and where there is none the one of all; a value that is missing, or
    a season without a grid, gives NULL.  A row stays one row and meets no join: tasks look its values up in the grids, a
    hundred numbers for each season, group and metric, whatever the number of rows.
    """
    metrics = list(dict.fromkeys(m for m, _ in wanted))
    known = {(r[0], r[1], r[2]): np.array(r[3], dtype=np.float64) for r in grid.where(F.col("metric").isin(metrics)).select(season, "reference_group", "metric", "grid").collect()}
    whole = with_missing(df, metrics).select(*held, F.col(season).alias("__season"), F.coalesce(F.col(group), F.lit(GLOBAL)).alias("__group"), *[X.num(m).alias(f"__v{k}") for k, m in enumerate(metrics)])
    schema = StructType([*whole.select(*held).schema.fields, *[StructField(f"__p{k}", DoubleType()) for k in range(len(wanted))]])

    def run(batches):
        for batch in batches:
            values = {m: batch.column(f"__v{k}").to_numpy(zero_copy_only=False).astype(np.float64) for k, m in enumerate(metrics)}
            out = np.full((len(wanted), batch.num_rows), np.nan)
            scopes = pa.table({"s": batch.column("__season"), "g": batch.column("__group"), "i": np.arange(batch.num_rows)}).group_by(["s", "g"]).aggregate([("i", "list")]).to_pylist()
            for scope in scopes:
                at = np.array(scope["i_list"])
                for k, (m, kind) in enumerate(wanted):
                    every = known.get((scope["s"], GLOBAL, m))
                    knots = known.get((scope["s"], scope["g"], m), every) if kind == POSITION else every
                    if knots is not None:
                        out[k, at] = X.interpolated(knots, values[m][at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], *[pa.array(x, from_pandas=True) for x in out]], [f.name for f in schema.fields])

    return whole.mapInArrow(run, schema)


def percentile_frame(df: DataFrame, grid: DataFrame, keys: list[str], season: str, group: str, wanted: list[tuple[str, str]], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried, metric, reference_group, percentile): a row for each prospect and each (metric, GLOBAL or POSITION) of ``wanted``, see ``placed``.

    ``grid`` as ``peers.grids`` gives it; ``keys`` name a prospect and include ``season``.
    """
    wanted = list(dict.fromkeys(wanted))
    rows = placed(df, grid, [*keys, *carried], season, group, wanted)
    each = [F.struct(F.lit(m).alias("metric"), F.lit(kind).alias("reference_group"), F.col(f"__p{k}").alias("percentile")) for k, (m, kind) in enumerate(wanted)]
    return rows.select(*keys, *carried, F.inline(F.array(*each)))


@dataclass
class Scores:
    """What one evaluation gives: percentiles of metrics, dimensions and archetypes, all long."""

    components: DataFrame
    dimensions: DataFrame
    profiles: DataFrame


def evaluated(df: DataFrame, grid: DataFrame, keys: list[str], season: str, group: str, spec: Specification | None = None) -> Scores:
    """All dimensions and archetypes of all prospects.

    ``components``: (keys, metric, reference_group, raw, oriented): percentiles behind their least attempts, as they are and with
    higher for better.  ``dimensions``: (keys, dimension, score, coverage), a mean where half of the metrics are there.
    ``profiles``: (keys, profile, fit_raw, eligibility, fit_status, fit_score, fit_rank), NULL unless all pillars are there,
    ranked within the season; everyone has a row for everything.
    """
    spec = spec or Specification()
    spec.check()
    spark = df.sparkSession
    apart = [(p[3], p[4]) for p in spec.pillars if p[2] == "METRIC" and p[4]]
    wanted = list(dict.fromkeys([(c[1], c[2]) for c in spec.components] + apart))
    named = {m: (spec.denominators.get(d, d), least) for m, d, least in spec.reliable}
    held = with_missing(df, [d for d, _ in named.values()]).withColumns({f"__d{k}": F.coalesce(X.num(d) >= least, F.lit(False)) for k, (d, least) in enumerate(named.values())})
    rows = placed(held, grid, list(dict.fromkeys([*keys, group])) + [f"__d{k}" for k in range(len(named))], season, group, wanted)
    # a prospect stays one row up to what is asked: nothing moves, and only the columns of what is asked are formed
    place = {pair: F.col(f"__p{k}") for k, pair in enumerate(wanted)}
    enough = {m: F.col(f"__d{k}") for k, m in enumerate(named)}
    own = {c[1]: c for c in spec.components}
    raw = {m: F.when(enough[m], place[m, c[2]]) if m in enough else place[m, c[2]] for m, c in own.items()}
    oriented = {m: raw[m] if c[3] else 100 - raw[m] for m, c in own.items()}

    def long(df: DataFrame, name: str, each: dict[str, list[Column]]) -> DataFrame:
        return df.select(*keys, *([group] if group not in keys else []), F.inline(F.array(*[F.struct(F.lit(n).alias(name), *cols) for n, cols in each.items()])))

    components = long(rows, "metric", {m: [F.lit(c[2]).alias("reference_group"), raw[m].alias("raw"), oriented[m].alias("oriented")] for m, c in own.items()})
    scored = rows
    for k, d in enumerate(spec.dimensions()):
        parts = [oriented[m] for m in spec.metrics_of(d)]
        n = X.row_count(*parts)
        scored = scored.withColumns({f"__s{k}": F.when(n >= math.ceil(LEAST_SHARE * len(parts)), X.row_mean(*parts)), f"__c{k}": n / len(parts)})
    score = {d: F.col(f"__s{k}") for k, d in enumerate(spec.dimensions())}
    dimensions = long(scored, "dimension", {d: [score[d].alias("score"), F.col(f"__c{k}").alias("coverage")] for k, d in enumerate(score)})
    fit = {}
    for profile in spec.archetypes():
        pillars: dict[str, list[Column]] = {}
        for _, pillar, source, name, peers in [p for p in spec.pillars if p[0] == profile]:
            pillars.setdefault(pillar, []).append(score[name] if source == "DIMENSION" else place[name, peers] if peers else oriented[name])
        means = [X.row_mean(*values) for values in pillars.values()]
        fit[profile] = means[0] if len(means) == 1 else X.geo_mean(*means)
    fits = long(scored, "profile", {p: [F.array(*[F.lit(g) for q, g in spec.eligible if q == p]).cast("array<string>").alias("__allowed"), f.alias("fit_raw")] for p, f in fit.items()})
    fits = fits.withColumn("__group", F.col(group))
    eligibility = (
        F.when(F.size("__allowed") == 0, "ELIGIBLE")
        .when(F.col("__group").isNull() | (F.col("__group") == "UNKNOWN"), "UNKNOWN_POSITION")
        .when(F.array_contains("__allowed", F.col("__group")), "ELIGIBLE")
        .otherwise("OUT_OF_POSITION")
    )
    fits = fits.withColumns({"eligibility": eligibility, "fit_status": F.when(F.col("fit_raw").isNull(), "UNAVAILABLE").otherwise("OK"), "fit_score": X.half_even(X.clamp(F.round("fit_raw", 9), 0.0, 100.0))})
    place = Window.partitionBy(season, "profile").orderBy(F.col("fit_raw").isNull(), F.col("eligibility") == "OUT_OF_POSITION", F.round("fit_raw", 9).desc_nulls_last(), *[k for k in keys if k != season])
    fits = fits.withColumn("fit_rank", F.row_number().over(place).cast("long"))
    return Scores(
        components.select(*keys, "metric", "reference_group", "raw", "oriented"),
        dimensions.select(*keys, "dimension", "score", "coverage"),
        fits.select(*keys, "profile", "fit_raw", "eligibility", "fit_status", "fit_score", "fit_rank"),
    )


def position_relative_size(df: DataFrame, grid: DataFrame, keys: list[str], season: str, group: str) -> DataFrame:
    """(keys, size_in_position): mean percentile of height and weight among the own position; a diagnostic, in no dimension."""
    rows = placed(df, grid, keys, season, group, [("height", POSITION), ("weight", POSITION)])
    return rows.select(*keys, X.row_mean(F.col("__p0"), F.col("__p1")).alias("size_in_position"))
