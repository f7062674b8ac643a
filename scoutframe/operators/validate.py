"""Dataset rules as data: field checks, consistency, duplicates, column policy, capabilities, expectations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    whole: bool = False
    choices: tuple[str, ...] = ()


#: Columns that tell outcomes, and rates that must come as counts.
PROHIBITED = ("actual_pick", "pick", "round", "drafted", "drafting_team")
DERIVED = ("three_point_pct", "fg_pct", "ft_pct", "efg_pct", "ts_pct")
LEAST_ROWS, MOST_ROWS = 5, 2000


def number(c: Column) -> Column:
    """Number from text with thousands commas."""
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def _issue(when: Column, severity: str, field: str, message: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(message).alias("message")))


def field_checks(fields: list[Field]) -> list[Column]:
    out = []
    for f in fields:
        raw = F.col(f.name).cast("string")
        blank = raw.isNull() | (F.trim(raw) == "")
        if f.required:
            out.append(_issue(blank, "error", f.name, "is required"))
        if f.choices:
            out.append(_issue(~blank & ~raw.isin(*f.choices), "error", f.name, "must be one of " + ", ".join(f.choices)))
            continue
        if f.low is None and f.high is None and not f.whole:
            continue
        v = number(F.col(f.name))
        out.append(_issue(~blank & v.isNull(), "error", f.name, "must be a number"))
        if f.whole:
            out.append(_issue(v != F.floor(v), "error", f.name, "must be a whole number"))
        if f.low is not None:
            out.append(_issue(v < f.low, "error", f.name, f"must be at least {f.low:g}"))
        if f.high is not None:
            out.append(_issue(v > f.high, "error", f.name, f"must be at most {f.high:g}"))
    return out


def box_checks(made: list[tuple[str, str]], minutes: str | None = None, games: str | None = None) -> list[Column]:
    """Makes never exceed attempts; minutes are totals."""
    out = [_issue(number(F.col(m)) > number(F.col(a)), "error", m, f"exceeds {a}") for m, a in made]
    if minutes and games:
        per = F.when(number(F.col(games)) > 0, number(F.col(minutes)) / number(F.col(games)))
        out.append(_issue((per < 1) | (per > 45), "error", minutes, "must be total minutes"))
    return out


def sum_checks(parts: tuple[str, ...], total: str, field: str, off: float = 1) -> list[Column]:
    """Parts add up to their total, give or take ``off``; else a warning."""
    found = number(F.col(parts[0]))
    for p in parts[1:]:
        found = found + number(F.col(p))
    return [_issue(F.abs(found - number(F.col(total))) > off, "warning", field, f"don't add up to {total}")]


def within_checks(part: str, whole: str) -> list[Column]:
    return [_issue(number(F.col(part)) > number(F.col(whole)), "error", part, f"exceeds {whole}")]


#: Kinds of population that an import may name.
POPULATION_TYPES = ("final", "declared", "watchlist", "custom")


def metadata_issues(metadata: dict, supported: tuple[int, ...]) -> list[tuple[str, str, str]]:
    """Issues of an import's metadata: (severity, field, message)."""
    out = []
    if metadata.get("schemaVersion") != 1:
        out.append(("error", "schemaVersion", "must be 1"))
    if not str(metadata.get("dataset_name") or "").strip():
        out.append(("error", "dataset_name", "is required"))
    season = metadata.get("season")
    if not isinstance(season, int) or isinstance(season, bool):
        out.append(("error", "season", "must be a whole number"))
    elif season not in supported:
        out.append(("warning", "season", "has no reference of its own"))
    if metadata.get("population_type") not in POPULATION_TYPES:
        out.append(("error", "population_type", "must be one of " + ", ".join(POPULATION_TYPES)))
    size = metadata.get("draft_size")
    if size is not None and not (isinstance(size, int) and 1 <= size <= 100):
        out.append(("error", "draft_size", "must be between 1 and 100"))
    return out


def row_limit_issues(rows: int, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> list[tuple[str, str, str]]:
    if rows < least:
        return [("error", "prospects", f"at least {least} are needed")]
    return [("error", "prospects", f"at most {most} are allowed")] if rows > most else []


def missing_warnings(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(field, severity, missing): optional groups of which some rows have nothing."""
    counts = df.agg(*[F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull()).alias(g) for g, cols in groups.items()])
    entries = F.array(*[F.struct(F.lit(g).alias("field"), F.lit("warning").alias("severity"), F.col(g).alias("missing")) for g in groups])
    return counts.select(F.explode(entries).alias("e")).select("e.*").where("missing > 0")


def row_issues(df: DataFrame, row: str, checks: list[Column]) -> DataFrame:
    """(row, severity, field, message): one pass, one row for each broken rule."""
    found = df.select(row, F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("issues"))
    return found.select(row, F.explode("issues").alias("i")).select(row, "i.severity", "i.field", "i.message")


def duplicate_issues(df: DataFrame, row: str, ident: str) -> DataFrame:
    own = Window.partitionBy(ident)
    first = df.where(F.col(ident).isNotNull()).withColumn("first_row", F.min(row).over(own))
    return first.where(F.col(row) > F.col("first_row")).select(
        row, F.lit("error").alias("severity"), F.lit(ident).alias("field"), F.concat(F.lit("duplicate, first used on row "), F.col("first_row").cast("string")).alias("message")
    )


def column_issues(columns: list[str], known: list[str]) -> list[tuple[str, str, str]]:
    out = []
    for c in columns:
        if c in PROHIBITED:
            out.append(("error", c, "tells the outcome"))
        elif c in DERIVED:
            out.append(("error", c, "give counts instead"))
        elif c not in known:
            out.append(("warning", c, "is not used"))
    return out


def clean_rows(df: DataFrame, issues: DataFrame, row: str) -> DataFrame:
    return df.join(issues.where("severity = 'error'").select(row).distinct(), row, "left_anti")


def capabilities(df: DataFrame, groups: dict[str, list[str]], needs: dict[str, list[str]]) -> DataFrame:
    """(capability, available, missing): a group of columns is present if any row has any of them."""
    present = {g: F.bool_or(F.greatest(*[F.col(c).isNotNull() for c in cols], F.lit(False))) for g, cols in groups.items()}
    one = df.agg(*[F.coalesce(v, F.lit(False)).alias(g) for g, v in present.items()])
    entries = []
    for name, wanted in needs.items():
        lacking = F.array_join(F.filter(F.array(*[F.when(~F.col(g), F.lit(g)) for g in wanted]), lambda x: x.isNotNull()), ",")
        entries.append(F.struct(F.lit(name).alias("capability"), (lacking == "").alias("available"), lacking.alias("missing")))
    return one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


class Guard:
    """Collects named expectations; ``report`` says which failed, ``check`` raises for hard ones."""

    def __init__(self):
        self.results: list[tuple[str, bool, bool]] = []

    def expect(self, name: str, ok: bool, hard: bool = True) -> None:
        self.results.append((name, bool(ok), hard))

    def expect_none(self, name: str, bad: DataFrame, hard: bool = True) -> None:
        self.expect(name, bad.isEmpty(), hard)

    def report(self) -> list[str]:
        return [f"{'ok' if ok else 'FAILED'}: {name}" for name, ok, _ in self.results]

    def check(self) -> None:
        bad = [name for name, ok, hard in self.results if hard and not ok]
        if bad:
            raise AssertionError("; ".join(bad))


def denied_columns(columns: list[str], names: tuple[str, ...] = PROHIBITED, parts: tuple[str, ...] = ("draft_pick", "drafted")) -> list[str]:
    return [c for c in columns if c in names or any(p in c for p in parts)]


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
