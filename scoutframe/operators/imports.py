"""An imported data set analysed in one scan: issues as rows, and beside them, observed as they pass, what the columns hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scoutframe.operators import validate as V
from scoutframe.sources.sinks import stored


@dataclass
class Schema:
    """What an import may hold: fields in groups, each with its limits."""

    fields: list[V.Field]
    groups: dict[str, list[str]]

    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def group_fields(self, group: str) -> list[str]:
        return list(self.groups[group])

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def document(self) -> dict:
        """The schema as data: what a form or another program is built from."""
        group_of = {c: g for g, own in self.groups.items() for c in own}
        return {
            "fields": [
                {"name": f.name, "group": group_of.get(f.name), "required": f.required, "min": f.low, "max": f.high, "integer": f.whole, "choices": list(f.choices) if f.choices else None} for f in self.fields
            ]
        }


@dataclass
class Analysis:
    """Issues (row, severity, field, message), rows without errors, and what was seen: rows, values by field, capabilities with what they lack."""

    issues: DataFrame
    clean: DataFrame
    rows: int
    present: dict[str, int]
    groups: dict[str, int]
    capabilities: dict[str, str]
    general: list[tuple[str, str, str]]

    def never_present(self) -> list[str]:
        """Fields that no row has: a fit would impute them for everyone."""
        return [c for c, n in self.present.items() if not n]

    def failed(self) -> bool:
        return any(s == "error" for s, *_ in self.general) or not self.issues.where("severity = 'error'").isEmpty()


def _there(name: str) -> Column:
    """Whether a field holds anything but blanks."""
    return F.coalesce(F.trim(F.col(f"`{name}`").cast("string")) != "", F.lit(False))


def analysed(df: DataFrame, row: str, ident: str, schema: Schema, checks: list[Column], needs: dict[str, list[str]]) -> Analysis:
    """Checks, presence, capabilities and clean rows of an import; the input is read once.

    ``checks`` as ``validate`` builds them; ``needs`` names the groups that each capability is made of.  Duplicate ids
    are found among the ids alone, which the same scan leaves behind.
    """
    known = [c for c in schema.names() if c in df.columns]
    seen = Observation()
    counted = {f"n_{c}": F.count_if(_there(c)) for c in known}
    grouped = {}
    for g, own in schema.groups.items():
        there = [_there(c) for c in own if c in df.columns]
        grouped[f"g_{g}"] = F.count_if(F.greatest(*there, F.lit(False))) if there else F.count_if(F.lit(False))
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in {**counted, **grouped}.items()])
    found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<struct<severity:string,field:string,message:string>>")
    held = stored(watched.withColumn("__issues", found))
    figures = seen.get
    own = held.select(F.col(row).alias("row"), F.explode("__issues").alias("i")).select("row", "i.severity", "i.field", "i.message")
    twice = V.duplicate_issues(held.select(row, ident), row, ident).withColumnRenamed(row, "row")
    issues = own.unionAll(twice.select("row", "severity", "field", "message"))
    clean = held.drop("__issues").join(issues.where("severity = 'error'").select(F.col("row").alias(row)).distinct(), row, "left_anti")
    groups = {g: figures[f"g_{g}"] for g in schema.groups}
    lacking = {name: ",".join(g for g in wanted if not groups[g]) for name, wanted in needs.items()}
    general = V.row_limit_issues(figures["rows"]) + V.column_issues([c for c in df.columns if c != row], [*schema.names(), ident])
    general += [("error", c, "is required") for c in schema.required() if c not in df.columns]
    return Analysis(issues, clean, figures["rows"], {c: figures.get(f"n_{c}", 0) for c in schema.names()}, groups, lacking, general)
