"""Tiered identity matching: override, unique name, school, then surname with school and prefix; never a forced match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def school_fits(schools, school):
    """Equal, or one contains the other."""
    return F.exists(schools, lambda s: (s == school) | s.contains(school) | F.contains(school, s))


def season_index(rows: DataFrame, ident: str, name_key: str, school: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per athlete (and season, where ``keys`` names it): name key, set of schools in order, rows."""
    return rows.where(F.col(ident).isNotNull()).groupBy(*keys, ident).agg(
        F.min(name_key).alias("name_key"), F.sort_array(F.collect_set(school)).alias("schools"), F.count("*").alias("n_rows")
    )


def named_index(rows: DataFrame, names: DataFrame, ident: str, name_key: str, school: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``season_index`` of rows without names, which ``names`` (ident, name key) has: a name joins an athlete's schools, not each of his rows."""
    schools = rows.where(F.col(ident).isNotNull()).groupBy(*keys, ident).agg(F.sort_array(F.collect_set(school)).alias("schools"), F.count("*").alias("n_rows"))
    return schools.join(names.groupBy(ident).agg(F.min(name_key).alias(name_key)), ident).select(*keys, ident, name_key, "schools", "n_rows")


def _told(people: DataFrame, own: list[str], found: DataFrame, merge: dict) -> DataFrame:
    """What was found for names and schools, by person."""
    side = found.withColumnsRenamed({c: f"__{c}" for c in own})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own]
    return people.select("person_id", *own).join(side, reduce(lambda a, b: a & b, same)).groupBy("person_id").agg(*[f(c).alias(c) for c, f in merge.items()])


def match(people: DataFrame, index: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds matched_id and method to ``people`` (person_id, name_key, school); everyone stays, once.

    ``index``: ident, name_key, schools; ``overrides``: person_id, ident (of several for a person the smallest ident).  With ``keys``,
    columns that both sides have, such as the season, people are only matched within them.
    """
    # what a name and school find doesn't hang on who has them: equal ones of either side meet once, with their number and largest ident
    own = [*keys, "name_key", "school"]
    asked = people.select(*own).distinct()
    known = index.groupBy(*keys, "name_key", "schools").agg(F.count("*").alias("m"), F.max("ident").alias("ident"))
    fits = school_fits(F.col("schools"), F.col("school"))
    named = asked.join(known, [*keys, "name_key"]).withColumn("fits", F.coalesce(fits, F.lit(False)))
    by_name = _told(people, own, named.groupBy(*own).agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("fits"), F.col("m")).otherwise(0)).alias("n_fit"), F.max("ident").alias("any_id"), F.max(F.when(F.col("fits"), F.col("ident"))).alias("fit_id")
    ), {"n": F.sum, "n_fit": F.sum, "any_id": F.max, "fit_id": F.max})
    surname = lambda c: F.regexp_extract(c, r"(\S+)$", 1)
    first = lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    # of two first names one begins the other, and both have three letters: these are the same, so they are a key, and few pairs meet
    named_like = lambda df, c, to: df.withColumns({"surname": surname(c), to: first(c)}).where(F.length(to) >= 3).withColumn("start", F.substring(to, 1, 3))
    near = (
        named_like(asked, "name_key", "first")
        .join(named_like(known.withColumnRenamed("name_key", "other_key"), "other_key", "other_first"), [*keys, "surname", "start"])
        .where(F.startswith("first", "other_first") | F.startswith("other_first", "first"))
        .where(fits)
        .groupBy(*own)
        .agg(F.sum("m").alias("n_near"), F.max("ident").alias("near_id"))
    )
    near = _told(people, own, near, {"n_near": F.sum, "near_id": F.max})
    over = overrides.groupBy("person_id").agg(F.min("ident").alias("over_id"))
    out = people.join(over, "person_id", "left").join(by_name, "person_id", "left").join(near, "person_id", "left")
    method = (
        F.when(F.col("over_id").isNotNull(), "OVERRIDE")
        .when(F.col("n") == 1, "NAME")
        .when(F.col("n_fit") == 1, "NAME_SCHOOL")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .when(F.col("n_near") == 1, "SURNAME_SCHOOL")
        .otherwise("UNMATCHED")
    )
    chosen = (
        F.when(F.col("method") == "OVERRIDE", F.col("over_id"))
        .when(F.col("method") == "NAME", F.col("any_id"))
        .when(F.col("method") == "NAME_SCHOOL", F.col("fit_id"))
        .when(F.col("method") == "SURNAME_SCHOOL", F.col("near_id"))
    )
    return out.withColumn("method", method).withColumn("matched_id", chosen).select(*people.columns, "matched_id", "method")
