"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Everything is DataFrame functions.  Each text gives a few counts and ratios.  A
log-linear histogram per language, source and ratio is the sketch: merging is
adding counts, so partial aggregation, retries and any partitioning give the
same sketch.  A bucket keeps five significant bits and stands for its largest value, so a quantile is at most a
sixteenth too high, and a sketch has a few hundred buckets whatever the input.

A ratio is rejected far above what its own language and source show, on a scale on which
one event more in a typical text of the group is a step: ``log2(ratio + unit)`` with
the unit of one event in the median text.  The fence stands ``FENCE`` times as far above the median
as the ninth decile does, so a group with a longer tail has a higher fence; where the ninth decile
is the median itself, as where nine texts in ten have no event, one event counts as the distance.  Median,
distance and unit of a group are averaged with those of its language, and those with the
figures of all, as if these were ``PRIOR`` rows more: small groups lean on the larger ones by degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm._shared import WHITE, stored, table

#: name of the ratio in thousandths: (expression over the counts, what an event is counted over).
RATIOS = {
    "symbol": ("1000 * n_symbols div greatest(n_words, 1)", "words"),
    "dup_line": ("1000 * n_dup_lines div greatest(n_lines, 1)", "lines"),
    "repeat": ("1000 * n_repeat_words div greatest(n_words, 1)", "words"),
    "length": ("1000 * word_chars div greatest(n_words, 1)", "words"),
}
#: Sizes of a text, which have sketches of their own.
SIZES = {"words": "n_words", "lines": "n_lines"}
FENCE = 6
PRIOR = 2000
MIN_WORDS = 50
#: Threshold tables up to this many groups are broadcast; beyond it the join shuffles, hot groups salted.
BROADCAST_GROUPS = 50_000


_ADDED = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) to any columns.

    Columns of these names that came in give way.  A null or empty text has no words and counts of 0.  Lines without a word
    count neither as lines nor as duplicates.  Windows of three words are
    compared by a 64-bit hash within one text.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in _ADDED]
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        *own,
        F.filter(F.split(t, WHITE), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    hashed = words.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(__words) >= 4 THEN transform(sequence(0, size(__words) - 3),"
            " i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) END"
        ).alias("__windows"),
    )
    # only texts in which some window recurs need the places, sorted by window
    placed = hashed.select(
        *[c for c in hashed.columns if c != "__windows"],
        F.expr(
            "CASE WHEN size(array_distinct(__windows)) < size(__windows)"
            " THEN sort_array(transform(__windows, (h, i) -> struct(h, i))) END"
        ).alias("__sorted"),
    )
    found = placed.select(
        *[c for c in placed.columns if c != "__sorted"],
        F.expr(
            "transform(filter(__sorted, (x, k) -> coalesce(get(__sorted, k - 1).h = x.h, false)"
            " OR coalesce(get(__sorted, k + 1).h = x.h, false)), x -> x.i)"
        ).alias("__places"),
    )
    return found.select(
        *[c for c in found.columns if c != "__places"],
        F.expr(
            "coalesce(size(array_distinct(flatten(transform(__places, p -> array(p, p + 1, p + 2))))), 0)"
        ).cast("long").alias("n_repeat_words"),
    )


def with_base(counted: DataFrame) -> DataFrame:
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _bucket(value: str) -> str:
    return f"shiftleft(shiftright({value}, greatest(length(bin({value})) - 5, 0)), greatest(length(bin({value})) - 5, 0))"


def _top(bucket: str) -> str:
    """The largest value of a bucket."""
    return f"{bucket} + shiftleft(1L, greatest(length(bin({bucket})) - 5, 0)) - 1"


def sketches(counted: DataFrame) -> DataFrame:
    """Counts per lang, source, ratio (or size) and bucket: the mergeable sketches, over all rows that pass the base rules."""
    values = {**{name: expr for name, (expr, _) in RATIOS.items()}, **SIZES}
    pairs = ", ".join(f"'{name}', CAST({expr} AS BIGINT)" for name, expr in values.items())
    return (
        counted.where("NOT base_failed")
        .select("lang", "source", F.expr(f"stack({len(values)}, {pairs}) AS (ratio, value)"))
        .select("lang", "source", "ratio", F.expr(_bucket("value")).alias("bucket"))
        .groupBy("lang", "source", "ratio", "bucket")
        .agg(F.count("*").alias("n"))
    )


_FIGURES = [*(f"unit_{size}" for size in SIZES), *(f"{part}_{name}" for name in RATIOS for part in ("middle", "spread"))]


def _figures(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, and each of ``_FIGURES``): median, distance of the ninth decile and unit of each ratio, as powers of two."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = ranked.groupBy(*keys, "ratio").agg(
        F.max("total").alias("total"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), F.expr(_top("bucket")))).alias("q50"),
        F.min(F.when(10 * F.col("upto") >= 9 * F.col("total"), F.expr(_top("bucket")))).alias("q90"),
    )
    names = [*RATIOS, *SIZES]
    wide = at.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("ratio") == r, F.col(q))).alias(f"{q}_{r}") for r in names for q in ("q50", "q90")])
    unit = {size: 1000.0 / F.greatest(F.col(f"q50_{size}"), F.lit(1)) for size in SIZES}
    out = {f"unit_{size}": F.log2(u) for size, u in unit.items()}
    for name, (_, size) in RATIOS.items():
        middle = F.log2(F.col(f"q50_{name}") + unit[size])
        out[f"middle_{name}"] = middle
        out[f"spread_{name}"] = F.greatest(F.log2(F.col(f"q90_{name}") + unit[size]), F.log2(F.col(f"q50_{name}") + 2 * unit[size])) - middle
    return wide.select(*keys, "total", *[c.alias(n) for n, c in out.items()])


def _leaning(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``own`` averaged with the figures of the larger group that it lies in, which count as ``PRIOR`` rows."""
    side = other.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in _FIGURES])
    lean = {c: (F.col("total") * F.col(c) + PRIOR * F.col(f"__{c}")) / (F.col("total") + PRIOR) for c in _FIGURES}
    return own.join(side, F.col(key).eqNullSafe(F.col("__key"))).select(*[c for c in own.columns if c not in _FIGURES], *[v.alias(c) for c, v in lean.items()])


def fence(name: str) -> Column:
    """The fence of a ratio in thousandths, from a group's figures."""
    _, size = RATIOS[name]
    return F.round(F.pow(F.lit(2.0), F.col(f"middle_{name}") + FENCE * F.col(f"spread_{name}")) - F.pow(F.lit(2.0), F.col(f"unit_{size}")), 3)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, total, max_<ratio>): upper fences of every group that has rows; a null language or source is one like any other."""
    sketch = stored(sketch.withColumn("whole", F.lit(0)))
    everything = _figures(sketch, ["whole"])
    by_lang = _leaning(_figures(sketch, ["whole", "lang"]), everything, "whole")
    own = _leaning(_figures(sketch, ["lang", "source"]), by_lang, "lang")
    return own.select("lang", "source", "total", *[fence(name).alias(f"max_{name}") for name in RATIOS])


def judged(counted: DataFrame) -> DataFrame:
    """Adds ``kept``: the base rules, then the fences of the row's own group.

    ``counted`` must be stored, as it is read once for the sketches and once for
    the verdict.  Null languages and sources are groups like any others.
    """
    fences = stored(thresholds(sketches(counted)))
    names = [f"max_{name}" for name in RATIOS]
    small = fences.count() <= BROADCAST_GROUPS
    side = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct(*names).alias("__fence"))
    out = counted.withColumn("__salt", F.lit(0) if small else F.pmod(F.hash("doc_id"), F.lit(64)))
    on = out["lang"].eqNullSafe(side["__lang"]) & out["source"].eqNullSafe(side["__source"])
    if not small:
        side = side.withColumn("__salts", F.explode(F.sequence(F.lit(0), F.lit(63))))
        on = on & (out["__salt"] == side["__salts"])
    out = out.join(F.broadcast(side) if small else side, on, "left")
    verdict = F.lit(True)
    for name, (expr, _) in RATIOS.items():
        verdict = verdict & F.coalesce(F.expr(expr) <= F.col("__fence")[f"max_{name}"], F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & verdict).drop("__salt", "__fence", "__lang", "__source", "__salts")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, each row with the columns that came in, whatever their names.

    Repeated rows share their fate; without texts, languages or sources (null) a row is judged like any other.
    An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "lang", "source")
    kept = judged(stored(with_base(with_counts(rows)))).where("kept")
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op6_quality_sketches(spark, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = stored(with_base(with_counts(docs)).drop("text"))
    return judged(counted).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    value = {**{name: expr.replace(" div ", " // ") for name, (expr, _) in RATIOS.items()}, **SIZES}
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS ratio, ({v})::BIGINT AS v FROM based WHERE NOT base_failed" for n, v in value.items())
    at = lambda r, q: f"max({q}) FILTER (ratio = '{r}')"
    unit = {size: f"(1000.0::DOUBLE / greatest({at(size, 'q50')}, 1))" for size in SIZES}
    figures = [f"log2({unit[size]}) AS unit_{size}" for size in SIZES]
    for n, (_, size) in RATIOS.items():
        middle = f"log2({at(n, 'q50')} + {unit[size]})"
        figures += [f"{middle} AS middle_{n}", f"greatest(log2({at(n, 'q90')} + {unit[size]}), log2({at(n, 'q50')} + 2 * {unit[size]})) - {middle} AS spread_{n}"]
    lean = ", ".join(f"(a.total * a.{c} + {PRIOR} * b.{c}) / (a.total + {PRIOR}) AS {c}" for c in _FIGURES)
    fences = ", ".join(f"round(pow(2.0::DOUBLE, middle_{n} + {FENCE} * spread_{n}) - pow(2.0::DOUBLE, unit_{size}), 3) AS max_{n}" for n, (_, size) in RATIOS.items())
    verdict = " AND ".join(f"coalesce(({expr.replace(' div ', ' // ')}) <= max_{n}, true)" for n, (expr, _) in RATIOS.items())
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k FROM windows),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY doc_id),
counted AS (SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
stacked AS ({stacked}),
buckets AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS b FROM stacked),
levels AS (SELECT 0 AS level, lang, source, ratio, b FROM buckets UNION ALL SELECT 1, lang, NULL, ratio, b FROM buckets UNION ALL SELECT 2, NULL, NULL, ratio, b FROM buckets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, ratio ORDER BY b) AS r, count(*) OVER (PARTITION BY level, lang, source, ratio) AS total FROM levels),
tops AS (SELECT *, b + (1::BIGINT << greatest(length(bin(b)) - 5, 0)) - 1 AS top FROM ranked),
quantiles AS (SELECT level, lang, source, ratio, max(total) AS total, min(CASE WHEN 2 * r >= total THEN top END) AS q50, min(CASE WHEN 10 * r >= 9 * total THEN top END) AS q90 FROM tops GROUP BY ALL),
figures AS (SELECT level, lang, source, max(total) AS total, {', '.join(figures)} FROM quantiles GROUP BY level, lang, source),
langs AS (SELECT a.lang, {lean} FROM figures a, figures b WHERE a.level = 1 AND b.level = 2),
fences AS (SELECT lang, source, {fences} FROM (SELECT a.lang, a.source, {lean} FROM figures a JOIN langs b ON a.level = 0 AND a.lang IS NOT DISTINCT FROM b.lang))
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept
FROM based d
LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source"""


QUERIES = {"op6_quality_sketches": op6_quality_sketches}
ORACLE_SQL = {"op6_quality_sketches": _oracle()}
