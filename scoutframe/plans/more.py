"""Queries: scalar and text functions, comparables, identity, validation, metrics, fits and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions import text as T
from scoutframe.operators import identity as I
from scoutframe.operators import metrics as M
from scoutframe.operators import similar as S
from scoutframe.operators import validate as V
from scoutframe.plans.queries import RATES_SQL, rates, registrar, rounded
from scoutframe.sources.sinks import stored
from scoutframe.sources.tables import BIO_SQL, bio, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


query = registrar(QUERIES, ORACLE_SQL)


# scalars and text


@query("SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 2, 0)::BIGINT AS half, least(greatest(l_extendedprice, 1000), 50000) AS clipped, round(CASE WHEN l_quantity - 25 > 0 THEN l_extendedprice / (l_quantity - 25) END, 6) AS rate FROM lineitem")
def scalar_rates(spark, sf_dir):
    c = F.col
    return rounded(
        read(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_quantity",
            X.half_even(c("l_quantity") / 2).alias("half"),
            X.clamp(c("l_extendedprice"), 1000.0, 50000.0).alias("clipped"),
            X.safe_div(c("l_extendedprice"), c("l_quantity") - 25).alias("rate"),
        )
    )


@query("SELECT p_partkey, round(exp((ln(greatest(p_size::DOUBLE, 1e-9)) + ln(greatest(p_retailprice, 1e-9))) / 2), 6) AS geo, round((coalesce(nullif(p_size, 11), 0) + p_retailprice) / (CASE WHEN p_size = 11 THEN 1 ELSE 2 END), 6) AS mean FROM part")
def row_means(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return rounded(read(spark, sf_dir, "part").select("p_partkey", X.geo_mean(size, price).alias("geo"), X.row_mean(F.nullif(size, F.lit(11.0)), price).alias("mean")))


@query("SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) AS initials, replace(p_name, ' ', '_') AS id, replace(lower(p_type), '_', ' ') AS label FROM part")
def text_labels(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", T.initials(F.col("p_name")).alias("initials"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"), T.label_of(F.lower("p_type")).alias("label")
    )


_PLAIN = r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents"


def _plain(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.squeezed(F.regexp_replace(T.unaccented(F.col("text")), "[^a-z ]", " ")).alias("plain"))


@query(_PLAIN)
def text_normalize(spark, sf_dir):
    return _plain(spark, sf_dir)


@query(_PLAIN.replace("doc_id", "conv_id, turn").replace("FROM documents", "FROM conversations"))
def text_normalize_whole(spark, sf_dir):
    """Every turn of the conversations."""
    plain = T.squeezed(F.regexp_replace(T.unaccented(F.col("text")), "[^a-z ]", " "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("plain"))


_PAIR_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, CASE l_suppkey % 5 WHEN 0 THEN l_linenumber || '-' || l_quantity WHEN 1 THEN ' ' || (l_linenumber + 0.5::DOUBLE) || '-' || l_partkey || ' ' WHEN 2 THEN '--' WHEN 3 THEN l_linenumber || '-' || l_quantity || '-' || l_partkey ELSE l_linenumber || '/' || l_quantity END AS pair FROM lineitem"


@query(f"""WITH p AS (SELECT *, string_split(trim(pair), '-') AS s FROM ({_PAIR_SQL})) SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN len(s) = 2 THEN TRY_CAST(s[1] AS DOUBLE) END AS made, CASE WHEN len(s) = 2 THEN TRY_CAST(s[2] AS DOUBLE) END AS attempted FROM p""")
def parse_made_attempted(spark, sf_dir):
    """Pairs of whole and of broken numbers with blanks around them, and three shapes that are none."""
    c = F.col
    text = lambda x: x.cast("string")
    plain = F.concat(text(c("l_linenumber")), F.lit("-"), text(c("l_quantity")))
    pair = (
        F.when(c("l_suppkey") % 5 == 0, plain)
        .when(c("l_suppkey") % 5 == 1, F.concat(F.lit(" "), text(c("l_linenumber") + F.lit(0.5)), F.lit("-"), text(c("l_partkey")), F.lit(" ")))
        .when(c("l_suppkey") % 5 == 2, "--")
        .when(c("l_suppkey") % 5 == 3, F.concat(plain, F.lit("-"), text(c("l_partkey"))))
        .otherwise(F.concat(text(c("l_linenumber")), F.lit("/"), text(c("l_quantity"))))
    )
    made, attempted = T.made_attempted(pair)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", made.alias("made"), attempted.alias("attempted"))


@query(f"WITH {BIO_SQL} SELECT athlete_id, CASE WHEN label IN ('G', 'PG', 'SG') THEN 'G' WHEN label IN ('F', 'SF', 'PF') THEN 'F' WHEN label = 'C' THEN 'C' ELSE 'UNKNOWN' END AS position, floor(height_inches / 12)::BIGINT || '''' || ' ' || (height_inches % 12)::INT || '\"' AS height, height_inches::INT AS inches FROM bio")
def position_and_height(spark, sf_dir):
    b = bio(spark, sf_dir).withColumn("height", T.feet_inches(F.col("height_inches")))
    return b.select("athlete_id", T.position_group(F.col("label")).alias("position"), "height", T.height_inches(F.col("height")).alias("inches"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'))) AS md5, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS n_links FROM pages""")
def stripped_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select(
        "page_id", F.md5(T.stripped_markup(F.col("html"))).alias("md5"), F.length(T.stripped_markup(F.col("html"))).cast("long").alias("n_text"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("n_links")
    )


# comparables

_DIMS = ["points_per_game", "rebounds_per_40", "assists_per_40", "ts_pct", "tov_pct", "three_point_pct"]
_EUCLID = "sqrt(list_avg([(p.{0} - q.{0}) ** 2, (p.{1} - q.{1}) ** 2, (p.{2} - q.{2}) ** 2, (p.{3} - q.{3}) ** 2, (p.{4} - q.{4}) ** 2, (p.{5} - q.{5}) ** 2]))".format(*_DIMS)
POOL_SQL = f"""{RATES_SQL}, eligible AS (SELECT * FROM rates WHERE minutes >= 120 AND games_played >= 5 AND season BETWEEN 1997 AND 2001 QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY season DESC) <= 3),
pool AS (SELECT athlete_id, {', '.join(f'sum({m} * minutes) / sum(minutes) FILTER ({m} IS NOT NULL) AS {m}' for m in _DIMS)}, array_to_string(list_sort(list(DISTINCT season)), ',') AS reference_seasons, sum(minutes) AS minutes, max(season) AS season, count(*) AS n_seasons FROM eligible GROUP BY athlete_id)"""


def _seasons(spark, sf_dir):
    """Season rows that several steps read: games are dealt once."""
    return stored(rates(spark, sf_dir).select("season", "athlete_id", "minutes", "games_played", "height_inches", *_DIMS))


def _pool(seasons: DataFrame, last: int | None = 3):
    return S.pool(S.eligible_seasons(seasons, minutes=120, games=5, first=1997, last=2001), "athlete_id", _DIMS, last)


@query(f"WITH {POOL_SQL} SELECT athlete_id, reference_seasons, season, n_seasons, round(minutes, 6) AS minutes, round(ts_pct, 6) AS ts_pct, round(points_per_game, 6) AS points_per_game FROM pool")
def reference_pool(spark, sf_dir):
    return rounded(_pool(_seasons(spark, sf_dir)).select("athlete_id", "reference_seasons", "season", "n_seasons", "minutes", "ts_pct", "points_per_game"))


_COMPARABLES = f"""WITH {POOL_SQL}, mine AS (SELECT * FROM rates), q AS (SELECT pool.*, bio.height_inches FROM pool JOIN bio USING (athlete_id)),
met AS (SELECT p.season, p.athlete_id, q.athlete_id AS other_id, {_EUCLID} AS distance, abs(p.height_inches - q.height_inches) AS gap, {' + '.join(f'(p.{d} IS NOT NULL AND q.{d} IS NOT NULL)::INT' for d in _DIMS)} AS shared FROM mine p JOIN q ON p.athlete_id <> q.athlete_id AND abs(p.height_inches - q.height_inches) <= 4 WHERE {' + '.join(f'(p.{d} IS NOT NULL)::INT' for d in _DIMS)} >= 5),
fit AS (SELECT *, count(*) FILTER (gap <= 2) OVER w AS g2, count(*) FILTER (gap <= 3) OVER w AS g3, count(*) OVER w AS g4 FROM met WHERE shared >= 5 WINDOW w AS (PARTITION BY season, athlete_id)),
gated AS (SELECT *, CASE WHEN g2 >= 3 THEN 2.0::DOUBLE WHEN g3 >= 3 THEN 3.0::DOUBLE WHEN g4 >= 3 THEN 4.0::DOUBLE END AS gate FROM fit),
near AS (SELECT *, row_number() OVER (PARTITION BY season, athlete_id ORDER BY distance, other_id) AS nth FROM gated WHERE gap <= gate)
SELECT m.season, m.athlete_id, other_id, round(distance, 6) AS distance, gate, nth, CASE WHEN other_id IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status FROM mine m LEFT JOIN (SELECT * FROM near WHERE nth <= 3) n USING (season, athlete_id)"""


def _comparables(spark, sf_dir):
    x = _seasons(spark, sf_dir)
    heights = bio(spark, sf_dir).select("athlete_id", F.col("height_inches").alias("other_height"))
    others = _pool(x).join(heights, "athlete_id").select(F.col("athlete_id").alias("other_id"), F.array(*_DIMS).alias("other_vec"), "other_height")
    mine = x.select("season", "athlete_id", F.array(*_DIMS).alias("vec"), F.col("height_inches").alias("height"))
    out = S.nearest_of_all(mine, others, ["season", "athlete_id"], "athlete_id", "other_id", len(_DIMS))
    return rounded(out.select("season", "athlete_id", "other_id", "distance", "gate", "nth", "status"))


@query(_COMPARABLES)
def comparables_top3(spark, sf_dir):
    """Every season row against the whole pool."""
    return _comparables(spark, sf_dir)


_CAREER = (
    _COMPARABLES.replace(" QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY season DESC) <= 3)", ")", 1)
    .replace("mine AS (SELECT * FROM rates)", "mine AS (SELECT rates.*, display_name FROM rates LEFT JOIN bio USING (athlete_id))")
    .replace("pool.*, bio.height_inches FROM", "pool.*, bio.height_inches, display_name FROM")
    .replace("p.athlete_id <> q.athlete_id AND", "p.athlete_id <> q.athlete_id AND p.display_name <> q.display_name AND")
)


@query(_CAREER)
def comparables_whole(spark, sf_dir):
    """Every season row against careers, and never against somebody of the same name."""
    b, x = bio(spark, sf_dir), _seasons(spark, sf_dir)
    careers = _pool(x, None)
    named = b.select("athlete_id", F.col("height_inches").alias("other_height"), T.name_key(F.col("display_name")).alias("other_key"))
    others = careers.join(named, "athlete_id").select(F.col("athlete_id").alias("other_id"), F.array(*_DIMS).alias("other_vec"), "other_height", "other_key")
    mine = x.join(b.select("athlete_id", T.name_key(F.col("display_name")).alias("name_key")), "athlete_id", "left")
    mine = mine.select("season", "athlete_id", F.array(*_DIMS).alias("vec"), F.col("height_inches").alias("height"), "name_key")
    out = S.nearest_of_all(mine, others, ["season", "athlete_id"], "athlete_id", "other_id", len(_DIMS), own_name="name_key", other_name="other_key")
    return rounded(out.select("season", "athlete_id", "other_id", "distance", "gate", "nth", "status"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS other, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings)
SELECT vec_id, other, round(d, 6) AS distance FROM (SELECT vec_id, other, 1 - list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x)))) AS d FROM p, q WHERE vec_id <> other) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) <= 3""")
def knn_cosine(spark, sf_dir):
    """The nearest three of every vector among all others."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    others = e.select(F.col("vec_id").alias("other"), F.col("v").alias("w"))
    return rounded(S.nearest_by_cosine(e, others, "vec_id", "other", "v", "w", 3))


# identity

_NAME = "lower(n_name) || ' ' || chr((97 + {k} % 13)::INT) || chr((97 + ({k} // 13) % 5)::INT) || 'son'"
IDENTITY_SQL = f"""people AS (SELECT c_custkey AS person_id, {_NAME.format(k='c_custkey')} AS name_key, lower(r_name) AS school FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
idx AS (SELECT s_suppkey AS ident, {_NAME.format(k='s_suppkey')} AS name_key, lower(r_name) AS school FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _people(spark, sf_dir, table: str, key: str, nation: str) -> DataFrame:
    n, reg = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col(key)
    name = F.concat(F.lower("n_name"), F.lit(" "), F.char(97 + k % 13), F.char(97 + F.floor(k / 13) % 5), F.lit("son"))
    t = read(spark, sf_dir, table)
    return t.join(n, F.col(nation) == F.col("n_nationkey")).join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(k.alias("id"), name.alias("name_key"), F.lower("r_name").alias("school"))


@query(f"""WITH {IDENTITY_SQL}, named AS (SELECT p.person_id, count(*) AS n, max(ident) AS any_id, count(*) FILTER (p.school = i.school OR contains(p.school, i.school) OR contains(i.school, p.school)) AS n_fit, max(ident) FILTER (p.school = i.school OR contains(p.school, i.school) OR contains(i.school, p.school)) AS fit_id FROM people p JOIN idx i USING (name_key) GROUP BY 1),
near AS (SELECT p.person_id, count(*) AS n, max(ident) AS near_id FROM people p JOIN idx i ON regexp_extract(p.name_key, '(\\S+)$', 1) = regexp_extract(i.name_key, '(\\S+)$', 1) AND (p.school = i.school OR contains(p.school, i.school) OR contains(i.school, p.school))
  AND (starts_with(split_part(p.name_key, ' ', 1), split_part(i.name_key, ' ', 1)) OR starts_with(split_part(i.name_key, ' ', 1), split_part(p.name_key, ' ', 1))) GROUP BY 1)
SELECT p.person_id, CASE WHEN p.person_id < 10 THEN p.person_id + 1 WHEN d.n = 1 THEN any_id WHEN d.n_fit = 1 THEN fit_id WHEN d.n > 1 THEN NULL WHEN near.n = 1 THEN near_id END AS matched_id,
  CASE WHEN p.person_id < 10 THEN 'OVERRIDE' WHEN d.n = 1 THEN 'NAME' WHEN d.n_fit = 1 THEN 'NAME_SCHOOL' WHEN d.n > 1 THEN 'AMBIGUOUS' WHEN near.n = 1 THEN 'SURNAME_SCHOOL' ELSE 'UNMATCHED' END AS method
FROM people p LEFT JOIN named d USING (person_id) LEFT JOIN near USING (person_id)""")
def tiered_match(spark, sf_dir):
    people = _people(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("id", "person_id")
    index = I.season_index(_people(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), "id", "name_key", "school").withColumnRenamed("id", "ident")
    overrides = people.where("person_id < 10").select("person_id", (F.col("person_id") + 1).alias("ident"))
    return I.match(people, index, overrides).select("person_id", "matched_id", "method")


# validation

_FIELDS = [V.Field("o_orderkey", True), V.Field("o_totalprice", True, 1000, 400000), V.Field("o_orderstatus", True, choices=("F", "O"))]


@query("SELECT o_orderkey, 'error' AS severity, 'o_totalprice' AS field, 'must be at least 1000' AS message FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'error', 'o_totalprice', 'must be at most 400000' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'error', 'o_orderstatus', 'must be one of F, O' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'error', 'o_custkey', 'exceeds o_orderkey' FROM orders WHERE o_custkey > o_orderkey")
def dataset_issues(spark, sf_dir):
    checks = V.field_checks(_FIELDS) + V.box_checks([("o_custkey", "o_orderkey")])
    return V.row_issues(read(spark, sf_dir, "orders"), "o_orderkey", checks)


@query("SELECT o_orderkey, 'duplicate, first used on row ' || first AS message FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderkey > first")
def duplicate_ids(spark, sf_dir):
    return V.duplicate_issues(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey").select("o_orderkey", "message")


@query("SELECT capability, available, CASE WHEN available THEN '' ELSE 'heights' END AS missing FROM (SELECT 'board' AS capability, count(o_totalprice) > 0 AS available FROM orders UNION ALL SELECT 'fit', count(CASE WHEN o_totalprice < 0 THEN o_totalprice END) > 0 FROM orders)")
def dataset_capabilities(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_totalprice", F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("height"))
    return V.capabilities(o, {"box": ["o_totalprice"], "heights": ["height"]}, {"board": ["box"], "fit": ["box", "heights"]})


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O') AND o_custkey <= o_orderkey".replace("*", "o_orderkey, o_custkey"))
def clean_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    issues = V.row_issues(o, "o_orderkey", V.field_checks(_FIELDS) + V.box_checks([("o_custkey", "o_orderkey")]))
    return V.clean_rows(o, issues, "o_orderkey").select("o_orderkey", "o_custkey")


# metrics: groups are order priorities, labels finished orders

OUT_SQL = "o AS (SELECT o_orderpriority AS g, o_orderkey AS id, floor(o_totalprice / 1000) / 600 AS p, (o_orderstatus = 'F')::INT AS y, floor(o_totalprice / 50000) AS a, year(o_orderdate) AS b FROM orders)"


def _outcomes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id"), (F.floor(F.col("o_totalprice") / 1000) / 600).alias("p"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("a"), F.year("o_orderdate").cast("double").alias("b"),
    )


@query(f"WITH {OUT_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2 AS r FROM o) SELECT g, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY g")
def roc_auc_exact(spark, sf_dir):
    return rounded(M.roc_auc(_outcomes(spark, sf_dir), ["g"], "p", "y"))


@query(f"WITH {OUT_SQL}, s AS (SELECT g, p, sum(y) AS tp, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY g ORDER BY p DESC)) SELECT g, round(sum(tp * ctp / cn) / sum(tp), 6) AS average_precision FROM c GROUP BY g")
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(_outcomes(spark, sf_dir), ["g"], "p", "y"))


@query(f"WITH {OUT_SQL}, q AS (SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS q FROM o) SELECT g, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(y), 6) AS base_rate, count(*) FILTER (y = 0) < 5 AS low_negative_support FROM q GROUP BY g")
def probability_losses(spark, sf_dir):
    return rounded(M.probability_losses(_outcomes(spark, sf_dir), ["g"], "p", "y"))


_DECILES = f"WITH {OUT_SQL}, e AS (SELECT g, list_distinct_sorted AS edges FROM (SELECT g, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS list_distinct_sorted FROM o GROUP BY g)), c AS (SELECT g, greatest(len(list_filter(edges, lambda x: x < p)) - 1, 0) AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS observed, abs(avg(p) - avg(y)) AS gap FROM o JOIN e USING (g) GROUP BY ALL)"


@query(f"{_DECILES} SELECT g, bin, n, round(mean_pred, 6) AS mean_pred, round(observed, 6) AS observed, round(gap, 6) AS gap FROM c")
def calibration_bins(spark, sf_dir):
    return rounded(M.calibration(_outcomes(spark, sf_dir), ["g"], "p", "y"))


@query(f"{_DECILES} SELECT g, round(sum(n * gap) / sum(n), 6) AS ece FROM c GROUP BY g")
def calibration_ece(spark, sf_dir):
    return rounded(M.expected_calibration_error(_outcomes(spark, sf_dir), ["g"], "p", "y"))


@query(f"WITH {OUT_SQL}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2 AS x, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS z FROM o) SELECT g, round(corr(x, z), 6) AS spearman FROM r GROUP BY g")
def spearman(spark, sf_dir):
    return rounded(M.spearman(_outcomes(spark, sf_dir), ["g"], "p", "b"))


@query(f"WITH {OUT_SQL}, c AS (SELECT g, a, b, count(*) AS n FROM o GROUP BY ALL), s AS (SELECT x.g, sum(sign(x.a - z.a) * sign(x.b - z.b) * x.n * z.n) / 2 AS s FROM c x JOIN c z ON x.g = z.g GROUP BY 1), ta AS (SELECT g, (sum(t) * (sum(t) - 1) - sum(t * (t - 1))) / 2 AS v FROM (SELECT g, a, count(*) AS t FROM o GROUP BY ALL) GROUP BY g), tb AS (SELECT g, (sum(t) * (sum(t) - 1) - sum(t * (t - 1))) / 2 AS v FROM (SELECT g, b, count(*) AS t FROM o GROUP BY ALL) GROUP BY g) SELECT g, round(s / (sqrt(ta.v) * sqrt(tb.v)), 6) AS kendall FROM s JOIN ta USING (g) JOIN tb USING (g)")
def kendall(spark, sf_dir):
    return rounded(M.kendall(_outcomes(spark, sf_dir), ["g"], "a", "b", "id"))


@query(f"WITH {OUT_SQL}, r AS (SELECT *, 1 / log2(row_number() OVER (PARTITION BY g ORDER BY a DESC) + 1) AS d, y / log2(row_number() OVER (PARTITION BY g ORDER BY y DESC) + 1) AS i FROM o), s AS (SELECT g, a, avg(y) * sum(d) AS dcg, sum(i) AS ideal FROM r GROUP BY ALL) SELECT g, round(sum(dcg) / sum(ideal), 6) AS ndcg FROM s GROUP BY g")
def ndcg_ties(spark, sf_dir):
    return rounded(M.ndcg(_outcomes(spark, sf_dir), ["g"], "a", "y"))


@query(f"WITH {OUT_SQL} SELECT g, round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) ** 2)), 6) AS rmse, round(quantile_cont(abs(a - p), 0.5), 6) AS median_ae FROM o GROUP BY g")
def order_errors(spark, sf_dir):
    return rounded(M.errors(_outcomes(spark, sf_dir), ["g"], "p", "a"))


@query(f"WITH {OUT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, md5(id::VARCHAR), id) AS k, row_number() OVER (PARTITION BY g ORDER BY y DESC) AS i FROM o) SELECT g, round(sum(y) FILTER (k <= 14) / 14, 6) AS precision_at_k, round(sum(y) FILTER (k <= 14) / sum(y), 6) AS recall_at_k, round(sum(y / log2(k + 1)) FILTER (k <= 14) / sum(y / log2(i + 1)) FILTER (i <= 14), 6) AS ndcg_at_k FROM r GROUP BY g")
def recall_at_k(spark, sf_dir):
    return rounded(M.at_k(_outcomes(spark, sf_dir), ["g"], "p", "y", "id", 14))


# models and publication


@query(f"WITH {RATES_SQL} SELECT season, athlete_id, round(0.25 + 1.5 * (coalesce(points_per_game, 30) - 35) / 12.0 - 0.75 * (coalesce(three_point_pct, 0.9) - 0.95) / 0.03, 6) AS score FROM rates")
def linear_inference(spark, sf_dir):
    cols = [F.col("points_per_game"), F.col("three_point_pct")]
    score = X.linear_inference(cols, [30, 0.9], [35, 0.95], [12.0, 0.03], [1.5, -0.75], 0.25)
    return rounded(rates(spark, sf_dir).select("season", "athlete_id", score.alias("score")))


@query("SELECT t AS test_year, count(*) FILTER (y < t) AS n_train, count(*) FILTER (y = t) AS n_test FROM (SELECT year(o_orderdate) AS y FROM orders), (SELECT DISTINCT year(o_orderdate) AS t FROM orders) WHERE t >= 1997 GROUP BY t")
def temporal_folds(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).count()  # a row a year
    folds = o.select(F.col("y").alias("test_year")).where("test_year >= 1997")
    return folds.crossJoin(o).groupBy("test_year").agg(
        F.sum(F.when(F.col("y") < F.col("test_year"), F.col("count")).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("y") == F.col("test_year"), F.col("count")).otherwise(0)).alias("n_test")
    )


@query("SELECT c_custkey, to_json({'id': c_custkey, 'name': c_name, 'segment': c_mktsegment}) AS doc FROM customer")
def nested_export(spark, sf_dir):
    s = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.to_json(s).alias("doc"))
