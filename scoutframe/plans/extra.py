"""Queries: the common space, boards and their metrics, views, assembly of a data set and audits, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions import text as T
from scoutframe.operators import aggregate as A
from scoutframe.operators import assembly as D
from scoutframe.operators import board as B
from scoutframe.operators import guards as G
from scoutframe.operators import metrics as M
from scoutframe.operators import model
from scoutframe.operators import rank as R
from scoutframe.operators import similar as S
from scoutframe.operators import space as C
from scoutframe.operators import validate as V
from scoutframe.operators import views as W
from scoutframe.plans.more import _pool, _seasons, POOL_SQL
from scoutframe.plans.queries import RATES_SQL, SEASON_SQL, SHOTS_SQL, _shots, r, rates, registrar, rounded
from scoutframe.sources.sinks import clean_numbers, ordered, stored
from scoutframe.sources.tables import BIO_SQL, bio, box, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

# the common space

_METRICS = ["points_per_game", "ts_pct", "tov_pct"]
_ROLES = {"scoring": ["points_per_game", "ts_pct"], "care": ["tov_pct"]}
SPACE_SQL = f"""{RATES_SQL}, x AS (SELECT season, athlete_id, position, {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)} FROM rates),
ref AS (SELECT * FROM x WHERE season >= 1995 AND position <> 'C'), sg AS (SELECT season, position, count(*) AS n FROM ref GROUP BY ALL), ss AS (SELECT season, count(*) AS n FROM ref GROUP BY ALL), gg AS (SELECT position, count(*) AS n FROM ref GROUP BY ALL),
scoped AS (SELECT x.*, CASE WHEN ss.n > 0 AND sg.n >= 30 THEN x.season || '/' || x.position WHEN ss.n > 0 THEN x.season || '/*' WHEN gg.n >= 30 THEN '*/' || x.position ELSE '*/*' END AS scope FROM x LEFT JOIN sg USING (season, position) LEFT JOIN ss USING (season) LEFT JOIN gg USING (position)),
peers AS (SELECT unnest([season || '/' || position, season || '/*', '*/' || position, '*/*']) AS scope, {', '.join(_METRICS)} FROM ref),
{', '.join(f'''u{k} AS (SELECT scope, v, c, sum(c) OVER (PARTITION BY scope ORDER BY v) AS hi, sum(c) OVER (PARTITION BY scope) AS n FROM (SELECT scope, v, sum(c) AS c FROM (SELECT scope, {m} AS v, 1 AS c FROM peers UNION ALL SELECT scope, {m}, 0 FROM scoped) WHERE v IS NOT NULL GROUP BY ALL))''' for k, m in enumerate(_METRICS))},
pct AS (SELECT s.season, s.athlete_id, {', '.join(f'CASE WHEN u{k}.n > 0 THEN 100.0::DOUBLE * (2 * u{k}.hi - u{k}.c) / (2 * u{k}.n) END AS {m}_pct' for k, m in enumerate(_METRICS))} FROM scoped s {' '.join(f'LEFT JOIN u{k} ON u{k}.scope = s.scope AND u{k}.v = s.{m}' for k, m in enumerate(_METRICS))})"""


def _space(spark, sf_dir):
    # read as prospects, as their peers and for the sizes of groups
    x = stored(rates(spark, sf_dir).select("season", "athlete_id", "position", *[F.round(m, 9).alias(m) for m in _METRICS]))
    return x, x.where("season >= 1995 AND position <> 'C'")


@query(f"WITH {SPACE_SQL} SELECT season, athlete_id, {r([f'{m}_pct' for m in _METRICS])} FROM pct")
def league_percentiles(spark, sf_dir):
    x, ref = _space(spark, sf_dir)
    out = C.league_percentiles(x, ref, ["season", "athlete_id"], _METRICS, "season", "position")
    return rounded(out.select("season", "athlete_id", *[f"{m}_pct" for m in _METRICS]))


@query(f"WITH {SPACE_SQL} SELECT season, athlete_id, round((coalesce(points_per_game_pct, 0) + coalesce(ts_pct_pct, 0)) / nullif((points_per_game_pct IS NOT NULL)::INT + (ts_pct_pct IS NOT NULL)::INT, 0), 6) AS scoring, round(100 - tov_pct_pct, 6) AS care FROM pct")
def college_space(spark, sf_dir):
    x, ref = _space(spark, sf_dir)
    out = C.college_space(x, ref, ["season", "athlete_id"], _ROLES, ("tov_pct",), "season", "position")
    return rounded(out.select("season", "athlete_id", "scoring", "care"))


_DISTANCE = "c_mktsegment AS g, c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS distance FROM customer"


def _distances(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("distance"))


@query(f"SELECT g, id, round(CASE WHEN distance IS NOT NULL THEN 100.0::DOUBLE * (n - row_number() OVER (PARTITION BY g ORDER BY distance NULLS LAST, id)) / greatest(n - 1, 1) END, 6) AS within_pool FROM (SELECT *, count(distance) OVER (PARTITION BY g) AS n FROM (SELECT {_DISTANCE}))")
def within_pool_percentile(spark, sf_dir):
    return rounded(C.within_pool_percentile(_distances(spark, sf_dir), ["g"], "distance", "id").select("g", "id", "within_pool"))


@query(f"SELECT g, round(next - distance, 6) AS gap FROM (SELECT *, lead(distance) OVER w AS next, row_number() OVER w AS k FROM (SELECT {_DISTANCE}) WHERE distance IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY distance, id)) WHERE k = 3")
def neighbour_gap(spark, sf_dir):
    return rounded(C.neighbour_gap(_distances(spark, sf_dir), ["g"], "distance", "id", 3))


@query("WITH ref AS (SELECT c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT count(*) AS n FROM ref) SELECT c_custkey, round(100 - 100.0::DOUBLE * ((SELECT count(*) FROM ref WHERE v < c_acctbal) + (SELECT count(*) FROM ref WHERE v <= c_acctbal)) / (2 * n), 6) AS similarity FROM customer, n")
def similarity_scores(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(S.farther_share(c, c.where("c_custkey % 2 = 0"), "c_acctbal").select("c_custkey", "similarity"))


_PAIRED = """met AS (SELECT sqrt(list_avg([(m.points_per_game - p.points_per_game) ** 2, (m.rebounds_per_40 - p.rebounds_per_40) ** 2, (m.ts_pct - p.ts_pct) ** 2])) AS d FROM rates m JOIN pool p ON m.athlete_id <> p.athlete_id)"""
CUTS_SQL = f"""{POOL_SQL}, {_PAIRED}, ranked AS (SELECT count(d) AS n, list_sort(list(d) FILTER (d IS NOT NULL)) AS ds FROM met),
bands AS (SELECT s, n, ds, round_even(100.0::DOUBLE * (n - k) / n, 0) = s AS ok, k FROM (SELECT s, n, ds, (200 * n - n * (2 * s - 1)) // 200 - CASE WHEN (200 * n - n * (2 * s - 1)) % 200 = 0 AND s % 2 = 1 THEN 1 ELSE 0 END AS k0, least(n, k0) AS k FROM ranked, (SELECT unnest(range(0, 101)) AS s))),
cuts AS (SELECT s AS score, n, CASE WHEN ok THEN ds[least(k, n - 1) + 1] END AS upto FROM bands)"""
_SPACE = ["points_per_game", "rebounds_per_40", "ts_pct"]


def _cuts(spark, sf_dir):
    x = _seasons(spark, sf_dir)
    mine = x.select("athlete_id", F.array(*_SPACE).alias("vec"))
    pool = _pool(x).select(F.col("athlete_id").alias("other_id"), F.array(*_SPACE).alias("other_vec"))
    return S.thresholds(mine, pool, "athlete_id", "other_id", len(_SPACE))


@query(f"WITH {CUTS_SQL} SELECT score::INT AS score, n, round(upto, 6) AS upto FROM cuts")
def distance_reference(spark, sf_dir):
    """Where the score falls, over the distances of every season row to the whole pool."""
    cuts = _cuts(spark, sf_dir).select("n", F.posexplode("cuts").alias("i", "upto"))
    return rounded(cuts.select((100 - F.col("i")).alias("score"), "n", "upto"))


@query(f"WITH {CUTS_SQL} SELECT s_suppkey, coalesce((SELECT max(score) FROM cuts WHERE round(upto, 9) >= round(abs(s_acctbal) / 1000, 9)), 0) AS score FROM supplier")
def threshold_scores(spark, sf_dir):
    """Balances in the role of distances."""
    cuts = _cuts(spark, sf_dir).select(F.transform("cuts", lambda c: F.round(c, 9)).alias("cuts"))
    s = read(spark, sf_dir, "supplier").crossJoin(F.broadcast(cuts))  # one row
    return s.select("s_suppkey", S.score_from_thresholds(F.round(F.abs("s_acctbal") / 1000, 9), F.col("cuts")).alias("score"))


_KEYED = "trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(name)), '\\b(jr|sr|ii|iii|iv|v)\\b\\.?', '', 'g'), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g'))"
_NAMES_SQL = "names AS (SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || [' Jr.', ' O''Neal-Díaz III', ' V. Šarić', ' Ångström Sr', ' Žižić'][(p_partkey % 5 + 1)::INT] AS name FROM part)"


def _names(spark, sf_dir):
    tails = F.array(*map(F.lit, (" Jr.", " O'Neal-Díaz III", " V. Šarić", " Ångström Sr", " Žižić")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.element_at(tails, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("name")
    )


@query(f"WITH {_NAMES_SQL} SELECT p_partkey, {_KEYED} AS name_key, trim(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(replace(lower(name), 'å', 'a')), '[^a-z ]', '', 'g'), '\\s+', ' ', 'g')), '( (jr|sr|ii|iii|iv|v))+$', '')) AS match_key FROM names")
def name_keys(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", T.name_key(F.col("name")).alias("name_key"), T.match_key(F.col("name")).alias("match_key"))


@query("SELECT s_suppkey, trim(regexp_replace(replace(replace(replace(lower(s_name), '#', ' st. '), 'st.', 'state'), '–', '-'), '\\s+', ' ', 'g')) AS school FROM supplier")
def school_keys(spark, sf_dir):
    s = F.concat(F.replace("s_name", F.lit("#"), F.lit(" St. ")), F.lit(" men's basketball"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.school_key(s).alias("school"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE l_partkey // 2 END AS id FROM lineitem")
def integer_ids(spark, sf_dir):
    """Ids as doubles in text, with blanks, missing, no numbers, and with halves that are cut."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    text = (
        F.when(n == 1, k.cast("double").cast("string"))
        .when(n == 2, F.concat(F.lit("  "), k.cast("string"), F.lit(" ")))
        .when(n == 3, F.concat(F.lit("x"), k.cast("string")))
        .when(n != 4, (k / 2).cast("string"))
    )
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.to_id(text).alias("id"))


# boards and metrics

RANK_SQL = "o AS (SELECT o_orderpriority AS g, o_orderkey AS id, year(o_orderdate) AS year, floor(o_totalprice / 10000) AS pred, (o_custkey % 60 + 1)::DOUBLE AS pick, (o_orderstatus = 'F')::INT AS y, floor(o_totalprice / 1000) / 600 AS p FROM orders)"


def _ranked(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "orders").select(
        c("o_orderpriority").alias("g"), c("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.floor(c("o_totalprice") / 10000).cast("double").alias("pred"),
        (c("o_custkey") % 60 + 1).cast("double").alias("pick"), (c("o_orderstatus") == "F").cast("int").alias("y"), (F.floor(c("o_totalprice") / 1000) / 600).alias("p"), F.lit(60.0).alias("size"),
    )


def _ndcg_sql(score: str, gain: str, k: int | None, name: str, rows: str = "o") -> str:
    keep = (lambda x: f"CASE WHEN {x} <= {k} THEN 1 ELSE 0 END") if k else (lambda x: "1")
    return f"""{name} AS (SELECT g, sum(dcg) / sum(ideal) AS {name} FROM (SELECT g, s, avg(gain) * sum({keep('a')} / log2(a + 1)) AS dcg, sum({keep('b')} * gain / log2(b + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC) AS a, row_number() OVER (PARTITION BY g ORDER BY gain DESC) AS b FROM (SELECT g, {score} AS s, {gain} AS gain FROM {rows})) GROUP BY g, s) GROUP BY g)"""


def _spearman_sql(a: str, b: str, name: str, rows: str = "o") -> str:
    rank = "rank() OVER (PARTITION BY g ORDER BY {0}) + (count(*) OVER (PARTITION BY g, {0}) - 1) / 2"
    return f"{name} AS (SELECT g, corr(x, z) AS {name} FROM (SELECT g, {rank.format(a)} AS x, {rank.format(b)} AS z FROM {rows}) GROUP BY g)"


@query(f"""WITH {RANK_SQL}, {_spearman_sql('pred', 'pick', 'sp')}, {_ndcg_sql('-pred', '61 - pick', None, 'nd')}, {_ndcg_sql('-pred', '61 - pick', 14, 'nd14')},
err AS (SELECT g, count(*) AS n, avg(abs(pred - pick)) AS mae, sqrt(avg((pred - pick) ** 2)) AS rmse, quantile_cont(abs(pred - pick), 0.5) AS median_ae FROM o GROUP BY g),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pred, id) AS k, count(*) OVER (PARTITION BY g) AS c, quantile_cont(pick, 0.5) OVER (PARTITION BY g) AS m FROM o),
rec AS (SELECT g, count(*) FILTER (pick <= 14 AND k <= 14) / count(*) FILTER (pick <= 14) AS lottery_recall, count(*) FILTER (pick <= 30 AND k <= 30) / count(*) FILTER (pick <= 30) AS first_round_recall, count(*) FILTER (k <= c // 2 AND pick <= m) / max(c // 2) AS top_half_concentration FROM k GROUP BY g)
SELECT g, n, round(sp, 6) AS spearman, round(nd, 6) AS ndcg, round(nd14, 6) AS ndcg_at_14, {r(['mae', 'rmse', 'median_ae', 'lottery_recall', 'first_round_recall', 'top_half_concentration'])} FROM err JOIN sp USING (g) JOIN nd USING (g) JOIN nd14 USING (g) JOIN rec USING (g)""")
def order_metrics(spark, sf_dir):
    out = M.order_metrics(_ranked(spark, sf_dir), ["g"], "pred", "pick", "size", "id")
    return rounded(out.select("g", "n", "spearman", "ndcg", "ndcg_at_14", "mae", "rmse", "median_ae", "lottery_recall", "first_round_recall", "top_half_concentration"))


@query(f"""WITH {RANK_SQL}, rel AS (SELECT *, CASE WHEN y = 1 THEN (61 - pick) / 60 ELSE 0 END AS rel FROM o), taken AS (SELECT * FROM o WHERE y = 1), {_ndcg_sql('p', 'rel', None, 'gn', 'rel')}, {_ndcg_sql('p', 'rel', 14, 'gn14', 'rel')}, {_spearman_sql('p', '-pick', 'sp', 'taken')},
auc AS (SELECT g, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2 AS r FROM o) GROUP BY g)
SELECT g, n, drafted, low_support, round(auc, 6) AS auc, round(gn, 6) AS graded_ndcg, round(gn14, 6) AS graded_ndcg_at_14, round(sp, 6) AS spearman FROM (SELECT g, count(*) AS n, sum(y)::BIGINT AS drafted, least(sum(y), count(*) - sum(y)) < 5 AS low_support FROM o GROUP BY g) JOIN auc USING (g) JOIN gn USING (g) JOIN gn14 USING (g) JOIN sp USING (g)""")
def board_metrics(spark, sf_dir):
    out = M.board_metrics(_ranked(spark, sf_dir), ["g"], "p", "y", "pick", "size", "id")
    return rounded(out.select("g", "n", "drafted", "low_support", "auc", "graded_ndcg", "graded_ndcg_at_14", "spearman"))


@query(f"WITH {RANK_SQL}, f AS (SELECT year, avg(abs(pred - pick)) AS mae, sqrt(avg((pred - pick) ** 2)) AS rmse FROM o GROUP BY year) SELECT metric, round(avg(v), 6) AS macro, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS low FROM (SELECT 'mae' AS metric, mae AS v FROM f UNION ALL SELECT 'rmse', rmse FROM f) GROUP BY metric")
def fold_summary(spark, sf_dir):
    return rounded(M.over_folds(M.errors(_ranked(spark, sf_dir), ["year"], "pred", "pick"), ["mae", "rmse"]))


_BOTH = "SELECT *, row_number() OVER (PARTITION BY g ORDER BY pred, id) AS a, CASE WHEN y = 1 THEN row_number() OVER (PARTITION BY g ORDER BY pick, id) END AS b FROM o"


def _both(spark, sf_dir):
    x = R.numbered(R.numbered(_ranked(spark, sf_dir), ["g"], ["pred", "id"], "a"), ["g"], ["pick", "id"], "b")
    return x.withColumn("b", F.when(F.col("y") == 1, F.col("b")))


@query(f"WITH {RANK_SQL}, x AS ({_BOTH}) SELECT g, count(*) FILTER (a <= 14 AND b <= 14) AS overlap, least(count(*) FILTER (b <= 14), 14) AS possible FROM x GROUP BY g")
def top_overlap(spark, sf_dir):
    return M.top_overlap(_both(spark, sf_dir), ["g"], "a", "b").withColumn("possible", F.col("possible").cast("long"))


@query(f"WITH {RANK_SQL}, x AS (SELECT g, id, a - b AS gap FROM ({_BOTH}) WHERE b IS NOT NULL) SELECT g, 'earlier' AS kind, row_number() OVER (PARTITION BY g ORDER BY gap DESC, id) AS place, id, gap FROM x QUALIFY place <= 3 UNION ALL SELECT g, 'later', row_number() OVER (PARTITION BY g ORDER BY gap, id) AS place, id, gap FROM x QUALIFY place <= 3")
def error_analysis(spark, sf_dir):
    return M.surprises(_both(spark, sf_dir), ["g"], "a", "b", "id", 3)


@query(f"WITH {RANK_SQL}, q AS (SELECT g, v, sum(c) OVER (PARTITION BY g ORDER BY v) - c AS lo, sum(c) OVER (PARTITION BY g) AS n FROM (SELECT g, v, sum(c) AS c FROM (SELECT g, -pred AS v, 0 AS c FROM o UNION ALL SELECT g, -pred, 1 FROM o WHERE year < 1995) GROUP BY ALL)) SELECT g, id, round((lo + 0.5) / (n + 1), 6) AS quality FROM o JOIN q USING (g) WHERE year >= 1995 AND q.v = -pred")
def historical_quality(spark, sf_dir):
    """Predictions of later years among those of earlier ones."""
    x = _ranked(spark, sf_dir)
    out = B.slot_signal(x.where("year >= 1995"), ["g"], "pred", F.lit(60.0), "historical", x.where("year < 1995"))
    return rounded(out.select("g", "id", "quality"))


@query(f"WITH {RANK_SQL} SELECT g, id, round((rank() OVER (PARTITION BY g ORDER BY -pred) + (count(*) OVER (PARTITION BY g, pred) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY g), 6) AS quality FROM o")
def class_quality(spark, sf_dir):
    return rounded(B.slot_signal(_ranked(spark, sf_dir), ["g"], "pred", F.lit(60.0), "class_percentile").select("g", "id", "quality"))


@query(f"WITH {RANK_SQL}, q AS (SELECT g, v, sum(c) OVER (PARTITION BY g ORDER BY v) - c AS lo, sum(c) OVER (PARTITION BY g) AS n FROM (SELECT g, v, sum(c) AS c FROM (SELECT g, p AS v, 0 AS c FROM o UNION ALL SELECT g, p, 1 FROM o WHERE year < 1995) GROUP BY ALL)) SELECT g, id, round_even(100 * (lo + 0.5) / (n + 1), 0)::BIGINT AS overall_score FROM o JOIN q USING (g) WHERE year >= 1995 AND q.v = p")
def historical_score(spark, sf_dir):
    x = _ranked(spark, sf_dir)
    return B.overall_score(x.where("year >= 1995"), ["g"], "p", x.where("year < 1995")).select("g", "id", F.col("overall_score").cast("long"))


@query("SELECT o_orderkey, o_totalprice AS raw, round(ln(p), 6) AS log, round((p - 1) / 59, 6) AS percentile, round((61 - p) / 60, 6) AS value, round(p, 6) AS back, round(p, 6) AS back_percentile FROM (SELECT *, (o_custkey % 60 + 1)::DOUBLE AS p FROM orders)")
def target_transforms(spark, sf_dir):
    p, size = (F.col("o_custkey") % 60 + 1).cast("double"), F.lit(60.0)
    kinds = {k: model.to_target(p, size, k).alias(k) for k in ("log", "percentile", "value")}
    back = model.from_target(model.to_target(p, size, "value"), size, "value").alias("back")
    back_percentile = model.from_target(model.to_target(p, size, "percentile"), size, "percentile").alias("back_percentile")
    return rounded(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("raw"), *kinds.values(), back, back_percentile))


# views


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def board_search(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("rank", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")))
    return W.board_list(c, "c_name", "rank", "  #00000001 ", "BUILDING", "c_mktsegment").select("c_custkey", "c_name")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place, c_custkey % 50 < 20 AS low_sample FROM customer")
def leaderboard(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("attempts", F.col("c_custkey") % 50)
    return W.leaderboard(c, ["c_nationkey"], "c_acctbal", "c_custkey", False, "attempts").select("c_nationkey", "c_custkey", "place", "low_sample")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 5")
def leaders(spark, sf_dir):
    return W.leaders(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "place")


@query(f"WITH {RATES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(points_per_game, 9) DESC NULLS LAST, athlete_id) AS fit_rank FROM rates) SELECT season, round(avg(ts_pct), 6) AS ts_pct, round(avg(tov_pct), 6) AS tov_pct FROM k WHERE fit_rank <= 10 GROUP BY season")
def top_averages(spark, sf_dir):
    x = R.numbered(rates(spark, sf_dir), ["season"], [F.round("points_per_game", 9).desc_nulls_last(), "athlete_id"], "fit_rank")
    return rounded(W.top_averages(x, ["season"], "fit_rank", ["ts_pct", "tov_pct"]))


_ABC = [("a", "o_custkey % 50"), ("b", "o_orderkey % 70"), ("c", "o_custkey % 41"), ("d", "o_orderkey % 60"), ("e", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 53 END"), ("f", "o_custkey % 45")]


@query("WITH v AS (SELECT o_orderkey, unnest([" + ", ".join(f"{{'k': {k}, 'm': '{n}', 'v': ({e})::DOUBLE}}" for k, (n, e) in enumerate(_ABC)) + "], recursive := true) FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, k) AS down, count(*) OVER (PARTITION BY o_orderkey) AS c FROM v WHERE v IS NOT NULL) SELECT o_orderkey, string_agg(m, ',' ORDER BY down) FILTER (down <= 3) AS strengths, string_agg(m, ',' ORDER BY down DESC) FILTER (down > 3 AND down > c - 2) AS watch FROM n GROUP BY ALL")
def strengths_and_watch(spark, sf_dir):
    best, worst = W.strengths_and_watch([(n, F.expr(e).cast("double")) for n, e in _ABC])
    return read(spark, sf_dir, "orders").select("o_orderkey", best.alias("strengths"), worst.alias("watch"))


@query("SELECT s_nationkey, s_suppkey, round((s_suppkey % 5) / sum(s_suppkey % 5) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier QUALIFY sum(s_suppkey % 5) OVER (PARTITION BY s_nationkey) > 0")
def weight_shares(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("w", F.col("s_suppkey") % 5)
    return rounded(W.weight_shares(s, ["s_nationkey"], "w").where("share IS NOT NULL").select("s_nationkey", "s_suppkey", "share"))


@query(f"WITH {RATES_SQL} SELECT season, count(v) AS n, min(v) AS low, median(v) AS median, round(avg(v), 6) AS mean, max(v) AS high, count(DISTINCT v) AS n_distinct FROM (SELECT season, games_played AS v FROM rates) GROUP BY season")
def class_summary(spark, sf_dir):
    return rounded(W.class_summary(rates(spark, sf_dir), ["season"], "games_played"))


@query("SELECT c_mktsegment AS profile, count(*) FILTER (c_acctbal > 0) AS available, count(*) FILTER (c_acctbal <= 0) AS unavailable, round(avg(c_acctbal) FILTER (c_acctbal > 0), 6) AS mean_fit, count(*) FILTER (c_nationkey < 10) AS eligible FROM customer GROUP BY ALL")
def fit_summary(spark, sf_dir):
    c = F.col
    x = read(spark, sf_dir, "customer").select(c("c_mktsegment").alias("profile"), F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("fit"), F.when(c("c_nationkey") < 10, "ELIGIBLE").otherwise("OUT_OF_POSITION").alias("eligible"))
    return rounded(W.fit_summary(x, "profile", "fit", "eligible"))


@query("SELECT coalesce(nullif(event_type, 'view'), 'NONE') AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, sf_dir):
    return W.status_counts(read(spark, sf_dir, "events").withColumn("s", F.nullif("event_type", F.lit("view"))), "s")


@query("SELECT event_type || '_' || b AS feature FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(0, 12)) AS b) EXCEPT SELECT event_type || '_' || floor(value / 25)::BIGINT FROM events")
def never_present(spark, sf_dir):
    """Kinds of events by bands of value: which of them no event has."""
    e = read(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    names = {f"{k}_{b}": F.when((F.col("event_type") == k) & (F.floor(F.col("value") / 25) == b), F.col("value")) for k in kinds for b in range(12)}
    return W.never_present(e.select(*[c.alias(n) for n, c in names.items()]), list(names))


@query("""WITH p AS (SELECT page_id, CASE WHEN length(html) % 5 = 0 THEN 'MISSING' ELSE 'OK' END AS status, CASE WHEN contains(html, 'the') THEN 'CC BY 4.0' ELSE '  ' END AS license, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS attribution, regexp_extract(html, 'href="([^"]+)"', 1) AS thumbnail FROM pages)
SELECT page_id, license, attribution, thumbnail FROM p WHERE status = 'OK' AND trim(license) <> '' AND trim(attribution) <> '' AND trim(thumbnail) <> ''""")
def photo_index(spark, sf_dir):
    c = F.col
    p = read(spark, sf_dir, "pages").select(
        "page_id", F.when(F.length("html") % 5 == 0, "MISSING").otherwise("OK").alias("status"), F.when(c("html").contains("the"), "CC BY 4.0").otherwise("  ").alias("license"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("attribution"), F.regexp_extract("html", 'href="([^"]+)"', 1).alias("thumbnail"),
    )
    return W.photo_index(p, "page_id")


_LICENCE_SQL = "['CC', 'cc', 'Cc'][(p_size % 3 + 1)::INT] || [' ', '-'][(p_partkey % 2 + 1)::INT] || ['BY', 'BY-SA', 'by-nc', 'BY-ND', 'by sa'][(p_size % 5 + 1)::INT] || ['', ' 4.0', ' 2', ' deed', '-3.0'][(p_partkey % 5 + 1)::INT]"


@query(f"""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN ['Public domain', 'PD old', 'All rights reserved', 'CC0', 'PDM'][(p_size % 5 + 1)::INT] ELSE {_LICENCE_SQL} END AS name FROM part), c AS (SELECT *, regexp_replace(replace(lower(name), '-', ' '), ' \\d(\\.\\d)?$', '') AS bare FROM l)
SELECT p_partkey, coalesce(bare IN ('cc by', 'cc by sa', 'cc0', 'public domain') OR starts_with(lower(name), 'pd '), false) AS free FROM c""")
def free_licenses(spark, sf_dir):
    """Licences put together of parts that vary: with and without share-alike, versions and words that take the freedom back."""
    k, z = F.col("p_partkey"), F.col("p_size")
    one = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    made = F.concat(one(("CC", "cc", "Cc"), z), one((" ", "-"), k), one(("BY", "BY-SA", "by-nc", "BY-ND", "by sa"), z), one(("", " 4.0", " 2", " deed", "-3.0"), k))
    other = one(("Public domain", "PD old", "All rights reserved", "CC0", "PDM"), z)
    return read(spark, sf_dir, "part").select("p_partkey", T.free_license(F.when(k % 7 == 1, other).when(k % 7 != 0, made)).alias("free"))


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer ORDER BY md5(concat_ws('/', c_custkey::VARCHAR, '11')), c_custkey LIMIT 25")
def seeded_sample(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return ordered(clean_numbers(W.sampled(c, "c_custkey", 25, 11)), "c_custkey")


@query("SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents WHERE text IS NOT NULL) WHERE w IN ('the', 'a', 'of') GROUP BY ALL")
def list_membership(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return d.where(F.array_contains(F.array(*map(F.lit, ("the", "a", "of"))), F.col("word"))).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# assembly

POPULATION_SQL = "population AS (SELECT year(o_orderdate) AS season, o_orderkey AS prospect_id, CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS athlete_id, CASE WHEN o_custkey % 9 = 0 THEN 'UNMATCHED' WHEN o_custkey % 11 = 0 THEN 'OVERRIDE' ELSE 'NAME' END AS method FROM orders)"
FEATURE_SQL = f"""{SEASON_SQL}, {BIO_SQL}, {SHOTS_SQL}, {POPULATION_SQL}, built AS (SELECT p.*, games_played, n_teams, fga, fgm - tpm AS two_points_made, fga - tpa AS two_points_attempted, fg_attempts, layup_attempts, label, height_inches, (season IN (2020, 2021))::INT AS short_season
FROM population p LEFT JOIN season_box USING (season, athlete_id) LEFT JOIN profile ON profile.athlete_id = p.athlete_id LEFT JOIN bio ON bio.athlete_id = p.athlete_id)"""


def _population(spark, sf_dir):
    k = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("prospect_id"), F.when(k % 9 > 0, k).alias("athlete_id"),
        F.when(k % 9 == 0, "UNMATCHED").when(k % 11 == 0, "OVERRIDE").otherwise("NAME").alias("method"),
    )


def _built(spark, sf_dir):
    shots = A.shot_profile(_shots(spark, sf_dir), ["athlete_id"])
    return D.prospect_features(_population(spark, sf_dir), A.season_box(box(spark, sf_dir)), shots, bio(spark, sf_dir))


@query(f"WITH {FEATURE_SQL} SELECT season, prospect_id, athlete_id, games_played, fg_attempts, layup_attempts, label, round(height_inches, 6) AS height_inches, {r(['two_points_made', 'two_points_attempted'])}, short_season FROM built")
def prospect_features(spark, sf_dir):
    names = ["season", "prospect_id", "athlete_id", "games_played", "fg_attempts", "layup_attempts", "label", "height_inches", "two_points_made", "two_points_attempted", "short_season"]
    return rounded(_built(spark, sf_dir).select(*names))


@query(f"WITH {FEATURE_SQL} SELECT season, count(*) AS prospects, count(athlete_id) AS matched, count(*) FILTER (athlete_id IS NULL) AS unmatched, count(games_played) AS with_box, count(fg_attempts) AS with_shots, count(*) FILTER (n_teams > 1) AS multi_team, count(*) FILTER (method = 'OVERRIDE') AS override, count(*) FILTER (method = 'AMBIGUOUS') AS ambiguous FROM built GROUP BY season")
def build_stats(spark, sf_dir):
    return D.build_stats(_built(spark, sf_dir), "season", "athlete_id", "method")


@query(f"WITH {FEATURE_SQL} SELECT count(*) AS declared, count(athlete_id) AS matched, count(*) FILTER (athlete_id IS NULL) AS unmatched, count(*) FILTER (athlete_id IS NOT NULL AND games_played IS NOT NULL) AS scoreable, count(*) FILTER (athlete_id IS NULL OR games_played IS NULL) AS insufficient FROM built")
def declared_audit(spark, sf_dir):
    return D.declared_audit(_built(spark, sf_dir), "athlete_id", "games_played")


@query(f"WITH {POPULATION_SQL} SELECT p.season, prospect_id, (o_orderstatus = 'F')::INT AS drafted, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 60 + 1)::DOUBLE END AS pick, CASE WHEN p.season = 1995 THEN 58 WHEN p.season = 1996 THEN 60 END AS draft_size, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'DECLARED' ELSE 'UNKNOWN' END AS status FROM population p JOIN orders ON o_orderkey = prospect_id")
def joined_targets(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    targets = o.select(F.col("o_orderkey").alias("prospect_id"), F.when(done, "True").otherwise("False").alias("drafted"), F.when(done, (F.col("o_custkey") % 60 + 1).cast("string")).otherwise("").alias("pick"))
    x = D.with_size(D.with_targets(_population(spark, sf_dir), targets, ["prospect_id"]), {1995: 58, 1996: 60}, "season")
    status = o.where("o_orderkey % 2 = 0 AND o_custkey % 3 = 0").select(F.col("o_orderkey").alias("prospect_id"), F.lit("DECLARED").alias("status"))
    return D.with_status(x, status, "prospect_id").select("season", "prospect_id", "drafted", "pick", "draft_size", "status")


APPEAR_SQL = "appearances AS (SELECT o_orderpriority AS source, o_orderdate::VARCHAR AS publication_date, 'u' || (o_orderkey % 7) AS url, c_name || CASE WHEN o_orderkey % 2 = 0 THEN ' Jr.' ELSE '' END AS player_name, c_mktsegment AS school FROM orders JOIN customer ON c_custkey = o_custkey)"


def _appearances(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    name = F.concat("c_name", F.when(F.col("o_orderkey") % 2 == 0, " Jr.").otherwise(""))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.concat(F.lit("u"), F.col("o_orderkey") % 7).alias("url"), name.alias("player_name"), F.col("c_mktsegment").alias("school")
    )


@query(f"WITH {APPEAR_SQL} SELECT source, arg_min(url, (publication_date[:10], url)) AS url, min(publication_date[:10]) AS publication_date, count(*) AS listed FROM appearances GROUP BY source")
def sources_summary(spark, sf_dir):
    return D.sources_summary(_appearances(spark, sf_dir))


@query(f"""WITH {APPEAR_SQL}, k AS (SELECT *, {_KEYED.replace('name)', "player_name || ' ' || school)")} AS normalized_name FROM appearances), n AS (SELECT normalized_name, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY ALL HAVING count(DISTINCT source) >= 2),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY source, player_name || ' ' || school, school) = 1)
SELECT '2027-' || replace(normalized_name, ' ', '_') AS prospect_id, 2027 AS draft_year, player_name || ' ' || school AS player_name, normalized_name, school AS college, sources, n_sources FROM f JOIN n USING (normalized_name)""")
def consensus_population(spark, sf_dir):
    a = _appearances(spark, sf_dir).withColumn("player_name", F.concat_ws(" ", "player_name", "school"))
    return D.consensus_population(a, 2027)


@query("WITH t AS (SELECT o_custkey AS k, min(o_totalprice) FILTER (o_orderstatus = 'F') AS F, min(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0), a AS (SELECT o_custkey AS k, min(o_orderkey % 10) FILTER (o_orderstatus = 'P') AS P FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT c_custkey AS k, round(F, 6) AS F, round(O, 6) AS O, round(P, 6) AS P_average FROM customer JOIN t ON t.k = c_custkey JOIN a ON a.k = c_custkey")
def player_seasons(spark, sf_dir):
    """Wide totals and averages; of several values of a name the smallest."""
    o = read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderstatus") == "P", (F.col("o_orderkey") % 10).cast("double")).otherwise(F.col("o_totalprice"))
    long = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "P", "averages").otherwise("totals").alias("category"), F.col("o_orderstatus").alias("stat_name"), value.alias("value"))
    least = long.groupBy("k", "category", "stat_name").agg(F.min("value").alias("value"))
    return rounded(D.player_seasons(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), least, "k", ["F", "O"], ["P"]))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS fgm, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber::DOUBLE END AS tpm, CASE WHEN l_partkey % 4 > 0 THEN l_extendedprice END AS steals, NULL::DOUBLE AS blocks, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity - l_linenumber END AS two_points_made, CASE WHEN l_suppkey % 3 > 0 THEN 2 * l_quantity - l_linenumber END AS two_points_attempted, year(l_shipdate) AS draft_year FROM lineitem")
def internal_frame(spark, sf_dir):
    """Counts that arrive as text, some of them no numbers, under the names of an import file; one is absent."""
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", c("l_quantity").cast("string").alias("field_goals"), (2 * c("l_quantity")).alias("field_goal_attempts"),
        F.when(c("l_suppkey") % 3 > 0, c("l_linenumber").cast("string")).otherwise("--").alias("threes"), c("l_linenumber").alias("three_attempts"),
        F.when(c("l_partkey") % 4 > 0, c("l_extendedprice")).otherwise(float("nan")).alias("thefts"),
    )
    rows = rows.withColumn("three_attempts", F.when(c("l_orderkey") >= 0, F.when(c("threes") != "--", c("three_attempts"))))
    renamed = {"field_goals": "fgm", "field_goal_attempts": "fga", "threes": "tpm", "three_attempts": "tpa", "thefts": "steals", "absent": "x"}
    out = D.to_primitives(rows, renamed, ["steals", "blocks"], F.year("l_shipdate"))
    return out.select("l_orderkey", "l_linenumber", "fgm", "tpm", "steals", "blocks", "two_points_made", "two_points_attempted", "draft_year")


_CALLED = "chr((97 + {0} % 5)::INT) || 'son'"


@query(f"WITH p AS (SELECT n_nationkey, {_CALLED.format('n_nationkey')} || ' ' || chr((97 + n_nationkey // 5)::INT) || 'a' AS name, r_name || ' State' AS school FROM nation JOIN region ON r_regionkey = n_regionkey), b AS (SELECT p.name, r_name AS region FROM supplier JOIN p ON n_nationkey = s_nationkey JOIN region ON r_regionkey = s_suppkey % 5) SELECT p.name, school, count(region) AS candidates, count(*) FILTER (split_part(lower(school), ' ', 1) = split_part(lower(region), ' ', 1)) AS confirmed FROM p LEFT JOIN b USING (name) GROUP BY ALL")
def roster_match(spark, sf_dir):
    n, reg, s = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    k = F.col("n_nationkey")
    name = F.concat(F.char(97 + k % 5), F.lit("son "), F.char(97 + F.floor(k / 5)), F.lit("a"))
    mine = n.join(reg, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", name.alias("name"), F.concat("r_name", F.lit(" State")).alias("school"))
    roster = s.join(mine, F.col("n_nationkey") == F.col("s_nationkey")).select("name", "s_suppkey").join(reg, F.col("r_regionkey") == F.col("s_suppkey") % 5)
    return D.roster_match(mine, roster.select(F.concat(F.upper("name"), F.lit(" Jr.")).alias("name"), F.col("r_name").alias("school")), "name", "school")


# audits


@query("WITH i AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS s, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY ALL), m AS (SELECT o_orderpriority, count(DISTINCT o_custkey) AS i FROM orders GROUP BY ALL) SELECT count(*) AS ids, count(*) FILTER (s > 1) AS in_several_seasons, count(*) FILTER (n > 1) AS under_several_names, (SELECT count(*) FILTER (i > 1) FROM m) AS names_of_several_ids FROM i")
def id_stability(spark, sf_dir):
    return G.id_stability(read(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate")), "o_custkey", "season", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(l_shipdate) > year(o_orderdate)")
def temporal_audit(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.select("l_orderkey", "l_linenumber", F.year("o_orderdate").alias("y"), F.year("l_shipdate").alias("s"))
    return G.temporal_audit(x, "y", "s").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1998)")
def held_out_rows(spark, sf_dir):
    return G.held_out_rows(read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "y", [1995, 1998]).select("o_orderkey")


@query("SELECT coalesce(e.y, f.y)::INT AS y, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM (VALUES (1995, 1::BIGINT), (2050, 3::BIGINT)) e(y, expected) FULL JOIN (SELECT year(o_orderdate) AS y, count(*) AS found FROM orders GROUP BY ALL) f ON e.y = f.y WHERE coalesce(expected, 0) <> coalesce(found, 0)")
def count_differences(spark, sf_dir):
    return G.count_differences(read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "y", {1995: 1, 2050: 3})


@query("SELECT year(o_orderdate) AS fold, count(*) FILTER (o_custkey % 5 = 0) AS missing, count(*) FILTER (o_custkey % 7 = 0 AND o_custkey % 5 > 0) AS repeated FROM orders GROUP BY ALL HAVING missing > 0 OR repeated > 0")
def fold_differences(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("fold"), F.col("o_orderkey").alias("id"), "o_custkey")
    kept = o.where("o_custkey % 5 > 0")
    return G.fold_differences(kept.unionAll(kept.where("o_custkey % 7 = 0")), o, "fold", "id")


@query("SELECT count(*) AS n, count(*) FILTER (k IN (SELECT o_custkey FROM orders)) AS covered, count(*) FILTER (k IN (SELECT o_custkey FROM orders)) / count(*) AS share FROM (SELECT DISTINCT c_custkey AS k FROM customer)")
def key_coverage(spark, sf_dir):
    return G.key_coverage(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH n AS (SELECT event_id, user_id, ['pick', 'picks', 'drafted', 'Pick', 'round', 'rounds', 'value', 'drafted_at'][(event_id % 8 + 1)::INT] AS name, event_type FROM events) SELECT event_id FROM n WHERE name IN ('pick', 'drafted', 'round') AND NOT (event_type = 'view')""")
def payload_scan(spark, sf_dir):
    """Keys of eight names, of which three tell outcomes, in a document or, for views, only in its text."""
    name = F.element_at(F.array(*map(F.lit, ("pick", "picks", "drafted", "Pick", "round", "rounds", "value", "drafted_at"))), (F.col("event_id") % 8 + 1).cast("int"))
    deep = F.to_json(F.create_map(name, F.col("user_id").cast("string")))
    doc = F.when(F.col("event_type") == "view", F.concat(F.lit('{"text": "'), name, F.lit(' of the day"}'))).otherwise(F.concat(F.lit('{"a": [{"b": '), deep, F.lit("}]}")))
    return G.text_leaks(read(spark, sf_dir, "events").withColumn("doc", doc), "doc").select("event_id")


@query("SELECT l_orderkey, l_linenumber, 'error' AS severity, 'l_linenumber' AS field FROM lineitem WHERE l_linenumber > l_quantity UNION ALL SELECT l_orderkey, l_linenumber, 'warning', 'boards' FROM lineitem WHERE abs(l_quantity + l_linenumber - (l_suppkey % 60)) > 1 UNION ALL SELECT l_orderkey, l_linenumber, 'error', 'started' FROM lineitem WHERE l_suppkey % 40 > l_quantity")
def consistency_issues(spark, sf_dir):
    """Threes within field goals, boards that add up, games started within games played."""
    checks = V.box_checks([("l_linenumber", "l_quantity")]) + V.sum_checks(("l_quantity", "l_linenumber"), "total", "boards") + V.within_checks("started", "l_quantity")
    li = read(spark, sf_dir, "lineitem").withColumns({"total": F.col("l_suppkey") % 60, "started": F.col("l_suppkey") % 40, "row": F.struct("l_orderkey", "l_linenumber")})
    return V.row_issues(li, "row", checks).select("row.l_orderkey", "row.l_linenumber", "severity", "field")


@query("SELECT 'heights' AS field, 'warning' AS severity, count(*) FILTER (p_size < 10) AS missing FROM part HAVING missing > 0")
def missing_heights(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("height", F.when(F.col("p_size") >= 10, F.col("p_size")))
    return V.missing_warnings(p, {"heights": ["height"]})
