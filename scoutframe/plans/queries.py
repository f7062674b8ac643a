"""Queries over the driver's tables in the roles of ``scoutframe.sources.tables``, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions import text as T
from scoutframe.operators import aggregate as A
from scoutframe.operators import board as B
from scoutframe.operators import identity as I
from scoutframe.operators import metrics as M
from scoutframe.operators import model
from scoutframe.operators import need as N
from scoutframe.operators import peers as P
from scoutframe.operators import rank as R
from scoutframe.operators import similar as S
from scoutframe.operators import validate as V
from scoutframe.sources import tables
from scoutframe.sources.sinks import stored
from scoutframe.sources.tables import BIO_SQL, BOX_SQL, SHOT_TYPES, bio, box, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def exact(sql: str) -> str:
    """``round(x, 6)`` rounds decimals of nine places, so that values differing in their last bits round alike."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = exact(sql[start + 6 : end - 1])
        wrapped = f"round(CAST({inner[:-3]} AS DECIMAL(38, 9)), 6)::DOUBLE" if inner.endswith(", 6") else f"round({inner})"
        out += [sql[at:start], wrapped]
        at = end
    return "".join([*out, sql[at:]])


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a query, and its DuckDB twin where it has one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = exact(sql)
            return f

        return add

    return query


query = registrar(QUERIES, ORACLE_SQL)


def at_six(c: str):
    return F.round(F.col(c).cast("decimal(38,9)"), DIGITS).cast("double")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[at_six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(names) -> str:
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names)


GAMES_SQL = BOX_SQL + f""", deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY season, athlete_id, game_id ORDER BY {', '.join(A.FIRST)}) AS rn FROM box) WHERE rn = 1),
games AS (SELECT * FROM deduped WHERE NOT did_not_play)"""
SEASON_SQL = GAMES_SQL + f""", season_box AS (SELECT season, athlete_id, {', '.join(f'sum({c}) AS {c}' for c in A.SUMS)}, count(*) AS games_played,
  sum(starter::INT)::BIGINT AS games_started, count(DISTINCT team_id) AS n_teams, arg_max(team_id, (game_date, game_id, team_id)) AS primary_team FROM games GROUP BY season, athlete_id)"""
TEAM_SQL = SEASON_SQL + f""", team_games AS (SELECT season, game_id, team_id, {', '.join(f'sum({c}) AS tm_{c}' for c in A.TEAM)} FROM games GROUP BY ALL),
pairs AS (SELECT a.*, b.team_id AS opp_team_id, {', '.join(f'b.tm_{c} AS opp_{c}' for c in A.TEAM)} FROM team_games a JOIN team_games b USING (season, game_id) WHERE a.team_id <> b.team_id),
context AS (SELECT g.season, g.athlete_id, {', '.join(f'coalesce(sum({s}_{c}), 0) AS {s}_{c}' for s in ('tm', 'opp') for c in A.TEAM)} FROM games g LEFT JOIN pairs p USING (season, game_id, team_id) GROUP BY ALL)"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


_POSS = "tm_fga + 0.44::DOUBLE * tm_fta - tm_oreb + tm_turnovers"
_OPP = "opp_fga + 0.44::DOUBLE * opp_fta - opp_oreb + opp_turnovers"
_FEATURES = {
    "team_possessions": _POSS,
    "opp_possessions": _OPP,
    "minutes_per_game": div("minutes", "games_played"),
    "start_share": div("games_started", "games_played"),
    "fg_pct": div("fgm", "fga"),
    "two_point_pct": div("fgm - tpm", "fga - tpa"),
    "three_point_pct": div("tpm", "tpa"),
    "ft_pct": div("ftm", "fta"),
    "efg_pct": div("fgm + 0.5 * tpm", "fga"),
    "ts_pct": div("points", "2 * (fga + 0.44::DOUBLE * fta)"),
    "three_point_attempt_rate": div("tpa", "fga"),
    "two_point_attempt_rate": div("fga - tpa", "fga"),
    "free_throw_rate": div("fta", "fga"),
    "assist_to_turnover_ratio": div("assists", "turnovers"),
    "ast_pct": "100 * " + div("assists", f"({div('minutes', 'tm_minutes / 5')}) * tm_fgm - fgm"),
    "tov_pct": "100 * " + div("turnovers", "fga + 0.44::DOUBLE * fta + turnovers"),
    "orb_pct": "100 * " + div("oreb * (tm_minutes / 5)", "minutes * (tm_oreb + opp_dreb)"),
    "drb_pct": "100 * " + div("dreb * (tm_minutes / 5)", "minutes * (tm_dreb + opp_oreb)"),
    "trb_pct": "100 * " + div("rebounds * (tm_minutes / 5)", "minutes * (tm_rebounds + opp_rebounds)"),
    "stl_pct": "100 * " + div("steals * (tm_minutes / 5)", f"minutes * ({_OPP})"),
    "blk_pct": "100 * " + div("blocks * (tm_minutes / 5)", "minutes * (opp_fga - opp_tpa)"),
    "usage_pct": "100 * " + div("(fga + 0.44::DOUBLE * fta + turnovers) * (tm_minutes / 5)", "minutes * (tm_fga + 0.44::DOUBLE * tm_fta + tm_turnovers)"),
}
for _n in ("points", "assists", "turnovers", "rebounds", "steals", "blocks"):
    _FEATURES |= {f"{_n}_per_game": div(_n, "games_played"), f"{_n}_per_40": div(f"40 * {_n}", "minutes"), f"{_n}_per_100": div(f"100 * {_n}", _POSS)}
for _n, _c in (("fga", "fga"), ("three_pa", "tpa"), ("fta", "fta"), ("oreb", "oreb"), ("dreb", "dreb"), ("personal_fouls", "fouls")):
    _FEATURES[f"{_n}_per_40"] = div(f"40 * {_c}", "minutes")
_POSITION_SQL = "CASE WHEN label IN ('G', 'PG', 'SG') THEN 'G' WHEN label IN ('F', 'SF', 'PF') THEN 'F' WHEN label = 'C' THEN 'C' ELSE 'UNKNOWN' END"
_RATES = ["points_per_game", "rebounds_per_40", "assists_per_40", "ts_pct", "tov_pct", "three_point_pct"]
RATES_SQL = SEASON_SQL + f""", {BIO_SQL}, rates AS (SELECT s.season, s.athlete_id, {_POSITION_SQL} AS position, minutes, games_played, tpa, height_inches,
  {', '.join(f'{_FEATURES[c]} AS {c}' for c in _RATES)} FROM season_box s LEFT JOIN bio USING (athlete_id))"""


def rates(spark, sf_dir: str) -> DataFrame:
    """Season rates with position and height: one row per season and athlete."""
    b = A.season_box(box(spark, sf_dir)).join(bio(spark, sf_dir), "athlete_id", "left")
    c = F.col
    return b.select(
        "season",
        "athlete_id",
        T.position_group(c("label")).alias("position"),
        "minutes",
        "games_played",
        "tpa",
        "height_inches",
        X.per_game(c("points"), c("games_played")).alias("points_per_game"),
        X.per_40(c("rebounds"), c("minutes")).alias("rebounds_per_40"),
        X.per_40(c("assists"), c("minutes")).alias("assists_per_40"),
        X.true_shooting(c("points"), c("fga"), c("fta")).alias("ts_pct"),
        X.turnover_pct(c("turnovers"), c("fga"), c("fta")).alias("tov_pct"),
        X.safe_div(c("tpm"), c("tpa")).alias("three_point_pct"),
    )


# scans, aggregates and joins


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE year(l_shipdate) IN (1996, 1998) AND l_discount < 0.05")
def scan_projection(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.where(F.year("l_shipdate").isin(1996, 1998) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_partkey", "l_quantity")


@query(f"WITH {SEASON_SQL} SELECT season, athlete_id, games_played, games_started, n_teams, primary_team, {r(A.SUMS)} FROM season_box")
def box_season_agg(spark, sf_dir):
    return rounded(A.season_box(box(spark, sf_dir)))


@query(f"WITH {BOX_SQL}, per AS (SELECT season, athlete_id, game_id, count(*) AS c FROM box GROUP BY ALL) SELECT season, sum(c)::BIGINT AS rows_before, sum(c - 1)::BIGINT AS dupes_removed FROM per GROUP BY season")
def duplicate_report(spark, sf_dir):
    return A.duplicate_report(box(spark, sf_dir))


@query(f"WITH {TEAM_SQL} SELECT season, game_id, team_id, opp_team_id, round(tm_fga, 6) AS tm_fga, round(opp_fga, 6) AS opp_fga FROM pairs")
def opponent_self_join(spark, sf_dir):
    return rounded(A.opponents(A.team_games(box(spark, sf_dir))).select("season", "game_id", "team_id", "opp_team_id", "tm_fga", "opp_fga"))


@query(f"WITH {TEAM_SQL} SELECT season, athlete_id, {r(f'{s}_{c}' for s in ('tm', 'opp') for c in A.TEAM)} FROM context")
def team_context(spark, sf_dir):
    return rounded(A.team_context(box(spark, sf_dir)))


@query(f"WITH {TEAM_SQL} SELECT season, athlete_id, {', '.join(f'round({v}, 6) AS {k}' for k, v in _FEATURES.items())} FROM season_box JOIN context USING (season, athlete_id)")
def engineered_features(spark, sf_dir):
    out = A.features(A.season_in_context(box(spark, sf_dir)))
    return rounded(out.select("season", "athlete_id", *_FEATURES))


def _shots(spark, sf_dir, *more: str):
    types = F.create_map(*[F.lit(x) for p in SHOT_TYPES.items() for x in p])
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("athlete_id"),
        F.try_element_at(types, "event_type").alias("type_text"),
        (F.col("value") < 100).alias("made"),
        F.when(F.col("event_id") % 3 == 0, 3).otherwise(2).alias("score_value"),
        F.when(F.get_json_object("props", "$.k").try_cast("int") < 50, F.get_json_object("props", "$.k").try_cast("int")).alias("assister"),
        *more,
    )


_SHOT_COLUMNS = [
    "fg_attempts", "fg_makes", "three_attempts", "three_makes", "assisted_makes", "unassisted_makes", "layup_attempts", "layup_makes",
    "dunk_attempts", "dunk_makes", "tip_attempts", "tip_makes", "jump_attempts", "jump_makes", "layup_assisted", "layup_unassisted",
    "dunk_assisted", "dunk_unassisted",
]
_KIND = {"layup": "click", "dunk": "purchase", "tip": "signup", "jump": "view"}
SHOTS_SQL = (
    """shots AS (SELECT user_id AS athlete_id, event_type AS t, value < 100 AS made, event_id % 3 = 0 AS three, TRY_CAST(json_extract_string(props, '$.k') AS INT) < 50 AS helped FROM events WHERE event_type <> 'error'),
profile AS (SELECT athlete_id, count(*) AS fg_attempts, count(*) FILTER (made) AS fg_makes, count(*) FILTER (three) AS three_attempts, count(*) FILTER (three AND made) AS three_makes,
  count(*) FILTER (made AND helped) AS assisted_makes, count(*) FILTER (made AND NOT coalesce(helped, false)) AS unassisted_makes, """
    + ", ".join(f"count(*) FILTER (t = '{e}') AS {k}_attempts, count(*) FILTER (t = '{e}' AND made) AS {k}_makes" for k, e in _KIND.items())
    + ", "
    + ", ".join(
        f"count(*) FILTER (t = '{_KIND[k]}' AND made AND helped) AS {k}_assisted, count(*) FILTER (t = '{_KIND[k]}' AND made AND NOT coalesce(helped, false)) AS {k}_unassisted"
        for k in ("layup", "dunk")
    )
    + " FROM shots GROUP BY athlete_id)"
)


@query(f"WITH {SHOTS_SQL} SELECT athlete_id, {', '.join(_SHOT_COLUMNS)} FROM profile")
def shot_conditional_agg(spark, sf_dir):
    return A.shot_profile(_shots(spark, sf_dir), ["athlete_id"]).select("athlete_id", *_SHOT_COLUMNS)


_RIM_A, _RIM_M = "(layup_attempts + dunk_attempts + tip_attempts)", "(layup_makes + dunk_makes + tip_makes)"
_SHOT_RATES = {f"{k}_attempt_share": div(f"{k}_attempts", "fg_attempts") for k in ("layup", "dunk", "tip", "three")} | {
    f"{k}_make_pct": div(f"{k}_makes", f"{k}_attempts") for k in ("layup", "dunk", "tip")
}
_SHOT_RATES |= {
    "rim_attempt_share": div(_RIM_A, "fg_attempts"), "rim_make_pct": div(_RIM_M, _RIM_A), "assisted_share": div("assisted_makes", "fg_makes"),
    "unassisted_share": div("unassisted_makes", "fg_makes"), "assisted_layup_share": div("layup_assisted", "layup_makes"), "assisted_dunk_share": div("dunk_assisted", "dunk_makes"),
}


@query(f"WITH {SHOTS_SQL} SELECT athlete_id, {', '.join(f'round({v}, 6) AS {k}' for k, v in _SHOT_RATES.items())} FROM profile")
def shot_profile_rates(spark, sf_dir):
    out = A.shot_features(A.shot_profile(_shots(spark, sf_dir), ["athlete_id"]))
    return rounded(out.select("athlete_id", *_SHOT_RATES))


@query("SELECT o_custkey, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS F, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS O, round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS P FROM orders GROUP BY o_custkey")
def pivot_long_wide(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("value"))
    return rounded(A.widened(o, ["o_custkey"], "o_orderstatus", "value", ["F", "O", "P"]))


@query(f"WITH {RATES_SQL} SELECT athlete_id, {', '.join(f'round(sum({m} * minutes) / sum(minutes) FILTER ({m} IS NOT NULL), 6) AS {m}' for m in ('ts_pct', 'three_point_pct'))} FROM rates GROUP BY athlete_id")
def weighted_mean(spark, sf_dir):
    return rounded(A.weighted_means(rates(spark, sf_dir), ["athlete_id"], ["ts_pct", "three_point_pct"], "minutes"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_sources, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS sources FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 3")
def consensus_having(spark, sf_dir):
    return A.consensus(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", 3)


@query("SELECT c AS column, n AS rows, present, present / n AS fill_rate FROM (SELECT count(*) AS n, count(CASE WHEN value > 50 THEN value END) AS a, count(nullif(event_type, 'error')) AS b, count(user_id) AS d FROM events), LATERAL (SELECT unnest(['big_value', 'clean_type', 'user_id']) AS c, unnest([a, b, d]) AS present)")
def missingness(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.when(F.col("value") > 50, F.col("value")).alias("big_value"), F.nullif("event_type", F.lit("error")).alias("clean_type"), "user_id"
    )
    return A.fill_rates(e, e.columns)


@query("SELECT round(avg((o_totalprice > 250000)::INT) FILTER (o_orderstatus = 'F'), 6) AS yes, round(avg((o_totalprice > 250000)::INT) FILTER (o_orderstatus <> 'F'), 6) AS no, o_orderpriority FROM orders GROUP BY o_orderpriority")
def coverage_by_outcome(spark, sf_dir):
    big, done = (F.col("o_totalprice") > 250000).cast("double"), F.col("o_orderstatus") == "F"
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return rounded(o.agg(F.avg(F.when(done, big)).alias("yes"), F.avg(F.when(~done, big)).alias("no")))


@query("WITH h AS (SELECT o_orderpriority, least(floor((least(greatest(o_totalprice, 0), 500000) - 0) / (500000.0::DOUBLE / 12)), 11)::INT AS bin, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT DISTINCT o_orderpriority, unnest(range(12))::INT AS bin FROM orders) SELECT g.o_orderpriority, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (o_orderpriority, bin)")
def fixed_width_histogram(spark, sf_dir):
    return A.histogram(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0, 500000, 12)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 4) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_preserve(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 4).alias("total")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_ids(spark, sf_dir):
    big = read(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return read(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_unscored(spark, sf_dir):
    big = read(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return read(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.k IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM a FULL JOIN b ON a.k = b.k")
def full_outer_precedence(spark, sf_dir):
    o = read(spark, sf_dir, "orders")

    def side(status, name):
        return o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias(name))

    return side("F", "a").join(side("O", "b"), "k", "full").select(
        "k", F.coalesce("a", "b").alias("v"), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("source")
    )


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)")
def key_set_ops(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"both": a.intersect(b), "only_customers": b.subtract(a), "either": a.union(b).distinct()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# ranks and windows


@query("SELECT o_orderkey, round((rank() OVER (PARTITION BY o_orderpriority ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY o_orderpriority, v) - 1) / 2 - 0.5) / count(v) OVER (PARTITION BY o_orderpriority), 6) AS pct FROM (SELECT *, floor(o_totalprice / 1000) AS v FROM orders)")
def avg_rank_percentile(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 1000))
    return rounded(o.select("o_orderkey", R.class_percentile(F.col("v"), ["o_orderpriority"]).alias("pct")))


@query(f"WITH {SEASON_SQL} SELECT athlete_id, season, games_played FROM season_box QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY season DESC) = 1")
def latest_season(spark, sf_dir):
    return R.top(A.season_box(box(spark, sf_dir)), ["athlete_id"], [F.desc("season")], 1).select("athlete_id", "season", "games_played")


@query(f"WITH {SEASON_SQL}, last AS (SELECT * FROM season_box QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY season DESC) <= 3) SELECT athlete_id, array_to_string(list_sort(list(DISTINCT season)), ',') AS seasons, sum(games_played)::BIGINT AS games FROM last GROUP BY athlete_id")
def recent_n_seasons(spark, sf_dir):
    rows = R.top(A.season_box(box(spark, sf_dir)), ["athlete_id"], [F.desc("season")], 3)
    return rows.groupBy("athlete_id").agg(F.array_join(F.sort_array(F.collect_set("season")), ",").alias("seasons"), F.sum("games_played").alias("games"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5")
def topk_per_group(spark, sf_dir):
    return R.top(read(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 5).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS gap FROM customer")
def rank_gap(spark, sf_dir):
    c = R.numbered(read(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], "a")
    return R.numbered(c, ["c_mktsegment"], ["c_custkey"], "b").select("c_custkey", (F.col("a") - F.col("b")).alias("gap"))


@query("WITH e AS (SELECT list_distinct(quantile_cont(p_size::DOUBLE, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM part) SELECT p_partkey, greatest(len(list_filter(edges, lambda x: x < p_size)) - 1, 0) AS bin FROM part, e")
def qcut_bins(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    return R.quantile_bins(p, "size").select("p_partkey", "bin")


@query(f"WITH {RATES_SQL} SELECT season, athlete_id, CASE WHEN greatest(a, b, c) < 80 THEN NULL WHEN a >= b AND a >= c THEN 'scorer' WHEN b >= c THEN 'rebounder' ELSE 'passer' END AS label FROM (SELECT season, athlete_id, least(points_per_game * 2, 100) AS a, least(rebounds_per_40 * 8, 100) AS b, least(assists_per_40 * 20, 100) AS c FROM rates WHERE minutes > 0)")
def argmax_label(spark, sf_dir):
    x = rates(spark, sf_dir).where("minutes > 0")
    s = [(n, F.least(F.col(c) * k, F.lit(100.0))) for n, c, k in (("scorer", "points_per_game", 2), ("rebounder", "rebounds_per_40", 8), ("passer", "assists_per_40", 20))]
    return x.select("season", "athlete_id", R.best_label(s, 80).alias("label"))


# peers

_PEER = ["points_per_game", "ts_pct", "tov_pct"]
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT season, position, athlete_id, '{m}' AS metric, {m} AS value FROM rates WHERE {m} IS NOT NULL" for m in _PEER) + ")"
MOMENTS_SQL = f"{RATES_SQL}, {LONG_SQL}, moments AS (SELECT season, position, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median, {', '.join(f'quantile_cont(value, {q / 100}) AS p{q}' for q in (10, 25, 75, 90))} FROM long GROUP BY ALL)"
GRID_SQL = f"""{RATES_SQL}, {LONG_SQL}, grid AS (SELECT season, reference_group, metric, quantile_cont(value, [{', '.join(str(q / 100) for q in range(101))}]) AS grid, count(*) AS n
  FROM (SELECT season, 'GLOBAL' AS reference_group, metric, value FROM long UNION ALL SELECT season, position, metric, value FROM long WHERE position <> 'UNKNOWN') GROUP BY ALL HAVING count(*) >= 50)"""


@query(f"WITH {MOMENTS_SQL} SELECT season, position, metric, n, {r(['mean', 'std', 'median', 'p10', 'p25', 'p75', 'p90'])} FROM moments")
def season_moments(spark, sf_dir):
    return rounded(P.moments(rates(spark, sf_dir), ["season", "position"], _PEER))


@query(f"WITH {GRID_SQL} SELECT season, reference_group, metric, n, (i - 1)::INT AS q, round(grid[i], 6) AS value FROM grid, (SELECT unnest(range(1, 102)) AS i)")
def quantile_grid(spark, sf_dir):
    g = P.grids(rates(spark, sf_dir), "season", "position", _PEER)
    return rounded(g.select("season", "reference_group", "metric", "n", F.posexplode("grid").alias("q", "value")))


@query(f"""WITH {GRID_SQL}, j AS (SELECT x.season, x.athlete_id, x.ts_pct AS v, coalesce(o.grid, g.grid) AS grid FROM rates x
LEFT JOIN grid o ON o.metric = 'ts_pct' AND o.season = x.season AND o.reference_group = x.position LEFT JOIN grid g ON g.metric = 'ts_pct' AND g.season = x.season AND g.reference_group = 'GLOBAL'),
k AS (SELECT *, len(list_filter(grid, lambda y: y <= v)) AS k FROM j)
SELECT season, athlete_id, round(CASE WHEN v IS NULL OR grid IS NULL THEN NULL WHEN k = 0 THEN 0 WHEN k >= 101 THEN 100 ELSE k - 1 + (v - grid[k]) / (grid[k + 1] - grid[k]) END, 4) AS percentile FROM k""")
def grid_interpolate(spark, sf_dir):
    x = stored(rates(spark, sf_dir).select("season", "athlete_id", "position", "ts_pct"))
    out = P.grid_percentiles(x, P.grids(x, "season", "position", ["ts_pct"]), "season", "position", "ts_pct")
    return out.select("season", "athlete_id", F.round("percentile", 4).alias("percentile"))


@query(f"""WITH {MOMENTS_SQL} SELECT x.season, x.athlete_id, {', '.join(f'round(CASE WHEN coalesce(a{i}.std, b{i}.std) > 0 THEN (x.{m} - coalesce(a{i}.mean, b{i}.mean)) / coalesce(a{i}.std, b{i}.std) END, 6) AS {m}' for i, m in enumerate(_PEER))}
FROM rates x {' '.join(f"LEFT JOIN moments a{i} ON a{i}.metric = '{m}' AND a{i}.season = x.season AND a{i}.position = x.position LEFT JOIN moments b{i} ON b{i}.metric = '{m}' AND b{i}.season = x.season AND b{i}.position = 'G'" for i, m in enumerate(_PEER))}""")
def zscore_fallback(spark, sf_dir):
    x = rates(spark, sf_dir)
    out = P.season_relative(x, P.moments(x, ["season", "position"], _PEER), "season", "position", _PEER)
    return rounded(out.select("season", "athlete_id", *_PEER))


@query(f"WITH {RATES_SQL} SELECT season, athlete_id, round(100.0 * (2 * hi - same) / (2 * n), 6) AS midrank FROM (SELECT season, athlete_id, count(*) OVER (PARTITION BY season ORDER BY games_played RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, count(*) OVER (PARTITION BY season, games_played) AS same, count(*) OVER (PARTITION BY season) AS n FROM rates)")
def midrank_percentile(spark, sf_dir):
    return rounded(P.midrank(rates(spark, sf_dir), ["season"], "games_played").select("season", "athlete_id", "midrank"))


_EXTERNAL = f"""WITH {RATES_SQL}, x AS (SELECT season, athlete_id, position, round(points_per_game, 9) AS v FROM rates), ref AS (SELECT v, count(*) AS c FROM x WHERE position = 'G' AND v IS NOT NULL GROUP BY v),
vals AS (SELECT DISTINCT v FROM x WHERE v IS NOT NULL), upto AS (SELECT v, sum(coalesce(c, 0)) OVER (ORDER BY v) AS hi, coalesce(c, 0) AS own, (SELECT sum(c) FROM ref) AS n FROM vals LEFT JOIN ref USING (v))
SELECT season, athlete_id, round(100.0 * (2 * hi - own) / (2 * n), 6) AS midrank, round((hi - own + 0.5) / (n + 1), 6) AS left_percentile FROM x LEFT JOIN upto USING (v)"""


def _external(spark, sf_dir):
    x = rates(spark, sf_dir).select(F.lit(1).alias("k"), "season", "athlete_id", "position", F.round("points_per_game", 9).alias("v"))
    out = P.external_percentiles(x, x.where("position = 'G'"), ["k"], "v")
    return rounded(out.select("season", "athlete_id", "midrank", "left_percentile"))


@query(_EXTERNAL)
def external_percentile(spark, sf_dir):
    """Every season row against all guards."""
    return _external(spark, sf_dir)


@query(f"""WITH {RATES_SQL}, x AS (SELECT season, athlete_id, position, round(ts_pct, 9) AS v FROM rates), ref AS (SELECT position, v, count(*) AS c FROM x WHERE v IS NOT NULL AND season <= 1998 GROUP BY ALL), n AS (SELECT position, sum(c) AS n FROM ref GROUP BY ALL),
vals AS (SELECT DISTINCT position, v FROM x WHERE v IS NOT NULL), upto AS (SELECT position, v, sum(coalesce(c, 0)) OVER (PARTITION BY position ORDER BY v) AS hi, coalesce(c, 0) AS own FROM vals LEFT JOIN ref USING (position, v))
SELECT season, athlete_id, round(100.0 * (2 * hi - own) / (2 * n), 6) AS midrank, round((hi - own + 0.5) / (n + 1), 6) AS left_percentile FROM x LEFT JOIN upto USING (position, v) LEFT JOIN n USING (position)""")
def external_percentile_whole(spark, sf_dir):
    """Every season row against the earlier seasons of its position."""
    x = rates(spark, sf_dir).select("season", "athlete_id", "position", F.round("ts_pct", 9).alias("v"))
    out = P.external_percentiles(x, x.where("season <= 1998"), ["position"], "v")
    return rounded(out.select("season", "athlete_id", "midrank", "left_percentile"))


# the board

_Z = ["points_per_game", "ts_pct"]
BOARD_SQL = f"""{MOMENTS_SQL}, scored AS (SELECT x.season, x.athlete_id, 1 / (1 + exp(-(x.points_per_game - m.mean) / m.std)) AS chance,
  CASE WHEN x.athlete_id % 7 = 0 THEN NULL ELSE ((x.athlete_id % 90) + 1)::DOUBLE END AS pick FROM rates x JOIN moments m ON m.metric = 'points_per_game' AND m.season = x.season AND m.position = x.position),
util AS (SELECT *, CASE WHEN pick IS NOT NULL THEN (60 + 1 - least(greatest(pick, 1), 60)) / 60 END AS u FROM scored), filled AS (SELECT * REPLACE (coalesce(u, quantile_cont(u, 0.5) OVER (PARTITION BY season), 0.5) AS u) FROM util),
pct AS (SELECT *, round(chance * u, 9) AS signal FROM filled),
ranked AS (SELECT *, (rank() OVER (PARTITION BY season ORDER BY signal NULLS LAST) + (count(signal) OVER (PARTITION BY season, signal) - 1) / 2 - 0.5) / count(signal) OVER (PARTITION BY season) AS percentile FROM pct)"""


def _scored(spark, sf_dir):
    x = stored(rates(spark, sf_dir).select("season", "athlete_id", "position", "points_per_game"))
    m = P.spreads(x, ["season", "position"], ["points_per_game"]).select("season", "position", "mean", "std")
    z = (F.col("points_per_game") - F.col("mean")) / F.col("std")
    pick = F.when(F.col("athlete_id") % 7 != 0, (F.col("athlete_id") % 90 + 1).cast("double"))
    return x.join(F.broadcast(m), ["season", "position"]).select("season", "athlete_id", X.logistic(z).alias("chance"), pick.alias("pick"))


@query(f"WITH {BOARD_SQL} SELECT season, athlete_id, round(signal, 6) AS signal, round(percentile, 6) AS percentile, round_even(100 * percentile, 0)::BIGINT AS score, row_number() OVER (PARTITION BY season ORDER BY signal DESC NULLS LAST, athlete_id) AS board_rank FROM ranked")
def general_board(spark, sf_dir):
    s = _scored(spark, sf_dir)
    s = B.order_signal(s.withColumn("utility", B.slot_utility(F.col("pick"), F.lit(60.0))), "utility", ["season"])
    s = B.combined(s, "chance", "utility", ["season"], "product").withColumn("signal", F.round("signal", 9))
    s = s.withColumn("percentile", R.class_percentile(F.col("signal"), ["season"]))
    s = s.withColumn("score", X.half_even(100 * X.clamp(F.col("percentile"), 0.0, 1.0)))
    s = R.numbered(s, ["season"], [F.col("signal").desc_nulls_last(), "athlete_id"], "board_rank")
    return rounded(s.select("season", "athlete_id", "signal", "percentile", "score", "board_rank"))


_PCT = "(rank() OVER (PARTITION BY season ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY season, {c}) - 1) / 2 - 0.5) / count({c}) OVER (PARTITION BY season)"


@query(f"WITH {BOARD_SQL}, p AS (SELECT season, athlete_id, chance, u, {_PCT.format(c='ch')} AS pa, {_PCT.format(c='u')} AS pb FROM (SELECT *, round(chance, 9) AS ch FROM filled)) SELECT season, athlete_id, round(sqrt(pa * pb), 6) AS geometric, round(least(floor(pa * 10), 9) + 0.999 * pb, 6) AS bands, round(0.5 * pa + 0.5 * pb, 6) AS equal FROM p")
def board_methods(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("chance", F.round("chance", 9))
    s = stored(B.order_signal(s.withColumn("utility", B.slot_utility(F.col("pick"), F.lit(60.0))), "utility", ["season"]))
    # the methods share their percentiles
    s = B.all_methods(s, "chance", "utility", ["season"], ("geometric", "bands", "equal"))
    return rounded(s.select("season", "athlete_id", "geometric", "bands", "equal"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN greatest(least((60 + 1 - c_custkey % 70) / 60, 1), 0) ELSE 0 END AS relevance FROM customer")
def graded_relevance(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", B.graded_relevance(F.col("c_mktsegment") == "BUILDING", (F.col("c_custkey") % 70).cast("double"), F.lit(60.0)).alias("relevance"))


# team need

_PARTS = {"shooting": ["s1", "s2", "s3"], "passing": ["a1", "a2"], "size_up": ["h1"]}
NEED_SQL = f"""{RATES_SQL}, raw_pct AS (SELECT season, athlete_id, position, CASE WHEN tpa >= 20 THEN three_point_pct * 100 END AS s1, CASE WHEN ts_pct < 3 THEN ts_pct * 30 END AS s2, CASE WHEN points_per_game < 40 THEN points_per_game * 2 END AS s3,
  CASE WHEN assists_per_40 < 5.00001 THEN assists_per_40 * 20 END AS a1, 100 - tov_pct * 10 AS a2, CASE WHEN height_inches > 70 THEN (height_inches - 68) * 5 END AS h1 FROM rates WHERE minutes > 0),
pct AS (SELECT * REPLACE (round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3, round(a1, 6) AS a1, round(a2, 6) AS a2, round(h1, 6) AS h1) FROM raw_pct),
dims AS (SELECT *, CASE WHEN ns >= 2 THEN (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / ns END AS shooting, CASE WHEN na >= 1 THEN (coalesce(a1, 0) + coalesce(a2, 0)) / na END AS passing, h1 AS size_up, ns / 3 AS shooting_coverage, na / 2 AS passing_coverage, nh AS size_up_coverage,
  (ns / 3 + na / 2 + nh) / 3 AS data_coverage FROM (SELECT *, (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS ns, (a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT AS na, (h1 IS NOT NULL)::INT AS nh FROM pct)),
fits AS (SELECT *, CASE WHEN held >= 0.5 * 10 THEN top / held END AS fit_raw FROM (SELECT *, coalesce(shooting, 0) * 5.0::DOUBLE + coalesce(passing, 0) * 3.0::DOUBLE + coalesce(size_up, 0) * 2.0::DOUBLE AS top,
  (CASE WHEN shooting IS NULL THEN 0 ELSE 5 END + CASE WHEN passing IS NULL THEN 0 ELSE 3 END + CASE WHEN size_up IS NULL THEN 0 ELSE 2 END)::DOUBLE AS held FROM dims))"""


def _dimensions(spark, sf_dir):
    x, c = rates(spark, sf_dir).where("minutes > 0"), F.col
    p = x.select(
        "season", "athlete_id", "position",
        N.reliable(c("three_point_pct") * 100, c("tpa")).alias("s1"),
        F.when(c("ts_pct") < 3, c("ts_pct") * 30).alias("s2"),
        F.when(c("points_per_game") < 40, c("points_per_game") * 2).alias("s3"),
        F.when(c("assists_per_40") < 5.00001, c("assists_per_40") * 20).alias("a1"),
        N.oriented("tov_pct", c("tov_pct") * 10).alias("a2"),
        F.when(c("height_inches") > 70, (c("height_inches") - 68) * 5).alias("h1"),
    )
    # thresholds on these must not depend on the order of a sum
    p = p.withColumns({c: at_six(c) for c in ("s1", "s2", "s3", "a1", "a2", "h1")})
    return N.dimensions(p, _PARTS)


@query(f"WITH {NEED_SQL} SELECT season, athlete_id, {r(['shooting', 'passing', 'size_up', 'shooting_coverage', 'passing_coverage', 'data_coverage'])} FROM dims")
def need_dimensions(spark, sf_dir):
    out = _dimensions(spark, sf_dir)
    return rounded(out.select("season", "athlete_id", "shooting", "passing", "size_up", "shooting_coverage", "passing_coverage", "data_coverage"))


@query(f"WITH {NEED_SQL} SELECT season, athlete_id, round(CASE WHEN shooting IS NOT NULL AND passing IS NOT NULL THEN exp((ln(greatest(shooting, 1e-9)) + ln(greatest(passing, 1e-9))) / 2) END, 6) AS fit_raw, CASE WHEN position = 'UNKNOWN' THEN 'UNKNOWN_POSITION' WHEN position IN ('G', 'F') THEN 'ELIGIBLE' ELSE 'OUT_OF_POSITION' END AS eligibility FROM dims")
def need_profiles(spark, sf_dir):
    out = _dimensions(spark, sf_dir).withColumn("fit_raw", N.archetype([F.col("shooting"), F.col("passing")]))
    return rounded(out.select("season", "athlete_id", "fit_raw", N.eligibility(F.col("position"), ("G", "F")).alias("eligibility")))


_WEIGHTS = {"shooting": 5.0, "passing": 3.0, "size_up": 2.0}


@query(f"WITH {NEED_SQL} SELECT season, athlete_id, round(fit_raw, 6) AS fit_raw, CASE WHEN fit_raw IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS fit_status, CASE WHEN fit_raw IS NOT NULL THEN round_even(least(greatest(round(fit_raw, 9), 0), 100), 0)::BIGINT END AS fit_score FROM fits")
def need_custom(spark, sf_dir):
    out = N.custom_fit(_dimensions(spark, sf_dir), _WEIGHTS, tuple(_PARTS)).withColumn("fit_raw", F.round("fit_raw", 9))
    return rounded(N.with_score(out).select("season", "athlete_id", "fit_raw", "fit_status", "fit_score"))


@query(f"WITH {NEED_SQL} SELECT season, athlete_id, row_number() OVER (PARTITION BY season ORDER BY (f IS NULL), CASE WHEN position IN ('G', 'F', 'UNKNOWN') THEN 0 ELSE 1 END, f DESC NULLS LAST, athlete_id) AS fit_rank FROM (SELECT *, round(fit_raw, 9) AS f FROM fits)")
def need_rank(spark, sf_dir):
    out = N.custom_fit(_dimensions(spark, sf_dir), _WEIGHTS, tuple(_PARTS)).withColumn("fit_raw", F.round("fit_raw", 9))
    out = out.withColumn("eligibility", N.eligibility(F.col("position"), ("G", "F")))
    return N.rank_fit(out, ["season"], "athlete_id", "eligibility").select("season", "athlete_id", "fit_rank")


_EXPLAIN = ["s1", "s2", "s3", "a1"]


@query(f"""WITH {NEED_SQL}, u AS (SELECT season, athlete_id, unnest([{', '.join(f"{{'k': {k}, 'm': '{m}', 'v': {m}}}" for k, m in enumerate(_EXPLAIN))}], recursive := true) FROM pct),
hi AS (SELECT season, athlete_id, string_agg(m, ',' ORDER BY v DESC, k) AS x FROM (SELECT * FROM u WHERE v >= 60 QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY v DESC, k) <= 2) GROUP BY ALL),
lo AS (SELECT season, athlete_id, string_agg(m, ',' ORDER BY v, k) AS x FROM (SELECT * FROM u WHERE v <= 40 QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY v, k) <= 2) GROUP BY ALL),
no AS (SELECT season, athlete_id, string_agg(m, ',' ORDER BY k) AS x FROM u WHERE v IS NULL GROUP BY ALL)
SELECT season, athlete_id, coalesce(hi.x, '') AS strengths, coalesce(lo.x, '') AS limiters, coalesce(no.x, '') AS missing FROM pct LEFT JOIN hi USING (season, athlete_id) LEFT JOIN lo USING (season, athlete_id) LEFT JOIN no USING (season, athlete_id)""")
def explain_strengths(spark, sf_dir):
    return N.explained(_dimensions(spark, sf_dir), _EXPLAIN).select("season", "athlete_id", "strengths", "limiters", "missing")
