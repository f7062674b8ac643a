"""Queries: digests by range, differences of tables, imports and bundles, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutframe.operators import bundles as B
from scoutframe.operators import imports as M
from scoutframe.operators import parity as P
from scoutframe.operators import peers
from scoutframe.operators import sealed as S
from scoutframe.operators import validate as V
from scoutframe.plans.queries import MOMENTS_SQL, rates, registrar, rounded
from scoutframe.sources.sinks import stored
from scoutframe.sources.tables import SHOT_TYPES, read
from scoutframe.streaming import shots as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

_LINE = "c_custkey || ':' || c_name || ':' || c_nationkey"
_TREE_SQL = f"""row AS (SELECT c_mktsegment AS g, c_custkey AS id, sha256({_LINE}) AS h FROM customer),
l0 AS (SELECT g, 0 AS level, floor(id / 16)::BIGINT AS node, min(id) AS low, max(id) AS high, count(*)::BIGINT AS n, sha256(string_agg(h || '*1', ',' ORDER BY id, h)) AS digest FROM row GROUP BY g, floor(id / 16)::BIGINT)"""


def _above(k: int) -> str:
    """Level ``k`` of the twin: the widest tree decides whether nodes fold by eight or into the root; nothing where one is left."""
    return f"""l{k} AS (SELECT g, {k} AS level, up AS node, min(low) AS low, max(high) AS high, sum(n)::BIGINT AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest
  FROM (SELECT *, CASE WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM l{k - 1} GROUP BY g)) <= 8 THEN 0 ELSE floor(node / 8)::BIGINT END AS up FROM l{k - 1}) WHERE (SELECT max(c) FROM (SELECT count(*) AS c FROM l{k - 1} GROUP BY g)) > 1 GROUP BY g, up)"""


_LEVELS = 8


@query(f"WITH {_TREE_SQL}, {', '.join(_above(k) for k in range(1, _LEVELS))} {' UNION ALL '.join(f'SELECT g, level::INT AS level, node, low, high, n, digest FROM l{k}' for k in range(_LEVELS))}")
def content_tree(spark, sf_dir):
    """Digests over ranges of customers, up to a root for each segment."""
    return _tree(spark, sf_dir)


def _tree(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), "c_custkey", F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")), 256).alias("h"))
    return S.tree(S.leaves(c, ["g"], "c_custkey", F.col("h"), 16), ["g"], 8)


@query(f"WITH {_TREE_SQL}, {', '.join(_above(k) for k in range(1, _LEVELS))}, whole AS ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(_LEVELS))}) SELECT g AS c_mktsegment, arg_max(digest, level) AS sha256 FROM whole GROUP BY g")
def content_hash(spark, sf_dir):
    """The root of each segment: one digest for its content, whatever the order of its rows."""
    return S.roots(_tree(spark, sf_dir), ["g"]).select(F.col("g").alias("c_mktsegment"), F.col("root").alias("sha256"))


@query("""WITH now AS (SELECT o_orderkey AS id, floor(o_orderkey / 32)::BIGINT AS leaf, o_orderkey || ':' || o_custkey AS t FROM orders), old AS (SELECT id, leaf, CASE WHEN id % 997 = 5 THEN t || 'x' ELSE t END AS t FROM now WHERE id % 1009 <> 7)
SELECT coalesce(a.leaf, b.leaf) AS leaf, least(a.low, b.low) AS low, greatest(a.high, b.high) AS high, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT leaf, min(id) AS low, max(id) AS high, string_agg(t, ',' ORDER BY id) AS d FROM now GROUP BY leaf) a FULL JOIN (SELECT leaf, min(id) AS low, max(id) AS high, string_agg(t, ',' ORDER BY id) AS d FROM old GROUP BY leaf) b USING (leaf) WHERE a.d IS DISTINCT FROM b.d""")
def changed_ranges(spark, sf_dir):
    """Ranges of orders in which a table differs from an older one, of which some rows are other ones and some are missing."""
    k = F.col("o_orderkey")
    now = read(spark, sf_dir, "orders").select(k.alias("id"), F.concat_ws(":", k.cast("string"), F.col("o_custkey").cast("string")).alias("t"))
    old = now.where("id % 1009 <> 7").withColumn("t", F.when(F.col("id") % 997 == 5, F.concat("t", F.lit("x"))).otherwise(F.col("t")))
    before, after = (S.tree(S.leaves(df, [], "id", width=32), []) for df in (old, now))
    return S.changed_ranges(before, after, [])


@query("""WITH a AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer WHERE c_custkey % 83 > 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 0.25 WHEN c_custkey % 11 = 0 THEN 0.001 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 31 > 0 THEN c_nationkey::DOUBLE END AS c_nationkey FROM customer WHERE c_custkey % 79 > 0),
j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS k, a.c_custkey IS NOT NULL AS l, b.c_custkey IS NOT NULL AS r, a.c_name <> b.c_name AS n, abs(a.c_acctbal - b.c_acctbal) AS d, a.c_nationkey IS DISTINCT FROM b.c_nationkey AS m FROM a FULL JOIN b ON a.c_custkey = b.c_custkey),
s AS (SELECT 'c_name' AS what, count(*) FILTER (l AND r AND n) AS changed, NULL::DOUBLE AS largest FROM j UNION ALL SELECT 'c_acctbal', count(*) FILTER (l AND r AND d > 0.01), max(d) FILTER (l AND r AND d > 0.01) FROM j UNION ALL SELECT 'place.nation[].key', count(*) FILTER (l AND r AND m), NULL FROM j)
SELECT replace(what, '[]', '') AS "column", changed, (SELECT count(*) FROM j WHERE NOT r) AS only_left, (SELECT count(*) FROM j WHERE NOT l) AS only_right, round(largest, 6) AS largest FROM s""")
def table_differences(spark, sf_dir):
    """Two versions of a nested table: what differs, by column."""
    c, k = F.col, F.col("c_custkey")
    place = F.struct(F.array(F.struct(c("c_nationkey").cast("double").alias("key"))).alias("nation")).alias("place")
    rows = read(spark, sf_dir, "customer")
    left = rows.where(k % 83 > 0).select("c_custkey", "c_name", "c_acctbal", place)
    other = rows.withColumns({"c_name": F.when(k % 41 == 0, F.upper("c_name")).otherwise(c("c_name")), "c_acctbal": c("c_acctbal") + F.when(k % 7 == 0, 0.25).when(k % 11 == 0, 0.001).otherwise(0.0), "c_nationkey": F.when(k % 31 > 0, c("c_nationkey"))})
    right = other.where(k % 79 > 0).select("c_custkey", "c_name", "c_acctbal", place)
    found = P.differences(left, right, ["c_custkey"], tolerances={"c_acctbal": 0.01})
    return rounded(P.summary(found))


# an import


_IMPORT = M.Schema([V.Field("o_orderkey", True), V.Field("o_totalprice", True, 1000, 400000), V.Field("o_orderstatus", True, choices=("F", "O")), V.Field("o_custkey", whole=True), V.Field("height")], {"box": ["o_totalprice"], "people": ["o_custkey"], "size": ["height"]})


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::VARCHAR ELSE ' ' END AS price FROM orders), f AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 > 0) AS priced, count(*) FILTER (o_orderkey % 5 = 0) AS blank,
count(*) FILTER (o_orderkey % 5 > 0 AND o_totalprice < 1000) AS low, count(*) FILTER (o_orderkey % 5 > 0 AND o_totalprice > 400000) AS high, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS state FROM o), d AS (SELECT count(*) - count(DISTINCT o_custkey) AS twice FROM orders),
c AS (SELECT count(*) AS clean FROM o WHERE o_orderkey % 5 > 0 AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderstatus IN ('F', 'O') AND o_orderkey = (SELECT min(p.o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey))
SELECT unnest(['rows', 'present o_orderkey', 'present o_totalprice', 'present o_orderstatus', 'present o_custkey', 'present height', 'group box', 'group people', 'group size', 'clean', 'o_totalprice is required', 'o_totalprice must be at least 1000', 'o_totalprice must be at most 400000', 'o_orderstatus must be one of F, O', 'o_custkey duplicate']) AS what,
unnest([n, n, priced, n, n, 0, priced, n, 0, clean, blank, low, high, state, twice]) AS n FROM f, d, c""")
def import_analysis(spark, sf_dir):
    """An import checked in one scan: issues by kind, what is present, and the rows without errors."""
    o = read(spark, sf_dir, "orders").drop("o_orderdate", "o_orderpriority")
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("string")).otherwise(" "))
    got = M.analysed(o, "o_orderkey", "o_custkey", _IMPORT, V.field_checks(_IMPORT.fields[1:3]), {"stats": ["box"], "fit": ["box", "size"]})
    seen = [("rows", got.rows), *((f"present {c}", n) for c, n in got.present.items()), *((f"group {g}", n) for g, n in got.groups.items())]
    figures = spark.createDataFrame(seen, "what string, n long")
    kind = F.concat_ws(" ", "field", F.regexp_replace("message", ", first used on row.*", ""))
    found = got.issues.groupBy(kind.alias("what")).agg(F.count("*").alias("n"))
    expected = ["o_totalprice is required", "o_totalprice must be at least 1000", "o_totalprice must be at most 400000", "o_orderstatus must be one of F, O", "o_custkey duplicate"]
    every = spark.createDataFrame([(e,) for e in expected], "what string").join(found, "what", "full").select("what", F.coalesce("n", F.lit(0)).alias("n"))
    return figures.unionAll(every).unionAll(got.clean.agg(F.count("*").alias("n")).select(F.lit("clean").alias("what"), "n"))


# bundles


@query(f"WITH {MOMENTS_SQL}, m AS (SELECT season, position, string_agg('\"' || metric || '\":{{\"mean\":' || printf('%.6f', round(mean::DECIMAL(38, 9), 6)) || ',\"n\":' || n || ',\"std\":' || CASE WHEN std IS NULL THEN 'null' ELSE printf('%.6f', round(std::DECIMAL(38, 9), 6)) END || '}}', ',' ORDER BY metric) AS body FROM moments GROUP BY ALL) SELECT season, '{{\"moments\":{{' || string_agg('\"' || position || '\":{{' || body || '}}', ',' ORDER BY position) || '}},\"season\":' || season || '}}' AS doc FROM m GROUP BY season")
def season_bundles(spark, sf_dir):
    """Moments of every season as one document each: maps of maps, keys in order, numbers to six places."""
    x = rates(spark, sf_dir)
    return B.season_documents(stored(peers.moments(x, ["season", "position"], ["points_per_game", "ts_pct", "tov_pct"])), "season", "position")


# a stream


@query("""WITH e AS (SELECT date_trunc('day', ts) AS day, value < 100 AS made, event_id % 3 = 0 AS three, event_type AS t, TRY_CAST(json_extract_string(props, '$.k') AS INT) < 50 AS helped FROM events WHERE event_type <> 'error')
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS fg_attempts, count(*) FILTER (made) AS fg_makes, count(*) FILTER (three) AS three_attempts, count(*) FILTER (made AND helped) AS assisted_makes, count(*) FILTER (t = 'click') AS layup_attempts, count(*) FILTER (t = 'purchase' AND made) AS dunk_makes FROM e GROUP BY day""")
def streamed_profile(spark, sf_dir):
    """The shot profile of every day, from events read as a stream that has caught up."""
    schema = read(spark, sf_dir, "events").schema
    arrived = T.event_stream(spark, f"{sf_dir}/events.parquet*", schema)
    types = F.create_map(*[F.lit(x) for p in SHOT_TYPES.items() for x in p])
    helper = F.get_json_object("props", "$.k").try_cast("int")
    shots = arrived.select(
        F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(types, "event_type").alias("type_text"), (F.col("value") < 100).alias("made"),
        F.when(F.col("event_id") % 3 == 0, 3).otherwise(2).alias("score_value"), F.when(helper < 50, helper).alias("assister"),
    )
    windows = T.caught_up(T.windowed_profile(shots, "ts", "1 day"))
    return windows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "fg_attempts", "fg_makes", "three_attempts", "assisted_makes", "layup_attempts", "dunk_makes")
