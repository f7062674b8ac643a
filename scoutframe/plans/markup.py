"""Queries: blocks and links of whole pages, and articles put together from tables and read back, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.operators import markup as K
from scoutframe.plans.queries import registrar
from scoutframe.sources.sinks import stored
from scoutframe.sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

_BARE = r"regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<![a-zA-Z][^>]*>', '', 'g')"


def _said(x: str) -> str:
    for name, sign in (("quot;", '"'), ("copy;", "©"), ("middot;", "·"), ("lt;", "<"), ("gt;", ">"), ("amp;", "&"), ("amp", "&")):
        x = f"replace({x}, '&{name}', '{sign}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace({_BARE}, '<br\s*/?>', ' ', 'g'), '</?(a|b|i|em|strong|span)(\s[^>]*)?>', '', 'g') AS x FROM pages),
s AS (SELECT page_id, regexp_split_to_array(x, '</?[a-zA-Z][^>]*>') AS runs, list_concat([''], regexp_extract_all(x, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS tags FROM p),
u AS (SELECT page_id, unnest(range(1, len(runs) + 1)) AS i, runs, tags FROM s), t AS (SELECT page_id, i, tags[i] AS tag, {_said('runs[i]')} AS text FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, tag, text FROM t WHERE text <> ''""")
def page_texts(spark, sf_dir):
    """Every run of text of every page, with the block tag before it."""
    rows = K.page_blocks(read(spark, sf_dir, "pages"), ["page_id"]).where("kind = 'text'")
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("place")).cast("long")
    return rows.select("page_id", nth.alias("nth"), "tag", "text")


@query(rf"""WITH l AS (SELECT page_id, regexp_extract_all({_BARE}, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all({_BARE}, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t FROM pages),
u AS (SELECT page_id, unnest(range(1, len(h) + 1)) AS nth, h, t FROM l) SELECT page_id, nth, {_said('h[nth]')} AS href, {_said('t[nth]')} AS text FROM u""")
def page_links(spark, sf_dir):
    rows = K.page_blocks(read(spark, sf_dir, "pages"), ["page_id"]).where("kind = 'link'")
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("place")).cast("long")
    return rows.select("page_id", nth.alias("nth"), "href", "text")


# articles of forty customers each

_SCHOOL = "n_name || CASE c_custkey % 4 WHEN 0 THEN ' State basketball' WHEN 1 THEN ' U basketball' WHEN 2 THEN ' B.C. (men''s basketball)' ELSE ' women''s team' END"
_ARTICLE_SQL = f"""c AS (SELECT c_custkey AS k, c_custkey // 40 AS page, c_name, c_mktsegment, n_name, {_SCHOOL} AS school, c_custkey % 4 = 0 AS ncaa,
  ['freshman', 'sophomore', 'junior', 'senior'][(c_custkey % 4 + 1)::INT] AS class, ['G', 'F', 'C', 'G/F', 'F/C'][(c_custkey % 5 + 1)::INT] AS position FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _articles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Articles with a table of picks and a list of entrants, and the redirects of their links."""
    n = read(spark, sf_dir, "nation")
    k, c, lit = F.col("c_custkey"), F.col, F.lit
    one = lambda i, *values: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").join(n, c("n_nationkey") == c("c_nationkey"))
    school = F.concat("n_name", one(k % 4, " State basketball", " U basketball", " B.C. (men's basketball)", " women's team"))
    year, short = one(k % 4, "freshman", "sophomore", "junior", "senior"), one(k % 4, "Fr", "So", "Jr", "Sr")
    said = F.when(k % 3 == 0, F.concat(lit("("), year, lit(")"))).when(k % 3 == 1, F.concat(lit("("), short, lit(".)"))).otherwise(F.concat(lit("([["), F.initcap(year), lit("|x]])")))
    linked = F.concat(lit("[["), school, lit("|"), F.col("n_name"), lit("{{okina}} ''U'']] "), said)
    place = one(k % 5, "G", "F", "C", "G/F", "F/C")
    who = F.when(k % 3 > 0, F.concat(lit("[["), c("c_name"), lit("|"), c("c_mktsegment"), lit(" "), k.cast("string"), lit("]]"))).otherwise(F.concat(c("c_mktsegment"), lit(" "), k.cast("string")))
    item = F.concat(lit("* {{flagicon|"), c("n_name"), lit("}} "), who, lit(" – "), place, lit(", "), linked)
    sort = F.concat(lit("{{sortname|"), c("c_mktsegment"), lit("|"), k.cast("string"), F.when(k % 7 == 0, lit("|dab=basketball")).otherwise(lit("")), lit("}}"))
    cells = [one(k % 2, "1", "2"), F.concat(lit("'''"), (k % 60 + 1).cast("string"), lit("'''<ref>no 9</ref>")), F.concat(sort, lit("*")), place, lit("USA"), F.concat(lit("[["), c("n_name"), lit(" Team|The "), c("n_name"), lit("]] (from {{a||b}})")), linked]
    row = F.when(k % 2 == 0, F.concat(lit("|-\n| "), F.concat_ws(" || ", *cells))).otherwise(F.concat(lit("|-\n| align=center | "), F.concat_ws("\n| ", *cells)))
    lines = rows.select(F.floor(k / 40).alias("page"), F.struct(k.alias("k"), row.alias("row"), item.alias("item")).alias("line"))
    page = lines.groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("lines"))  # forty lines
    text = F.concat(
        lit("intro [[Not here]]\n== Draft selections ==\n{| class=\"wikitable\"\n"), F.array_join(F.transform("lines", lambda x: x["row"]), "\n"), lit("\n|}\n== Early entrants ==\n=== College ===\n"),
        F.array_join(F.transform("lines", lambda x: x["item"]), "\n"), lit("\n== Notes ==\n* [[Nobody]]\n"),
    )
    aliases = n.select(F.concat("n_name", lit(" U basketball")).alias("alias"), F.concat("n_name", lit(" U (basketball)")).alias("target"))
    return page.select("page", text.alias("text")), aliases


def _units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    articles, aliases = _articles(spark, sf_dir)
    units = stored(K.wiki_units(articles, ["page"], "text"))
    return units, K.programs(units, aliases)


@query(f"WITH {_ARTICLE_SQL} SELECT page, CASE WHEN k % 3 > 0 THEN c_name WHEN ncaa THEN '' ELSE school END AS title, CASE WHEN k % 3 > 0 OR ncaa THEN c_mktsegment || ' ' || k ELSE n_name || ' U' END AS name, position, CASE WHEN ncaa THEN n_name || ' U' END AS college, ncaa AS is_ncaa, class FROM c")
def parsed_entrants(spark, sf_dir):
    """Entrants read back from articles: players with and without an article of their own, colleges, clubs and redirects.

    Where a player without an article is followed by a club, the first link is taken for the player.
    """
    units, known = _units(spark, sf_dir)
    return K.early_entrants(units, ["page"], known).select("page", "title", "name", "position", "college", "is_ncaa", "class")


@query(f"WITH {_ARTICLE_SQL} SELECT page, (1 + k % 2)::INT AS round, (k % 60 + 1)::INT AS pick, c_mktsegment || ' ' || k || CASE WHEN k % 7 = 0 THEN ' (basketball)' ELSE '' END AS title, c_mktsegment || ' ' || k AS name, position, 'The ' || n_name AS team, CASE WHEN ncaa THEN n_name || ' U' END AS college, ncaa AS is_ncaa, class FROM c")
def parsed_picks(spark, sf_dir):
    """Picks read back from tables of both styles."""
    units, known = _units(spark, sf_dir)
    return K.draft_picks(units, ["page"], known).select("page", "round", "pick", "title", "name", "position", "team", "college", "is_ncaa", "class")
