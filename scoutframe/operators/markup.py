"""Markup to rows: blocks and links of web pages, and items, table rows and links of wiki texts.

A small scanner walks over a text once, with a stack of what is open (tags, links,
templates, tables), and gives rows; it runs on Arrow batches, text by text.  All that is
decided from those rows (which link is a school, who is a player, which class) is
joins and expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# web pages

#: Tags that are part of a run of text; all others end it.
INLINE = frozenset("a abbr b bdi cite code em font i mark q s small span strong sub sup u var".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![a-z][^>]*>|<(/?)([a-z][a-z0-9]*)((?:[\s/][^>]*)?)>", re.S | re.I)
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def page_rows(text: str) -> Iterator[tuple[str, str, str | None, str]]:
    """(kind, tag, href, text): each run of text with the block tag before it ("/p" for one that ends), and each link.

    Scripts, styles and comments are no text; entities are written out, white space is squeezed, empty runs are left out.
    """
    run: list[str] = []
    links: list[tuple[str, list[str]]] = []
    tag, at = "", 0

    def said(piece: str) -> None:
        run.append(piece)
        for _, own in links:
            own.append(piece)

    for m in _TAG.finditer(text):
        said(html.unescape(text[at : m.start()]))
        at = m.end()
        name = (m[3] or "").lower()
        if name == "a":
            if m[2]:
                if links:
                    href, own = links.pop()
                    yield "link", "a", href, _squeezed("".join(own))
            elif href := _HREF.search(m[4] or ""):
                links.append((html.unescape(next(g for g in href.groups() if g is not None)), []))
        elif name == "br":
            said(" ")
        elif name and name not in INLINE:
            if words := _squeezed("".join(run)):
                yield "text", tag, None, words
            run.clear()
            tag = m[2] + name
    said(html.unescape(text[at:]))
    if words := _squeezed("".join(run)):
        yield "text", tag, None, words
    for href, own in links:  # links that nothing ends
        yield "link", "a", href, _squeezed("".join(own))


def _rows_of(df: DataFrame, keys: list[str], text: str, scan: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """(keys, place, ...): the rows that ``scan`` gives for each text, numbered from 0; a null text has none."""
    named = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.select(*keys).schema)

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                value = batch.column("__text")[one].as_py()
                found = list(scan(value)) if value else []
                if found:
                    rows = [batch.column(k).take(pa.array([one] * len(found))) for k in keys]
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(range(len(found)), pa.int32()), *columns], [*keys, "place", *[c.split()[0] for c in schema.split(", ")]])

    names = [c.split()[0] for c in schema.split(", ")]
    assert len(names) == len(kinds)
    return named.mapInArrow(run, f"{own}, place int, {schema}")


def page_blocks(pages: DataFrame, keys: list[str], text: str = "html") -> DataFrame:
    """(keys, place, kind, tag, href, text) of whole pages: see ``page_rows``; places are those of all rows of a page."""
    return _rows_of(pages, keys, text, page_rows, "kind string, tag string, href string, text string", [pa.utf8()] * 4)


# wiki texts

_OPEN = {"{{": "}}", "[[": "]]"}
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||<!--.*?-->|<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>|<[^>]+>|'{2,3}", re.S)
_CUT = re.compile(r"\{\{|\}\}|\[\[|\]\]|\n\s*[|!]|\|\||!!")
_ATTRIBUTES = re.compile(r'(?:[\w-]+\s*=\s*"[^"]*"\s*)+\|(?!\|)|(?:align|bgcolor|scope|style|colspan|rowspan|width)\s*=\s*[^|]*\|')
_HEADING = re.compile(r"(=+)\s*(.*?)\s*=+\s*$")


def tree(text: str) -> list:
    """A text as pieces: strings, and (opener, fields) for links and templates at any depth; what nothing closes stays text."""
    root: list = []
    stack: list[tuple[str, list[list]]] = [("", [root])]

    def fold() -> None:
        """The innermost open mark becomes text of what holds it."""
        mark, fields = stack.pop()
        into = stack[-1][1][-1]
        into.append(mark)
        for k, field in enumerate(fields):
            into.extend(["|", *field] if k else field)

    at = 0
    for m in _MARK.finditer(text):
        stack[-1][1][-1].append(text[at : m.start()])
        at, mark = m.end(), m[0]
        if mark in _OPEN:
            stack.append((mark, [[]]))
        elif mark == "|" and len(stack) > 1:
            stack[-1][1].append([])
        elif mark in _OPEN.values() and any(_OPEN.get(s[0]) == mark for s in stack):
            while _OPEN[stack[-1][0]] != mark:
                fold()
            node = stack.pop()
            stack[-1][1][-1].append(node)
        elif mark[0] not in "<'":
            stack[-1][1][-1].append(mark)
    stack[-1][1][-1].append(text[at:])
    while len(stack) > 1:
        fold()
    return root


def plain(pieces: list) -> str:
    """Text as a reader sees it: links by their labels, templates, references, tags and quotes gone."""
    out = []
    for p in pieces:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "[[":
            out.append("|".join(plain(f) for f in p[1][1:]) if len(p[1]) > 1 else plain(p[1][0]))
    return _squeezed("".join(out)) if not out or len(out) > 1 else _squeezed(out[0])


def nodes(pieces: list, mark: str) -> Iterator[list[list]]:
    """Fields of all links or templates, from the outside in."""
    for p in pieces:
        if not isinstance(p, str):
            if p[0] == mark:
                yield p[1]
            for field in p[1]:
                yield from nodes(field, mark)


def player(pieces: list) -> tuple[str | None, str | None]:
    """(title, name) of the player that a cell names: by a sorting template, the first link, or its text without marks at the end."""
    for fields in nodes(pieces, "{{"):
        words = [plain(f) for f in fields]
        if words[0] == "sortname" and len(words) > 2:
            name = f"{words[1]} {words[2]}"
            more = words[3:]
            if apart := next((w[4:].strip() for w in more if w.startswith("dab=")), ""):
                return f"{name} ({apart})", name
            if more and more[0] and "=" not in more[0] and "nolink" not in more[0]:
                return more[0], name
            return name, name
    for fields in nodes(pieces, "[["):
        title = plain(fields[0])
        return title, plain(fields[1]) if len(fields) > 1 else title
    text = re.sub(r"[*#~^+]+$", "", plain(pieces)).strip()
    return (text, text) if text else (None, None)


def cell(text: str) -> dict:
    """What one cell or item says: as written, as read, its player, its links, and what is read before a dash outside of links."""
    pieces = tree(text)
    title, name = player(pieces)
    lead: list = []
    for p in pieces:
        parts = re.split(r"[–—]|\s-\s", p, maxsplit=1) if isinstance(p, str) else [p]
        lead.append(parts[0])
        if len(parts) > 1:
            break
    links = [{"target": plain(f[0]), "label": plain([x for part in f[1:] for x in part]) if len(f) > 1 else plain(f[0])} for f in nodes(pieces, "[[")]
    return {"raw": text, "text": plain(pieces), "title": title, "name": name, "lead": plain(lead), "links": links}


def cells(row: str) -> list[str]:
    """Cells of a table row, parted outside of links and templates by line or by double bars, without attributes before a bar."""
    out, depth, at = [], 0, 0
    text = "\n" + row.strip()
    for m in _CUT.finditer(text):
        if m[0] in _OPEN:
            depth += 1
        elif m[0] in _OPEN.values():
            depth = max(0, depth - 1)
        elif not depth and (m[0] != "!!" or text.lstrip().startswith("!")):
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    bare = ((_ATTRIBUTES.sub("", c.strip(), count=1) if _ATTRIBUTES.match(c.strip()) else c).strip() for c in out)
    return [c for c in bare if c]


def wiki_rows(text: str) -> Iterator[tuple[list[str], str, list[dict]]]:
    """(sections, kind, cells): items of lists (one cell) and rows of tables, below the headings that hold them, outermost first."""
    headings: list[tuple[int, str]] = []
    depth, row = 0, []

    def ended():
        found = cells("\n".join(row))
        row.clear()
        if found:
            yield [h for _, h in headings], "row", [cell(c) for c in found]

    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            depth += 1
            if depth > 1:
                row.append(line)
        elif depth and bare.startswith("|}"):
            depth -= 1
            if depth:
                row.append(line)
            else:
                yield from ended()
        elif depth == 1 and bare.startswith("|-"):
            yield from ended()
        elif depth:
            row.append(line)
        elif m := _HEADING.match(bare):
            headings = [(n, h) for n, h in headings if n < len(m[1])] + [(len(m[1]), m[2])]
        elif bare.startswith("*"):
            yield [h for _, h in headings], "item", [cell(bare.lstrip("*").strip())]
    yield from ended()  # a table that nothing ends


_LINK = pa.struct([("target", pa.utf8()), ("label", pa.utf8())])
_CELL = pa.struct([("raw", pa.utf8()), ("text", pa.utf8()), ("title", pa.utf8()), ("name", pa.utf8()), ("lead", pa.utf8()), ("links", pa.list_(_LINK))])


def wiki_units(articles: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, place, sections, kind, cells) of whole articles: see ``wiki_rows``."""
    link = "array<struct<target:string,label:string>>"
    schema = f"sections array<string>, kind string, cells array<struct<raw:string,text:string,title:string,name:string,lead:string,links:{link}>>"
    return _rows_of(articles, keys, text, wiki_rows, schema, [pa.list_(pa.utf8()), pa.utf8(), pa.list_(_CELL)])


def canonical(titles: DataFrame, aliases: DataFrame, title: str = "title") -> DataFrame:
    """(title, canonical): titles through up to three redirects; ``aliases``: alias, target (of several the first)."""
    once = aliases.groupBy("alias").agg(F.min("target").alias("target"))
    out = titles.select(F.col(title).alias("title")).distinct().withColumn("canonical", F.col("title"))
    for k in range(3):
        step = once.select(F.col("alias").alias("canonical"), F.col("target").alias(f"__to{k}"))
        out = out.join(step, "canonical", "left").withColumn("canonical", F.coalesce(f"__to{k}", "canonical")).drop(f"__to{k}")
    return out.select("title", "canonical")


def is_program(canonical_title: Column) -> Column:
    """A college programme: its title ends with "basketball" and has no parenthesis, as clubs, leagues and players have."""
    return F.coalesce(canonical_title.endswith("basketball") & ~canonical_title.contains("("), F.lit(False))


def school_candidates(units: DataFrame) -> DataFrame:
    """(title): every link target that could name a team."""
    linked = units.select(F.explode(F.flatten(F.transform("cells", lambda c: c["links"]))).alias("link"))
    return linked.where(F.lower("link.target").contains("basketball")).select(F.col("link.target").alias("title")).distinct()


def programs(units: DataFrame, aliases: DataFrame) -> DataFrame:
    """(title): link targets that lead to a college programme."""
    return canonical(school_candidates(units), aliases).where(is_program(F.col("canonical"))).select("title")


#: Short names of classes.
CLASSES = {"fr": "freshman", "so": "sophomore", "jr": "junior", "sr": "senior", "gr": "graduate"}


def class_of(raw: Column) -> Column:
    """The class in parentheses: a link, a word, or a short name; NULL without one."""
    linked = F.regexp_extract(raw, r"\(\[\[([A-Za-z0-9 ]+)\|", 1)
    word = F.regexp_extract(raw, r"(?i)\((freshman|sophomore|junior|senior|graduate|5th year|redshirt[a-z ]*)\)", 1)
    short = F.lower(F.regexp_extract(raw, r"\((Fr|So|Jr|Sr|Gr)\.\)", 1))
    table = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    return F.when(linked != "", F.lower(F.trim(linked))).when(word != "", F.lower(word)).otherwise(F.try_element_at(table, short))


def _with_school(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Adds college, is_ncaa and whether the first link is a school to (keys, place, links)."""
    linked = rows.select(*keys, "place", F.posexplode("links").alias("__at", "__link"))
    hit = linked.join(known.select(F.col("title").alias("__target")).distinct(), F.col("__link.target") == F.col("__target"), "left_semi")
    found = hit.groupBy(*keys, "place").agg(F.min_by("__link.label", "__at").alias("college"), F.min("__at").alias("__first"))
    out = rows.join(found, [*keys, "place"], "left")
    return out.withColumns({"is_ncaa": F.col("__first").isNotNull(), "school_first": F.coalesce(F.col("__first") == 0, F.lit(False))}).drop("__first")


def draft_picks(units: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, place, round, pick, title, name, position, team, college, is_ncaa, class) of the rows below "Draft selections".

    ``known``: (title) of college programmes.  A row without a number of the round, of the pick, or a player is none.
    """
    c = F.col("cells")
    rows = units.where((F.col("kind") == "row") & F.array_contains("sections", "Draft selections") & (F.size("cells") >= 5))
    team = F.get(c, F.lit(5))
    linked = F.get(team["links"], F.lit(0))["label"]
    later = F.slice(c, 7, F.greatest(F.size("cells") - 6, F.lit(0)))
    raw = F.array_join(F.transform(later, lambda x: x["raw"]), " ")
    rows = rows.where(c[0]["raw"].rlike(r"^\d+$")).select(
        *keys, "place", c[0]["raw"].try_cast("int").alias("round"), F.regexp_extract(c[1]["text"], r"\d+", 0).try_cast("int").alias("pick"), c[2]["title"].alias("title"), c[2]["name"].alias("name"),
        c[3]["text"].alias("position"), F.coalesce(linked, team["text"], F.lit("")).alias("team"), F.flatten(F.transform(later, lambda x: x["links"])).alias("links"), class_of(raw).alias("class"),
    )
    sound = rows.where("pick IS NOT NULL AND title IS NOT NULL")
    return _with_school(sound, keys, known).select(*keys, "place", "round", "pick", "title", "name", "position", "team", "college", "is_ncaa", "class")


def early_entrants(units: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, place, title, name, position, college, is_ncaa, class) of the items below "Early entrants", or of an article without items its table rows.

    A first link that is a school names no player: then the text before the dash does, and the title is empty.
    """
    own = units.where(F.array_contains("sections", "Early entrants"))
    listed = own.where("kind = 'item'").select(*keys).distinct().withColumn("__listed", F.lit(True))
    own = own.join(listed, keys, "left").where((F.col("kind") == "item") | (F.col("__listed").isNull() & (F.col("kind") == "row")))
    c = F.col("cells")
    raw = F.array_join(F.transform(c, lambda x: x["raw"]), " ")
    rows = own.select(
        *keys, "place", "kind", c[0]["title"].alias("title"), c[0]["name"].alias("name"), c[0]["lead"].alias("lead"), F.size(c[0]["links"]).alias("own_links"), c[0]["raw"].alias("first"),
        F.nullif(F.regexp_extract(raw, r"[–—-]\s*([A-Z]{1,2}(?:/[A-Z]{1,2})?)\s*,", 1), F.lit("")).alias("position"), class_of(raw).alias("class"), F.flatten(F.transform(c, lambda x: x["links"])).alias("links"),
    )
    rows = _with_school(rows, keys, known)
    item, named = F.col("kind") == "item", (F.col("own_links") > 0) & ~F.col("school_first")
    title = F.when(item & ~named, "").otherwise(F.col("title"))
    name = F.when(item & ~named, F.col("lead")).otherwise(F.col("name"))
    marked = F.col("first").contains("[[") | F.col("first").contains("{{sortname")
    kept = rows.withColumns({"title": title, "name": name}).where((item & (F.col("name") != "")) | (~item & marked & F.col("title").isNotNull() & (F.length("title") <= 60)))
    return kept.select(*keys, "place", "title", "name", "position", "college", "is_ncaa", "class")
