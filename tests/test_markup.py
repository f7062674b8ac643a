"""Markup to rows: wiki cases, and web pages against the standard parser."""

import html.parser

from scoutframe.operators import markup as K

DUKE, HAWAII = "Duke Blue Devils men's basketball", "Hawaii Rainbow Warriors basketball"


def units(spark, *texts):
    return K.wiki_units(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ["id"], "text")


def known(spark, *titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def entrants(spark, *texts):
    rows = K.early_entrants(units(spark, *texts), ["id"], known(spark, DUKE, HAWAII)).orderBy("id", "place").collect()
    return [(r.id, r.title, r.name, r.position, r.college, r.is_ncaa, r["class"]) for r in rows]


def test_programs(spark):
    titles = {
        "Duke Blue Devils men's basketball": True, "Georgia Bulldogs basketball": True, "UNLV Runnin' Rebels basketball": True, "Beşiktaş J.K. (men's basketball)": False,
        "Liga Națională (men's basketball)": False, "Anthony Edwards (basketball)": False, "UT Permian Basin Falcons": False, "Real Madrid Baloncesto": False,
    }
    text = "== Early entrants ==\n" + "\n".join(f"* [[{t}|x]]" for t in titles) + "\n* [[Old Duke basketball]] [[Loop basketball]]"
    aliases = spark.createDataFrame([("Old Duke basketball", "Duke"), ("Duke", "Duke Blue Devils men's basketball"), ("Loop basketball", "Loop basketball")], "alias string, target string")
    got = {r.title for r in K.programs(units(spark, text), aliases).collect()}
    assert got == {t for t, ok in titles.items() if ok} | {"Old Duke basketball", "Loop basketball"}
    assert "Real Madrid Baloncesto" not in {r.title for r in K.school_candidates(units(spark, text)).collect()}


def test_entrants(spark):
    texts = [
        f"===Early entrants===\n* {{{{flagicon|USA}}}} [[Cameron Boozer]] – F, [[{DUKE}|Duke]] (freshman)\n",
        f"===Early entrants===\n*{{{{flagicon|USA}}}} Casdon Jardine – G/F, [[{HAWAII}|Hawai{{{{okina}}}}i]]\n",
        f'===Early entrants===\n{{|class="wikitable"\n|-\n| {{{{sortname|Jabari|Parker}}}} || [[{DUKE}|Duke]] || [[Freshman]]\n|-\n| Nobody linked || x\n|}}\n',
        "===Early entrants===\n* {{flagicon|TUR}} [[Alperen Şengün]] – C, [[Beşiktaş J.K. (men's basketball)|Beşiktaş]] ([[Turkey]])\n",
        f"== Early entrants ==\n=== College ===\n* [[A B|Abe]] - G , [[{DUKE}]] (Jr.)\n* \n== After ==\n* [[Too late]]\n",
        "no section\n* [[X]]",
    ]
    assert entrants(spark, *texts) == [
        (0, "Cameron Boozer", "Cameron Boozer", "F", "Duke", True, "freshman"),
        (1, "", "Casdon Jardine", "G/F", "Hawaii", True, None),
        (2, "Jabari Parker", "Jabari Parker", None, "Duke", True, None),
        (3, "Alperen Şengün", "Alperen Şengün", "C", None, False, None),
        (4, "A B", "Abe", "G", DUKE, True, "junior"),
    ]


def test_picks(spark):
    text = f"""== Draft selections ==
{{| class="wikitable sortable"
! Round !! Pick !! Player !! Pos. !! Nationality !! Team !! School
|-
| style="text-align:center" | 1 || align=center | 2 || {{{{sortname|Ann|Lee|dab=basketball}}}}^ || [[Guard|G]] || USA || [[Boston Celtics|Boston]] (from {{{{a||b}}}}) || [[{DUKE}|Duke]] ([[Junior (education)|Jr.]])
|-
| 2
| '''33'''<ref name="x">no 44</ref>
| [[Bo Cy]]
| F
| SRB
| Utah
| [[Beşiktaş J.K. (men's basketball)|Beşiktaş]] (Sr.)
|-
| 1 || none || Dee || C || X || Y
|}}
"""
    rows = K.draft_picks(units(spark, text), ["id"], known(spark, DUKE)).orderBy("pick").collect()
    assert [tuple(r)[2:] for r in rows] == [
        (1, 2, "Ann Lee (basketball)", "Ann Lee", "G", "Boston", "Duke", True, None),
        (2, 33, "Bo Cy", "Bo Cy", "F", "Utah", None, False, "senior"),
    ]


def test_scanner():
    assert K.plain(K.tree("a {{x|{{y|z}}|w}} [[b|c]] [[d]] ''e'' <ref>f</ref><br/>g<ref name=h />")) == "a c d e g"
    assert K.plain(K.tree("[[open {{never | closed")) == "[[open {{never | closed" and K.plain(K.tree("}} ]] | x")) == "}} ]] | x"
    assert K.cells("| a || {{t|b||c}} || [[d|e]]\n! scope=row| f\n| style=\"x\" | g") == ["a", "{{t|b||c}}", "[[d|e]]", "f", "g"]
    assert K.player(K.tree("{{sortname|A|B|C D}}")) == ("C D", "A B") and K.player(K.tree("{{sortname|A|B|nolink=1}}")) == ("A B", "A B") and K.player(K.tree("")) == (None, None)
    nested = "== T ==\n{|\n| a\n{|\n| inner\n|}\n|-\n| b\n|}\n* i\n=== U ===\n* j\n== V ==\n* k\n{|\n| c"
    assert [(s, k, [c["text"] for c in cs]) for s, k, cs in K.wiki_rows(nested)] == [
        (["T"], "row", ["a {|", "inner", "}"]), (["T"], "row", ["b"]), (["T"], "item", ["i"]), (["T", "U"], "item", ["j"]), (["V"], "item", ["k"]), (["V"], "row", ["c"]),
    ]


class Standard(html.parser.HTMLParser):
    """The same rows from the events of the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.run, self.links, self.tag, self.mute = [], [], [], "", None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute = tag
        elif tag == "a":
            if "href" in dict(attrs):
                self.links.append((dict(attrs)["href"], []))
        elif tag == "br":
            self.handle_data(" ")
        elif tag not in K.INLINE:
            self.flush(tag)

    def handle_endtag(self, tag):
        if tag == self.mute:
            self.mute = None
        elif tag == "a":
            if self.links:
                href, own = self.links.pop()
                self.rows.append(("link", "a", href, " ".join("".join(own).split())))
        elif tag not in K.INLINE and tag != "br":
            self.flush("/" + tag)

    def handle_data(self, data):
        if not self.mute:
            self.run.append(data)
            for _, own in self.links:
                own.append(data)

    def flush(self, tag):
        if words := " ".join("".join(self.run).split()):
            self.rows.append(("text", self.tag, None, words))
        self.run, self.tag = [], tag


def test_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    # a page that is cut off in the middle of a tag ends before it
    whole = [(r.page_id, r.html[: r.html.rfind(">") + 1]) for r in pages.collect()]
    whole += [(-1, None), (-2, ""), (-3, "<p>a &lt; b<a href='x?y&amp;z'>l <b>m</b></a> n<br>o</p>&copy; <A HREF=q>r</A><!-- <p>no</p> --><td>s")]
    got = {}
    for r in K.page_blocks(spark.createDataFrame(whole, "page_id long, html string"), ["page_id"]).orderBy("place").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.tag, r.href, r.text))
    for page, text in whole:
        parser = Standard()
        parser.feed(text or "")
        parser.close()
        parser.flush("")
        assert got.get(page, []) == parser.rows, page
    assert got[-3] == [("link", "a", "x?y&z", "l m"), ("text", "p", None, "a < bl m n o"), ("link", "a", "q", "r"), ("text", "/p", None, "© r"), ("text", "td", None, "s")]
