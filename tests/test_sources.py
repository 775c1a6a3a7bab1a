"""Source normalisers on payloads of every kind, broken ones too."""

import json

import pytest
from pyspark.sql import functions as F

from trellis.sources import books as B
from trellis.sources import catalogues as C
from trellis.sources import encyclopedia as E
from trellis.sources import xml as M


def test_articles(spark):
    long = "Soil holds water and air. " * 8
    page = {"title": "Soil", "fullurl": "u", "extract": f"{long}\n== Erosion ==\n{long}\n== Gallery ==\n{long}"}
    rows = [(1, json.dumps({"query": {"pages": {"7": page}}})), (2, json.dumps({"query": {"pages": {"-1": {"title": "x", "missing": ""}}}})), (3, "no json"), (4, None), (5, "{}")]
    got = E.articles(spark.createDataFrame(rows, "k long, payload string")).collect()
    assert [(r.k, r.title, [s.title for s in r.sections]) for r in got] == [(1, "Soil", ["Introduction", "Erosion"])]
    assert got[0].n_chars == sum(len(s.content) for s in got[0].sections)
    hits = spark.createDataFrame([("a", json.dumps({"query": {"search": [{"title": "T"}, {"title": "U"}]}})), ("b", "broken")], "q string, payload string")
    assert [(r.q, r.hit, r.title) for r in E.search_titles(hits).collect()] == [("a", 0, "T"), ("a", 1, "U")]


def test_related_titles(spark):
    headings = spark.createDataFrame([("Soil", 0, "Clay"), ("Soil", 1, "See more"), ("Soil", 2, "Sand"), ("Soil", 3, "Silt")], "topic string, section int, heading string")
    hits = [("Clay", ["List of clays", "Kaolin", "Third"]), ("See more", ["No"]), ("Sand", ["SOIL", "kaolin"]), ("Silt", ["Loess", "Mud"])]
    hits = spark.createDataFrame([("Soil", h, i, t) for h, ts in hits for i, t in enumerate(ts)], "topic string, heading string, hit int, title string")
    assert [(r.title, r.place) for r in E.related_titles(headings, hits, 2).orderBy("place").collect()] == [("Kaolin", 1), ("Loess", 2)]


def test_books(spark):
    hits = [(0, "Scouting/Knots", "ropes"), (1, "Seas/Tides", "the <b>ocean</b> moves"), (2, "Seas", ""), (3, "", "ocean"), (4, "Ocean life", None)]
    rows = spark.createDataFrame([("The ocean of", *h) for h in hits], "topic string, hit int, title string, snippet string")
    assert [(r.root, r.place) for r in B.book_roots(rows, 2).orderBy("place").collect()] == [("Seas", 1), ("Ocean life", 2)]
    text = "w" * 400
    pages = spark.createDataFrame([("Seas/Tides", text), ("Seas/Index", text), ("Seas/a/b", text), ("Seas/Short", "w"), ("Ocean life", f" {text} "), ("Seas", text)], "title string, text string")
    roots = spark.createDataFrame([("Seas",), ("Ocean life",)], "root string")
    assert sorted((r.root, r.title, len(r.text)) for r in B.book_rows(pages, roots, 20).collect()) == [("Ocean life", "Ocean life", 400), ("Seas", "Seas/Tides", 400)]


def test_xml(spark):
    unit = "<c:subcollection><m:title> U </m:title><c:content><c:subcollection><m:title>One &amp; two</m:title><c:content><c:module document='m1'/><c:module/></c:content></c:subcollection><c:subcollection><m:title/></c:subcollection></c:content></c:subcollection>"
    toc = f'<c:collection xmlns:c="http://cnx.rice.edu/collxml" xmlns:m="http://cnx.rice.edu/mdml"><c:content>{unit}</c:content></c:collection>'
    rows = spark.createDataFrame([("b", "s", toc), ("x", "s", "<open"), ("y", "s", None)], "book string, slug string, payload string")
    chapters = M.toc_chapters(rows)
    assert [(r.book, r.unit, r.chapter, r.modules) for r in chapters.collect()] == [("b", "U", "One & two", ["m1"])]
    modules = spark.createDataFrame([("m1", "t" * 120)], "module string, text string")
    assert [(r.id, r.content[:21]) for r in M.textbook_rows(chapters, modules).collect()] == [("openstax_s_one-two", "# b — U: One & two\n\nt")]
    entry = "<entry><id>http://x/abs/1.2v1/</id><title>\nA\nb</title><summary>{}</summary></entry>"
    feed = f'<feed xmlns="http://www.w3.org/2005/Atom">{entry.format("s" * 150)}{entry.format("short")}<entry><id>q</id></entry></feed>'
    got = M.atom_rows(spark.createDataFrame([(1, feed), (2, "")], "k int, payload string")).collect()
    assert [(r.k, r.id, r.title) for r in got] == [(1, "arxiv_1.2v1", "A b")]
    books = M.curated_books(spark.createDataFrame([("Marine microbiology",), ("Art",)], "topic string"), [("biology", "bio"), ("marine", "bio"), ("microbiology", "micro")])
    assert [(r.slug, r.place) for r in books.collect()] == [("bio", 0), ("micro", 1)]
    papers = spark.createDataFrame([("a", "A Survey of a", ""), ("a", "on a", ""), ("b", "about B", ""), ("b", "other", "")], "topic string, title string, abstract string")
    assert sorted(r.title for r in M.prefer_surveys(papers).collect()) == ["A Survey of a", "about B"]


def test_catalogues(spark):
    def book(**more):
        keys = {"dc.title": "T", "dc.description.abstract": "a" * 200, "dc.rights": "by/4.0"} | {k.replace("_", "."): v for k, v in more.items()}
        return json.dumps({"uuid": more.get("uuid"), "handle": "20.1/x", "metadata": [{"key": k, "value": v} for k, v in keys.items()]})

    rows = [(0, book(uuid="1")), (1, book(uuid="1", dc_title="later")), (2, book(uuid="2", dc_language="de")), (3, book(dc_publisher="P")), (4, "broken"), (5, None)]
    rows = spark.createDataFrame([("t", *r) for r in rows], "topic string, n int, payload string")
    got = {r.id: r for r in C.open_book_rows(rows, "n").collect()}
    assert got.keys() == {"doab_1", "doab_T"} and got["doab_1"].title == "T" and got["doab_1"].url == "https://library.oapen.org/handle/20.1/x"
    assert got["doab_T"].content == f"# T\n\n**Publisher:** P\n**License:** CC BY 4.0\n\n## Abstract\n{'a' * 200}"
    text = {"id": 3, "title": " T ", "description": "d" * 150, "license": "Attribution", "formats": [{"type": "PDF", "url": "p"}, {"type": "Online", "url": "o"}], "subjects": [{"name": "A"}, {"name": ""}, {"name": "B"}]}
    rows = spark.createDataFrame([("t", 0, json.dumps(text | {"id": 0})), ("t", 1, json.dumps(text)), ("t", 2, json.dumps(text | {"id": 9})), ("t", 3, "[")], "topic string, n int, payload string")
    got = C.textbook_rows(rows, "n", 1).collect()
    assert [(r.id, r.url, r.content) for r in got] == [("otl_3", "o", f"# T\n\n**License:** CC BY\n**Subjects:** A, B\n\n## Overview\n{'d' * 150}")]
    assert spark.range(1).select(C.meta(F.lit(None).cast("array<struct<key:string,value:string>>"), "k")).first()[0] == ""


@pytest.mark.parametrize("title, nav", [("a/Index", True), ("Index", True), ("a/Indexes", False)])
def test_navigation(spark, title, nav):
    assert spark.range(1).select(B.is_navigation(F.lit(title))).first()[0] is nav


def test_module_texts_and_contents(spark):
    ns = 'xmlns="http://cnx.rice.edu/cnxml"'
    cases = {
        f"<document {ns}>one <b>two</b> three <note>x <b>y</b> z</note> lost <c/> four<!-- c --> five<figure/>gone<d>  six\n seven </d></document>": "one two three four five six seven",
        "<a><b>unclosed</a>": "", "": "", None: "", "no xml": "", "<note>all gone</note>": "", "<a>" * 300 + "deep" + "</a>" * 300: "deep",
        f"<m:document xmlns:m='u'><m:media>x<m:image>y</m:image></m:media>tail<m:p>&amp; kept</m:p></m:document>": "& kept",
    }
    rows = spark.createDataFrame([(i, p, "x") for i, p in enumerate(cases)], "module long, payload string, title string")
    assert {r.module: r.text for r in M.module_texts(rows).collect()} == dict(enumerate(cases.values()))
    assert M.module_texts(rows).columns == ["module", "title", "text"]
    col, md = "http://cnx.rice.edu/collxml", "http://cnx.rice.edu/mdml"
    sub = lambda title, inner: f"<c:subcollection><m:title> {title}<i/>x</m:title><m:title>second</m:title><c:content>{inner}</c:content></c:subcollection>"
    module = lambda k: f'<c:module document="{k}"/>'
    deep = sub("U", module("m0") + sub("C1", module("m1") + sub("S", module("m2"))) + sub("", module("m3")) + sub("C2", "<c:module/>") + sub("C3", module("m4")))
    toc = f'<c:collection xmlns:c="{col}" xmlns:m="{md}"><c:content>{deep}</c:content></c:collection>'
    got = M.toc_chapters(spark.createDataFrame([("b", toc), ("n", None), ("x", "<c")], "book string, payload string")).collect()
    assert [(r.book, r.place, r.unit, r.chapter, r.modules) for r in sorted(got, key=lambda r: r.place)] == [("b", 0, "U", "C1", ["m1", "m2"]), ("b", 1, "U", "C3", ["m4"]), ("b", 2, "C1", "S", ["m2"])]


def test_resolved_roots(spark):
    topics = spark.createDataFrame([("soil",), ("deep blue oceans",), ("tiny to an ant",), ("nothing here",), ("soil",)], "topic string")
    pages = spark.createDataFrame([("soil",), ("Oceans",), ("Blue",), ("List of ants",), ("Ant hill",), ("Far hit",)], "title string")
    hits = [("tiny to an ant", 0, "List of ants"), ("tiny to an ant", 1, "unknown"), ("tiny to an ant", 2, "Ant hill"), ("nothing here", 5, "Far hit"), ("soil", 0, "Blue"), (None, 0, "Blue")]
    got = E.resolved_roots(topics, pages, spark.createDataFrame(hits, "topic string, hit int, title string"))
    assert sorted(map(tuple, got.collect())) == [("deep blue oceans", 1, "Oceans"), ("soil", 0, "soil"), ("tiny to an ant", 2, "Ant hill")]
    asked = []

    def stage(found):
        def run(still):
            asked.append(sorted(r.topic for r in still.collect()))
            return still.filter(F.col("topic").isin(found)).select("topic", F.lit(0).alias("rank"), F.lit("t").alias("title"))

        return run

    three = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    E.first_stage(three, [stage(["a"]), stage(["b", "c"]), stage([])]).collect()
    assert asked == [["a", "b", "c"], ["b", "c"]]  # nobody is left for the third


def test_response_items(spark):
    rows = [("list", '[{"a": 1}, 2, "x", null, {"b": [1, 2]}]'), ("wrapped", ' {"links": {}, "data": [{"a": 1}]}'), ("odd", '{"data": 5}'), ("broken", "["), ("null", None)]
    df = spark.createDataFrame(rows, "topic string, payload string")
    got = sorted((r.topic, r.place, json.loads(r.payload)) for r in C.response_items(df).collect())
    assert got == [("list", 0, {"a": 1}), ("list", 4, {"b": [1, 2]})]
    assert sorted((r.topic, r.place) for r in C.response_items(df, "data").collect()) == [("list", 0), ("list", 4), ("wrapped", 0)]


def test_ingest(spark):
    from trellis.sources import ingest as I

    rows = lambda *ids: spark.createDataFrame([(i, "t", s, "u", i, s) for i, s in ids], I.MATERIAL)
    old = rows(("a", "old"), ("b", "old"))
    sources = {"one": lambda t: rows(("b", "one"), ("c", "one"), (None, "one")), "two": lambda t: rows(("c", "two")), "fails": lambda t: 1 / 0, "late": lambda t: rows(("z", "z")).withColumn("id", F.raise_error(F.lit("no")))}
    got, failures = I.ingest(spark.range(1), sources, old)
    assert {(r.id, r.source) for r in got.collect()} == {("a", "old"), ("b", "one"), ("c", "two")} and failures.keys() == {"fails", "late"}
    assert {(r.source, r.rows) for r in I.material_totals(got).collect()} == {("old", 1), ("one", 1), ("two", 1)}


def test_hits_are_limited_before_the_shuffle(spark):
    """No task reads a whole language: each sends the hits that are wanted."""
    from trellis.jobs import registry

    plan = registry.queries()["book_roots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit"):]
