"""XML payloads: tables of contents of textbooks and Atom feeds. A payload that is no XML, or
null, gives no row."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
COLLECTION = "{http://cnx.rice.edu/collxml}"
METADATA = "{http://cnx.rice.edu/mdml}"
ATOM = "{http://www.w3.org/2005/Atom}"
SKIP_TAGS = ["image", "media", "figure", "subfigure", "caption", "note", "glossary"]
SURVEY_WORDS = ["survey", "review", "introduction", "tutorial"]


def _parsed(payload: str | None):
    try:
        return ElementTree.fromstring(payload) if payload else None
    except ElementTree.ParseError:
        return None


def _text(element) -> str | None:
    return None if element is None else (element.text or "").strip()


class _Contents:
    """Reads a table of contents in one pass: a stack of open elements, of which subcollections are
    books of their own with a title, their modules and the unit right above them."""

    def __init__(self):
        self.open, self.books = [], []

    def start(self, tag, attributes):
        book = None
        if tag == f"{COLLECTION}subcollection" and self.open:  # the root is no unit
            unit = self.open[-2][1] if len(self.open) > 1 and self.open[-1][0] == f"{COLLECTION}content" else None
            book = {"title": None, "modules": [], "unit": unit, "order": len(self.books)}
            self.books.append(book)
        if tag == f"{COLLECTION}module" and attributes.get("document"):
            for _, above, _ in self.open:
                if above is not None:
                    above["modules"].append(attributes["document"])
        self.open.append((tag, book, []))

    def data(self, text):
        # a title's text ends where its first child begins
        if self.open and self.open[-1][0] == f"{METADATA}title" and self.open[-1][2][:1] != [None]:
            self.open[-1][2].append(text)

    def end(self, tag):
        _, _, parts = self.open.pop()
        above = self.open[-1] if self.open else None
        if above and above[0] == f"{METADATA}title":
            above[2].insert(0, None)
        elif tag == f"{METADATA}title" and above and above[1] is not None and above[1]["title"] is None:
            above[1]["title"] = "".join(x for x in parts if x).strip()

    def close(self):
        found = [b for b in self.books if b["unit"] is not None and b["title"] and b["modules"]]
        found.sort(key=lambda b: (b["unit"]["order"], b["order"]))
        return [{"unit": b["unit"]["title"] or "", "chapter": b["title"], "modules": b["modules"]} for b in found]


def _chapters(payload: str | None) -> list[dict]:
    return _read(payload, _Contents()) or []


class _ModuleText:
    """Reads the plain text of a module: pieces between tags, stripped, one blank apart. An element that
    is skipped takes what is inside it and the text right behind it along."""

    def __init__(self):
        self.open, self.hidden, self.pieces, self.text = [], 0, [], []

    def _piece(self):
        piece = "".join(self.text).strip()
        self.text = []
        if piece:
            self.pieces.append(piece)

    def start(self, tag, attributes):
        self._piece()
        skip = tag.rpartition("}")[2] in SKIP_TAGS
        if skip and not self.hidden:
            self.hidden = len(self.open) + 1
        self.open.append([skip and self.hidden == len(self.open) + 1, False])

    def data(self, text):
        if not self.hidden and not (self.open and self.open[-1][1]):
            self.text.append(text)

    def end(self, tag):
        self._piece()
        skipped, _ = self.open.pop()
        if skipped:
            self.hidden = 0
        if self.open:
            self.open[-1][1] = skipped  # the text behind a skipped element is its tail

    def close(self):
        return " ".join(" ".join(self.pieces).split())


def _read(payload: str | None, target):
    """What a target makes of the events of a payload; None for null and what is no XML."""
    if not payload:
        return None
    parser = ElementTree.XMLParser(target=target)
    try:
        parser.feed(payload)
        return parser.close()
    except ElementTree.ParseError:
        return None


def module_text(payload: str) -> Column:
    """Plain text of module XML; empty for null and for what is no XML."""

    def parse(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: _read(x, _ModuleText()) or "")

    return F.pandas_udf(parse, "string")(payload)


def module_texts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads (module, ...) with text in place of the payload."""
    return payloads.withColumn("text", module_text(payload)).drop(payload)


def _entries(payload: str | None) -> list[dict]:
    root, out = _parsed(payload), []
    for entry in () if root is None else root.findall(f"{ATOM}entry"):
        found = {k: _text(entry.find(f"{ATOM}{k}")) for k in ("id", "title", "summary")}
        if None not in found.values():
            out.append(found)
    return out


def _toc(payload: str) -> Column:
    def parse(payloads: pd.Series) -> pd.Series:
        return payloads.map(_chapters)

    return F.pandas_udf(parse, "array<struct<unit: string, chapter: string, modules: array<string>>>")(payload)


def _feed(payload: str) -> Column:
    def parse(payloads: pd.Series) -> pd.Series:
        return payloads.map(_entries)

    return F.pandas_udf(parse, "array<struct<id: string, title: string, summary: string>>")(payload)


def slug_title(title: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def toc_chapters(collections: DataFrame, payload: str = "payload") -> DataFrame:
    """collections with (place, unit, chapter, modules): every subcollection is a unit to the
    subcollections right below it, its chapters, with all modules under them."""
    keys = [c for c in collections.columns if c != payload]
    return collections.select(*keys, F.posexplode(_toc(payload)).alias("place", "c")).select(*keys, "place", "c.*")


def textbook_rows(chapters: DataFrame, modules: DataFrame, least: int = 100) -> DataFrame:
    """(book, id, title, content) of the chapters (book, slug, place, unit, chapter, modules): the
    texts of their modules (module, text) in order, where there are `least` characters."""
    keys = ["book", "slug", "place", "unit", "chapter"]
    parts = chapters.select(*keys, F.posexplode("modules").alias("k", "module")).join(modules.filter("text <> ''"), "module")
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("t"))
    rows = whole.withColumn("text", F.array_join("t.text", "\n\n")).filter(F.length("text") >= least)
    return rows.select(
        "book", F.concat_ws("_", F.lit("openstax"), "slug", slug_title(F.col("chapter"))).alias("id"), F.concat_ws(" — ", "book", "chapter").alias("title"), "unit",
        F.concat(F.lit("# "), "book", F.lit(" — "), "unit", F.lit(": "), "chapter", F.lit("\n\n"), "text").alias("content"),
    )


def curated_books(topics: DataFrame, books: list[tuple[str, str]]) -> DataFrame:
    """(topic, slug, place): books (keyword, slug) whose keyword lies in the lower-case topic, each
    slug once, in the list's order. The list is a parameter of the program, so it is small."""
    low = F.lower("topic")
    found = [F.when(F.contains(low, F.lit(k)), F.lit(s)) for k, s in books]
    return topics.select("topic", F.posexplode(F.array_distinct(F.array_compact(F.array(*found)))).alias("place", "slug"))


def atom_rows(feeds: DataFrame, payload: str = "payload", least: int = 150) -> DataFrame:
    """feeds with (id, url, title, content) of their entries with an abstract of `least` characters;
    the id is the last part of the entry's, new lines are spaces."""
    keys = [c for c in feeds.columns if c != payload]
    rows = feeds.select(*keys, F.explode(_feed(payload)).alias("e"))
    line = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    rows = rows.withColumn("title", line(F.col("e.title"))).withColumn("abstract", line(F.col("e.summary"))).filter(F.length("abstract") >= least)
    last = F.element_at(F.split(F.regexp_replace("e.id", "/+$", ""), "/"), -1)
    return rows.select(*keys, F.concat(F.lit("arxiv_"), last).alias("id"), F.col("e.id").alias("url"), "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), "abstract").alias("content"))


def matches_topic(topic: Column, title: Column, abstract: Column) -> Column:
    return F.contains(F.lower(title), F.lower(topic)) | F.contains(F.lower(abstract), F.lower(topic))


def is_survey(title: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SURVEY_WORDS)), lambda w: F.contains(F.lower(title), w))


def prefer_surveys(papers: DataFrame) -> DataFrame:
    """Of papers (topic, title, abstract, ...) that match their topic the surveys, and all of them
    for topics without a survey."""
    good = papers.filter(matches_topic(F.col("topic"), F.col("title"), F.col("abstract")))
    surveys = good.filter(is_survey(F.col("title")))
    return surveys.unionByName(good.join(surveys.select("topic").distinct(), "topic", "left_anti").select(surveys.columns))
