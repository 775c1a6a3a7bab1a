"""Encyclopedia payloads, landed as JSON strings, to articles and related titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import kept_sections, sections
from trellis.operators.components import union
from trellis.operators.storage import written
from trellis.operators.topics import search_words

# Fixed values.
SKIP_HEADING_WORDS = ["history", "references", "further", "see", "notes"]
LIST_PAGES = ["List of", "Outline of", "Index of"]
PAGE = "query struct<pages: map<string, struct<title: string, fullurl: string, extract: string, missing: string>>>"
HITS = "query struct<search: array<struct<title: string>>>"


def is_list_page(title: Column) -> Column:
    first, *rest = (title.startswith(p) for p in LIST_PAGES)
    for r in rest:
        first = first | r
    return first


def skipped_heading(heading: Column) -> Column:
    """One of the words is anywhere in the heading."""
    return F.exists(F.array(*map(F.lit, SKIP_HEADING_WORDS)), lambda w: F.contains(F.lower(heading), w))


def articles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with title, url, sections and n_chars, the sum of the sections' lengths. Rows whose
    payload is no JSON, has no page or a page with a missing key give no row."""
    page = F.get(F.map_values(F.from_json(payload, PAGE)["query"]["pages"]), F.lit(0))
    rows = payloads.withColumn("page", page).filter("page is not null and page.missing is null")
    rows = rows.withColumn("sections", kept_sections(sections(F.coalesce("page.extract", F.lit("")))))
    total = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.length(s["content"]))
    return rows.withColumns({"title": F.col("page.title"), "url": F.col("page.fullurl"), "n_chars": total}).drop("page", payload)


def first_stage(topics: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(topic, stage, rank, title): for each of topics (topic) the first candidate of the first stage that has
    one. A stage is given the topics that are still open and returns (topic, rank, title); it is not
    asked when none is left."""
    still, out = topics.select("topic").distinct(), []
    for k, stage in enumerate(stages):
        best = stage(still).groupBy("topic").agg(F.min(F.struct("rank", "title")).alias("b"))
        out.append(written(best.select("topic", F.lit(k).alias("stage"), "b.rank", "b.title")))
        still = written(still.join(out[-1].select("topic"), "topic", "left_anti"))
        if still.isEmpty():
            break
    return union(out)


def resolved_roots(topics: DataFrame, pages: DataFrame, hits: DataFrame, most_hits: int = 5) -> DataFrame:
    """(topic, stage, title): the root article of each topic among the titles of pages: the topic itself,
    else one of its words (search_words, in order), else the first of its hits (topic, hit, title) that is
    no list page; topics without any are left out."""
    titles = pages.select("title").distinct()
    there = lambda rows: rows.join(titles, "title", "left_semi").select("topic", "rank", "title")
    exact = lambda t: there(t.select("topic", F.lit(0).alias("rank"), F.col("topic").alias("title")))
    words = lambda t: there(t.select("topic", F.posexplode(search_words(F.col("topic"))).alias("rank", "title")))
    good = hits.filter((F.col("hit") < most_hits) & ~is_list_page(F.col("title")))
    found = lambda t: there(good.join(t, "topic", "left_semi").select("topic", F.col("hit").cast("int").alias("rank"), "title"))
    return first_stage(topics, [exact, words, found]).select("topic", "stage", "title")


def article_documents(rows: DataFrame) -> DataFrame:
    """Articles (topic, title, url, sections) as materials (id, topic_id, source, url, title, content): a
    heading for the title and for each section."""
    parts = F.flatten(F.transform("sections", lambda s: F.array(F.concat(F.lit("## "), s["title"]), s["content"], F.lit(""))))
    content = F.regexp_replace(F.array_join(F.concat(F.array(F.concat(F.lit("# "), "title"), F.lit("")), parts), "\n"), r"^\s+|\s+$", "")
    slug = F.replace(F.replace(F.lower("title"), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    return rows.select(F.concat(F.lit("wiki_"), slug).alias("id"), F.col("topic").alias("topic_id"), F.lit("wikipedia").alias("source"), "url", "title", content.alias("content"))


def linked_articles(rows: DataFrame, root: Column, least: int = 300) -> DataFrame:
    """Articles of which roots stay whatever their length, and others with enough text."""
    return rows.filter(root | (F.col("n_chars") >= least))


def search_titles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads exploded to (hit, title); a payload that is no JSON gives no row."""
    hits = F.from_json(payload, HITS)["query"]["search"]["title"]
    return payloads.select(*[c for c in payloads.columns if c != payload], F.posexplode(hits).alias("hit", "title"))


def related_titles(headings: DataFrame, hits: DataFrame, limit: int, hits_each: int = 2) -> DataFrame:
    """(topic, title, place) of the first `limit` titles that the headings (topic, section, heading)
    of a topic lead to: hits (topic, heading, hit, title) up to hits_each each, in order, no list
    pages, each title once whatever its case, and not the topic itself."""
    asked = headings.filter(~skipped_heading(F.col("heading")))
    found = asked.join(hits.filter(F.col("hit") < hits_each), ["topic", "heading"])
    found = found.filter(~is_list_page(F.col("title")) & (F.lower("title") != F.lower("topic")))
    first = found.groupBy("topic", F.lower("title").alias("low")).agg(F.min(F.struct("section", "hit", "title")).alias("m"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy("m")).cast("long")
    return first.withColumn("place", place).filter(F.col("place") <= limit).select("topic", "m.title", "place")
