"""Open books in a wiki: roots from search hits, chapters by title, rows with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import tokens

# Fixed values.
STOP_WORDS = ["the", "a", "an", "of", "in", "and", "or", "for", "to", "with", "by"]
HITS_EACH = 6
NAVIGATION = ["Printable version", "Print version", "Cover", "Index", "Glossary", "Bibliography", "Appendix", "About", "Authors", "Contributors"]


def topic_keywords(topic: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words."""
    low = F.transform(tokens(topic), F.lower)
    return F.array_distinct(F.filter(low, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2)))


def relevance_score(text: Column, keywords: Column) -> Column:
    """How many of the keywords are anywhere in the text."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), k)))


def is_navigation(title: Column) -> Column:
    return F.element_at(F.split(title, "/"), -1).isin(NAVIGATION)


def book_roots(hits: DataFrame, max_books: int, hits_each: int = HITS_EACH) -> DataFrame:
    """(topic, root, place): hits (topic, hit, title, snippet) up to hits_each for each book wanted;
    a root is what comes before the first slash; its first hit decides whether a keyword of the
    topic is in it; the first max_books such roots."""
    rows = hits.filter((F.col("hit") < max_books * hits_each) & (F.coalesce("title", F.lit("")) != ""))
    rows = rows.withColumn("root", F.trim(F.split_part("title", F.lit("/"), F.lit(1)))).filter("root <> ''")
    first = rows.groupBy("topic", "root").agg(F.min(F.struct("hit", "snippet")).alias("m"))
    plain = F.regexp_replace(F.coalesce("m.snippet", F.lit("")), "<[^>]+>", "")
    good = first.filter(relevance_score(F.concat_ws(" ", "root", plain), topic_keywords(F.col("topic"))) > 0)
    place = F.row_number().over(Window.partitionBy("topic").orderBy("m.hit")).cast("long")
    return good.withColumn("place", place).filter(F.col("place") <= max_books).select("topic", "root", "place")


def chapter_titles(pages: DataFrame, roots: DataFrame, max_chapters: int, scanned: int = 50) -> DataFrame:
    """(root, title, place): of the first `scanned` titles below a root those that are no navigation
    page and not deeper than one slash, max_chapters of them."""
    below = pages.filter(F.contains("title", F.lit("/"))).withColumn("root", F.split_part("title", F.lit("/"), F.lit(1)))
    by = Window.partitionBy("root").orderBy("title")
    rows = below.join(roots.select("root").distinct(), "root", "left_semi").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= scanned)
    rows = rows.filter(~is_navigation(F.col("title")) & (F.size(F.split("title", "/")) <= 2))
    return rows.withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= max_chapters).select("root", "title", "place")


def book_rows(pages: DataFrame, roots: DataFrame, max_chapters: int, least: int = 400) -> DataFrame:
    """(root, title, text) of the chapters of each book, of the root's own page if it has none;
    only pages (title, text) with `least` characters."""
    chapters = chapter_titles(pages.select("title"), roots, max_chapters).select("root", "title")
    alone = roots.select("root").distinct().join(chapters, "root", "left_anti").select("root", F.col("root").alias("title"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return chapters.unionByName(alone).join(pages.select("title", text.alias("text")), "title").filter(F.length("text") >= least).select("root", "title", "text")


def book_documents(rows: DataFrame) -> DataFrame:
    """Book pages (topic, root, title, text) as materials: id, url and title by the page's title, of which
    the part behind the first slash names the chapter; a root's own page is named by the root."""
    chapter = F.when(F.contains("title", F.lit("/")), F.regexp_replace("title", "^[^/]*/", "")).otherwise(F.col("title"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    return rows.withColumn("chapter", chapter).select(
        F.concat(F.lit("wikibooks_"), swap(swap(F.lower("title"), " ", "_"), "/", "__")).alias("id"), F.col("topic").alias("topic_id"), F.lit("wikibooks").alias("source"),
        F.concat(F.lit("https://en.wikibooks.org/wiki/"), swap(swap(F.col("title"), " ", "_"), "/", "%2F")).alias("url"),
        F.when(F.col("chapter") != F.col("root"), F.concat("root", F.lit(" — "), "chapter")).otherwise(F.col("root")).alias("title"),
        F.concat(F.lit("# "), "root", F.lit(": "), "chapter", F.lit("\n\n"), "text").alias("content"),
        F.lit("Wikibooks contributors").alias("authors"), F.lit("Wikibooks").alias("publisher"),
    )
