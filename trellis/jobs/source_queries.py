"""Queries of the source normalisers, over payloads that Spark builds from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.jobs import views as V
from trellis.jobs.register import query
from trellis.sources import books as B
from trellis.sources import catalogues as C
from trellis.sources import encyclopedia as E
from trellis.sources import ingest as I
from trellis.sources import xml as M

_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""WITH c AS (SELECT doc_id, lang, source, length({_LINE}) AS n FROM documents WHERE lang <> 'fr')
SELECT doc_id, source || ' ' || doc_id AS title, 'https://example.org/wiki/' || doc_id AS url, CAST((n > 50)::INT + (n >= 60)::INT AS BIGINT) AS n_sections,
CAST(CASE WHEN n > 50 THEN n ELSE 0 END + CASE WHEN n >= 60 THEN n ELSE 0 END AS BIGINT) AS n_chars FROM c
WHERE lang = 'en' OR CASE WHEN n > 50 THEN n ELSE 0 END + CASE WHEN n >= 60 THEN n ELSE 0 END >= 300""")
def encyclopedia_rows(spark, d):
    t = V.table(spark, d, "documents")
    extract = F.concat_ws("\n", "text", F.lit("== Threats =="), "text", F.lit("== See also =="), "text")
    page = F.struct(
        F.concat_ws(" ", "source", "doc_id").alias("title"), F.concat(F.lit("https://example.org/wiki/"), "doc_id").alias("fullurl"), extract.alias("extract"),
        F.when(F.col("lang") == "fr", "").alias("missing"),
    )
    landed = t.select("doc_id", "lang", F.to_json(F.struct(F.struct(F.create_map(F.col("doc_id").cast("string"), page).alias("pages")).alias("query"))).alias("payload"))
    rows = E.linked_articles(E.articles(landed), F.col("lang") == "en")
    return rows.select("doc_id", "title", "url", F.size("sections").cast("long").alias("n_sections"), "n_chars")


@query("""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS hit, lang || ' ' || doc_id AS title FROM documents""")
def search_titles(spark, d):
    t = V.table(spark, d, "documents")
    hits = F.sort_array(F.collect_list(F.struct("doc_id", F.concat_ws(" ", "lang", "doc_id").alias("title"))))
    titles = F.transform(hits, lambda h: F.struct(h["title"].alias("title")))
    landed = t.groupBy("source").agg(F.to_json(F.struct(F.struct(titles.alias("search")).alias("query"))).alias("payload"))
    return E.search_titles(landed).select("source", F.col("hit").cast("long").alias("hit"), "title")


@query("""WITH h AS (SELECT DISTINCT p_brand AS topic, p_type || CASE WHEN p_type = 'SMALL' THEN ' Notes' ELSE '' END AS heading FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY heading) AS section FROM h WHERE heading NOT LIKE '% Notes'),
f AS (SELECT p_brand AS topic, p_type AS heading, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS hit, CASE WHEN p_size % 10 = 0 THEN 'List of ' ELSE '' END || p_name AS title FROM part),
u AS (SELECT s.topic, title, section, hit FROM s JOIN f USING (topic, heading) WHERE hit <= 2 AND title NOT LIKE 'List of%' QUALIFY row_number() OVER (PARTITION BY s.topic, lower(title) ORDER BY section, hit) = 1)
SELECT topic, title, row_number() OVER (PARTITION BY topic ORDER BY section, hit) AS place FROM u QUALIFY place <= 8""")
def related_titles(spark, d):
    p = V.table(spark, d, "part")
    notes = F.concat("p_type", F.when(F.col("p_type") == "SMALL", " Notes").otherwise(""))
    headings = p.select(F.col("p_brand").alias("topic"), notes.alias("heading")).distinct().withColumn("section", F.row_number().over(Window.partitionBy("topic").orderBy("heading")))
    title = F.concat(F.when(F.col("p_size") % 10 == 0, "List of ").otherwise(""), "p_name")
    by = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return E.related_titles(headings, p.select(F.col("p_brand").alias("topic"), notes.alias("heading"), (F.row_number().over(by) - 1).alias("hit"), title.alias("title")), 8)


@query(r"""WITH h AS (SELECT 'The ' || lang || ' of tion' AS topic, lang, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS hit FROM documents),
f AS (SELECT *, lower(source || ' ' || regexp_replace(text, '<[^>]+>', '', 'g')) AS low FROM h WHERE hit < 18 QUALIFY row_number() OVER (PARTITION BY topic, source ORDER BY hit) = 1)
SELECT topic, source AS root, row_number() OVER (PARTITION BY topic ORDER BY hit) AS place FROM f WHERE contains(low, 'tion') QUALIFY place <= 3""")
def book_roots(spark, d):
    # the limit on the plain row number is applied in each task before the shuffle, so no task reads a language
    t = V.table(spark, d, "documents").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter(F.col("n") <= 3 * B.HITS_EACH)
    topic = F.concat(F.lit("The "), "lang", F.lit(" of tion")).alias("topic")
    hits = t.select(topic, (F.col("n") - 1).alias("hit"), F.concat_ws("/", "source", "doc_id").alias("title"), F.concat(F.lit("<b>"), "text", F.lit("</b>")).alias("snippet"))
    return B.book_roots(hits, 3)


_PAGES = r"""p AS (SELECT source || '/' || CASE WHEN length(text) < 300 THEN 'Index' ELSE 'part ' || doc_id END || CASE WHEN lang = 'de' THEN '/deep' ELSE '' END AS title, source AS root, text FROM documents
  UNION ALL SELECT lang, NULL, max(text) FROM documents GROUP BY lang),
k AS (SELECT root, title, text, row_number() OVER (PARTITION BY root ORDER BY title, text) AS n FROM p WHERE root IS NOT NULL QUALIFY n <= 50),
c AS (SELECT root, title FROM k WHERE title NOT LIKE '%/Index' AND title NOT LIKE '%/%/%' QUALIFY row_number() OVER (PARTITION BY root ORDER BY title) <= 20)"""


@query(rf"""WITH {_PAGES}, r AS (SELECT root, title FROM c UNION ALL SELECT DISTINCT lang, lang FROM documents)
SELECT r.root, r.title, CAST(length(regexp_replace(p.text, '^\s+|\s+$', '', 'g')) AS BIGINT) AS n FROM r JOIN p USING (title) WHERE n >= 400""")
def book_rows(spark, d):
    return _book_rows(spark, d).select("root", "title", F.length("text").cast("long").alias("n"))


def _book_rows(spark, d):
    t = V.table(spark, d, "documents")
    leaf = F.when(F.length("text") < 300, "Index").otherwise(F.concat_ws(" ", F.lit("part"), "doc_id"))
    pages = t.select(F.concat("source", F.lit("/"), leaf, F.when(F.col("lang") == "de", "/deep").otherwise("")).alias("title"), "text")
    pages = pages.unionByName(t.groupBy(F.col("lang").alias("title")).agg(F.max("text").alias("text")))
    roots = t.select(F.col("source").alias("root")).union(t.select("lang"))
    return B.book_rows(pages, roots, 20)


def _collections(spark, d):
    """A table of contents for each type of part: brands as units, names as chapters, parts as modules."""
    p = V.table(spark, d, "part")
    module = lambda x: F.concat(F.lit('<col:module document="'), x["p_partkey"].cast("string"), F.lit('"/>'))
    chapter = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey"))), module), "")
    chapters = p.groupBy("p_type", "p_brand", "p_name").agg(F.concat(F.lit("<col:subcollection><md:title> "), "p_name", F.lit("\n</md:title><col:content>"), chapter, F.lit("</col:content></col:subcollection>")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_name", "x"))), lambda x: x["x"]), "")
    units = chapters.groupBy("p_type", "p_brand").agg(F.concat(F.lit("<col:subcollection><md:title>"), "p_brand", F.lit("</md:title><col:content>"), joined, F.lit("</col:content></col:subcollection>")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_brand", "x"))), lambda x: x["x"]), "")
    head = '<col:collection xmlns:col="http://cnx.rice.edu/collxml" xmlns:md="http://cnx.rice.edu/mdml"><col:content>'
    return units.groupBy(F.col("p_type").alias("book")).agg(F.concat(F.lit(head), joined, F.lit("</col:content></col:collection>")).alias("payload"))


@query("""SELECT p_type AS book, p_brand AS unit, p_name AS chapter, CAST(count(*) AS BIGINT) AS n_modules, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_partkey) AS modules FROM part GROUP BY ALL""")
def xml_toc(spark, d):
    c = M.toc_chapters(_collections(spark, d))
    return c.select("book", "unit", "chapter", F.size("modules").cast("long").alias("n_modules"), F.array_join("modules", " ").alias("modules"))


def _modules(spark, d):
    """Modules in XML, one of each document: a fifth of them is broken off."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.concat(F.lit('<document xmlns="http://cnx.rice.edu/cnxml"><title> '), "source", F.lit("</title><content><para>\n"), F.coalesce(esc, F.lit("")), F.lit(" <emphasis>"), "lang")
    tail = F.lit('</emphasis> after</para><note>gone <para>deep</para></note> lost <media><image src="x"/></media> too<section><title>End</title> rest </section></content>')
    broken = F.length(F.coalesce("text", F.lit(""))) % 5 == 0
    return V.table(spark, d, "documents").select("doc_id", F.concat(head, tail, F.when(broken, "").otherwise("</document>")).alias("payload"))


@query(r"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 5 = 0 THEN '' ELSE trim(regexp_replace(source || ' ' || coalesce(text, '') || ' ' || lang || ' after End rest', '\s+', ' ', 'g')) END AS text FROM documents""")
def module_texts(spark, d):
    return M.module_texts(_modules(spark, d))


@query(r"""WITH t AS (SELECT DISTINCT p_type || ' ' || p_name AS topic FROM part), w AS (SELECT topic, unnest(string_split(topic, ' ')) AS w, unnest(range(len(string_split(topic, ' ')))) AS i FROM t),
pages AS (SELECT DISTINCT p_type || ' ' || p_name AS title FROM part WHERE p_size = 50 UNION SELECT DISTINCT upper(w[1]) || lower(w[2:]) FROM w WHERE length(w) BETWEEN 6 AND 7 OR (length(w) = 4 AND topic LIKE 'SMALL%')
  UNION SELECT DISTINCT 'Page ' || p_brand FROM part WHERE p_brand NOT LIKE '%5' UNION SELECT DISTINCT 'List of ' || p_brand FROM part),
hits AS (SELECT p_type || ' ' || p_name AS topic, row_number() OVER (PARTITION BY p_type || ' ' || p_name ORDER BY p_partkey) - 1 AS hit, CASE WHEN p_size % 3 = 0 THEN 'List of ' ELSE 'Page ' END || p_brand AS title FROM part),
c AS (SELECT topic, 0 AS stage, 0 AS rank, topic AS title FROM t UNION ALL SELECT topic, 1, CASE WHEN i = 0 THEN -10000 ELSE i - 100 * length(w) END, upper(w[1]) || lower(w[2:]) FROM w WHERE length(w) >= 3 UNION ALL SELECT topic, 2, hit, title FROM hits WHERE hit < 5 AND title NOT LIKE 'List of%')
SELECT topic, CAST(stage AS INT) AS stage, title FROM c WHERE title IN (SELECT title FROM pages) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY stage, rank, title) = 1""")
def resolved_roots(spark, d):
    """The root article of every topic: its own, that of a word, or that of a search hit."""
    p = V.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("topic"), "p_brand", "p_size")
    words = p.select("topic", F.explode(F.split("topic", " ")).alias("w")).filter(F.length("w").between(6, 7) | ((F.length("w") == 4) & F.col("topic").startswith("SMALL")))
    titles = p.filter("p_size = 50").select(F.col("topic").alias("title")).union(words.select(F.initcap("w")))
    titles = titles.union(p.filter("p_brand not like '%5'").select(F.concat(F.lit("Page "), "p_brand"))).union(p.select(F.concat(F.lit("List of "), "p_brand")))
    hit = (F.row_number().over(Window.partitionBy("topic").orderBy("p_partkey")) - 1).alias("hit")
    hits = p.select("topic", hit, F.concat(F.when(F.col("p_size") % 3 == 0, "List of ").otherwise("Page "), "p_brand").alias("title"))
    return E.resolved_roots(p.select("topic"), titles, hits)


@query(r"""WITH s AS (SELECT doc_id, lang, source || '/' || doc_id AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT 'wiki_' || lower(replace(title, '/', '_')) AS id, lang AS topic_id, title, md5(trim('# ' || title || chr(10) || chr(10) || CASE WHEN length(x) > 50 THEN '## Introduction' || chr(10) || x || chr(10) || chr(10) ELSE '' END
|| CASE WHEN length(x) >= 60 THEN '## Threats' || chr(10) || x || chr(10) ELSE '' END, chr(10) || ' ')) AS digest FROM s""")
def article_documents(spark, d):
    return _articles(spark, d).select("id", "topic_id", "title", F.md5("content").alias("digest"))


def _articles(spark, d):
    t = V.table(spark, d, "documents")
    extract = F.concat_ws("\n", "text", F.lit("== Threats =="), "text", F.lit("== See also =="), "text")
    page = F.struct(F.concat_ws("/", "source", "doc_id").alias("title"), F.lit("u").alias("fullurl"), extract.alias("extract"))
    landed = t.select(F.col("lang").alias("topic"), F.to_json(F.struct(F.struct(F.create_map(F.lit("1"), page).alias("pages")).alias("query"))).alias("payload"))
    return E.article_documents(E.articles(landed))


@query(rf"""WITH {_PAGES}, r AS (SELECT root, title FROM c UNION ALL SELECT DISTINCT lang, lang FROM documents), x AS (SELECT r.root, r.title, regexp_replace(p.text, '^\s+|\s+$', '', 'g') AS text, CASE WHEN contains(r.title, '/') THEN regexp_replace(r.title, '^[^/]*/', '') ELSE r.title END AS chapter FROM r JOIN p USING (title))
SELECT 'wikibooks_' || replace(replace(lower(title), ' ', '_'), '/', '__') AS id, root AS topic_id, 'https://en.wikibooks.org/wiki/' || replace(replace(title, ' ', '_'), '/', '%2F') AS url,
CASE WHEN chapter <> root THEN root || ' — ' || chapter ELSE root END AS title, md5('# ' || root || ': ' || chapter || chr(10) || chr(10) || text) AS digest FROM x WHERE length(text) >= 400""")
def book_documents(spark, d):
    return _books(spark, d).select("id", "topic_id", "url", "title", F.md5("content").alias("digest"))


def _books(spark, d):
    return B.book_documents(_book_rows(spark, d).withColumn("topic", F.col("root")))


@query(r"""WITH s AS (SELECT doc_id, lang, source || '/' || doc_id AS title FROM documents),
a AS (SELECT 'wiki_' || lower(replace(title, '/', '_')) AS id, lang AS topic_id, 'wikipedia' AS source, title FROM s),
o AS (SELECT 'wiki_' || lower(replace(title, '/', '_')) AS id, 'old' AS topic_id, 'old' AS source, title FROM s WHERE doc_id % 2 = 0 UNION ALL SELECT 'old_' || lang, 'old', 'old', lang FROM (SELECT DISTINCT lang FROM s)),
c AS (SELECT 'corrected_' || lang AS id, lang AS topic_id, 'corrections' AS source, min(source) AS title FROM documents GROUP BY lang UNION ALL SELECT a.id, 'fixed', 'corrections', a.title FROM a WHERE title LIKE '%3')
SELECT id, topic_id, source, title FROM c UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM a)""")
def ingest_sources(spark, d):
    """Old materials after three sources that work and two that fail, one at planning and one in its tasks."""
    t = V.table(spark, d, "documents")
    row = lambda df, source, i, topic, title: df.select(i.alias("id"), topic.alias("topic_id"), F.lit(source).alias("source"), F.lit("u").alias("url"), title.alias("title"), F.lit("c").alias("content"))
    wiki = F.concat(F.lit("wiki_"), F.lower("source"), F.lit("_"), "doc_id")
    title = F.concat_ws("/", "source", "doc_id")
    old = row(t.filter("doc_id % 2 = 0"), "old", wiki, F.lit("old"), title).unionByName(row(t.select("lang").distinct(), "old", F.concat(F.lit("old_"), "lang"), F.lit("old"), F.col("lang")))
    first = t.groupBy("lang").agg(F.min("source").alias("title"))

    def corrections(topics):
        whole = row(first.join(topics, first["lang"] == topics["topic"], "left_semi"), "corrections", F.concat(F.lit("corrected_"), "lang"), F.col("lang"), F.col("title"))
        return whole.unionByName(row(t.filter(title.endswith("3")), "corrections", wiki, F.lit("fixed"), title))

    sources = {
        "wikipedia": lambda topics: _articles(spark, d),
        "missing": lambda topics: spark.read.parquet(f"{d}/no such table.parquet"),
        "broken": lambda topics: row(t, "broken", F.raise_error(F.lit("the payload is broken")).cast("string"), F.col("lang"), title),
        "corrections": corrections,
    }
    materials, failures = I.ingest(t.select(F.col("lang").alias("topic")).distinct(), sources, old)
    if failures.keys() != {"missing", "broken"}:
        raise RuntimeError(f"sources failed: {failures}")
    return materials.select("id", "topic_id", "source", "title")


_BOOK = """t AS (SELECT p_type AS book, p_brand AS unit, p_name AS chapter, string_agg(text, chr(10) || chr(10) ORDER BY p_partkey) AS text FROM part JOIN documents ON doc_id = p_partkey WHERE text <> '' GROUP BY ALL),
r AS (SELECT book, unit, chapter, '# ' || book || ' — ' || unit || ': ' || chapter || chr(10) || chr(10) || text AS content FROM t WHERE length(text) >= 100)"""


def _textbooks(spark, d):
    c = M.toc_chapters(_collections(spark, d)).withColumn("slug", F.lower("book"))
    return M.textbook_rows(c, V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("module"), "text"))


@query(f"WITH {_BOOK} SELECT book, 'openstax_' || lower(book) || '_' || replace(chapter, ' ', '-') AS id, book || ' — ' || chapter AS title, unit, md5(content) AS digest FROM r")
def textbook_chapters(spark, d):
    return _textbooks(spark, d).select("book", "id", "title", "unit", F.md5("content").alias("digest"))


@query(f"WITH {_BOOK} SELECT book, CAST(count(*) AS BIGINT) AS chapters, CAST(sum(length(content)) AS BIGINT) AS chars FROM r GROUP BY book")
def textbook_totals(spark, d):
    return _textbooks(spark, d).groupBy("book").agg(F.count("*").alias("chapters"), F.sum(F.length("content")).alias("chars"))


@query("""WITH m AS (SELECT * FROM (VALUES (1, 'econ', 'economics'), (2, 'small', 'basics'), (3, 'eco', 'economics'), (4, 'gear', 'mechanics'), (5, 'prom', 'marketing')) m(o, k, s)),
f AS (SELECT p_partkey AS id, s, min(o) AS o FROM part JOIN m ON contains(lower(p_type || ' ' || p_name), k) GROUP BY ALL)
SELECT id, s AS slug, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS BIGINT) AS place FROM f""")
def curated_books(spark, d):
    topics = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("topic"))
    books = [("econ", "economics"), ("small", "basics"), ("eco", "economics"), ("gear", "mechanics"), ("prom", "marketing")]
    found = M.curated_books(topics.select("topic").distinct(), books)
    return topics.join(found, "topic").select("id", "slug", F.col("place").cast("long").alias("place"))


@query(r"""WITH e AS (SELECT doc_id, source || ' ' || lang AS title, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS a FROM documents)
SELECT 'arxiv_' || doc_id || 'v1' AS id, 'http://arxiv.org/abs/' || doc_id || 'v1/' AS url, title, md5('# ' || title || chr(10) || chr(10) || a) AS digest FROM e WHERE length(a) >= 150""")
def atom_entries(spark, d):
    t = V.table(spark, d, "documents")
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), "doc_id", F.lit("v1/</id><title>\n"), "source", F.lit("\n"), "lang", F.lit("</title><summary> "), text, F.lit("</summary></entry>"))
    landed = t.groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("payload"))
    return M.atom_rows(landed).select("id", "url", "title", F.md5("content").alias("digest"))


@query("""WITH g AS (SELECT doc_id, lang || 'e' AS topic, length(text) > 8000 AND lang <> 'de' AS survey FROM documents WHERE contains(lower(text), lang || 'e'))
SELECT topic, doc_id FROM g WHERE survey OR topic NOT IN (SELECT topic FROM g WHERE survey)""")
def survey_or_general(spark, d):
    t = V.table(spark, d, "documents")
    title = F.concat("source", F.when((F.length("text") > 8000) & (F.col("lang") != "de"), ": A Survey").otherwise(""))
    papers = t.select("doc_id", F.concat("lang", F.lit("e")).alias("topic"), title.alias("title"), F.col("text").alias("abstract"))
    return M.prefer_surveys(papers).select("topic", "doc_id")


@query(r"""WITH b AS (SELECT doc_id, lang, source, left(md5(text), 12) AS uuid, regexp_replace(text, '^\s+|\s+$', '', 'g') AS a, length(text) % 4 AS k FROM documents WHERE lang IN ('en', 'es')),
f AS (SELECT *, CASE k WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC BY-NC' WHEN 2 THEN 'Open Access' ELSE 'own terms' END AS license FROM b WHERE length(a) >= 200 QUALIFY row_number() OVER (PARTITION BY source, uuid ORDER BY doc_id) = 1)
SELECT source AS topic, 'doab_' || uuid AS id, CASE WHEN k = 0 THEN 'http://books.example.org/' || doc_id ELSE 'https://library.oapen.org/handle/20.500/' || doc_id END AS url, source || ' ' || doc_id AS title, license,
md5('# ' || source || ' ' || doc_id || chr(10) || chr(10) || '**Authors:** ' || source || chr(10) || '**License:** ' || license || chr(10) || chr(10) || '## Abstract' || chr(10) || a || CASE WHEN k = 1 THEN chr(10) || chr(10) || '**Subjects:** ' || lang ELSE '' END) AS digest FROM f""")
def open_book_catalogue(spark, d):
    t = V.table(spark, d, "documents").withColumn("k", F.length("text") % 4)
    k = F.col("k")
    rights = F.when(k == 0, "https://creativecommons.org/licenses/by/4.0").when(k == 1, "Terms BY-NC").when(k == 2, "Open Access").otherwise("own terms")
    language = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "es", "  ").otherwise(F.col("lang"))
    items = {
        "dc.title": F.lit("an older title"), "dc.title ": F.lit("x"), "dc.contributor.author": F.lit(" "), "dc.contributor.editor": F.col("source"), "dc.language": language, "dc.description.abstract": F.col("text"),
        "dc.identifier": F.when(k == 0, F.concat(F.lit("http://books.example.org/"), "doc_id")), "dc.rights": rights, "oapen.subject": F.when(k == 1, F.col("lang")),
    }
    pairs = [F.struct(F.lit(a).alias("key"), b.cast("string").alias("value")) for a, b in items.items()]
    pairs.append(F.struct(F.lit("dc.title").alias("key"), F.concat_ws(" ", "source", "doc_id").alias("value")))
    book = F.struct(F.substring(F.md5("text"), 1, 12).alias("uuid"), F.concat(F.lit("20.500/"), "doc_id").alias("handle"), F.array(*pairs).alias("metadata"))
    books = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(book).alias("b")))), lambda x: x["b"])
    landed = t.groupBy(F.col("source").alias("topic")).agg(F.concat(F.lit("["), F.array_join(books, ", "), F.lit("]")).alias("payload"))
    landed = landed.union(spark.createDataFrame([("bad", '{"error": 1}'), ("worse", "<html>"), ("none", None), ("mixed", '[1, "x", null]')], "topic string, payload string"))
    return C.open_book_rows(C.response_items(landed), "place").select("topic", "id", "url", "title", "license", F.md5("content").alias("digest"))


@query(r"""WITH b AS (SELECT doc_id, lang, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS a, length(text) % 3 AS k FROM documents WHERE doc_id <> 0),
f AS (SELECT *, CASE k WHEN 0 THEN 'CC BY-NC' WHEN 1 THEN 'CC BY' ELSE 'own terms' END AS license FROM b WHERE length(a) >= 150 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 4)
SELECT lang || '/' || source AS topic, 'otl_' || doc_id AS id, CASE k WHEN 0 THEN 'http://a.example.org/' || doc_id WHEN 1 THEN 'http://b.example.org/' || doc_id ELSE 'https://open.umn.edu/opentextbooks/textbooks/' || doc_id END AS url, source || ' ' || doc_id AS title, license,
md5('# ' || source || ' ' || doc_id || chr(10) || chr(10) || '**Publisher:** ' || source || chr(10) || CASE WHEN k = 1 THEN '**Year:** 2021' || chr(10) ELSE '' END || '**License:** ' || license || chr(10) || '**Subjects:** ' || lang || ', ' || source || chr(10) || chr(10) || '## Overview' || chr(10) || a) AS digest FROM f""")
def textbook_catalogue(spark, d):
    t = V.table(spark, d, "documents").withColumn("k", F.length("text") % 3)
    k = F.col("k")
    one = lambda c: F.struct(c.alias("name"))
    form = lambda kind, host, n: F.struct(F.lit(kind).alias("type"), F.when(k == n, F.concat(F.lit(host), "doc_id")).alias("url"))
    book = F.struct(
        F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit(" "), "source", "doc_id").alias("title"), F.col("text").alias("description"), F.when(k == 1, 2021).otherwise(0).alias("copyright_year"),
        F.when(k == 0, "Attribution-NonCommercial").when(k == 1, " Attribution ").otherwise(" own terms ").alias("license"), F.array(form("PDF", "http://b.example.org/", 1), form("Online", "http://a.example.org/", 0)).alias("formats"),
        F.array(one(F.col("source")), one(F.col("lang"))).alias("publishers"), F.array(one(F.col("lang")), one(F.lit("")), one(F.col("source"))).alias("subjects"),
    )
    books = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(book).alias("b")))), lambda x: x["b"])
    listed = F.concat(F.lit("["), F.array_join(books, ","), F.lit("]"))
    wrapped = F.when(F.col("lang") == "en", F.concat(F.lit('{"links": {"next": null}, "data": '), listed, F.lit("}"))).otherwise(listed)
    landed = t.groupBy("lang", "source").agg(wrapped.alias("payload")).select(F.concat_ws("/", "lang", "source").alias("topic"), "payload")
    landed = landed.union(spark.createDataFrame([("bad", '{"error": 1}'), ("worse", "<html>"), ("none", None)], "topic string, payload string"))
    return C.textbook_rows(C.response_items(landed, "data"), "place", 4).select("topic", "id", "url", "title", "license", F.md5("content").alias("digest"))
