"""Registered queries of the library proper, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.jobs import build_queries, extract_queries, source_queries, topic_queries  # noqa: F401
from trellis.jobs import views as V
from trellis.jobs.register import oracle_sql, queries, query  # noqa: F401
from trellis.operators import build as B
from trellis.operators import graph as G
from trellis.operators import names as N
from trellis.operators import tables as T
from trellis.operators import vectors as E
from trellis.operators.storage import written

W = V.with_views


def L(c):
    return F.col(c).cast("long").alias(c)


# ---- sources and rows ------------------------------------------------------------------


@query(W("SELECT id, topic_id, source, CAST(length(content) AS BIGINT) AS n FROM raw_materials WHERE content IS NOT NULL AND length(content) > 200"))
def materials_scan(spark, d):
    m = V.raw_materials(spark, d)
    return m.filter("content is not null and length(content) > 200").select("id", "topic_id", "source", F.length("content").cast("long").alias("n"))


@query("""SELECT doc_id AS id, CASE WHEN length(text) > 1000 THEN upper(source) ELSE source END AS source, CASE WHEN length(text) > 1000 THEN 'second' ELSE 'first' END AS batch FROM documents""")
def materials_union_merge(spark, d):
    """All documents are there already; those of more than 1000 characters come anew."""
    docs = V.table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("id"), "source", F.lit("first").alias("batch"))
    b = docs.filter(F.length("text") > 1000).select(F.col("doc_id").alias("id"), F.upper("source").alias("source"), F.lit("second").alias("batch"))
    return T.merge_by_key(a, b, ["id"])


@query("""SELECT doc_id AS id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, CASE WHEN lang = 'en' THEN 'second' ELSE 'first' END AS batch FROM documents""")
def materials_union_merge_whole(spark, d):
    """All documents are there already; those in English come anew."""
    docs = V.table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("id"), "source", F.lit("first").alias("batch"))
    b = docs.filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.upper("source").alias("source"), F.lit("second").alias("batch"))
    return T.merge_by_key(a, b, ["id"])


@query("""WITH c AS (SELECT source, doc_id, CASE WHEN lang = 'fr' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS stage FROM documents)
SELECT source, doc_id, CAST(stage AS BIGINT) AS stage FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY stage, doc_id) = 1""")
def source_fallback(spark, d):
    stage = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "de", 1).otherwise(2)
    c = V.table(spark, d, "documents").select("source", "doc_id", stage.cast("long").alias("stage"))
    best = c.groupBy("source").agg(F.min(F.struct("stage", "doc_id")).alias("b"))
    return best.select("source", "b.doc_id", "b.stage")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)")
def first_wins_dedup(spark, d):
    return V.table(spark, d, "documents").groupBy(F.xxhash64(F.lower("text")), F.md5(F.lower("text"))).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages""")
def html_outline(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title")
    )


@query("""SELECT doc_id, 'wiki_' || replace(replace(lower(left(text, 40)), ' ', '_'), '/', '_') AS id,
'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || trim(text) AS content,
CASE WHEN lang = source THEN source ELSE source || ' — ' || lang END AS title FROM documents""")
def markdown_document(spark, d):
    t = V.table(spark, d, "documents")
    return t.select(
        "doc_id",
        F.concat(F.lit("wiki_"), F.replace(F.replace(F.lower(F.substring("text", 1, 40)), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))).alias("id"),
        F.concat_ws("\n", F.concat(F.lit("# "), "source"), F.lit(""), F.concat(F.lit("## "), "lang"), F.trim("text")).alias("content"),
        F.when(F.col("lang") == F.col("source"), F.col("source")).otherwise(F.concat("source", F.lit(" — "), "lang")).alias("title"),
    )


@query(r"""WITH t AS (SELECT doc_id, text || chr(10) || '== References ==' || chr(10) || text || chr(10) || '== ' || source || ' ==' || chr(10) || text AS t FROM documents),
p AS (SELECT doc_id, ['Introduction'] || regexp_extract_all(t, '\n==+ *([^=\n]+?) *==+\n', 1) AS titles, string_split_regex(t, '\n==+ *[^=\n]+? *==+\n') AS parts FROM t),
u AS (SELECT doc_id, unnest(titles) AS title, trim(regexp_replace(unnest(parts), '\s+', ' ', 'g')) AS content FROM p)
SELECT doc_id, title, CAST(length(content) AS BIGINT) AS n FROM u WHERE (title = 'Introduction' AND length(content) > 50)
OR (title <> 'Introduction' AND title NOT IN (""" + ", ".join(map(repr, X.SKIP_SECTIONS)) + ") AND length(content) >= 60)")
def sections_split(spark, d):
    t = V.table(spark, d, "documents")
    text = F.concat_ws("\n", "text", F.lit("== References =="), "text", F.concat(F.lit("== "), "source", F.lit(" ==")), "text")
    return t.select("doc_id", F.explode(X.kept_sections(X.sections(text))).alias("s")).select("doc_id", "s.title", F.length("s.content").cast("long").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, length(text) AS n, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, left(array_to_string(list_filter(s, lambda x: length(x) > 20)[1:2], ' '), 500) AS summary,
CAST(CASE WHEN n < 5000 THEN 1 WHEN n < 15000 THEN 2 WHEN n < 40000 THEN 3 WHEN n < 90000 THEN 4 ELSE 5 END AS BIGINT) AS difficulty FROM s""")
def sentence_summary(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"), X.difficulty_from_length(F.length("text")).cast("long").alias("difficulty"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': '', 'size': CAST(0 AS BIGINT)}, list_transform(p, lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x, 'size': length(x)})),
  lambda a, x: CASE WHEN a.size > 0 AND a.size + x.size > 3200 THEN {'done': list_append(a.done, a.cur), 'cur': x.cur, 'size': x.size}
    WHEN a.size = 0 THEN {'done': a.done, 'cur': x.cur, 'size': x.size} ELSE {'done': a.done, 'cur': a.cur || chr(10) || chr(10) || x.cur, 'size': a.size + x.size} END) AS r FROM p),
c AS (SELECT doc_id, unnest(CASE WHEN r.size > 0 THEN list_append(r.done, r.cur) ELSE r.done END) AS chunk FROM f)
SELECT doc_id, chunk FROM c WHERE length(chunk) >= 200""")
def chunk_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), r"\n+")).alias("chunk"))


@query(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s-]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)), '\s+', '-', 'g') AS slug FROM documents""")
def slugify_names(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query(r"""WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(replace(text, 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(w, lambda x: x <> '')) AS BIGINT) AS words, array_to_string(list_transform(list_filter(w, lambda x: x <> ''),
lambda x: CASE WHEN x = upper(x) AND x <> lower(x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS name FROM w""")
def capitalise_names(spark, d):
    t = F.replace("text", F.lit("ß"), F.lit("ss"))
    return V.table(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.capitalise(t).alias("name"))


@query()
def slugify_texts(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query()
def capitalise_texts(spark, d):
    t = F.replace("text", F.lit("ß"), F.lit("ss"))
    return V.table(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.capitalise(t).alias("name"))


@query("""SELECT doc_id, CASE WHEN l LIKE '%attribution-noncommercial-noderivatives%' THEN 'CC BY-NC-ND' WHEN l LIKE '%attribution-noncommercial-sharealike%' THEN 'CC BY-NC-SA'
WHEN l LIKE '%attribution-noncommercial%' THEN 'CC BY-NC' WHEN l LIKE '%attribution-noderivatives%' THEN 'CC BY-ND' WHEN l LIKE '%attribution-sharealike%' THEN 'CC BY-SA'
WHEN l LIKE '%attribution%' THEN 'CC BY' WHEN l LIKE '%public domain%' THEN 'Public Domain' WHEN l LIKE '%cc0%' THEN 'CC0' ELSE trim(r) END AS license,
CASE WHEN doc_id % 4 = 0 THEN 'http://x/' || doc_id WHEN doc_id % 4 = 1 THEN 'https://handles/' || doc_id ELSE NULL END AS url
FROM (SELECT doc_id, lower(r) AS l, r FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Attribution-ShareAlike ' || source WHEN 1 THEN 'Public Domain' WHEN 2 THEN 'Attribution' WHEN 3 THEN 'CC0 1.0' ELSE ' ' || source || ' ' END AS r FROM documents))""")
def license_and_url(spark, d):
    k = F.col("doc_id")
    raw = F.when(k % 5 == 0, F.concat(F.lit("Attribution-ShareAlike "), "source")).when(k % 5 == 1, "Public Domain").when(k % 5 == 2, "Attribution").when(k % 5 == 3, "CC0 1.0").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    url = F.when(k % 4 == 0, F.concat(F.lit("http://x/"), k)).when(k % 4 == 1, k.cast("string")).otherwise(F.lit(" "))
    return V.table(spark, d, "documents").select("doc_id", X.normalise_license(raw).alias("license"), X.normalise_url(url, "https://handles/").alias("url"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'on-' || doc_id WHEN doc_id % 3 = 1 THEN 'pdf-' || doc_id ELSE 'any-' || doc_id END AS url FROM documents""")
def pick_format_url(spark, d):
    k = F.col("doc_id")
    f = lambda t, u: F.struct(F.lit(t).alias("type"), u.alias("url"))
    any_url, pdf, online = (F.concat(F.lit(p), k) for p in ("any-", "pdf-", "on-"))
    formats = F.array(f("Print", any_url), f("PDF", F.when(k % 3 == 1, pdf).otherwise("")), f("Online", F.when(k % 3 == 0, online)))
    return V.table(spark, d, "documents").select("doc_id", X.pick_url(formats).alias("url"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [source, lang] WHEN 1 THEN [source] WHEN 2 THEN [lang] ELSE CAST([] AS VARCHAR[]) END) AS name FROM documents""")
def llm_json_parse(spark, d):
    k = F.col("doc_id") % 4
    item = lambda c: F.struct(F.col(c).alias("name"))
    raw = F.when(k == 0, F.to_json(F.array(item("source"), item("lang")))).when(k == 1, F.concat(F.lit('{"edges": '), F.to_json(F.array(item("source"))), F.lit("}")))
    raw = raw.when(k == 2, F.concat(F.lit('{"other": '), F.to_json(F.array(item("lang"))), F.lit("}"))).otherwise("not json")
    t = V.table(spark, d, "documents").select("doc_id", X.json_items(raw, "edges", "struct<name:string>").alias("i"))
    return t.select("doc_id", F.explode("i").alias("i")).select("doc_id", "i.name")


# ---- candidates ------------------------------------------------------------------------

_CANDIDATES = V.phrases_sql()


@query(f"WITH {_CANDIDATES} SELECT doc_id, name FROM phrases")
def np_candidates(spark, d):
    return V.phrases(spark, d).select("doc_id", "name")


@query(rf"""WITH {_CANDIDATES}, s AS (SELECT DISTINCT doc_id, regexp_replace(trim(regexp_replace(strip_accents(name), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g') AS slug FROM phrases)
SELECT slug, CAST(count(*) AS BIGINT) AS docs FROM s GROUP BY slug HAVING count(*) >= 2""")
def cross_doc_frequency(spark, d):
    names = V.phrases(spark, d).select("doc_id", "name")
    c = names.select("doc_id", X.slugify(F.col("name")).alias("slug")).distinct()
    return c.groupBy("slug").agg(F.count("*").alias("docs")).filter("docs >= 2")


@query("""SELECT doc_id, sha256('wiki_summary||' || source || lang) AS key, doc_id % 2 = 0 AS hit FROM documents""")
def cache_split(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("wiki_summary||"), "source", "lang"), 256).alias("key"))
    keyed = rows.withColumn("k", F.concat_ws("/", "key", "doc_id"))
    cache = keyed.filter("doc_id % 2 = 0").select("k", F.lit("{}").alias("response_json"))
    return T.cached(keyed, cache, "k").select("doc_id", "key", "hit")


@query("""WITH e AS (SELECT source AS k, min(doc_id) AS v FROM documents WHERE lang = 'de' GROUP BY source), n AS (SELECT source || lang AS k, min(doc_id) AS v FROM documents GROUP BY ALL
UNION ALL SELECT source, max(doc_id) FROM documents GROUP BY source) SELECT k, v FROM e UNION ALL SELECT k, min(v) FROM n WHERE k NOT IN (SELECT k FROM e) GROUP BY k""")
def cache_insert_ignore(spark, d):
    t = V.table(spark, d, "documents")
    e = t.filter("lang = 'de'").groupBy(F.col("source").alias("k")).agg(F.min("doc_id").alias("v"))
    n = t.groupBy(F.concat("source", "lang").alias("k")).agg(F.min("doc_id").alias("v")).unionByName(t.groupBy(F.col("source").alias("k")).agg(F.max("doc_id").alias("v")))
    return T.insert_or_ignore(e, n, ["k"], ["v"])


@query(W("SELECT id, topic_id, CAST((row_number() OVER (PARTITION BY topic_id ORDER BY name, id) - 1) // 30 AS BIGINT) AS batch FROM concepts"))
def batch_assign(spark, d):
    return T.batch_numbers(V.concepts(spark, d), ["topic_id"], ["name", "id"], 30).select("id", "topic_id", "batch")


@query(W("""SELECT topic_id, tier, string_agg('- ' || name || ' (difficulty ' || difficulty || ')', chr(10) ORDER BY name, id) AS prompt
FROM (SELECT *, CAST(CASE WHEN difficulty <= 2 THEN 1 WHEN difficulty = 3 THEN 2 ELSE 3 END AS BIGINT) AS tier FROM concepts) GROUP BY topic_id, tier"""))
def prompt_lines(spark, d):
    c = V.concepts(spark, d).withColumn("tier", X.tier_band(F.col("difficulty")).cast("long"))
    line = F.format_string("- %s (difficulty %d)", "name", "difficulty")
    lines = F.sort_array(F.collect_list(F.struct("name", "id", line.alias("line"))))
    return c.groupBy("topic_id", "tier").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


@query(W("""SELECT t.topic_id, t.tier, c.id, row_number() OVER (PARTITION BY t.topic_id, t.tier ORDER BY c.difficulty DESC, c.name, c.id) AS rank
FROM (SELECT DISTINCT topic_id, CAST(CASE WHEN difficulty <= 2 THEN 1 WHEN difficulty = 3 THEN 2 ELSE 3 END AS BIGINT) AS tier FROM concepts) t
JOIN (SELECT *, CASE WHEN difficulty <= 2 THEN 1 WHEN difficulty = 3 THEN 2 ELSE 3 END AS tier FROM concepts) c ON c.topic_id = t.topic_id AND c.tier < t.tier QUALIFY rank <= 40"""))
def tier_context_topk(spark, d):
    return B.tier_context(V.concepts(spark, d))


@query("""SELECT source, CAST(avg(quality) AS DOUBLE) AS avg_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""".replace("CAST(avg(quality) AS DOUBLE)", "coalesce(avg(quality), 0.0)"))
def quiz_avg(spark, d):
    j = V.table(spark, d, "documents").select("doc_id", "source").join(V.table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.coalesce(F.avg("quality"), F.lit(0.0)).alias("avg_score"))


# ---- vectors ---------------------------------------------------------------------------


@query("""WITH t AS (SELECT CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), t), 4) AS similarity FROM embeddings, t WHERE list_dot_product(CAST(embedding AS DOUBLE[]), t) >= 0.2""")
def relevance_filter(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    topic = e.filter("vec_id = 0").select(F.col("embedding").alias("topic")).limit(1)  # one row, none if vector 0 is missing
    near = e.join(F.broadcast(topic)).withColumn("similarity", E.dot(F.col("embedding"), F.col("topic"))).filter("similarity >= 0.2")
    return near.select("vec_id", F.round("similarity", 4).alias("similarity"))


_PAIRS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 4) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) >= 0.35)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def similarity_pairs(spark, d):
    return E.similar_pairs(V.table(spark, d, "embeddings"), 0.35).withColumn("similarity", F.round("similarity", 4))


@query(f"""WITH RECURSIVE {_PAIRS}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
SELECT n.i, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = n.vec_id AND list_contains(g.kept, p.a)) THEN g.kept ELSE list_append(g.kept, n.vec_id) END FROM g JOIN n ON n.i = g.i + 1)
SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)""")
def greedy_dedup(spark, d):
    e = V.table(spark, d, "embeddings")
    return E.greedy_keep(e.select("vec_id"), E.similar_pairs(e, 0.35))


# ---- changes of tables -----------------------------------------------------------------


@query(W("""SELECT coalesce(e.id, n.id) AS id, coalesce(e.name, n.name) AS name, CASE WHEN n.id IS NOT NULL THEN n.difficulty ELSE e.difficulty END AS difficulty
FROM (SELECT id, name, difficulty FROM concepts WHERE difficulty <= 3) e FULL JOIN (SELECT id, upper(name) AS name, CAST(5 AS INT) AS difficulty FROM concepts WHERE difficulty >= 3) n ON e.id = n.id"""))
def upsert_concepts(spark, d):
    c = V.concepts(spark, d).select("id", "name", "difficulty")
    return T.upsert(c.filter("difficulty <= 3"), c.filter("difficulty >= 3").select("id", F.upper("name").alias("name"), F.lit(5).cast("int").alias("difficulty")), ["id"], ["difficulty"])


@query(W("SELECT source_id, target_id, CAST(CASE WHEN strength < 0.5 THEN 1.0 ELSE strength END AS FLOAT) AS strength FROM edges"))
def upsert_edges(spark, d):
    e = V.edges(spark, d).select("source_id", "target_id", "strength")
    return T.merge_by_key(e, e.filter("strength < 0.5").withColumn("strength", F.lit(1.0).cast("float")), ["source_id", "target_id"])


@query(W("SELECT source_id, target_id, strength FROM edges WHERE strength >= 0.5"))
def delete_edges(spark, d):
    e = V.edges(spark, d).select("source_id", "target_id", "strength")
    return T.delete_by_key(e, e.filter("strength < 0.5"), ["source_id", "target_id"])


@query(W("SELECT topic_id, CAST(count(*) AS BIGINT) AS concept_count FROM concepts GROUP BY topic_id"))
def topic_counts(spark, d):
    return V.concepts(spark, d).groupBy("topic_id").agg(F.count("*").alias("concept_count"))


@query(W("""SELECT c.topic_id, c.id, CASE WHEN c.id NOT IN (SELECT target_id FROM edges) THEN 'unlocked' ELSE coalesce(p.status, 'locked') END AS status
FROM concepts c LEFT JOIN progress p ON p.concept_id = c.id AND p.topic_id = c.topic_id"""))
def init_progress(spark, d):
    c = V.concepts(spark, d)
    return T.init_progress(c, G.root_concepts(c, V.edges(spark, d)), V.progress(spark, d))


@query(W("SELECT topic_id, concept_id FROM progress WHERE status IN ('unlocked', 'in_progress', 'mastered')"))
def progress_unlocked(spark, d):
    return V.progress(spark, d).filter(F.col("status").isin("unlocked", "in_progress", "mastered")).select("topic_id", "concept_id")


@query(W("""SELECT 'concepts' AS name, CAST(count(*) AS BIGINT) AS n FROM concepts WHERE topic_id <> 'Brand#11' UNION ALL
SELECT 'edges', count(*) FROM edges WHERE topic_id <> 'Brand#11' UNION ALL SELECT 'progress', count(*) FROM progress WHERE topic_id <> 'Brand#11'"""))
def reset_topic(spark, d):
    c = V.concepts(spark, d)
    gone = c.filter("topic_id = 'Brand#11'").select("id")
    e = V.edges(spark, d)
    e = T.delete_by_key(e, gone.withColumnRenamed("id", "source_id"), ["source_id"])
    e = T.delete_by_key(e, gone.withColumnRenamed("id", "target_id"), ["target_id"])
    p = T.delete_by_key(V.progress(spark, d), gone.withColumnRenamed("id", "concept_id"), ["concept_id"])
    left = {"concepts": T.delete_by_key(c, gone, ["id"]), "edges": e, "progress": p}
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(W("""SELECT 'name' AS rule, name AS key, CAST(count(*) AS BIGINT) AS n FROM concepts GROUP BY name HAVING count(*) > 1 UNION ALL
SELECT 'strength', source_id, CAST(count(*) AS BIGINT) FROM edges WHERE strength NOT BETWEEN 0 AND 0.9 GROUP BY source_id"""))
def dq_constraints(spark, d):
    names = T.violations(V.concepts(spark, d), ["name"]).select(F.lit("name").alias("rule"), F.col("name").alias("key"), "n")
    weak = V.edges(spark, d).filter("not strength between 0 and 0.9").groupBy(F.col("source_id").alias("key")).agg(F.count("*").alias("n"))
    return names.unionByName(weak.select(F.lit("strength").alias("rule"), "key", "n"))


# ---- graph -----------------------------------------------------------------------------

_CLOSURE = "closure AS (SELECT topic_id, source_id AS src, target_id AS dst FROM edges UNION SELECT c.topic_id, c.src, e.target_id FROM closure c JOIN edges e ON e.source_id = c.dst)"
_LAYERS = """paths AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM concepts UNION SELECT e.target_id, p.depth + 1 FROM paths p JOIN edges e ON e.source_id = p.id),
levels AS (SELECT id, max(depth) AS layer FROM paths GROUP BY id)"""
_GRAPH = (
    _CLOSURE + ", " + _LAYERS + """,
fan AS (SELECT c.topic_id, c.id, c.name, c.difficulty, CAST(count(k.dst) AS BIGINT) AS fanout FROM concepts c LEFT JOIN closure k ON k.src = c.id AND k.dst <> c.id GROUP BY ALL),
scored AS (SELECT *, fanout * CASE WHEN fanout >= 5 AND list_has_any(string_split(lower(name), ' '), ["""
    + ", ".join(repr(w) for w in X.UMBRELLA_WORDS)
    + """]) THEN CAST(0.3 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS score FROM fan),
cut AS (SELECT topic_id, list(score ORDER BY score DESC) AS s, count(*) AS n FROM scored GROUP BY topic_id),
nodes AS (SELECT s.id, s.topic_id, s.name, s.difficulty, s.fanout, round(s.score, 2) AS score,
  CASE WHEN s.score > 0 AND s.score >= c.s[CAST(n * 2 // 25 AS INT) + 1] THEN 'CORE' WHEN s.score > 0 AND s.score >= c.s[CAST(n // 4 AS INT) + 1] THEN 'IMPORTANT'
  WHEN s.score > 0 AND s.score >= c.s[CAST(n * 3 // 5 AS INT) + 1] THEN 'STANDARD' ELSE 'SUPPLEMENTARY' END AS tier, l.layer, coalesce(p.status, 'locked') AS status
  FROM scored s JOIN cut c USING (topic_id) JOIN levels l ON l.id = s.id LEFT JOIN progress p ON p.concept_id = s.id AND p.topic_id = s.topic_id)"""
)


@query(W("SELECT topic_id, id FROM concepts WHERE id NOT IN (SELECT target_id FROM edges)"))
def root_concepts(spark, d):
    return G.root_concepts(V.concepts(spark, d), V.edges(spark, d))


@query(W("""SELECT topic_id, id FROM concepts WHERE id NOT IN (SELECT concept_id FROM progress WHERE status = 'mastered')
AND id NOT IN (SELECT target_id FROM edges WHERE source_id NOT IN (SELECT concept_id FROM progress WHERE status = 'mastered'))"""))
def unlock_candidates(spark, d):
    mastered = V.progress(spark, d).filter("status = 'mastered'").select("topic_id", F.col("concept_id").alias("id"))
    return G.unlock_candidates(V.concepts(spark, d), V.edges(spark, d), mastered)


@query(W("""SELECT e.target_id AS id, 'prerequisite' AS kind, e.source_id AS other, round(CAST(e.strength AS DOUBLE), 3) AS strength FROM edges e
UNION ALL SELECT e.source_id, 'dependent', e.target_id, round(CAST(e.strength AS DOUBLE), 3) FROM edges e"""))
def direct_neighbours(spark, d):
    e = G.topic_edges(V.edges(spark, d), V.concepts(spark, d)).withColumn("strength", F.round("strength", 3))
    a = e.select(F.col("target_id").alias("id"), F.lit("prerequisite").alias("kind"), F.col("source_id").alias("other"), "strength")
    return a.unionByName(e.select(F.col("source_id").alias("id"), F.lit("dependent").alias("kind"), F.col("target_id").alias("other"), "strength"))


@query(W("SELECT topic_id, src, dst FROM closure", _CLOSURE, True))
def descendants(spark, d):
    return G.closure(V.edges(spark, d))


@query(W("SELECT topic_id, dst AS src, src AS dst FROM closure", _CLOSURE, True))
def ancestors(spark, d):
    e = V.edges(spark, d)
    return G.closure(e.select("topic_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


@query(W("SELECT topic_id, id, fanout FROM fan", _GRAPH, True))
def transitive_fanout(spark, d):
    return G.fan_out(V.concepts(spark, d), V.edges(spark, d))


_PAIRS_ASKED = "asked AS (SELECT topic_id, id AS src, lag(id, 7) OVER w AS dst FROM concepts WINDOW w AS (PARTITION BY topic_id ORDER BY difficulty DESC, id) UNION SELECT topic_id, source_id, target_id FROM edges UNION SELECT a.topic_id, a.source_id, b.target_id FROM edges a JOIN edges b ON b.source_id = a.target_id)"


@query(W("SELECT topic_id, src, dst, EXISTS (SELECT 1 FROM closure c WHERE c.src = a.src AND c.dst = a.dst) AS reached FROM asked a WHERE dst IS NOT NULL", f"{_CLOSURE}, {_PAIRS_ASKED}", True))
def reachable_pairs(spark, d):
    """Whether one concept leads to another, for pairs: neighbours, neighbours' neighbours, and others."""
    from pyspark.sql import Window

    e = written(V.edges(spark, d).select("topic_id", "source_id", "target_id"))
    other = V.concepts(spark, d).select("topic_id", F.col("id").alias("src"), F.lag("id", 7).over(Window.partitionBy("topic_id").orderBy(F.desc("difficulty"), "id")).alias("dst"))
    near = e.select("topic_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    second = near.withColumnRenamed("dst", "mid").join(near.withColumnRenamed("src", "mid"), ["topic_id", "mid"]).select("topic_id", "src", "dst")
    pairs = written(other.filter("dst is not null").union(near).union(second).distinct())
    return G.reaches(e, pairs)


@query(W("SELECT topic_id, id, CAST(count(DISTINCT dst) FILTER (dst <> id) AS BIGINT) AS fanout FROM (SELECT c.topic_id, c.id, r.dst FROM concepts c LEFT JOIN reach r ON r.src = c.id) GROUP BY topic_id, id",
"reach AS (SELECT topic_id, source_id AS src, target_id AS dst FROM edges_cyclic UNION SELECT c.topic_id, c.src, e.target_id FROM reach c JOIN edges_cyclic e ON e.source_id = c.dst)", True))
def cyclic_fanout(spark, d):
    """Fan-out where the edges have cycles: components are contracted first."""
    return G.fan_out(V.concepts(spark, d), V.edges_cyclic(spark, d))


@query(W("SELECT c.topic_id, c.id, l.layer FROM concepts c JOIN levels l USING (id)", _LAYERS, True))
def longest_path_layers(spark, d):
    return G.layers(V.concepts(spark, d), V.edges(spark, d))[0]


@query(W("SELECT c.topic_id, c.id, row_number() OVER (PARTITION BY c.topic_id ORDER BY l.layer, c.id) AS position FROM concepts c JOIN levels l USING (id)", _LAYERS, True))
def topological_levels(spark, d):
    return G.topological_order(V.concepts(spark, d), V.edges(spark, d))


@query(W("SELECT * FROM nodes", _GRAPH, True))
def criticality_graph(spark, d):
    return G.criticality(V.concepts(spark, d), V.edges(spark, d), V.progress(spark, d))


@query(W("SELECT tier, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY tier", _GRAPH, True))
def tier_counts(spark, d):
    return criticality_graph(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query(W("""SELECT source_id || '--' || target_id AS id, source_id, target_id, round(CAST(strength AS DOUBLE), 3) AS strength,
1 + CAST(1.5 AS DOUBLE) * CAST(strength AS DOUBLE) AS width, CAST(0.35 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(strength AS DOUBLE) AS opacity FROM edges
WHERE source_id IN (SELECT id FROM nodes WHERE tier <> 'SUPPLEMENTARY') AND target_id IN (SELECT id FROM nodes WHERE tier <> 'SUPPLEMENTARY')""", _GRAPH, True))
def flow_elements(spark, d):
    shown = criticality_graph(spark, d).filter("tier <> 'SUPPLEMENTARY'").select("id")
    e = G.topic_edges(V.edges(spark, d), V.concepts(spark, d))
    for end in ("source_id", "target_id"):
        e = e.join(shown.withColumnRenamed("id", end), end, "left_semi")
    s = F.col("strength")
    return e.select(F.concat_ws("--", "source_id", "target_id").alias("id"), "source_id", "target_id", F.round(s, 3).alias("strength"), (1 + 1.5 * s).alias("width"), (0.35 + 0.5 * s).alias("opacity"))


@query(W("""SELECT topic_id, id, layer, row_number() OVER w AS rank, pw AS w, ph AS h, layer * 240 AS x,
28 - CAST(sum(ph + 10) OVER (PARTITION BY topic_id, layer) AS BIGINT) / 2 + CAST(coalesce(sum(ph + 10) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y
FROM (SELECT *, CAST(round(160 * scale) AS BIGINT) AS pw, CAST(round(48 * greatest(0.8 * scale, 0.7)) AS BIGINT) AS ph FROM (
SELECT *, CASE tier WHEN 'CORE' THEN 0 WHEN 'IMPORTANT' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 3 END AS o,
CAST(0.6 AS DOUBLE) + pow(fanout / greatest(max(fanout) OVER (PARTITION BY topic_id), 1), 0.4) * CAST(0.8 AS DOUBLE) AS scale FROM nodes))
WINDOW w AS (PARTITION BY topic_id, layer ORDER BY o, name, id)""", _GRAPH, True))
def layer_layout(spark, d):
    nodes = written(criticality_graph(spark, d))  # read twice below
    most = nodes.groupBy("topic_id").agg(F.greatest(F.max("fanout"), F.lit(1)).alias("max_fanout"))
    return G.layer_layout(nodes, most)


@query(W("""SELECT c.topic_id, c.id, c.name, c.difficulty, CASE WHEN p.status = 'mastered' THEN 'mastered' WHEN u.id IS NOT NULL THEN 'unlocked' ELSE 'locked' END AS status
FROM concepts c LEFT JOIN progress p ON p.concept_id = c.id LEFT JOIN (SELECT id FROM concepts WHERE id NOT IN (SELECT concept_id FROM progress WHERE status = 'mastered')
AND id NOT IN (SELECT target_id FROM edges WHERE source_id NOT IN (SELECT concept_id FROM progress WHERE status = 'mastered'))) u ON u.id = c.id"""))
def graph_serializable(spark, d):
    nodes, _ = _serializable(spark, d)
    return nodes.select("topic_id", "id", "data.name", "data.difficulty", "data.status")


def _described(spark, d):
    return V.concepts(spark, d).withColumn("description", F.when(F.col("difficulty") > 2, F.concat_ws(" of ", "name", "topic_id")))


def _reasons(spark, d):
    e = V.edges(spark, d)
    return e.withColumn("rationale", F.when(F.col("strength") < 0.5, F.concat_ws(" before ", "source_id", "target_id")))


def _serializable(spark, d):
    c, e = _described(spark, d), _reasons(spark, d)
    mastered = V.progress(spark, d).filter("status = 'mastered'").select("topic_id", F.col("concept_id").alias("id"))
    return G.serializable(c, e, mastered, G.unlock_candidates(c, e, mastered))


@query(W("""SELECT topic_id, source_id || '->' || target_id AS id, source_id AS source, target_id AS target, CAST(strength AS DOUBLE) AS strength,
CASE WHEN strength < 0.5 THEN source_id || ' before ' || target_id ELSE '' END AS rationale FROM edges"""))
def graph_serializable_edges(spark, d):
    return _serializable(spark, d)[1].select("topic_id", "id", "source", "target", "data.strength", "data.rationale")


_DESCRIBED = "CASE WHEN n.difficulty > 2 THEN n.name || ' of ' || n.topic_id ELSE '' END"


@query(W(f"""SELECT n.topic_id, 'node' AS kind, row_number() OVER (PARTITION BY topic_id ORDER BY name, id) AS place, id AS a, name AS b, {_DESCRIBED} AS text, CAST(fanout AS DOUBLE) AS x, score AS y, tier || ' ' || layer || ' ' || status AS more FROM nodes n
UNION ALL SELECT topic_id, 'edge', row_number() OVER (PARTITION BY topic_id ORDER BY source_id, target_id), source_id, target_id, CASE WHEN strength < 0.5 THEN source_id || ' before ' || target_id ELSE '' END, round(CAST(strength AS DOUBLE), 3), NULL, NULL FROM edges""", _GRAPH, True))
def graph_payload(spark, d):
    """The graph as a page reads it, nodes and edges of a topic in one value, taken apart again."""
    g = written(G.graph_payload(_described(spark, d), _reasons(spark, d), V.progress(spark, d)))
    place = (F.col("place") + 1).cast("long").alias("place")
    n = g.select("topic_id", F.posexplode("nodes").alias("place", "n"))
    n = n.select("topic_id", F.lit("node").alias("kind"), place, F.col("n.id").alias("a"), F.col("n.name").alias("b"), F.col("n.description").alias("text"), F.col("n.transitive_fanout").cast("double").alias("x"), F.col("n.criticality_score").alias("y"), F.concat_ws(" ", "n.tier", "n.layer", "n.status").alias("more"))
    e = g.select("topic_id", F.posexplode("edges").alias("place", "e"))
    none = F.lit(None)
    return n.unionByName(e.select("topic_id", F.lit("edge").alias("kind"), place, F.col("e.source").alias("a"), F.col("e.target").alias("b"), F.col("e.rationale").alias("text"), F.col("e.strength").alias("x"), none.cast("double").alias("y"), none.cast("string").alias("more")))


_CYCLES = "reach AS (SELECT topic_id, source_id AS src, target_id AS dst FROM edges_cyclic UNION SELECT c.topic_id, c.src, e.target_id FROM reach c JOIN edges_cyclic e ON e.source_id = c.dst)"


@query(W("SELECT topic_id, src AS id FROM reach WHERE src = dst", _CYCLES, True))
def cycle_core(spark, d):
    return G.cycle_core(V.concepts(spark, d), V.edges_cyclic(spark, d))


@query()
def detect_cycles(spark, d):
    found = G.detect_cycles(V.concepts(spark, d), V.edges_cyclic(spark, d))
    return found.select("topic_id", F.size("nodes").cast("long").alias("n"), F.array_join("nodes", " > ").alias("cycle"))


_SLUG = r"regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g')"


@query(W("SELECT topic_id, name, id FROM r", rf"""e AS (SELECT topic_id, id AS key, id, {{'n': name, 'i': id, 'k': 0, 'w': 0}} AS place FROM concepts
UNION ALL SELECT topic_id, {_SLUG.format('name')}, id, {{'n': name, 'i': id, 'k': 1, 'w': 0}} FROM concepts
UNION ALL SELECT topic_id, w[j], id, {{'n': name, 'i': id, 'k': 2, 'w': j}} FROM (SELECT *, unnest(generate_series(1, len(w))) AS j FROM (
  SELECT *, list_filter(string_split_regex(lower(name), '\s+'), lambda x: length(x) > 4) AS w FROM concepts))),
ix AS (SELECT topic_id, key, coalesce(arg_max(id, place) FILTER (place.k < 2), arg_min(id, place) FILTER (place.k = 2)) AS id, min(place) AS place FROM e GROUP BY topic_id, key),
n AS (SELECT topic_id, name, {_SLUG.format('name')} AS slug FROM (SELECT p_brand AS topic_id, substr(p_name, 3, 9) AS name FROM part UNION SELECT p_brand, p_type FROM part)),
r AS (SELECT n.topic_id, n.name, x.id FROM n LEFT JOIN ix x ON x.topic_id = n.topic_id AND (contains(x.key, n.slug) OR contains(n.slug, x.key))
  QUALIFY row_number() OVER (PARTITION BY n.topic_id, n.name ORDER BY CASE WHEN x.key = n.slug THEN 0 ELSE 1 END, x.place) = 1)"""))
def resolve_names(spark, d):
    part = V.table(spark, d, "part")
    names = part.select(F.col("p_brand").alias("topic_id"), F.substring("p_name", 3, 9).alias("name"))
    names = names.union(part.select("p_brand", "p_type")).distinct()
    return N.resolve_names(names, V.concepts(spark, d))


@query(W("""SELECT topic_id AS cycle_id, arg_min(source_id, k) AS source_id, arg_min(target_id, k) AS target_id FROM (SELECT *, {'x': strength, 's': source_id, 't': target_id} AS k FROM (
SELECT a.topic_id, e.source_id, e.target_id, e.strength FROM (SELECT topic_id, list(source_id ORDER BY source_id, target_id)[1] AS a, list(target_id ORDER BY source_id, target_id)[1] AS b FROM edges_cyclic GROUP BY topic_id) a
JOIN edges_cyclic e ON (e.source_id = a.a AND e.target_id = a.b) OR (e.source_id = a.b AND e.target_id = a.a))) GROUP BY topic_id"""))
def weakest_edge(spark, d):
    e = V.edges_cyclic(spark, d)
    pair = e.groupBy("topic_id").agg(F.min(F.struct("source_id", "target_id")).alias("m"))
    cycles = pair.select(F.col("topic_id").alias("cycle_id"), F.array("m.source_id", "m.target_id").alias("nodes"))
    return G.weakest_edges(cycles, e)


@query()
def weakest_cycle_edge(spark, d):
    """The weakest edge of the cycle that detect_cycles finds in each topic."""
    e = written(V.edges_cyclic(spark, d))
    cycles = G.detect_cycles(V.concepts(spark, d), e).select(F.col("topic_id").alias("cycle_id"), "nodes")
    return G.weakest_edges(written(cycles), e)
