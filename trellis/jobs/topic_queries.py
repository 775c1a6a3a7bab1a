"""Queries about topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.jobs import views as V
from trellis.jobs.register import query
from trellis.operators import graph as G
from trellis.operators import topics as T


def _ids(spark, d):
    return V.table(spark, d, "part").select(F.concat_ws("-", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("id"))


@query("""WITH i AS (SELECT DISTINCT lower(p_type) || '-' || replace(p_name, ' ', '-') AS id FROM part), w AS (SELECT id, string_split(id, '-') AS w FROM i)
SELECT id, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS name, replace(id, '-', ' ') AS query, regexp_replace('t/' || id, '[^a-zA-Z0-9_-]', '', 'g') AS safe,
CASE WHEN length(w[3]) > length(w[2]) THEN upper(w[1][1]) || w[1][2:] || ' ' || upper(w[3][1]) || w[3][2:] || ' ' || upper(w[2][1]) || w[2][2:]
ELSE array_to_string(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: upper(x[1]) || x[2:]), ' ') END AS words FROM w""")
def topic_rows(spark, d):
    i = F.col("id")
    words = F.array_join(T.search_words(T.topic_query(i)), " ")
    return _ids(spark, d).distinct().select("id", T.topic_name(i).alias("name"), T.topic_query(i).alias("query"), T.safe_id(F.concat(F.lit("t/"), i)).alias("safe"), words.alias("words"))


@query("""WITH t AS (SELECT p_brand AS id, max(p_name) AS name FROM part WHERE p_size > 25 GROUP BY p_brand UNION ALL SELECT DISTINCT 'spare-parts', 'Old' FROM part),
a AS (SELECT id, name FROM t UNION ALL SELECT DISTINCT p_brand, p_brand FROM part WHERE p_brand NOT IN (SELECT id FROM t)
UNION ALL SELECT DISTINCT 'all-' || lower(p_type), 'All ' || upper(p_type[1]) || lower(p_type[2:]) FROM part)
SELECT id, name, CAST((SELECT count(*) FROM part WHERE p_brand = a.id) AS BIGINT) AS concept_count FROM a""")
def topics_ensured(spark, d):
    p = V.table(spark, d, "part")
    old = p.filter("p_size > 25").groupBy(F.col("p_brand").alias("id")).agg(F.max("p_name").alias("name")).withColumn("concept_count", F.lit(-1).cast("long"))
    old = old.unionByName(p.select(F.lit("spare-parts").alias("id"), F.lit("Old").alias("name"), F.lit(5).cast("long").alias("concept_count")).distinct())
    ids = p.select(F.col("p_brand").alias("id")).union(p.select(F.concat(F.lit("all-"), F.lower("p_type")))).union(p.select(F.lit("spare-parts")))
    return T.count_concepts(T.ensure_topics(old, ids), V.concepts(spark, d))


@query(V.with_views("""SELECT topic_id, id, name, array_to_string(list_sort(list_distinct(coalesce((SELECT list(source_id) FROM edges e WHERE e.target_id = c.id), []))), ' ') AS prerequisites,
array_to_string(list_sort(list_distinct(coalesce((SELECT list(target_id) FROM edges e WHERE e.source_id = c.id), []))), ' ') AS dependents FROM concepts c"""))
def concept_pages(spark, d):
    pages = T.concept_pages(V.concepts(spark, d).select("topic_id", "id", "name"), V.edges(spark, d))
    return pages.select("topic_id", "id", "name", F.array_join("prerequisites", " ").alias("prerequisites"), F.array_join("dependents", " ").alias("dependents"))


_RESET = "gone AS (SELECT p_brand AS topic_id FROM part GROUP BY p_brand HAVING count(*) % 2 = 0)"


@query(V.with_views("""SELECT 'concepts' AS part, topic_id AS key, CAST(count(*) AS BIGINT) AS n FROM concepts WHERE topic_id NOT IN (SELECT topic_id FROM gone) GROUP BY topic_id
UNION ALL SELECT 'edges', topic_id, count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM concepts WHERE topic_id IN (SELECT topic_id FROM gone)) GROUP BY topic_id
UNION ALL SELECT 'progress', topic_id, count(*) FROM progress WHERE topic_id NOT IN (SELECT topic_id FROM gone) GROUP BY topic_id
UNION ALL SELECT 'topics', topic_id, CASE WHEN topic_id IN (SELECT topic_id FROM gone) THEN 0 ELSE count(*) END FROM concepts GROUP BY topic_id""", _RESET))
def reset_cascade(spark, d):
    c = V.concepts(spark, d)
    gone = c.groupBy("topic_id").agg(F.count("*").alias("n")).filter("n % 2 = 0")
    topics = c.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("concept_count"))
    out = T.reset_topics({"concepts": c, "edges": V.edges(spark, d), "progress": V.progress(spark, d), "topics": topics}, gone)
    rows = out["topics"].select(F.lit("topics").alias("part"), F.col("id").alias("key"), F.col("concept_count").alias("n"))
    for name in ("concepts", "edges", "progress"):
        rows = rows.unionByName(out[name].groupBy(F.col("topic_id").alias("key")).agg(F.count("*").alias("n")).withColumn("part", F.lit(name)))
    return rows


@query(V.with_views("""SELECT topic_id, layer, 'Layer ' || (layer + 1) AS label, CAST(count(*) AS BIGINT) AS concepts, CAST(max(max(layer)) OVER (PARTITION BY topic_id) + 1 AS BIGINT) AS layers
FROM (SELECT c.topic_id, c.id, CAST(coalesce(max(w.n), 0) AS BIGINT) AS layer FROM concepts c LEFT JOIN walk w ON w.id = c.id GROUP BY ALL) GROUP BY topic_id, layer""",
"walk AS (SELECT target_id AS id, 1 AS n FROM edges UNION SELECT e.target_id, w.n + 1 FROM walk w JOIN edges e ON e.source_id = w.id)", True))
def layer_labels(spark, d):
    return T.layer_labels(G.layers(V.concepts(spark, d), V.edges(spark, d))[0])


@query(V.with_views("SELECT topic_id, id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY difficulty, name, id) AS BIGINT) AS by_difficulty, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY name, id) AS BIGINT) AS by_name FROM concepts"))
def concept_orders(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("topic_id")
    return V.concepts(spark, d).select("topic_id", "id", F.row_number().over(w.orderBy("difficulty", "name", "id")).cast("long").alias("by_difficulty"), F.row_number().over(w.orderBy("name", "id")).cast("long").alias("by_name"))


@query("""SELECT lang AS topic_id, CAST(count(*) AS BIGINT) AS materials, CAST(count(*) FILTER (length(text) > 200) AS BIGINT) AS long, CAST(coalesce(max(length(text)), 0) AS BIGINT) AS longest, CASE WHEN count(*) FILTER (length(text) > 200) >= 5 THEN 2 ELSE 1 END AS least_docs FROM documents GROUP BY lang""")
def material_counts(spark, d):
    n = F.length("content")
    long = F.count(F.when(n > 200, True))
    return V.raw_materials(spark, d).groupBy("topic_id").agg(
        F.count("*").alias("materials"), long.alias("long"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("longest"), F.when(long >= 5, 2).otherwise(1).alias("least_docs")
    )


@query("""SELECT CAST(row_number() OVER (ORDER BY name, id) AS BIGINT) AS place, id, name, status, CAST(coalesce(n, 0) AS BIGINT) AS concept_count FROM (
SELECT p_brand AS id, max(p_name) AS name, CASE WHEN count(*) % 2 = 0 THEN 'ready' ELSE 'building' END AS status, CASE WHEN count(*) % 3 > 0 THEN count(*) END AS n FROM part GROUP BY p_brand)""")
def topic_listing(spark, d):
    n = F.count("*")
    t = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.max("p_name").alias("name"), F.when(n % 2 == 0, "ready").otherwise("building").alias("status"), F.when(n % 3 > 0, n).alias("concept_count"))
    return T.topic_list(t)


@query("""SELECT id, CASE WHEN n % 2 = 0 THEN 'ready' ELSE 'building' END AS status, CASE WHEN n % 2 = 0 THEN 1700000000 ELSE 1600000000 END AS updated_at FROM (SELECT p_brand AS id, count(*) AS n FROM part GROUP BY p_brand)""")
def topics_touched(spark, d):
    p = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("n"))
    t = p.select("id", F.lit("building").alias("status"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("updated_at"))
    return T.touched(t, p.filter("n % 2 = 0"), "ready", F.timestamp_seconds(F.lit(1_700_000_000))).select("id", "status", F.unix_timestamp("updated_at").cast("int").alias("updated_at"))


@query(V.with_views("""SELECT topic_id, CAST(max(layer) + 1 AS BIGINT) AS layers, CAST(count(*) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM edges e WHERE e.topic_id = l.topic_id) AS BIGINT) AS edges
FROM (SELECT c.topic_id, c.id, coalesce(max(w.n), 0) AS layer FROM concepts c LEFT JOIN walk w ON w.id = c.id GROUP BY ALL) l GROUP BY topic_id""",
"walk AS (SELECT target_id AS id, 1 AS n FROM edges UNION SELECT e.target_id, w.n + 1 FROM walk w JOIN edges e ON e.source_id = w.id)", True))
def graph_counts(spark, d):
    e = V.edges(spark, d)
    return T.graph_counts(G.layers(V.concepts(spark, d), e)[0], e)


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS preview FROM documents""")
def previews(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))
