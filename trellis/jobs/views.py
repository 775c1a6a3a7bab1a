"""The domain's tables derived from the given ones, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.operators.storage import written

_SIZE = "CAST(1 + (p_size - 1) % 5 AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_materials(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("lang").alias("topic_id"), "source", F.col("text").alias("content")
    )


def phrases(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, n, name): candidate phrases of all documents, whole texts in all languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"), "text")
    return X.phrase_candidates(docs, "text", "lang")


def phrases_sql() -> str:
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    stops = " ".join(f"WHEN '{k}' THEN [{quoted(w)}]" for k, w in X.STOP_WORDS.items() if k != "en")
    return f"""w AS (SELECT doc_id, lang, length(text) AS n, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\s]+', ' | ', 'g'), '\\s+', ' ', 'g')), ' ') AS w,
  CASE lang {stops} ELSE [{quoted(X.STOP_WORDS["en"])}] END AS stop FROM documents),
parts AS (SELECT DISTINCT doc_id, lang, n, regexp_replace(trim(unnest(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN list_contains(stop, x) THEN '|' ELSE x END), ' '), '|'))), '(?i)^({"|".join(X.DETERMINERS)})\\s+', '') AS name FROM w),
phrases AS (SELECT doc_id, lang, n, name FROM (SELECT *, string_split(name, ' ') AS p FROM parts WHERE name <> '') WHERE len(p) BETWEEN 2 AND 6 AND NOT (len(p) = 2 AND p[1] IN ({quoted(X.GENERIC_LEADS)}) AND p[2] IN ({quoted(X.GENERIC_TAILS)})))"""


def concepts(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" systems"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("topic_id"), name.alias("name"),
        F.expr(_SIZE).alias("difficulty"),
    )


def bought_together(spark, sf_dir) -> DataFrame:
    """(l_orderkey, l_linenumber, part, topic_id, difficulty) of the lines whose order has another line of
    their topic, as a table: few lines are left to be paired, and lines are shuffled once, by numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part")).filter("l_orderkey is not null")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("topic_id"), F.expr(_SIZE).alias("difficulty"))
    bought = lines.join(parts, "part").filter("topic_id is not null")
    many = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "topic_id"))
    return written(bought.withColumn("many", many).filter("many > 1").drop("many"))


def _edges(spark, sf_dir, rising: bool) -> DataFrame:
    bought = bought_together(spark, sf_dir)
    a, b = bought.alias("a"), bought.alias("b")
    order = F.col("a.difficulty") < F.col("b.difficulty") if rising else (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.part") != F.col("b.part"))
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.topic_id") == F.col("b.topic_id")) & order)
    once = pairs.groupBy(F.col("a.part").alias("source"), F.col("b.part").alias("target"), F.col("a.topic_id").alias("topic_id")).agg(
        F.least(F.lit(1.0), F.count("*") / 3.0).cast("float").alias("strength")
    )
    return once.select(F.concat(F.lit("part-"), F.col("source")).alias("source_id"), F.concat(F.lit("part-"), F.col("target")).alias("target_id"), "topic_id", "strength")


def edges(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir, True)


def edges_cyclic(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir, False)


def progress(spark, sf_dir) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("r", F.lit(True))
    parts = table(spark, sf_dir, "part").join(returned, "p_partkey", "left")
    status = F.when(F.col("p_partkey") % 3 == 0, "mastered").when((F.col("p_partkey") % 3 == 1) & F.col("r"), "in_progress")
    return parts.select(F.col("p_brand").alias("topic_id"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("concept_id"), status.alias("status")).filter("status is not null")


SQL = """raw_materials AS (SELECT 'doc-' || doc_id AS id, lang AS topic_id, source, text AS content FROM documents),
concepts AS (SELECT 'part-' || p_partkey AS id, p_brand AS topic_id, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' systems' ELSE '' END AS name,
  CAST(1 + (p_size - 1) % 5 AS INT) AS difficulty FROM part),
bought AS (SELECT l_orderkey, l_linenumber, c.id, topic_id, difficulty FROM lineitem JOIN concepts c ON c.id = 'part-' || l_partkey),
edges AS (SELECT a.id AS source_id, b.id AS target_id, a.topic_id, CAST(least(1.0, count(*) / 3.0) AS FLOAT) AS strength
  FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.topic_id = b.topic_id AND a.difficulty < b.difficulty GROUP BY ALL),
edges_cyclic AS (SELECT a.id AS source_id, b.id AS target_id, a.topic_id, CAST(least(1.0, count(*) / 3.0) AS FLOAT) AS strength
  FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.topic_id = b.topic_id AND a.l_linenumber < b.l_linenumber AND a.id <> b.id GROUP BY ALL),
progress AS (SELECT p_brand AS topic_id, 'part-' || p_partkey AS concept_id, CASE WHEN p_partkey % 3 = 0 THEN 'mastered' ELSE 'in_progress' END AS status
  FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')))"""


def with_views(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{', ' + more if more else ''} {body}"
