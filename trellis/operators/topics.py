"""Topics: rows, counts, reset, one concept's page, layer labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import tokens
from trellis.operators.tables import insert_or_ignore, ranked


def topic_query(topic_id: Column) -> Column:
    return F.replace(topic_id, F.lit("-"), F.lit(" "))


def topic_name(topic_id: Column) -> Column:
    """Words of the id, each with its first letter up and the others down."""
    return F.initcap(topic_query(topic_id))


def safe_id(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "")


def search_words(topic: Column, most: int = 5, least: int = 3) -> Column:
    """The first `most` words of `least` letters: the first one, then the others by falling length,
    equal ones in their order, each with its first letter up and the rest down."""
    words = F.slice(F.filter(tokens(topic), lambda w: F.length(w) >= least), 1, most)
    rest = F.transform(F.slice(words, 2, most), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    ordered = F.concat(F.slice(words, 1, 1), F.transform(F.array_sort(rest), lambda x: x["w"]))
    return F.transform(ordered, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))


def ensure_topics(topics: DataFrame, ids: DataFrame) -> DataFrame:
    """topics (id, name, concept_count) with those ids that were not there, named after the id."""
    new = ids.select("id").distinct().select("id", topic_name(F.col("id")).alias("name"), F.lit(0).cast("long").alias("concept_count"))
    return insert_or_ignore(topics, new, ["id"], ["name"])


def count_concepts(topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """topics with concept_count as it is now; topics without concepts have 0."""
    n = concepts.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("now"))
    return topics.join(n, "id", "left").select(*[F.coalesce("now", F.lit(0)).alias(c) if c == "concept_count" else F.col(c) for c in topics.columns])


def reset_topics(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after the topics in gone (topic_id) are reset: their quiz rows, progress, concepts
    and materials go, with the edges that leave one of their concepts; the topic stays with a
    count of 0; the cache, which no topic owns, is emptied. tables may lack some of quiz, progress,
    edges, concepts, topics, materials, cache."""
    gone, out = gone.select("topic_id").distinct(), dict(tables)
    for name in ("quiz", "progress", "concepts", "materials"):
        if name in tables:
            out[name] = tables[name].join(gone, "topic_id", "left_anti")
    if "edges" in tables:
        own = tables["concepts"].join(gone, "topic_id", "left_semi").select(F.col("id").alias("source_id"))
        out["edges"] = tables["edges"].join(own, "source_id", "left_anti").select(tables["edges"].columns)
    if "topics" in tables:
        reset = gone.select(F.col("topic_id").alias("id"), F.lit(True).alias("reset"))
        t = tables["topics"].join(reset, "id", "left")
        out["topics"] = t.select(*[F.when(F.col("reset"), 0).otherwise(F.col(c)).alias(c) if c == "concept_count" else F.col(c) for c in tables["topics"].columns])
    if "cache" in tables:
        out["cache"] = tables["cache"].limit(0)
    return out


def concept_pages(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every concept with its direct prerequisites and dependents, sorted by id; [] for none."""
    before = edges.groupBy("topic_id", F.col("target_id").alias("id")).agg(F.sort_array(F.collect_set("source_id")).alias("prerequisites"))
    after = edges.groupBy("topic_id", F.col("source_id").alias("id")).agg(F.sort_array(F.collect_set("target_id")).alias("dependents"))
    none = F.array().cast("array<string>")
    out = concepts.join(before, ["topic_id", "id"], "left").join(after, ["topic_id", "id"], "left")
    return out.select(*concepts.columns, F.coalesce("prerequisites", none).alias("prerequisites"), F.coalesce("dependents", none).alias("dependents"))


def layer_labels(levels: DataFrame) -> DataFrame:
    """(topic_id, layer, label, concepts, layers) of levels (topic_id, id, layer): a row for each layer,
    with the number of its concepts and of the topic's layers."""
    n = levels.groupBy("topic_id", "layer").agg(F.count("*").alias("concepts"))
    most = n.groupBy("topic_id").agg((F.max("layer") + 1).alias("layers"))
    return n.join(most, "topic_id").select("topic_id", "layer", F.concat(F.lit("Layer "), (F.col("layer") + 1).cast("string")).alias("label"), "concepts", "layers")


def topic_list(topics: DataFrame) -> DataFrame:
    """(place, id, name, status, concept_count) of topics by name and id, from 1; a missing count is 0."""
    rows = ranked(topics.select("id", "name", "status", F.coalesce("concept_count", F.lit(0)).cast("long").alias("concept_count")), ["name", "id"], "place")
    return rows.select((F.col("place") + 1).alias("place"), "id", "name", "status", "concept_count")


def touched(topics: DataFrame, changed: DataFrame, status: str, at: Column | None = None) -> DataFrame:
    """topics with the status and updated_at, by default now, of those in changed (id)."""
    mark = changed.select("id").distinct().withColumn("_changed", F.lit(True))
    now = F.current_timestamp() if at is None else at
    t = topics.join(mark, "id", "left")
    new = {"status": F.lit(status), "updated_at": now}
    return t.select(*[F.when(F.col("_changed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in topics.columns])


def graph_counts(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic_id, layers, nodes, edges) of levels (topic_id, id, layer) and the edges between them."""
    n = levels.groupBy("topic_id").agg((F.max("layer") + 1).alias("layers"), F.count("*").alias("nodes"))
    e = edges.groupBy("topic_id").agg(F.count("*").alias("edges"))
    return n.join(e, "topic_id", "left").select("topic_id", "layers", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
