"""Names of concepts, as a model writes them, to concepts of the topic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import slugify, tokens
from trellis.operators.storage import written
from trellis.operators.tables import ranked

#: Keys or slugs of a shard.
SHARD = 20_000


def name_index(concepts: DataFrame, word_length: int = 4) -> DataFrame:
    """(topic_id, key, id, place): the keys under which a topic's concepts are found. Concepts
    count in the order of name and id. An id or the slug of a name belongs to the last concept
    that has it, a word of more than word_length letters to the first, unless it is an id or slug
    too. place is where a key first occurs."""
    words = F.filter(tokens(F.lower("name")), lambda w: F.length(w) > word_length)
    key = lambda k, kind, i: F.struct(k.alias("key"), F.lit(kind).alias("kind"), i.alias("i"))
    keys = F.concat(
        F.array(key(F.col("id"), 0, F.lit(0)), key(slugify(F.col("name")), 1, F.lit(0))),
        F.transform(words, lambda w, i: key(w, 2, i)),
    )
    rows = concepts.filter("name is not null").select("topic_id", "id", "name", F.explode(keys).alias("k"))
    at = F.struct("name", "id", "k.kind", "k.i")
    grouped = rows.groupBy("topic_id", F.col("k.key").alias("key")).agg(
        F.max(F.when(F.col("k.kind") < 2, at)).alias("last"), F.min(F.when(F.col("k.kind") == 2, at)).alias("first"), F.min(at).alias("place")
    )
    return grouped.select("topic_id", "key", F.coalesce("last.id", "first.id").alias("id"), "place")


def _searched(keys: pd.DataFrame, slugs: pd.DataFrame) -> pd.DataFrame:
    """The first key of a shard that each slug of another holds or lies in: one automaton over the keys
    reads every slug, one over the slugs every key, so the work follows the length of both."""
    import ahocorasick

    out: dict = {}
    if len(keys) and len(slugs):
        rank, names = keys["rank"].tolist(), keys["key"].tolist()
        of_key = dict(zip(names, rank, strict=True))
        sought = slugs["slug"].tolist()
        if "" in of_key:  # the empty key lies in every slug
            out = dict.fromkeys(sought, of_key[""])
        if "" in sought:  # and the empty slug in every key
            out[""] = min(rank)

        def automaton(words):
            a = ahocorasick.Automaton()
            for w in words:
                if w:
                    a.add_word(w, w)
            if len(a):
                a.make_automaton()
            return a

        inside = automaton(names)
        for slug in sought if len(inside) else ():
            for _, key in inside.iter(slug):
                if slug not in out or of_key[key] < out[slug]:
                    out[slug] = of_key[key]
        around = automaton(sought)
        for key, r in of_key.items() if len(around) else ():
            for _, slug in around.iter(key):
                if slug not in out or r < out[slug]:
                    out[slug] = r
    topic = slugs["topic_id"].iloc[0] if len(slugs) else None
    text = lambda values: pd.Series(values, dtype=object)  # noqa: E731  an empty column of strings too
    return pd.DataFrame({"topic_id": text([topic] * len(out)), "slug": text(list(out)), "rank": pd.Series(list(out.values()), dtype="int64")})


def resolve_names(names: DataFrame, concepts: DataFrame, shard: int = SHARD) -> DataFrame:
    """names (topic_id, name) with the id of the concept each one means: that of the key equal
    to its slug, else of the first key that contains the slug or lies in it, else null. Distinct slugs
    without an equal key are sought once; a topic's keys and slugs are dealt to shards of about
    `shard` each, by hash, and every pair of shards is one task's work."""
    index = written(ranked(name_index(concepts), ["place", "topic_id", "key"], "rank"))
    sought = names.select("topic_id", "name", slugify(F.col("name")).alias("slug"))
    slugs = written(sought.filter("slug is not null and topic_id is not null").select("topic_id", "slug").distinct())
    same = slugs.join(index.withColumnRenamed("key", "slug"), ["topic_id", "slug"]).select("topic_id", "slug", "id")
    rest = written(slugs.join(index.select("topic_id", F.col("key").alias("slug")), ["topic_id", "slug"], "left_anti"))
    size = lambda rows, name: rows.groupBy("topic_id").agg(F.ceil(F.count("*") / shard).cast("int").alias(name))
    plan = size(index, "keys").join(size(rest, "slugs"), "topic_id")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, "topic_id").select("topic_id", "key", "rank", part("key", "keys").alias("p"), every("slugs").alias("q"))
    right = rest.join(plan, "topic_id").select("topic_id", "slug", part("slug", "slugs").alias("q"), every("keys").alias("p"))
    by = ["topic_id", "p", "q"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searched, "topic_id string, slug string, rank long")
    best = found.groupBy("topic_id", "slug").agg(F.min("rank").alias("rank")).join(index.select("rank", "id"), "rank").select("topic_id", "slug", "id")
    return sought.join(same.unionByName(best), ["topic_id", "slug"], "left").select("topic_id", "name", "id")
