"""Steps that are taken once, and patterns that stand for several steps."""

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from trellis.functions import text as X
from trellis.jobs import registry
from trellis.jobs import views as V
from trellis.operators import build as B
from trellis.operators import extract as E

SMALL = "/root/testdata/sf0.001"


def test_phrases_by_one_pattern(spark):
    texts = [
        ("en", "The the cat sat"), ("en", "a b | c d, the e f"), ("en", "some any river"), ("en", "one two three four five six seven"),
        ("en", "every one two three four five six"), ("en", "key role. Key role model\tof  bay"), ("de", "these der die these, große Straße über Nacht"),
        ("xx", "its"), ("en", ""), ("en", " . "), ("en", None),
    ]
    docs = spark.createDataFrame([Row(k=k, lang=lang, text=text) for k, (lang, text) in enumerate(texts)], "k long, lang string, text string")
    found = {}
    for r in X.phrase_candidates(docs, "text", "lang").collect():
        found.setdefault(r["k"], set()).add(r["name"])
    assert found == {0: {"cat sat"}, 1: {"c d", "e f"}, 2: {"any river"}, 4: {"one two three four five six"}, 5: {"key role model"}, 6: {"große straße über nacht"}}


def test_plain_slugs(spark):
    names = ["two words", "Two  Words", " led", "é à la", "a-b c", "x\n", "", "straße 7", None]
    rows = spark.createDataFrame([Row(name=n) for n in names], "name string").select(X.slugify(F.col("name"))).collect()
    assert [r[0] for r in rows] == ["two-words", "two-words", "led", "e-a-la", "a-b-c", "x", "", "strae-7", None]


def test_slugs_of_long_texts(spark):
    words = ["word"] * 200_000
    rows = spark.createDataFrame([Row(name=" ".join(words)), Row(name=" ".join(words) + " é ")], "name string").select(X.slugify(F.col("name"))).collect()
    assert [r[0] for r in rows] == ["-".join(words), "-".join([*words, "e"])]


def test_slug_queries_on_long_texts(spark, tmp_path):
    texts = [(1, "word " * 100_000 + "end"), (2, "a b"), (3, " É " * 100_000), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()["slugify_names"] + " ORDER BY doc_id").fetchall()
    assert len(want[0][1]) == 500_003
    for name in ("slugify_texts", "slugify_names"):
        assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == want


def test_candidates_are_made_once(spark, monkeypatch):
    calls, made = [], E.frequent_candidates
    monkeypatch.setattr(E, "frequent_candidates", lambda *a, **k: calls.append(1) or made(*a, **k))
    registry.queries()["extract_concepts"](spark, SMALL)
    assert len(calls) == 1


def test_responses_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x

    raw = spark.createDataFrame([("t", 1, 0, "red", "blue", 1.0, "")], "topic_id string, batch long, pos long, source string, target string, strength double, rationale string")
    raw = raw.withColumn("source", F.udf(tell, "string").asNondeterministic()("source"))
    plan = spark.createDataFrame([("t", "a", "red", 1), ("t", "b", "blue", 1)], "topic_id string, id string, name string, batch long")
    assert [tuple(r)[3:5] for r in B.resolved_edges(raw, plan).collect()] == [("a", "b")]
    assert seen.value == 1


def test_lines_are_joined_to_parts_once(spark, tmp_path, monkeypatch):
    """Lines that could make no edge are gone before lines are paired; nulls and repeats make none, as in SQL."""
    d = str(tmp_path)
    lines = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 1), (2, 1, 2), (2, 2, 1), (3, 1, 1), (4, 1, 4), (4, 2, 1), (5, 1, 5), (5, 2, 5), (None, 1, 1), (None, 2, 2), (6, None, 1), (6, 2, 2), (7, 1, 9), (7, 2, 1), (8, 1, None), (8, 2, 2), (9, 1, 6), (9, 2, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    parts = [(1, "x", "B1", 1), (2, "y", "B1", 2), (3, "z", "B2", 3), (4, "u", None, 4), (5, "v", None, 2), (6, "w", "B1", None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    duck = duckdb.connect()
    for name in ("lineitem", "part", "documents"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'" if name != "documents" else "CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
    tables, plain = [], V.written
    monkeypatch.setattr(V, "written", lambda df: tables.append(plain(df)) or tables[-1])
    for name, view in (("edges", V.edges), ("edges_cyclic", V.edges_cyclic)):
        want = duck.sql(V.with_views(f"SELECT source_id, target_id, topic_id, strength FROM {name} ORDER BY ALL")).fetchall()
        got = view(spark, d)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 0
        assert got.schema.simpleString() == "struct<source_id:string,target_id:string,topic_id:string,strength:float>"
    assert {r[0] for r in tables[0].select("l_orderkey").collect()} == {1, 2, 6, 9}
