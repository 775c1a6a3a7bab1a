"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

from trellis.jobs import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/**/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(names).collect()) == want


def test_merge_leaves_no_document_out(spark):
    got = registry.queries()["materials_union_merge_whole"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert Counter(r.id for r in got.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.batch for r in got.collect()} == {"first", "second"}


def test_slugs_and_capitals_of_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}

    def slug(t):
        plain = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return re.sub(r"\s+", "-", re.sub(r"[^a-z0-9\s-]", "", plain, flags=re.A).strip(" \t\n\r\f\v"), flags=re.A)

    def capital(w):
        return w if w == w.upper() and w != w.lower() else w[:1].upper() + w[1:].lower()

    words = {i: re.findall(r"\S+", t.replace("ß", "ss"), flags=re.A) for i, t in texts.items() if t is not None}
    assert any(len(t) > 200 for t in texts.values() if t)
    got = {r.doc_id: r.slug for r in registry.queries()["slugify_texts"](spark, DATA).collect()}
    assert got == {i: None if t is None else slug(t) for i, t in texts.items()}
    got = {r.doc_id: (r.words, r.name) for r in registry.queries()["capitalise_texts"](spark, DATA).collect()}
    assert all(got[i] == (len(w), " ".join(map(capital, w))) for i, w in words.items()) and got.keys() == texts.keys()
