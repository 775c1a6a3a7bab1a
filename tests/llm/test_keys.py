"""Keys and columns that operators must not touch, final columns, and brute force where there is no SQL."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import decontamination, jaccard_join, language_id, packing, quality, sharding, suffix_dedup, token_counts
from trellis.llm.words import ALNUM, word_hashes

tokenizers = pytest.importorskip("public_tokenizers")
BIG = 2**60 + 1
NAMES = (
    "row doc tag at hot removed kept cut spans mark token place rep component n a b kind slice counts rid no k start length ids unit times nats chars level "
    "many spoken head words gram c share left score limit keep mean own_lang _bucket _at _start bucket shard slot grown_shard item_id alignments _tag _doc _spans"
).split()
own = np.random.default_rng(17)
VOCABULARY = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fo", "gu", "ha") for b in ("ra", "si", "to", "un", "ve", "wa", "xi", "yo", "za")]


def words(n):
    return " ".join(own.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(80)
    texts = [base, base, base + " end", words(60), None, "", words(3), words(400), words(60)]
    ids = [BIG, BIG, BIG + 2, None, None, 7, BIG + 4, BIG + 6, 5]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("x").alias(n) for n in NAMES))


def test_keys_and_columns_survive(spark, docs):
    keys = sorted((r.doc_id is None, r.doc_id) for r in docs.collect())

    def same(df):
        return sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect()) == keys

    labels = spark.createDataFrame([(BIG, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(BIG, words(30)), (None, docs.first().text)], "item_id long, text string")
    net = language_id.ByteNetwork(["de", "en"])
    assert same(language_id.predict(docs, net)) and same(token_counts.token_counts(docs, tokenizers.path("byte_bpe_50k.json"), chunk=200, overlap=40))
    assert same(jaccard_join.jaccard_components(docs)) and same(quality.classify(docs, labels)) and same(suffix_dedup.remove_repeats(docs))
    pieces = packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {k for _, k in keys}
    leaks = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert leaks == {(BIG, None), (BIG + 2, None)}
    shards = sharding.shard_records(docs, "doc_id", [1.0] * 4, order=["n_chars"])
    assert same(shards) and {r["_bucket"] for r in shards.collect()} == {"x"}
    for stage in (lambda: quality.keep_good(docs, labels), lambda: jaccard_join.keep_one(docs), lambda: suffix_dedup.without_repeats(docs), lambda: decontamination.decontaminate(docs, bench)):
        out = stage()
        assert out.schema.names == docs.schema.names and all(r["tag"] == "x" for r in out.collect())
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == {BIG, None, 7, BIG + 4, BIG + 6, 5}
    one = suffix_dedup.without_repeats(docs.filter("n_chars > 0"))
    assert all(r.n_chars == len(r.text) for r in one.collect())


def test_final_columns(spark, tmp_path):
    texts = [None, "", words(9), words(300), "é" * 30, words(9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
    for r in packing.op6_tiered_packing(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    seen = defaultdict(set)
    for r in sharding.op7_rendezvous_sharding(spark, str(tmp_path)).collect():
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key") and r.grown_shard in (r.shard, 40)
        seen[r.shard].add(r.slot)
    assert all(s == set(range(len(s))) for s in seen.values())
    for r in suffix_dedup.op5_suffix_dedup(spark, str(tmp_path)).collect():
        t = (texts[r.doc_id] or "").encode()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), 0, 0, hashlib.sha256(t).hexdigest())
    assert {r.doc_id: r.over_limit for r in token_counts.op3_token_counts(spark, str(tmp_path)).collect()} == dict.fromkeys(range(6), False)


def test_decontamination_against_every_alignment(spark):
    items = [words(n) for n in (12, 25, 40, 9)]
    texts = []
    for k in range(60):
        item = items[k % 4].split()
        cut = item[own.integers(0, 4) : len(item) - own.integers(0, 4)]
        for at in own.integers(0, len(cut), own.integers(0, 4)):
            cut[at] = "other"
        texts.append(f"{words(20)} {' '.join(cut)} {words(20)}" if k % 3 else words(70))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = word_hashes([t], ALNUM)[0]
        for i, item in enumerate(items):
            x, have, longest = word_hashes([item], ALNUM)[0], set(), 0
            for start in range(1 - len(x), len(w)):
                a, b = max(0, -start), min(len(x), len(w) - start)
                equal = w[start + a : start + b] == x[a:b]
                seeds = any(all(equal[s + j] for j, c in enumerate(m) if c == "1") for m in decontamination.MASKS for s in range(len(equal) - len(m.rstrip("0")) + 1))
                if seeds:
                    p, q = decontamination.best_run(equal)
                    have |= {a + p + j for j in np.flatnonzero(equal[p:q]).tolist()}
                    longest = max(longest, int(equal[p:q].sum()))
            if longest >= 13 or (len(have) >= 0.5 * len(x) and len(have) >= min(8, len(x))):
                want.add((d, i))
    assert got == want and 20 < len(want) < 60


def test_held_out_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    net = language_id.learn(df.filter(~held))
    rows = language_id.predict(df.filter(held), net).join(df.select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_pipeline_against_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    kept = docs
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        left.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert left[0] > left[1] == left[2] > left[3] and left[0] <= set(ids)
    rejected = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("not keep").collect()}
    assert left[0] == set(ids) - rejected
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == left[3]
    lengths = defaultdict(int)
    for r in out:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in out)


def test_pipeline_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns), name
