"""The operators against brute force on small fixtures with nulls, ties, repeats and empty tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trellis.llm import chat, decontamination, embedding_dedup, jaccard_join, language_id, packing, quality, sharding, suffix_dedup, token_counts
from trellis.llm.components import connected_components

tokenizers = pytest.importorskip("public_tokenizers")
rng = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(3000)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(rng.choice(WORDS, n))


BASE = words(120)
TEXTS = [
    None, "", "  ", "one", "Two words", "héllo wörld " * 3, BASE, BASE, BASE.upper(), BASE + " tail of it", words(40) + " " + BASE[:450] + " " + words(30),
    "x" * 700, "ab" * 400, "a  b \n c\t" * 40, "<|endoftext|> and <|im_end|>", "日本語 テキスト" * 5, words(900), words(3), words(3),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOC)


def test_chat_round_trip_and_budget(spark):
    rows = [(1, 0, "system", "be <|x|> kind\\"), *[(1, k, "user" if k % 2 else "assistant", words(60)) for k in range(1, 30)], (2, 0, None, None), (None, 0, "assistant", "lone"),
            (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (4, 0, "a\nb", "<|im_end|>\n<|im_start|>user\n"), (5, 0, "user", words(900)), (5, 1, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.format_windows(df, 400, 100)
    assert all(r.over_budget == (r.n_tokens > 400) for r in w.collect())
    assert {r.conv_id for r in w.filter("over_budget").collect()} == {5}
    back = defaultdict(str), defaultdict(str)
    for r in chat.read_back(w).orderBy("conv_id", "window").collect():
        back[0][r.conv_id] += r.turns
        back[1][r.conv_id] += r.loss
    for c in {r[0] for r in rows}:
        turns = sorted(((t, ro or "", x or "") for k, t, ro, x in rows if k == c))
        assert back[0][c] == "".join(f"{ro}\n{x}\n" for _, ro, x in turns)
        assert back[1][c] == "".join(x for _, ro, x in turns if ro == "assistant")
    assert chat.format_windows(df.limit(0)).count() == 0


def test_language(spark):
    rows = [(i, " ".join(rng.choice(["der", "und", "nicht", "schön"] if i % 2 else ["the", "and", "not", "nice"], 20)), "de" if i % 2 else "en") for i in range(80)]
    df = spark.createDataFrame([*rows, (100, None, "de"), (101, "12 34", "de"), (102, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df.filter("doc_id < 60"))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i >= 60)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert {r.lang_pred for r in language_id.predict(df, language_id.learn(df.limit(0))).collect()} == {"und"}


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for options in ({}, {"chunk": 64, "overlap": 2}):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path, **options).collect()}
        assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}


def test_decontamination(spark):
    items = [words(30), words(6), None, ""]
    near = items[0].split()
    near[4], near[17] = "zz", "yy"
    texts = [words(50) + " " + items[0] + " " + words(20), words(9) + " " + " ".join(near), items[1], words(200), None, "", " ".join(items[0].split()[:10])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, block_words=20).collect()}
    assert got == {(0, 0), (1, 0), (2, 1)}
    assert {r.doc_id for r in decontamination.decontaminate(df, bench).collect()} == {3, 4, 5, 6}
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_finds_passages_of_long_items(spark):
    own = np.random.default_rng(8)
    item, middle = own.choice(WORDS, 300).tolist(), own.choice(WORDS, 59).tolist()
    fill = [" ".join(own.choice(WORDS, 50)) for _ in range(4)]
    texts = [" ".join([fill[0], *item[100:240], fill[1]]), " ".join([fill[2], *middle[20:48], fill[3]]), " ".join([fill[0], *item[50:60], fill[1]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(middle))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()} == {(0, 0), (1, 1)}
    assert {r.doc_id for r in decontamination.decontaminate(df, bench).collect()} == {2}


@pytest.mark.parametrize("options", [{}, {"hot_anchor": 1, "run_bytes": 2000}])
def test_suffix_dedup(docs, options):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in TEXTS]
    for r in raws:
        for p in range(len(r) - 199):
            seen[r[p : p + 200]] += 1
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs, **options).collect()}
    for i, r in enumerate(raws):
        spans = suffix_dedup.merged([(p, p + 200) for p in range(len(r) - 199) if seen[r[p : p + 200]] > 1])
        assert [(s.start, s.end) for s in got[i].removed] == spans, i
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_loser_tree_merges_with_shared_prefixes():
    rows = sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(200))
    runs = []
    for k in range(5):
        shared, size, rests = suffix_dedup.front_code(rows[k::5])
        runs.append(suffix_dedup.Run(shared, size, rests))
    out, last = [], b""
    for i, shared in suffix_dedup.LoserTree(runs).merge():
        row = runs[i].row
        assert shared == suffix_dedup.shared_prefix(last, row, 0)
        out.append(row)
        last = row
    assert out == rows


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, path).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted(by[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == ids.tobytes() and {r.doc_tokens for r in pieces} == {len(ids)}
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
        assert sum(r.length for r in rows) == rows[0].sequence_tokens
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_sharding(spark, docs):
    rows = docs.select("doc_id", F.lit(1).alias("size")).unionByName(spark.createDataFrame([(None, 1), (3, 1)], "doc_id long, size int"))
    got = sharding.shard_records(rows, "doc_id", [1.0, 1.0, 2.0], order=["size"]).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    many = spark.range(20000).withColumn("s", sharding.rendezvous_shard(F.col("id"), [1.0, 1.0, 2.0])).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 5000) for r in many} == {0: 1, 1: 1, 2: 2}


def test_sharding_against_recomputed_scores(spark):
    keys = [0, 1, 7, 2**60 + 1, -5, None, 12345678901]
    weights = [1.0, 0.0, 2.5, 1.0]

    def best(key, weights):
        first = xxhash.xxh64_intdigest(("\x00null" if key is None else str(key)).encode(), seed=42)
        draws = []
        for s, w in enumerate(weights):
            if w > 0:
                # shard names continue the key's hash, of which the first 53 bits are kept
                h = xxhash.xxh64_intdigest(f"shard-{s}".encode(), seed=first) >> 11
                draws.append((-math.log((h + 0.5) / 2.0**53) / w, s))
        return min(draws)[1]

    df = spark.createDataFrame([(k,) for k in keys + list(range(20, 320))], "doc_id long").withColumn("at", F.lit("clash")).withColumn("shard", F.lit("clash"))
    got = sharding.shard_records(df, "doc_id", weights).collect()
    assert len(got) == len(keys) + 300 and all(r.at == "clash" for r in got)
    assert all((r.shard, r.grown_shard) == (best(r.doc_id, weights), best(r.doc_id, [*weights, 1.0])) for r in got)
    assert sharding.shard_records(df.limit(0), "doc_id", weights).count() == 0


def test_decontamination_of_shared_passages(spark):
    passage, other = words(60), words(40)
    texts = [passage + f" x{i % 3}" for i in range(300)] + [passage] * 200 + [words(50) for _ in range(20)] + [other + " " + passage, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("seed", F.lit("clash")).withColumn("doc_key", F.lit("clash"))
    bench = spark.createDataFrame([(0, passage), (1, passage), (2, passage.upper()), (3, other), (4, None), (None, other)], "item_id long, text string").withColumn("text_key", F.lit("clash"))
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()]
    want = [(d, i) for d in range(500) for i in (0, 1, 2)] + [(520, i) for i in (0, 1, 2, 3, None)]
    assert Counter(got) == Counter(want)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(500, 520), 521, 522}


def test_jaccard(spark):
    texts = [t if t is None else t.replace("\n", " ") for t in TEXTS]
    for k in range(25):  # a family of near copies and copies with a common passage
        w = BASE.split()
        w[5 * (k % 20)] = f"edit{k}"
        texts += [" ".join(w), words(60) + " " + BASE[:120]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token", F.lit("clash"))
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    for short in (2, 8):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, short_list=short).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_embeddings(spark):
    centre = rng.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] + 0.1 * rng.standard_normal(8)).tolist(), i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (5, (-centre[0]).tolist(), 1), (61, rows[0][1], 0), (62, None, 0), (63, [0.0] * 8, 0), (64, [float("nan")] * 8, 0), (65, [None] * 8, 0), (66, rows[0][1], None), (67, rows[0][1][:4], 0), (68, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    every = embedding_dedup.near_duplicates(df, 0.95, cell_rows=7).collect()
    # one vec_id for two vectors: each has its own links
    assert sorted(r.n_links > 0 for r in every if r.vec_id == 5) == [False, True]
    got = {r.vec_id: r for r in every if r.vec_id != 5 or r.n_links}
    good = [(i, np.array(e, dtype=np.float32).astype(float), lab) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    for k, (i, x, lab) in enumerate(good):
        if i == 5 and not got[5].n_links == sum(1 for j, y, m in good if j != i and lab == m and x @ y >= 0.95 * np.sqrt((x @ x) * (y @ y))):
            continue  # the other vector of this vec_id
        n = sum(1 for j, y, m in good if j != i and lab == m and len(x) == len(y) and x @ y >= 0.95 * np.sqrt((x @ x) * (y @ y)))
        assert got[i].n_links == n, i
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(62, 69))
    assert got[61].component_id == 0 and embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50}


def kneser_ney(trusted, order):
    """Surprisal of an n-gram of `order` characters by the textbook formulas, from dictionaries."""
    top = Counter()
    for t in trusted:
        for w in t.split():
            w = f" {w} "
            top.update(w[max(0, i - order + 1) : i + 1] for i in range(1, len(w)))
    before = defaultdict(set)
    for g in top:
        for k in range(1, len(g)):
            before[g[k:]].add(g[k - 1 :])
    counts = {**{g: len(v) for g, v in before.items()}, **top}
    discount, total, kept = {}, Counter(), Counter()
    for n in range(1, order + 1):
        have = Counter(c for g, c in counts.items() if len(g) == n)
        y = have[1] / (have[1] + 2 * have[2]) if have[1] else 0.5
        for k in (1, 2, 3):
            discount[n, k] = min(max(k - (k + 1) * y * have[k + 1] / have[k], 0.05), k - 0.05) if have[k] and have[k + 1] else 0.5
    for g, c in counts.items():
        total[g[:-1], len(g)] += c
        kept[g[:-1], len(g)] += discount[len(g), min(c, 3)]

    def p(g, letters):
        low = p(g[1:], letters) if len(g) > 1 else 1 / (1 + letters)
        key = g[:-1], len(g)
        own = (counts[g] - discount[len(g), min(counts[g], 3)]) / total[key] if g in counts else 0.0
        return own + (kept[key] / total[key] if key in total else 1.0) * low

    return p


def test_quality_model_against_dictionaries(spark):
    texts = [t for t in TEXTS if t] + ["aa ab abc abcd abcde " * 3]
    learnt = spark.createDataFrame([(t,) for t in texts[::2]], "text string")
    every = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    got = {r.gram: r.nats for r in quality.surprisals(quality.gram_counts(learnt, 4), quality.gram_counts(every, 4), 4).collect()}
    p = kneser_ney(texts[::2], 4)
    letters = len({g[-1] for g in got})
    assert len(got) > 100 and all(abs(x + np.log(p(g, letters))) < 1e-9 for g, x in got.items())
    # sums of whole texts, with and without the broadcast n-grams
    df = spark.createDataFrame([(2**60 + 1, t, None) for t in texts], "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    known = quality.surprisals(quality.gram_counts(learnt, 4), quality.gram_counts(every, 4), 4)
    want = []
    for t in texts:
        grams = [f" {w} "[max(0, i - 3) : i + 1] for w in t.split() for i in range(1, len(w) + 2)]
        want.append((2**60 + 1, round(sum(got[g] for g in grams), 6), len(grams)))
    for n in (0, 20, 10_000):
        rows = quality.score(df, known, 4, frequent=n).collect()
        assert sorted((r.doc_id, round(r.nats, 6), r.chars) for r in rows) == sorted(want)
        strange = sorted(sorted((s.level, s.many) for r in rows for s in r.strange if s is not None))
        total = Counter()
        for level, m in strange:
            total[level] += m
        first = total if not n else first
        assert total == first


def test_quality(spark):
    own = np.random.default_rng(3)
    good = [(i, " ".join(own.choice(["the", "garden", "grows", "green", "trees", "and", "flowers"], 30)), "en", "s", 0) for i in range(300)]
    bad = [(500 + i, "".join(chr(c) for c in own.integers(33, 126, 150)), "en", "s", 0) for i in range(5)]
    df = spark.createDataFrame([*good, *bad, (900, None, None, "s", 0), (901, "", "xx", "s", 0), (None, "the garden", "en", "s", 0)], DOC)
    labels = spark.createDataFrame([(i, 1, None if i % 3 else 0) for i in range(240)] + [(500, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.classify(df, labels).collect()}
    assert not any(keep[500 + i] for i in range(5)) and sum(keep[i] for i in range(300)) >= 297 and keep[900] and keep[901] and keep[None]
    assert all(r.keep for r in quality.classify(df, labels.limit(0)).collect()) and quality.classify(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns


def test_quality_limits_by_language_and_few_strange_words(spark):
    own = np.random.default_rng(4)
    plain = ["the", "garden", "grows", "green", "trees", "and", "flowers"]
    ja, other = "今日は天気がよいので庭で花を見ました。", "鬱蠢麤驫龘纛鑿饕餮魑魅魍魎蠱毒簒奪。"
    good = [(i, " ".join(own.choice(plain, 60)), "en", "s", 0) for i in range(240)] + [(1000 + i, ja * 5, "ja", "s", 0) for i in range(240)]
    rude = own.choice(plain, 60).tolist()
    rude[20], rude[40] = "xqzvk", "wjxqz"
    df = spark.createDataFrame([*good, (5000, " ".join(rude), "en", "s", 0), (5001, other * 5, "ja", "s", 0), *good[:2]], DOC)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels, min_trusted=20).collect()}
    assert all(got[r[0]].keep for r in good) and not got[5000].keep and not got[5001].keep
    assert got[5000].worst > got[5000].worst_limit
    assert got[5001].perplexity > 5 * got[1000].perplexity and got[0].limit != got[1000].limit


def test_cover_trees_of_near_equal_vectors_end(spark):
    base = rng.standard_normal(64).astype(np.float32)
    near = np.repeat(base[None, :], 200, axis=0)
    near[np.arange(200), np.arange(200) % 64] = np.nextafter(near[np.arange(200), np.arange(200) % 64], np.float32(9))
    near[64:] *= np.float32(1.0000001)
    x = np.concatenate([near, rng.standard_normal((30, 64)).astype(np.float32)])
    i, j = embedding_dedup.linked_pairs(embedding_dedup.unit(x), None, 0.98)
    assert len(i) == 200 * 199 // 2 and max(j) == 199
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype(float))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (199, 0) if k < 200 else (0, k) for k in range(len(x))}


def test_pieces_of_every_letter_before_a_mark():
    from trellis.llm import pieces

    path = tokenizers.path("word_bpe_49k.json")
    encoder, library = pieces.WordEncoder(path), pieces.load(path)
    assert encoder.direct
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    for some in (letters[a : a + 2000] for a in range(0, len(letters), 2000)):
        for word, exact in zip((x + "." for x in some), library.encode_batch([x + "." for x in some], add_special_tokens=False), strict=True):
            got = np.frombuffer(encoder.ids([word.encode()]), dtype="<u4").tolist()
            assert got == exact.ids, (word, hex(ord(word[0])))
    for word in ("पढ़.", "aक़,", "İ.", "STRASSE!", "Éa..", "ΑΣ."):
        assert np.frombuffer(encoder.ids([word.encode()]), dtype="<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_nul_is_a_byte_of_a_word(spark):
    rows = [(1, "a\0b c d e f g"), (2, "a\0b c d e f g"), (3, "a b c d e f g"), (4, "\0"), (None, "a\0b c d e f g")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles for r in got if r.doc_id in (1, 3, 4)), reverse=True) == [3, 2, 1]
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}


def test_texts_without_letters_and_parts_of_runs(spark):
    assert not any(map(language_id.has_letter, ("²½③Ⅳ 12", "", None, "́"))) and language_id.has_letter("²é")
    run = "日本語のテキスト" * 20
    parts = language_id.runs_of(run)
    assert b"".join(parts).decode() == run and all(len(p) <= language_id.MAX_RUN for p in parts) and all(p.decode() for p in parts)
    df = spark.createDataFrame([(1, "²½③"), (2, "und"), (3, "x" * 2_000_000), (4, run * 1000)], "doc_id long, text string")
    net = language_id.ByteNetwork(["de", "en"])
    got = {r.doc_id: r for r in language_id.predict(df, net).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and all(got[i].lang_pred in net.languages for i in (2, 3, 4))
    assert language_id.predict(df.limit(0), net).count() == 0


def test_network_against_plain_loops_and_finite_differences():
    net = language_id.ByteNetwork(["a", "b", "c"], hidden=5, seed=3)
    run = np.frombuffer("héllo wörld".encode(), dtype=np.uint8)

    def states(way, seq):
        h, out = np.zeros(way.h), []
        for b in seq:
            x, n = way.p["x"][b].astype(float), way.h
            z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + h @ way.p["u"][:, k * n : k * n + n]))) for k in (0, 1))
            c = np.tanh(x[2 * n :] + (r * h) @ way.p["c"])
            h = (1 - z) * h + z * c
            out.append(h)
        return np.array(out)

    def by_hand(seq):
        both = np.concatenate([states(net.ways[0], seq), states(net.ways[1], seq[::-1])[::-1]], axis=1)
        x = both @ net.out["w"] + net.out["b"]
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    assert np.allclose(net.labels(run[:, None])[:, 0], by_hand(run), atol=1e-5)
    sums = net.run_sums([bytes(run)])
    assert np.allclose(sums[0, :-1], by_hand(run).sum(axis=0), atol=1e-4) and sums[0, -1] == len(run)
    way = net.ways[0]
    for n in way.p:
        way.p[n] = way.p[n].astype(np.float64)
    weights = rng.standard_normal((len(run), 1, way.h))
    _, cache = way.forward(run[:, None], True)
    grads = way.backward(cache, weights)
    for name, at in (("x", (run[2], 3)), ("x", (run[0], 12)), ("u", (1, 7)), ("c", (2, 4))):
        keep, step, value = way.p[name][at], 1e-2, []
        for d in (step, -step):
            way.p[name][at] = keep + d
            value.append((states(way, run) * weights[:, 0]).sum())
        way.p[name][at] = keep
        assert grads[name][at] == pytest.approx((value[0] - value[1]) / (2 * step), rel=0.02, abs=2e-3)


def test_runs_stand_for_all_pairs_of_places():
    for text, item in (("a " * 300, "a " * 40), ("a b " * 90, "x a b a b a b a b a b y"), ("p q r " * 50 + "z " + "p q r " * 9, "q r p q r p q r p q r p q z z"), (words(50), words(50))):
        (w, _), (v, _) = (decontamination.word_hashes([t], decontamination.ALNUM) for t in (text, item))
        places = tuple(i for i, c in enumerate(decontamination.MASKS[0]) if c == "1")
        h, g = decontamination.windows_hash(w, places), decontamination.windows_hash(v, places)
        want = {i - j for i, x in enumerate(h.tolist()) for j, y in enumerate(g.tolist()) if x == y}
        runs = []
        for x in (h, g):
            at = np.arange(len(x))
            begins, step, many = decontamination._runs(np.zeros(len(x), int), x, at)
            runs.append([(x[b], b, s, m) for b, s, m in zip(begins.tolist(), step.tolist(), many.tolist(), strict=True)])
            back = sorted(b + s * k for _, b, s, m in runs[-1] for k in range(m))
            assert back == at.tolist()
        pairs = [(*r[1:], *q[1:]) for r in runs[0] for q in runs[1] if r[0] == q[0]]
        assert (set(decontamination.alignments(pairs).tolist()) if pairs else set()) == want
        if text.startswith("a a"):
            assert len(pairs) == 1


def test_decontamination_of_repeated_words_and_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_ITEMS", 3)
    long = words(3000)
    items = [(i, " ".join(long.split()[i * 40 : i * 40 + 20])) for i in range(20)] + [(50, "tick " * 60), (51, "tick tock " * 30), (52, "")]
    docs = [(1, long), (2, "tick " * 20_000), (3, "tick tock " * 3000), (4, words(50)), (5, ""), (6, None), (7, long)]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 7) for i in range(20)} | {(2, 50), (3, 51)}
    assert {(r.matched_words, r.alignments) for r in got if r.item_id == 50} == {(60, 20_000 + 60 - 2 * 10 + 1)}


@pytest.mark.parametrize("cells", [1, 5, 40])
def test_top_of_the_tree_routes_by_covering_radii(cells):
    centres = rng.standard_normal((8, 12))
    x = embedding_dedup.unit(np.concatenate([centres[i % 8] + 0.1 * rng.standard_normal((1, 12)) for i in range(400)]))
    top = embedding_dedup.Top.fit(x[:200], cells)
    assert len(top.centres) == cells and top.level[0] == 0
    for k in range(1, cells):  # nested, radii halve
        assert top.level[top.parent[k]] < top.level[k]
        assert top.angle[k, top.parent[k]] <= np.pi / 2 ** (top.level[k] - 1) + 1e-9
        before = top.angle[k, : k].min()
        assert before > np.pi / 2 ** top.level[k] - 1e-9
    d = embedding_dedup._angle(x, top.centres)
    cell = d.argmin(axis=1)
    radius = np.array([d[cell == k, k].max(initial=-1.0) for k in range(cells)])
    reach = float(np.arccos(0.95)) + 1e-6
    pairs = set(top.pairs(radius, reach))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert {(min(a, b), max(a, b)) for a, b in zip(cell[i].tolist(), cell[j].tolist(), strict=True) if a != b} <= pairs
    assert all(d[a, cell[b]] <= radius[cell[b]] + reach for a, b in zip(i.tolist(), j.tolist(), strict=True))
    if cells > 8:
        assert len(pairs) < cells * (cells - 1) / 4


def test_near_duplicates_over_many_cells_and_labels(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 64)
    base = rng.standard_normal((40, 6))
    vec = [(base[i % 40] + 0.05 * rng.standard_normal(6)) for i in range(420)]
    rows = [(i, v.astype(np.float32).astype(float).tolist(), ("p", "q", None)[i % 7 // 3]) for i, v in enumerate(vec)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.98, cell_rows=20, block_rows=8).collect()}
    x = embedding_dedup.unit([r[1] for r in rows])
    same = np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    link = (x @ x.T >= 0.98) & same & ~np.eye(len(rows), dtype=bool)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
    assert got == {i: (int(link[i].sum()), root[i]) for i in range(len(rows))} and link.sum() > 400
