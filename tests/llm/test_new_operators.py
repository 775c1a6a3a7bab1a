"""Forest search, manifest and ranked search against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import forest, lexical, merkle

own = np.random.default_rng(29)
VEC = "vec_id long, embedding array<float>, label int, score double, class string"


# ---- nearest neighbours ----------------------------------------------------------------


def brute_nearest(rows, k, step):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % step == 0:
            near = sorted(((-float((x * v).sum()), i) for i, x in good if i != q and len(x) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.fixture(scope="module")
def vectors():
    centres = own.standard_normal((12, 16))
    x = [(i, (centres[i % 12] + 0.4 * own.standard_normal(16)).astype(np.float32).astype(float).tolist()) for i in range(1500)]
    x[20] = (20, [4 * v for v in x[20][1]])  # the nearest of itself
    x += [(2000 + i, x[20][1]) for i in range(60)]  # one vector many times
    x += [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [math.nan] + [1.0] * 15), (3080, [math.inf] + [1.0] * 15), (3100, [None] + [1.0] * 15), (None, [1.0] * 16)]
    x += [(4000, [1.0, 0.0]), (4001, [0.5, 0.5]), (4002, [0.0, -1.0])]
    return x


def test_nearest_against_brute_force(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 0.0, "x") for i, v in vectors], VEC).repartition(5)
    got = forest.nearest(df, F.col("vec_id") % 20 == 0, k=8, leaf_rows=40, sample=900, shard_numbers=16 * 300, group_queries=30).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(vectors, 8, 20)
    assert by.keys() == want.keys() and 3000 not in by
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    products = {i: np.array(v) for i, v in vectors if i is not None and v and None not in v}
    for q, rows in by.items():
        assert [s for _, s in rows] == pytest.approx([float((products[i] * products[q]).sum()) for i, _ in rows], abs=1e-12)
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in rows}
    assert [i for i, _ in by[20]] == [2000 + i for i in range(8)]  # ties go to the smaller vec_id
    assert by[4000] == [(4001, 0.5), (4002, 0.0)]


def test_nearest_sees_all_rows_with_a_budget_beyond_them(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, 0.0, "x") for i, v in vectors], VEC)
    got = forest.nearest(df, F.col("vec_id") % 100 == 0, k=5, leaf_rows=64, budget=1e12).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for i, _ in rows] for q, rows in brute_nearest(vectors, 5, 100).items()}
    assert forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 1, 0.0, "x"), (21, [1.0, 2.0], 1, 0.0, "x")], VEC)
    assert [tuple(r) for r in forest.nearest(one, F.col("vec_id") == 20).collect()] == [(20, 1, 21, 5.0)]


def test_queue_gives_every_leaf_once_and_the_home_leaves_first():
    x = forest.lifted(own.standard_normal((500, 8)), 10.0)
    f = forest.Forest([forest.grow(x, 20, seed) for seed in range(4)])
    q = forest.lifted(own.standard_normal((500, 8)), 12.0)  # no row of the sample: none lies on a plane
    dealt, margins = f.deal(q), f.margins(q)
    for i in range(0, 500, 50):
        order = list(f.walk(margins[i]))
        assert sorted(order) == list(range(f.leaves))
        # margins of 0 or more on the way: all home leaves come before any leaf across a plane
        assert set(order[:4]) == set(dealt[i].tolist())
    assert {f.tree_of[leaf] for leaf in dealt[0]} == {0, 1, 2, 3}


# ---- manifest --------------------------------------------------------------------------


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, {}
    for n in names:
        by[n].sort(key=lambda r: (r[0] is not None, r[0], leaf(r, r[4])))
        trees[n] = levels([leaf(r, r[4]) for r in by[n]])
    top = levels([trees[n][-1][0] for n in names])
    for k, n in enumerate(names):
        for i, r in enumerate(by[n]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            d, proof = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if bad else r[4]), ""
            for before, after in [*path(trees[n], i), *path(top, k)]:
                d, proof = h("".join(before) + d + "".join(after)), proof + "".join(before + after)
            out[r[0]] = (trees[n][0][i], trees[n][-1][0], top[-1][0], h(proof), d, d == top[-1][0])
    return out


DOC = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest int"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_brute_force(spark, height, monkeypatch, tmp_path):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "LEAVES", 8**height)
    rows = [(i, "s" if i % 5 else None, ("en", None, "dé", "=x", "ü")[i % 5], i, f"Text {i} Ä" * (i % 4)) for i in range(0, 700, 1)]
    rows += [(5000, None, "one", None, None), (5001, "", "two", 0, ""), (5002, "A", "two", 1, "ABC" * 40_000)]
    rows += [(10_000 + i, "s", "big", 1, "Same") for i in range(600)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    if height == 4:
        got = merkle.op12_veb_merkle_manifest(spark, str(tmp_path))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_manifest(rows)
        df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
        assert merkle.op12_veb_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
        return
    # workers know only the true height: small blocks are tried here, in one process
    leaves = [h(str(i)) for i in range(700)]
    level, n, roots = leaves, len(leaves), []
    while True:
        blocks = [merkle.Block(n, len(level[i : i + 8**height])).build(level[i : i + 8**height]) for i in range(0, len(level), 8**height)]
        roots = [b.root() for b in blocks]
        if n <= 8**height:
            break
        level, n = roots, -(-n // 8**height)
    want = leaves
    while len(want) > 1:
        want = [h("".join(want[i : i + 8])) for i in range(0, len(want), 8)]
    assert roots == want


def test_layout_is_a_permutation_with_whole_subtrees():
    for levels in range(1, 6):
        places = np.concatenate([merkle.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.nodes_in(levels)))
    # a subtree below the middle lies in one piece
    below = np.concatenate([merkle.address(5, 2 + d, np.arange(8**d) + 3 * 8**d) for d in range(3)])
    assert below.max() - below.min() == merkle.nodes_in(3) - 1


# ---- ranked search ---------------------------------------------------------------------


def brute_search(docs, items, top=10):
    def terms(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scored = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n_docs // all_terms if b else 0
            s = sum(x * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, x in w.items() if b[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_search_against_brute_force(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)] + ["Über", "日本語", "Naïve", "a_b", "x\0y"]
    text = lambda n: " ".join(own.choice(words, n, p=own.dirichlet(np.full(len(words), 0.3))))
    base = text(30)
    docs = [(i, text(int(own.integers(1, 60)))) for i in range(150)]
    docs += [(200 + i, base) for i in range(40)] + [(300 + i, base.upper() if base.isascii() else base) for i in range(5)]
    docs += [(400, None), (401, ""), (402, " .,- "), (403, "ünknown word"), (404, "w1 " * 500_000), (405, "q" * 3_000_000)]
    items = [(i, text(12)) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere"), (53, base), (54, "w1 W1 w1"), (55, "q" * 3_000_000)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, class string").repartition(4)
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    want = brute_search(docs, items)
    assert sorted((tuple(r) for r in lexical.search(d, b).collect()), key=str) == want
    assert sorted((tuple(r) for r in lexical.search(d, b, block_postings=90).collect()), key=str) == want  # several blocks
    assert lexical.search(d.limit(0), b).count() == 0 and lexical.search(d, b.limit(0)).count() == 0


def test_scores_in_integers_beyond_exact_doubles():
    item_of, term_of = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 0, 2])
    size, ids, tfs, m = np.array([2, 1]), np.array([0, 2, 1]), np.array([3, 1, 2]), np.array([10, 55])
    block = lexical.Block(np.array([7, 5, 3]), item_of, term_of, 3)
    small = block.scores(size, ids, tfs, m)
    assert block.exact
    block.exact = False
    assert (block.scores(size, ids, tfs, m) == small).all()
    huge = lexical.Block(np.array([7, 5, 3]) * 10**12, item_of, term_of, 3)
    assert not huge.exact and (huge.scores(size, ids, tfs, m) == small.astype(np.int64) * 10**12).all()


def test_terms_of_parts_equal_those_of_the_whole(monkeypatch):
    text = "Ab cd, éa-x " * 50 + "y" * 100
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PART", 17)
    assert lexical.term_counts(text) == whole and whole[("y" * 100).encode()] == 1
