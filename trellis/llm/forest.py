"""Nearest vectors by inner product from a forest of random-projection trees.

Equal vectors are one class, which keeps its smallest vec_ids; only classes are indexed. The
trees are fitted on a bounded sample, at most SAMPLE classes by hash: a node splits at the median of
the projections on the difference of two of its vectors, until a leaf stands for about LEAF_ROWS
classes (or for LEAST_SAMPLE of the sample, if there are far more). Vectors are scaled by the largest
norm and get one more component that makes them unit vectors, so the largest inner product is the
nearest vector. Every class is dealt to one leaf of every tree.

A query walks all trees through one priority queue: a branch's priority is the smallest margin by
which the query lies on its side on the way there, and leaves are taken in this order until
they hold `budget` rows. The budget is measured: CALIBRATION queries are compared with all rows,
and the budget is the smallest with which RECALL of their nearest would be found. So the work follows
how far the data can be pruned at all; vectors without structure cost a large share of a scan.

Leaves lie together in shards of a bounded number of rows, so that a task holds one shard, and a
query is sent to a shard once, with the leaves it wants. A task gives the best of its shard for each
query; these are reranked by their score on the original vectors. Shards that a leaf fills are
split by hash, and so are the queries of a shard.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither do rows without vec_id; vectors of different lengths do not meet; fewer candidates
than k give all of them; equal scores go to the smaller vec_id; rows sharing a vec_id are
candidates of their own, except for a query of the same vec_id; an empty table gives no rows; other
columns are ignored. vec_id is an integer.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import materialize, tidy

TREES = 6
SAMPLE = 32_768
LEAF_ROWS = 512
LEAST_SAMPLE = 16
#: Numbers (rows times length) of a shard: 16 MB as doubles.
SHARD_NUMBERS = 1 << 21
#: Queries of one group.
GROUP_QUERIES = 4096
#: Cells of a product of queries and rows.
PRODUCT = 2_000_000
CALIBRATION = 64
RECALL = 0.95
K = 20


def valid(v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """x over norm, with the component that completes each row to length 1."""
    x = x / norm
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]], axis=1)


# ---- the forest ------------------------------------------------------------------------


def grow(x: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over lifted rows: directions, thresholds, and children by node (two columns); a
    child below 0 is leaf -1 - child. Leaves are numbered from left to right."""
    rng = np.random.default_rng(seed)
    directions, cuts, children, leaves = [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(4):  # equal rows of a sample do not part
                i, j = rng.choice(rows, 2, replace=False)
                d = x[i] - x[j]
                if (size := np.linalg.norm(d)) > 0:
                    p = x[rows] @ (d / size)
                    cut = float(np.median(p))
                    left = p < cut
                    if left.any():
                        k = len(cuts)
                        directions.append(d / size)
                        cuts.append(cut)
                        children.append([0, 0])
                        children[k][:] = node(rows[left]), node(rows[~left])
                        return k
        leaves += 1
        return -leaves

    root = node(np.arange(len(x)))
    if root < 0:  # a single leaf: a node that sends everything to it
        return np.zeros((1, x.shape[1])), np.full(1, -1.0), np.array([[-1, -1]])
    return np.array(directions), np.array(cuts), np.array(children)


class Forest:
    """Trees as one table of nodes: trees' roots are given, leaves are numbered through."""

    def __init__(self, trees):
        self.directions, self.cuts = np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees])
        nodes, leaves, children, self.roots, self.tree_of = 0, 0, [], [], []
        for k, (_, cuts, child) in enumerate(trees):
            children.append(np.where(child >= 0, child + nodes, child - leaves))
            self.roots.append(nodes)
            nodes, leaves = nodes + len(cuts), leaves - int(child.min())
            self.tree_of += [k] * (leaves - len(self.tree_of))
        self.children, self.leaves = np.concatenate(children), leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions.T - self.cuts

    def deal(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        margins, out = self.margins(x), np.empty((len(x), len(self.roots)), dtype=np.int64)
        for k, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (live := np.flatnonzero(at >= 0)).size:
                at[live] = self.children[at[live], (margins[live, at[live]] >= 0).astype(int)]
            out[:, k] = -1 - at
        return out

    def walk(self, margins: np.ndarray):
        """Leaves in the order of the shared queue, for one query's margins."""
        queue = [(-np.inf, root) for root in self.roots]
        while queue:
            priority, at = heapq.heappop(queue)
            if at < 0:
                yield -1 - at
                continue
            m = margins[at]
            for side, child in ((-m, self.children[at, 0]), (m, self.children[at, 1])):
                heapq.heappush(queue, (max(priority, -side), int(child)))

    def visit(self, margins: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        out, rows = [], 0
        for leaf in self.walk(margins):
            if sizes[leaf]:
                out.append(leaf)
                rows += sizes[leaf]
            if rows >= budget:
                break
        return out


def _fitted(leaf: int, norm: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class")
        tree = int(frame["tree"].iloc[0])
        directions, cuts, children = grow(lifted(np.array(frame["embedding"].tolist(), dtype=np.float64), norm), leaf, 1000 + tree)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(cuts)), "direction": list(directions), "cut": cuts, "below": children[:, 0], "above": children[:, 1]})

    return run


def fit(classes: DataFrame, n: int, norm: float, trees: int, leaf_rows: int, sample: int) -> Forest:
    """A forest from a sample of classes (class, embedding): at most about `sample` of them, by hash.
    What comes to the driver is bounded by the sample: trees times sample / LEAST_SAMPLE nodes."""
    share = min(1.0, sample / max(1, n))
    drawn = classes.select("class", "embedding").filter(F.pmod(F.xxhash64("class", F.lit("forest")), F.lit(1 << 30)) <= int(share * (1 << 30)))
    leaf = max(LEAST_SAMPLE, int(leaf_rows * share))
    copies = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    found = copies.groupBy("tree").applyInPandas(_fitted(leaf, norm), "tree int, node int, direction array<double>, cut double, below int, above int").toPandas()
    parts = []
    for tree in range(trees):
        t = found[found["tree"] == tree].sort_values("node")
        if len(t):
            parts.append((np.array(t["direction"].tolist()), t["cut"].to_numpy(), t[["below", "above"]].to_numpy().astype(np.int64)))
    if not parts:  # the sample missed a small table
        dim = classes.select(F.size("embedding")).first()[0] + 1
        parts = [(np.zeros((1, dim)), np.full(1, -1.0), np.array([[-1, -1]]))]
    return Forest(parts)


# ---- search ----------------------------------------------------------------------------


def _nearest_of_all(shared, k: int):
    """The best k classes of a task for each of a few queries."""

    def run(frames):
        ids, q = shared.value
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(q)
        for batch in frames:
            s, own = q @ _matrix(batch["embedding"]).T, batch["class"].to_numpy()
            for i, row in enumerate(s):
                row = np.where(own == ids[i], -np.inf, row)
                some = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                score, place = np.concatenate([best[i][0], row[some]]), np.concatenate([best[i][1], own[some]])
                top = np.lexsort((place, -score))[:k]
                best[i] = score[top], place[top]
        for i, (score, place) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(place, pa.int64()), pa.array(score, pa.float64())], ["q", "class", "score"])

    return run


def measured_budget(classes: DataFrame, queries: DataFrame, dealt: DataFrame, forest: Forest, sizes: np.ndarray, norm: float, k: int, recall: float, most: int) -> float:
    """The rows of leaves, repeated ones too, that a query has to see for `recall` of the nearest of
    about `most` sample queries, which are compared with all classes."""
    n = queries.count()
    drawn = queries.filter(F.pmod(F.xxhash64("class", F.lit("budget")), F.lit(1 << 30)) <= int(min(1.0, most / max(1, n)) * (1 << 30))).limit(4 * most).toArrow()
    if not drawn.num_rows:
        return float("inf")
    ids, q = drawn["class"].to_numpy(), _matrix(drawn["embedding"])
    shared = classes.sparkSession.sparkContext.broadcast((ids, q))
    near = classes.select("class", "embedding").mapInArrow(_nearest_of_all(shared, k), "q int, class long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "class")
    near = near.filter(F.col("score") > float("-inf")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "class", "r")
    found = near.join(dealt, "class").join(classes.select("class", "copies"), "class").toPandas().sort_values(["q", "r"])
    margins, ranks = forest.margins(np.concatenate([q / norm, np.zeros((len(q), 1))], axis=1)), []
    weights = []  # a class counts as often as it is among the k nearest rows
    for i, rows in found.groupby("q"):
        order = np.fromiter(forest.walk(margins[i]), dtype=np.int64)
        place = np.empty(forest.leaves, dtype=np.int64)
        place[order] = np.arange(len(order))
        seen = np.concatenate([[0], np.cumsum(sizes[order])])
        # all rows of the leaves before the first one that holds it: the walk stops behind them
        ranks += [seen[place[np.asarray(leaves)].min()] + 1 for leaves in rows["leaves"]]
        upto = np.minimum(k, rows["copies"].cumsum().to_numpy())
        weights.append(np.diff(upto, prepend=0))
    if not ranks:
        return float("inf")
    order = np.argsort(ranks)
    share = np.cumsum(np.concatenate(weights)[order])
    return float(np.asarray(ranks)[order][np.searchsorted(share, recall * share[-1])])


def _searched(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("leaf", "ascending"), ("class", "ascending")])
        leaf, own, x = rows["leaf"].to_numpy(), rows["class"].to_numpy(), _matrix(rows["embedding"])
        query, q, wanted = asked["class"].to_numpy(), _matrix(asked["embedding"]), asked["leaves"].combine_chunks()
        at = np.repeat(np.arange(len(query)), np.diff(wanted.offsets.to_numpy()))
        want = wanted.flatten().to_numpy()
        turn = np.argsort(want, kind="stable")
        at, want = at[turn], want[turn]
        best_s, best_c = np.full((len(query), k), -np.inf), np.full((len(query), k), -1, dtype=np.int64)
        for part in np.unique(want):
            a, b = np.searchsorted(leaf, part), np.searchsorted(leaf, part, "right")
            if a == b:
                continue
            who_all = at[np.searchsorted(want, part) : np.searchsorted(want, part, "right")]
            for who in np.array_split(who_all, 1 + len(who_all) * (b - a) // PRODUCT):
                s = q[who] @ x[a:b].T
                if b - a > k:
                    some = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, c = np.take_along_axis(s, some, axis=1), own[a:b][some]
                else:
                    c = np.broadcast_to(own[a:b], s.shape)
                s, c = np.concatenate([best_s[who], s], axis=1), np.concatenate([best_c[who], c], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s[who], best_c[who] = np.take_along_axis(s, top, axis=1), np.take_along_axis(c, top, axis=1)
        i, j = np.nonzero(best_c >= 0)
        # a row's score is summed in one order, so that it is the same in whatever shard it is found
        place = np.argsort(own, kind="stable")
        there = place[np.searchsorted(own[place], best_c[i, j])]
        score = np.concatenate([(q[i[a : a + 65536]] * x[there[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        return pa.table([pa.array(query[i]), pa.array(best_c[i, j]), pa.array(score)], schema=schema)

    return run


def _dealer(shared, norm: float):
    def run(frames):
        forest = shared.value
        for batch in frames:
            leaves = forest.deal(lifted(_matrix(batch["embedding"]), norm)) if batch.num_rows else np.zeros((0, len(forest.roots)), dtype=np.int64)
            offsets = pa.array(np.arange(0, leaves.size + 1, leaves.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["class"], pa.ListArray.from_arrays(offsets, pa.array(leaves.reshape(-1)))], ["class", "leaves"])

    return tidy(run)


def _asker(shared, sizes: np.ndarray, shard_of: np.ndarray, budget: float, norm: float):
    """The shards a query is sent to, and the leaves it wants there."""

    def run(frames):
        forest = shared.value
        for batch in frames:
            q = _matrix(batch["embedding"]) if batch.num_rows else np.zeros((0, 1))
            for a in range(0, len(q), 512):
                margins = forest.margins(np.concatenate([q[a : a + 512] / norm, np.zeros((len(q[a : a + 512]), 1))], axis=1))
                row, shard, leaves = [], [], []
                for i, m in enumerate(margins):
                    by: dict[int, list[int]] = {}
                    for leaf in forest.visit(m, sizes, budget):
                        by.setdefault(int(shard_of[leaf]), []).append(leaf)
                    row += [a + i] * len(by)
                    shard += by.keys()
                    leaves += by.values()
                some = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([some["class"], some["embedding"], pa.array(shard, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["class", "embedding", "shard", "leaves"])

    return tidy(run)


def _of_one_length(classes: DataFrame, queries: DataFrame, dim: int, k: int, options: dict) -> DataFrame:
    """(query, class, score): the k nearest classes found for each class in queries, itself included."""
    spark = classes.sparkSession
    kind = classes.schema["embedding"].dataType.simpleString()
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, norm = classes.agg(F.count("*"), F.max(F.sqrt(square))).first()
    forest = fit(classes, n, norm, options["trees"], options["leaf_rows"], options["sample"])
    shared = spark.sparkContext.broadcast(forest)
    dealt = materialize(classes.select("class", "embedding").mapInArrow(_dealer(shared, norm), "class long, leaves array<long>"))
    sizes = np.zeros(forest.leaves, dtype=np.int64)
    for r in dealt.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    # consecutive leaves of a tree share a shard up to a number of rows; larger ones are salted
    most = max(1, options["shard_numbers"] // dim)
    shard_of, salts, full = np.zeros(forest.leaves, dtype=np.int64), [], 0
    for leaf, size in enumerate(sizes):
        if not salts or full + size > most or forest.tree_of[leaf] != forest.tree_of[leaf - 1]:
            salts.append(1)
            full = 0
        full += int(size)
        shard_of[leaf], salts[-1] = len(salts) - 1, max(1, -(-full // most))
    budget = options["budget"] or measured_budget(classes, queries, dealt, forest, sizes, norm, k, options["recall"], options["calibration"])
    asked = materialize(queries.select("class", "embedding").mapInArrow(_asker(shared, sizes, shard_of, budget, norm), f"class long, embedding {kind}, shard long, leaves array<long>"))
    counts = {r["shard"]: r["n"] for r in asked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(leaf, int(s), int(salts[s]), int(max(1, -(-counts.get(int(s), 0) // options["group_queries"])))) for leaf, s in enumerate(shard_of)], "leaf long, shard long, salts int, groups int"
    )
    spread = dealt.select("class", F.explode("leaves").alias("leaf")).join(plan, "leaf").join(classes.select("class", "embedding"), "class")
    left = spread.select(
        "class", "embedding", "leaf", "shard", F.pmod(F.xxhash64("class", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
    )
    to = asked.join(plan.select("shard", "salts", "groups").distinct(), "shard")
    right = to.select(
        "class", "embedding", "leaves", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("class", F.lit("group")), F.col("groups")).cast("int").alias("group"),
    )
    keys = ["shard", "salt", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k), "query long, class long, score double")
    # a class may be found in several trees
    once = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return once.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, recall: float = RECALL, calibration: int = CALIBRATION, budget: float | None = None,
    shard_numbers: int = SHARD_NUMBERS, group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of vectors (vec_id, embedding)
    for which is_query holds, among all others. budget: rows to see, in place of measuring it."""
    options = {"trees": trees, "leaf_rows": leaf_rows, "sample": sample, "recall": recall, "calibration": calibration, "budget": budget, "shard_numbers": shard_numbers, "group_queries": group_queries}
    rows = vectors.filter(valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    groups = rows.groupBy("embedding").agg(F.max("asks").alias("asks"), F.count("*").alias("copies"))
    classes = materialize(groups.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    out = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        some = classes.filter(F.col("dim") == dim)
        asks = some.filter("asks")
        if asks.isEmpty():
            continue
        found = _of_one_length(some, asks, dim, k + 1, options)  # one more: a query's own row does not count
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = materialize(out)
    # members of the classes that were found, the smallest few of each
    w = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).select("embedding", "vec_id")
    members = first.join(classes.select("embedding", "class"), "embedding").select("class", "vec_id")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = materialize(out.join(members, "class").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).select("query", "vec_id", "score"))
    asking = rows.filter("asks").join(classes.select("embedding", F.col("class").alias("query")), "embedding").select("query", F.col("vec_id").alias("query_id")).distinct()
    pairs = asking.join(ranked, "query").filter("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_projection_forest_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every one whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
