"""Embedding near-dedup by dual traversal of cover trees, exact at the threshold.

Equal vectors of a label are first counted as one. The top of a label's tree is fitted on a bounded
sample of its distinct vectors: centres in farthest-first order, of which those with an insertion
radius above pi / 2**l are level l, so levels are nested and radii halve. Every vector goes to its
nearest centre, its cell, and the covering radii of cells, taken over all vectors, give those of the
levels above. The top is walked against itself: a pair of nodes is dropped when the angle of their
centres exceeds the covering radii and the threshold's angle together. Of the pairs of cells
that are left, a vector visits the second only if its angle to that centre is within its radius and
the threshold's angle. A cell's vectors and its visitors then meet in tasks, block by block, where
cover trees of both are built and walked in the same way; what reaches single vectors is compared by
its cosine in double precision. A task returns a row for each linked vector: how many vectors it is
linked to, and the smallest of its component there.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label link with nothing; vectors of different lengths do not link; repeated
rows with the same vec_id count as vectors of their own; an empty table gives no rows; other
columns are ignored. vec_id is an integer.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialize
from trellis.llm.components import connected_components, spanning_links

THRESHOLD = 0.98
CELL_ROWS = 1024
#: Centres of a label at most, and vectors of the sample for each.
MOST_CELLS, SAMPLE_PER_CELL = 256, 16
#: Vectors of a group that is dealt to cells, and of a block that meets another.
GROUP_ROWS, BLOCK_ROWS = 8192, 2048
#: Angles up to this are not told apart: near 0 the arc cosine of a double is off by some 1e-8.
ROUNDING = 1e-6


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class Node:
    """A centre, the largest angle to a vector below it, and its children."""

    __slots__ = ("at", "children", "radius", "rows")

    def __init__(self, at: int, radius: float, rows: np.ndarray, children: list):
        self.at, self.radius, self.rows, self.children = at, radius, rows, children


def cover_tree(x: np.ndarray, leaf: int = 32) -> Node:
    """Nested levels: a node's first child has its centre, every child's vectors lie within
    half the level's radius of the child's centre. Nodes of up to leaf vectors stay whole, and so
    do those whose radius is not far above the rounding of an angle."""

    def build(at: int, rows: np.ndarray, angle: np.ndarray, level: float) -> Node:
        radius = float(angle.max())
        if len(rows) <= leaf or radius <= ROUNDING:
            return Node(at, radius, rows, [])
        while level / 2 >= radius:
            level /= 2
        children, left, d, centre = [], rows, angle, at
        while len(left):
            near = (d <= level / 2) | (left == centre)  # by number: its own angle may be rounded up
            children.append((centre, left[near], d[near]))
            left = left[~near]
            if len(left):
                # centres are the furthest from the parent's, so they stay apart
                centre = int(left[np.argmax(d[~near])]) if len(children) == 1 else int(left[0])
                d = _angle(x[centre : centre + 1], x[left])[0]
        return Node(at, radius, rows, [build(c, r, a, level / 2) for c, r, a in children])

    rows = np.arange(len(x))
    return build(0, rows, _angle(x[:1], x)[0], np.pi)


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in x, j in y) of vectors whose cosine is at least threshold; without y those
    of x among themselves, i < j."""
    same = y is None
    y = x if same else y
    reach = float(np.arccos(threshold)) + 1e-6
    a, b = cover_tree(x), cover_tree(y)
    found_i, found_j = [], []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        p, q = np.nonzero(x[i] @ y[j].T >= threshold)
        p, q = i[p], j[q]
        if same:
            p, q = p[p < q], q[p < q]
        found_i.append(p)
        found_j.append(q)

    todo = [(a, b)]
    while todo:
        m, n = todo.pop()
        left, right = m.children or [m], n.children or [n]
        if not m.children and not n.children:
            compare(m.rows, n.rows)
            continue
        gap = _angle(x[[c.at for c in left]], y[[c.at for c in right]])
        bound = np.array([c.radius for c in left])[:, None] + np.array([c.radius for c in right])[None, :] + reach
        open_ = gap <= bound
        single = np.array([not c.children for c in left])[:, None] & np.array([not c.children for c in right])[None, :]
        # leaves are compared together: one product for each leaf on the left
        for p in np.flatnonzero((open_ & single).any(axis=1)):
            compare(left[p].rows, np.concatenate([right[q].rows for q in np.flatnonzero(open_[p] & single[p])]))
        todo += [(left[p], right[q]) for p, q in zip(*np.nonzero(open_ & ~single), strict=True)]
    return np.concatenate(found_i), np.concatenate(found_j)


class Top:
    """The top of a cover tree: centres, the level at which each appears, and its parent in the
    level above. A node is a centre at a level from its own down to the last."""

    def __init__(self, centres: np.ndarray, level: np.ndarray, parent: np.ndarray):
        self.centres, self.level, self.parent = centres, level, parent
        self.last = int(level.max(initial=0))
        self.angle = _angle(centres, centres)
        self.below: dict = {}
        for k in range(1, len(centres)):
            self.below.setdefault((int(parent[k]), int(level[k])), []).append(k)

    @classmethod
    def fit(cls, x: np.ndarray, most: int) -> Top:
        order, level, parent = [0], [0], [-1]
        d = _angle(x[:1], x)[0]
        while len(order) < most and (far := float(d.max())) > ROUNDING:
            k = int(np.argmax(d))
            at = int(np.floor(np.log2(np.pi / far))) + 1  # the first level whose radius is below far
            above = [i for i, n in enumerate(level) if n < at]
            near = _angle(x[k : k + 1], x[[order[i] for i in above]])[0]
            order.append(k)
            level.append(at)
            parent.append(above[int(np.argmin(near))])
            d = np.minimum(d, _angle(x[k : k + 1], x)[0])
        return cls(x[order], np.array(level), np.array(parent))

    def children(self, k: int, n: int) -> list[int]:
        return [k, *self.below.get((k, n + 1), ())]

    def pairs(self, radius: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """Pairs of cells, i < j, that may hold linked vectors; radius is that of each cell, below 0
        for cells without vectors."""
        cover = {(k, self.last): float(r) if r >= 0 else -np.inf for k, r in enumerate(radius)}
        for n in range(self.last - 1, -1, -1):
            for k in np.flatnonzero(self.level <= n).tolist():
                cover[k, n] = max(self.angle[k, c] * (c != k) + cover[c, n + 1] for c in self.children(k, n))
        out, todo = [], [(0, 0, 0)]
        while todo:
            i, j, n = todo.pop()
            if i != j and self.angle[i, j] > cover[i, n] + cover[j, n] + reach:
                continue
            if n == self.last:
                if i != j:
                    out.append((min(i, j), max(i, j)))
                continue
            a, b = self.children(i, n), self.children(j, n)
            todo += [(p, q, n + 1) for p in a for q in b if i != j or p <= q]
        return sorted(set(out))


_CELLS = "label long, dim int, rep long, copies long, embedding array<double>"


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _parted(frame: pd.DataFrame, name: str):
    """The rows of a group, and the arrays that its one row with a value in `name` brings, or None."""
    brings = frame[name].notna()
    held = np.load(io.BytesIO(frame[name][brings].iloc[0])) if brings.any() else None
    return frame[~brings].drop(columns=name), held


def _fitted(frame: pd.DataFrame) -> pd.DataFrame:
    top = Top.fit(unit(frame.sort_values("rep")["embedding"]), int(frame["cells"].iloc[0]))
    packed = _packed(centres=top.centres, level=top.level, parent=top.parent)
    return pd.DataFrame([{"label": frame["label"].iloc[0], "dim": frame["dim"].iloc[0], "top": packed}])


def _dealt(frame: pd.DataFrame) -> pd.DataFrame:
    """Each vector's cell and its angle to the centre; all in cell 0 of a label without a top."""
    rows, top = _parted(frame.drop(columns="salt"), "top")
    if top is None or not len(rows):
        return rows.assign(cell=0, angle=0.0)
    d = _angle(unit(rows["embedding"]), top["centres"])
    cell = d.argmin(axis=1)
    return rows.assign(cell=cell, angle=d[np.arange(len(d)), cell])


def _guide(reach: float):
    """The pairs of cells of a label that may hold linked vectors, with centres and radii."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        radii, held = _parted(frame, "top")
        if held is None:
            return pd.DataFrame({"label": [], "dim": [], "guide": []})
        top = Top(held["centres"], held["level"], held["parent"])
        radius = np.full(len(top.centres), -1.0)
        radius[radii["cell"].to_numpy()] = radii["radius"].to_numpy()
        meets = np.zeros((len(radius), len(radius)), dtype=bool)
        for i, j in top.pairs(radius, reach):
            meets[i, j] = True
        return pd.DataFrame([{"label": frame["label"].iloc[0], "dim": frame["dim"].iloc[0], "guide": _packed(centres=top.centres, radius=radius, meets=meets)}])

    return run


def _visitors(reach: float):
    """The vectors of a group in their own cells, and in those that they visit."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, g = _parted(frame.drop(columns="salt"), "guide")
        own = rows.assign(guest=False)
        if g is None or not len(rows):
            return own
        near = _angle(unit(rows["embedding"]), g["centres"]) <= g["radius"] + reach
        row, cell = np.nonzero(g["meets"][rows["cell"].to_numpy()] & near)
        return pd.concat([own, own.iloc[row].assign(cell=cell, guest=True)])

    return run


def _pair(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        block, p, q = frame["block"].to_numpy(), frame["p"].iloc[0], frame["q"].iloc[0]
        side = block == p
        out = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not side.any() or p != q and side.all():
            return out
        x, ids, n = unit(frame["embedding"][side]), frame["rep"].to_numpy()[side], frame["copies"].to_numpy()[side]
        if p == q:
            i, j = linked_pairs(x, None, threshold)
            other, m = ids, n
        else:
            other, m = frame["rep"].to_numpy()[~side], frame["copies"].to_numpy()[~side]
            i, j = linked_pairs(x, unit(frame["embedding"][~side]), threshold)
        links = pd.concat([pd.DataFrame({"rep": ids[i], "links": m[j]}), pd.DataFrame({"rep": other[j], "links": n[i]})]).groupby("rep", as_index=False)["links"].sum()
        root = spanning_links(ids[i].tolist(), other[j].tolist())
        return links.assign(root=links["rep"].map(root)) if len(links) else out

    return run


def sent_to_cells(reps: DataFrame, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """reps (label, dim, rep, copies, embedding) with cell and guest: each in its cell, and as a guest in
    those where a linked vector may lie."""
    reach = float(np.arccos(threshold)) + ROUNDING
    keys = ["label", "dim"]
    stats = reps.groupBy(*keys).agg(F.count("*").alias("n"))
    stats = stats.select(*keys, "n", F.least(F.ceil(F.col("n") / cell_rows), F.lit(MOST_CELLS)).cast("int").alias("cells"), F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("groups"))
    stats = materialize(stats)
    large = stats.filter("cells > 1")
    draw = F.pmod(F.xxhash64("rep", F.lit("centres")), F.lit(1 << 30)) / float(1 << 30)
    sample = reps.join(large, keys).filter(draw < SAMPLE_PER_CELL * F.col("cells") / F.col("n"))
    tops = materialize(sample.groupBy(*keys).applyInPandas(_fitted, "label long, dim int, top binary"))
    salt = F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("salt")
    fields = ["label", "dim", "rep", "copies", "embedding"]
    by = [*keys, "salt"]

    def with_guides(rows: DataFrame, guides: DataFrame, name: str) -> DataFrame:
        """rows in groups of a bounded size, to each of which the label's guide is added as a row."""
        grouped = rows.join(stats.select(*keys, "groups"), keys).select(*rows.columns, salt)
        every = guides.join(stats.select(*keys, "groups"), keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        empty = {"rep": F.lit(-1), "copies": F.lit(0), "embedding": F.lit(None), "cell": F.lit(-1)}
        kinds = {f.name: f.dataType for f in grouped.schema}
        more = every.select(*(F.col(c) if c in by else empty[c].cast(kinds[c]).alias(c) for c in grouped.columns), name)
        return grouped.withColumn(name, F.lit(None).cast("binary")).unionByName(more)

    placed = materialize(with_guides(reps.select(*fields), tops, "top").groupBy(*by).applyInPandas(_dealt, f"{_CELLS}, cell int, angle double"))
    radii = placed.groupBy(*keys, "cell").agg(F.max("angle").alias("radius")).withColumn("top", F.lit(None).cast("binary"))
    radii = radii.unionByName(tops.select(*keys, F.lit(-1).alias("cell"), F.lit(0.0).alias("radius"), "top"))
    guides = materialize(radii.groupBy(*keys).applyInPandas(_guide(reach), "label long, dim int, guide binary"))
    return with_guides(placed.drop("angle"), guides, "guide").groupBy(*by).applyInPandas(_visitors(reach), f"{_CELLS}, cell int, guest boolean")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("named"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("named").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.filter(valid)
    grouped = good.groupBy("named", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # distinct vectors and labels are known by numbers of their own: a vec_id may come with several vectors
    reps = materialize(grouped.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    names = materialize(reps.select("named").distinct().withColumn("label", F.monotonically_increasing_id()))
    numbered = reps.join(names, "named").select("label", "dim", "rep", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    sent = materialize(sent_to_cells(materialize(numbered), threshold, cell_rows))
    keys = ["label", "dim", "cell"]
    blocks = lambda guest: F.ceil(F.count(F.when(F.col("guest") == guest, True)) / block_rows).cast("int")
    plan = sent.groupBy(*keys).agg(blocks(False).alias("own"), blocks(True).alias("guests")).filter("own > 0")
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("own"))).cast("int")
    dealt = sent.join(plan, keys).withColumn("mine", mine)
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    among = F.transform(upto(F.col("own")), lambda k: pair(F.least(k, F.col("mine")), F.greatest(k, F.col("mine"))))
    none = F.array().cast("array<struct<p:int,q:int>>")
    hosts = F.when(F.col("guests") > 0, F.transform(upto(F.col("guests")), lambda k: pair(F.col("mine"), F.col("own") + k))).otherwise(none)
    visit = F.transform(upto(F.col("own")), lambda k: pair(k, F.col("own") + F.col("mine")))
    meets = F.when(F.col("guest"), visit).otherwise(F.concat(among, hosts))
    block = F.when(F.col("guest"), F.col("own") + F.col("mine")).otherwise(F.col("mine")).alias("block")
    asked = dealt.select(*keys, "rep", "copies", "embedding", block, F.explode(meets).alias("pair")).select(*keys, "rep", "copies", "embedding", "block", "pair.p", "pair.q")
    found = materialize(asked.groupBy(*keys, "p", "q").applyInPandas(_pair(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("other_links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    known = materialize(known.select("named", "embedding", "component", "least", (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links")))
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("named", "embedding", "n_links", "component_id")
    counted = good.join(known, ["named", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return counted.unionByName(alone)


def op9_cover_tree_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m.b, vec_id)) AS BIGINT) AS component_id,
  vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least_of m ON m.a = vec_id"""
