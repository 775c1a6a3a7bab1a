"""Strongly connected components of directed graphs, and what follows from them.

Nodes are numbers. Edges (g, s, t) may belong to several graphs g, which are worked on at once; no
graph and no component is gathered in one task, unless it is of a bounded size and said so.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.storage import written

#: Edges of a connected part or a component that one task may hold.
LOCAL_EDGES = 20_000
#: Edges that a task joins to stars at once.
STAR_EDGES = 500_000


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges (g, s, t, ...) without those that lie on no cycle because one end has no edge before or
    behind it, and so on, and their number. A round is one written table."""
    now, n = edges, None
    while True:
        into, out = now.select("g", F.col("t").alias("s")).distinct(), now.select("g", F.col("s").alias("t")).distinct()
        now = written(now.join(into, ["g", "s"], "left_semi").join(out, ["g", "t"], "left_semi").select(edges.columns))
        before, n = n, now.count()
        if n in (0, before):
            return now, n


def _coloured(edges: DataFrame) -> DataFrame:
    """(g, n, label) for the nodes of edges: the smallest node from which each is reached, or itself.
    Only nodes whose label fell tell their neighbours."""
    nodes = edges.select("g", F.col("s").alias("n")).union(edges.select("g", "t")).distinct()
    state = written(nodes.select("g", "n", F.col("n").alias("label"), F.lit(True).alias("fell")))
    while True:
        told = edges.join(state.filter("fell").select("g", F.col("n").alias("s"), "label"), ["g", "s"]).groupBy("g", F.col("t").alias("n")).agg(F.min("label").alias("new"))
        better = F.coalesce(F.col("new") < F.col("label"), F.lit(False))
        state = written(state.join(told, ["g", "n"], "left").select("g", "n", F.when(better, F.col("new")).otherwise(F.col("label")).alias("label"), better.alias("fell")))
        if state.filter("fell").isEmpty():
            return state.drop("fell")


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (g, a, b) of a task, some at a time, as stars: of the nodes that they join each points to the smallest."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def out() -> pd.DataFrame:
        rows = [(*x, top(x)[1]) for x in list(up)]
        up.clear()
        return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype="int64") for i, k in enumerate("gab")})

    for frame in frames:
        for g, a, b in zip(frame["g"].tolist(), frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = top((g, a)), top((g, b))
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > STAR_EDGES:
            yield out()
    yield out()


def weak_parts(edges: DataFrame) -> DataFrame:
    """(g, n, part) for the nodes of edges that are no loops: the smallest node of those that are joined
    in any direction. What lies in one task is joined there first, by ranges of nodes, then by ranges of the
    smallest nodes found; then by large and small stars in turn, so rounds grow with the logarithm of the
    nodes; a round is one written table of no more rows than edges."""
    near = edges.filter("s <> t").select("g", F.greatest("s", "t").alias("a"), F.least("s", "t").alias("b"))
    joined = lambda e, end: written(e.repartitionByRange("g", end).mapInPandas(_stars, "g long, a long, b long"))
    now, again = joined(near, "a"), True
    while True:
        ends = now.select("g", F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(now.select("g", F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        # stars: a node points to one other at most, and to none if it is pointed to
        if ends.groupBy("g", "n").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up + top > 1").isEmpty():
            return now.select("g", F.col("a").alias("n"), F.col("b").alias("part")).unionByName(now.select("g", F.col("b").alias("n"), F.col("b").alias("part")).distinct())
        if again:
            now, again = joined(now.distinct(), "b"), False
            continue
        # large star: a node's larger neighbours point to its smallest neighbour or itself
        both = now.unionByName(now.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("g", "a").agg(F.min("b").alias("m")).select("g", "a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, ["g", "a"]).select("g", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        first = large.groupBy("g", "a").agg(F.min("b").alias("m"))
        small = large.join(first, ["g", "a"]).filter("b <> m").select("g", F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(first.select("g", "a", F.col("m").alias("b"))).distinct())


def _coded(g: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of edges as numbers from 0, in the order of graph and node, and the node of each number."""
    names, n = np.unique(np.concatenate([s, t]), return_inverse=True)
    _, graph = np.unique(g, return_inverse=True)
    keys, codes = np.unique(np.concatenate([graph, graph]) * len(names) + n, return_inverse=True)
    return codes[: len(s)], codes[len(s) :], names[keys % max(1, len(names))]


def strong_labels(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of the component of each, by edges that one task holds."""
    label = np.arange(n)
    s, t = s[s != t], t[s != t]
    for _ in range(30):  # most edges on no cycle go by their ends, without a search
        inside = (np.bincount(t, minlength=n)[s] > 0) & (np.bincount(s, minlength=n)[t] > 0)
        if inside.all():
            break
        s, t = s[inside], t[inside]
    if not len(s):
        return label
    # Tarjan's search without recursion
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).tolist()
    nexts, at = t[np.argsort(s, kind="stable")].tolist(), starts[:-1]
    index, low, count, held, path = [0] * n, [0] * n, 0, [], []
    for root in np.unique(s).tolist():
        if index[root]:
            continue
        new = root
        while True:
            if new is not None:
                count += 1
                index[new] = low[new] = count
                held.append(new)
                path.append(new)
                new = None
            v = path[-1]
            if at[v] < starts[v + 1]:
                w = nexts[at[v]]
                at[v] += 1
                if not index[w]:
                    new = w
                elif index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            if low[v] == index[v]:
                k = len(held) - 1
                while held[k] != v:
                    k -= 1
                members = held[k:]
                del held[k:]
                label[members] = min(members)
                for m in members:
                    index[m] = n + 1  # no later node falls to it
            if not path:
                break
            low[path[-1]] = min(low[path[-1]], low[v])
    return label


def _small_components(frame: pd.DataFrame) -> pd.DataFrame:
    """All components with a cycle of some small graphs."""
    g = frame["g"].to_numpy()
    s, t, names = _coded(g, frame["s"].to_numpy(), frame["t"].to_numpy())
    label = strong_labels(s, t, len(names))
    inside = label[s] == label[t]
    found = pd.DataFrame({"g": g[inside], "n": names[s[inside]], "component": names[label[s[inside]]]}, dtype="int64")
    return found.drop_duplicates()


def dealt(edges: DataFrame, keys: list[str], local_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of the graphs that keys tell apart with up to local_edges edges, with a `task` of about
    local_edges edges in which a graph lies whole, and the edges of the others, if there are any."""
    sizes = written(edges.groupBy(*keys).agg(F.count("*").alias("size")))
    few = F.col("size") <= local_edges
    total, many = sizes.agg(F.sum(F.when(few, F.col("size"))), F.count(F.when(~few, True))).first()
    tasks = max(1, -(-(total or 0) // max(1, local_edges)))
    task = F.pmod(F.xxhash64(*keys), F.lit(tasks)).alias("task")
    return edges.join(sizes.filter(few).select(*keys, task), keys), edges.join(sizes.filter(~few).select(*keys), keys, "left_semi") if many else None


def parted(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges (g, s, t, ...), dealt by weakly connected parts."""
    ends = weak_parts(edges).withColumnRenamed("n", "s")
    placed = written(edges.join(ends, ["g", "s"], "left").withColumn("part", F.coalesce("part", "s")))
    small, large = dealt(placed, ["g", "part"], local_edges)
    return small.drop("part"), large and large.drop("part")


def _by_part(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """(components, rest): the components in all graphs, and all weakly connected parts of graphs, of up to
    local_edges edges, and the edges of the other parts. They are dealt whole to tasks of about
    local_edges edges each."""
    many = written(edges.groupBy("g").agg(F.count("*").alias("many")).filter(F.col("many") > local_edges).select("g"))
    large = edges.join(many, "g", "left_semi")
    placed = edges.join(many, "g", "left_anti").withColumn("part", F.lit(-1).cast("long"))
    if not many.isEmpty():
        ends = weak_parts(large).withColumnRenamed("n", "s")
        placed = placed.unionByName(large.join(ends, ["g", "s"], "left").withColumn("part", F.coalesce("part", "s")))
    placed = written(placed)
    sizes = written(placed.groupBy("g", "part").agg(F.count("*").alias("size")))
    small = sizes.filter(F.col("size") <= local_edges)
    tasks = max(1, -(-(small.agg(F.sum("size")).first()[0] or 0) // max(1, local_edges)))
    dealt = placed.join(small, ["g", "part"]).withColumn("task", F.pmod(F.xxhash64("g", "part"), F.lit(tasks)))
    found = written(dealt.select("task", "g", "s", "t").groupBy("task").applyInPandas(_small_components, "g long, n long, component long"))
    return found, placed.join(small, ["g", "part"], "left_anti").select("g", "s", "t")


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(g, n, component) for all nodes on cycles of edges (g, s, t); component is the smallest node
    of those that reach each other. Weakly connected parts of up to local_edges edges are finished in
    tasks. In larger ones by trimming and colouring: a colour's root, the node that gave
    it, forms a component with the nodes of its colour that reach it, found backwards; they are
    taken out, and edges between colours with them, and what is left is parted again."""
    left = written(edges.select("g", "s", "t").distinct())
    n, out = left.count(), []
    while True:
        if n <= local_edges:
            out.append(written(left.groupBy("g").applyInPandas(_small_components, "g long, n long, component long")))
            return union(out)
        if local_edges:
            found, left = _by_part(left, local_edges)
            out.append(found)
        left, n = trimmed(left)
        if n <= local_edges:
            continue
        colour = _coloured(left)
        same = left.join(colour.select("g", F.col("n").alias("s"), F.col("label").alias("a")), ["g", "s"]).join(colour.select("g", F.col("n").alias("t"), F.col("label").alias("b")), ["g", "t"])
        same = written(same.filter("a = b").select("g", "s", "t", F.col("a").alias("label")))
        back = same.select("g", "label", F.col("t").alias("n"), F.col("s").alias("m"))
        # only labels whose root has an edge into it inside the colour have a component
        front = written(same.filter("t = label").select("g", "label", F.col("label").alias("n")).distinct())
        found = [front]
        while not front.isEmpty():
            new = back.join(front, ["g", "label", "n"]).select("g", "label", F.col("m").alias("n")).distinct()
            front = written(new.join(union(found), ["g", "label", "n"], "left_anti"))
            found.append(front)
        members = written(union(found).select("g", "n", F.col("label").alias("component")))
        out.append(members)
        gone = members.select("g", "n")
        roots = same.select("g", F.col("label").alias("n")).distinct()  # roots without a component are on no cycle
        gone = gone.union(roots).distinct()
        rest = same.select("g", "s", "t").join(gone.withColumnRenamed("n", "s"), ["g", "s"], "left_anti").join(gone.withColumnRenamed("n", "t"), ["g", "t"], "left_anti")
        left, n = trimmed(rest)


def tarjan(after: dict) -> dict:
    """Component of each node of a small graph of lists, by Tarjan's search without recursion."""
    index, low, stack, held, out = {}, {}, [], set(), {}
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, nexts = work[-1]
            for m in nexts:
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    held.add(m)
                    work.append((m, iter(after.get(m, ()))))
                    break
                if m in held:
                    low[node] = min(low[node], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        m = stack.pop()
                        held.discard(m)
                        out[m] = node
                        if m == node:
                            break
    return out


def closing_places(g: np.ndarray, r: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Places of the edges (g, r, s, t), which one task holds, that close a cycle of their graph with edges of
    rank up to theirs; edges of rank -1 are there from the start and are not asked for. It is the bisection
    of closing_edges, a round for all graphs at once."""
    place, done = np.arange(len(r)), []
    # the first round parts the graphs into components, and ranks are counted in each
    s, t, names = _coded(g, s, t)
    label = strong_labels(s, t, len(names))
    g, inside = label[s], label[s] == label[t]
    place, g, r, s, t = (x[inside] for x in (place, g, r, s, t))
    order = np.lexsort((r, g))
    order = order[r[order] >= 0]
    heads, first, many = np.unique(g[order], return_index=True, return_counts=True)
    r = r.copy()
    r[order] = np.arange(len(order)) - np.repeat(first, many)
    asked = np.isin(g, heads)
    place, g, r, s, t = (x[asked] for x in (place, g, r, s, t))
    low, high = np.zeros(len(g), dtype="int64"), many[np.searchsorted(heads, g)] - 1
    while len(place):
        # an interval of one rank: its edge lies inside a component, so it closes a cycle
        one = low == high
        done.append(place[one & (r >= 0)])
        place, g, r, s, t, low, high = (x[~one] for x in (place, g, r, s, t, low, high))
        mid = (low + high) // 2
        early = r <= mid
        s, t, names = _coded(g, s, t)
        label = strong_labels(s[early], t[early], len(names))
        a, b = label[s], label[t]
        inside = a == b
        done.append(place[inside & ~early])
        lower, upper = inside & early, ~inside
        both = lambda x, y: np.concatenate([x[lower], y[upper]])
        _, g = np.unique(g, return_inverse=True)
        place, g, low, high, s, t, r = both(place, place), both(a, g + len(names)), both(low, mid + 1), both(mid, high), both(s, a), both(t, b), both(r, np.where(early, -1, r))
        _, g = np.unique(g, return_inverse=True)
        left = np.bincount(g, weights=r >= 0)[g] > 0
        place, g, r, s, t, low, high = (x[left] for x in (place, g, r, s, t, low, high))
    return np.concatenate(done) if done else place


def closing_edges(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(g, r) of the edges (g, r, s, t), r from 0 and different for each, that close a cycle with edges
    of smaller r, each counted whether it is one of them itself or not: for r by falling strength,
    those that are the weakest of some cycle. Without them the graph has no cycle.

    The smallest number of edges at which both ends of an edge lie in one component is narrowed by
    bisection, for all edges at once: the components of the lower half of an interval part its edges
    into those inside, which go on in the lower half, and those across, which go on in the upper
    one with components contracted. So there are as many rounds as the ranks have bits, and in
    each an edge is in one graph. Graphs of up to local_edges edges are finished in one task."""
    inner = strong_components(edges)
    at = lambda e, end, c: e.join(c.select("g", F.col("n").alias(end), F.col("component").alias(f"{end}_c")), ["g", end], "left")
    now = at(at(edges.select("g", "r", "s", "t"), "s", inner), "t", inner).filter("s_c = t_c")
    # a graph is a component and an interval of ranks, [low, high], at the end of which it is one component
    top = edges.agg(F.max("r")).first()[0]
    now = written(now.select(F.col("g").alias("graph"), F.col("s_c").alias("part"), F.lit(0).cast("long").alias("low"), F.lit(top or 0).cast("long").alias("high"), "r", "s", "t"))
    done = []

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        rank = frame["r"].fillna(-1).to_numpy().astype("int64")
        found = closing_places(np.zeros(len(rank), dtype="int64"), rank, frame["s"].to_numpy(), frame["t"].to_numpy())
        return pd.DataFrame({"g": frame["graph"].iloc[0], "r": rank[found]})

    while True:
        keys = ["graph", "part", "low", "high"]
        sizes = now.groupBy(*keys).agg(F.count("*").alias("size"), F.count("r").alias("open"))
        sized = now.join(sizes.filter("open > 0"), keys)
        small = sized.filter((F.col("size") <= local_edges) | (F.col("low") == F.col("high"))).drop("size", "open")
        # an interval of one rank: its edge lies inside a component, so it closes a cycle
        one = small.filter("low = high and r is not null").select(F.col("graph").alias("g"), "r")
        done.append(written(small.filter("low < high").groupBy("graph", "part", "low").applyInPandas(finish, "g long, r long").unionByName(one)))
        large = written(sized.filter((F.col("size") > local_edges) & (F.col("low") < F.col("high"))).drop("size", "open"))
        if large.isEmpty():
            return union(done)
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        # graphs are told apart by a number of their own
        names = written(large.select(*keys).distinct().withColumn("g", F.monotonically_increasing_id()))
        halves = written(large.join(names, keys).withColumn("mid", mid))
        parts = strong_components(halves.filter("r is null or r <= mid"))
        e = at(at(halves, "s", parts), "t", parts)
        e = written(e.withColumn("inside", F.coalesce(F.col("s_c") == F.col("t_c"), F.lit(False))))
        done.append(written(e.filter("inside and r > mid").select(F.col("graph").alias("g"), "r")))
        lower = e.filter("inside and (r is null or r <= mid)").select("graph", F.col("s_c").alias("part"), "low", F.col("mid").alias("high"), "r", "s", "t")
        upper = e.filter("not inside").select("graph", "part", (F.col("mid") + 1).alias("low"), "high", F.when(F.col("r") > F.col("mid"), F.col("r")).alias("r"), F.coalesce("s_c", "s").alias("s"), F.coalesce("t_c", "t").alias("t"))
        now = written(lower.unionByName(upper))
