"""Prerequisite graphs: concepts (id, topic_id, name, difficulty, ...) and edges (source_id,
target_id, topic_id, strength), source being a prerequisite of target. All functions work on
all topics at once; no topic and no neighbourhood is gathered in one task unless said so."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import UMBRELLA_WORDS, tokens
from trellis.operators.components import LOCAL_EDGES, closing_edges, closing_places, dealt, parted, strong_components, strong_labels, tarjan, union, weak_parts
from trellis.operators.storage import written
from trellis.operators.tables import ranked


def topic_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges with both ends among the concepts of their topic; strength 1.0 by default."""
    ids = concepts.select("id", "topic_id")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), ["source_id", "topic_id"], "left_semi")
    out = out.join(ids.withColumnRenamed("id", "target_id"), ["target_id", "topic_id"], "left_semi")
    return out.withColumn("strength", F.coalesce(F.col("strength").cast("double"), F.lit(1.0)))


def root_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    targets = edges.select("topic_id", F.col("target_id").alias("id"))
    return concepts.join(targets, ["topic_id", "id"], "left_anti").select("topic_id", "id")


def unlock_candidates(concepts: DataFrame, edges: DataFrame, mastered: DataFrame) -> DataFrame:
    """Concepts not mastered whose direct prerequisites all are; mastered has topic_id, id."""
    missing = edges.join(mastered.withColumnRenamed("id", "source_id"), ["topic_id", "source_id"], "left_anti")
    missing = missing.select("topic_id", F.col("target_id").alias("id"))
    return concepts.join(mastered, ["topic_id", "id"], "left_anti").join(missing, ["topic_id", "id"], "left_anti").select("topic_id", "id")


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(topic_id, src, dst): dst is reached from src by one edge or more, for all src or those
    in seeds (topic_id, src). Each round joins only what the last one found; src = dst appears
    if src lies on a cycle."""
    steps = written(edges.select("topic_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct())
    known = steps if seeds is None else steps.join(seeds, ["topic_id", "src"], "left_semi")
    known = front = steps if seeds is None else written(known)
    hop = steps.select("topic_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        new = front.join(hop, ["topic_id", "dst"]).select("topic_id", "src", F.col("next").alias("dst")).distinct()
        front = written(new.join(known, ["topic_id", "src", "dst"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def peeled(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Distinct edges (topic_id, source_id, target_id, ...) by the layer of their source, a table for
    each layer from 0, and those left over on or behind cycles. A round takes the edges whose source
    is no target any more; it is one written table and one count."""
    left, out = edges, []
    while True:
        targets = left.select("topic_id", F.col("target_id").alias("source_id"), F.lit(False).alias("free")).distinct()
        state = written(left.join(targets, ["topic_id", "source_id"], "left").withColumn("free", F.coalesce("free", F.lit(True))))
        n, free = state.agg(F.count("*"), F.count(F.when(F.col("free"), True))).first()
        left = state.filter(~F.col("free")).drop("free")
        if free:
            out.append(state.filter("free").drop("free"))
        if not free or free == n:
            return out, left


def layers(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic_id, id, layer) and the edges left over. The layer is the length of the longest
    path from a root. Nodes on or behind a cycle are left over and have layer 0."""
    found, left = peeled(written(edges.select("topic_id", "source_id", "target_id").distinct()))
    return _layers(concepts, found, left), left


def _layers(concepts: DataFrame, found: list[DataFrame], left: DataFrame) -> DataFrame:
    nodes = concepts.select("topic_id", "id")
    if not found:
        return nodes.withColumn("layer", F.lit(0).cast("long"))
    steps = union([e.select("topic_id", F.col("target_id").alias("id"), F.lit(k + 1).cast("long").alias("layer")) for k, e in enumerate(found)])
    steps = steps.unionByName(left.select("topic_id", F.col("target_id").alias("id"), F.lit(-1).cast("long").alias("layer")))
    far = steps.groupBy("topic_id", "id").agg(F.when(F.min("layer") < 0, 0).otherwise(F.max("layer")).cast("long").alias("layer"))
    return nodes.join(far, ["topic_id", "id"], "left").select("topic_id", "id", F.coalesce("layer", F.lit(0)).alias("layer"))


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (topic_id, source_id, target_id) between components, and (topic_id, id, head) of
    the nodes of components with a cycle: head, their smallest node, stands for them."""
    rows, nodes = numbered(edges)
    found = written(strong_components(rows.select("g", "s", "t")))
    names = nodes.select(F.col("n").alias("component"), F.col("id").alias("head"))
    members = written(found.join(nodes, "n").join(names, "component").select("topic_id", "id", "head"))
    out = edges.select("topic_id", "source_id", "target_id")
    for end in ("source_id", "target_id"):
        out = out.join(members.select("topic_id", F.col("id").alias(end), "head"), ["topic_id", end], "left").withColumn(end, F.coalesce("head", end)).drop("head")
    return out.filter("source_id <> target_id").distinct(), members


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their ends as numbers s and t in one graph g, or in those that a column g tells apart,
    and the nodes (topic_id, id, n)."""
    edges = written(edges)
    # neighbours in number are neighbours in topic, without a count before
    nodes = written(_ends(edges).repartitionByRange("topic_id", "id").sortWithinPartitions("topic_id", "id").withColumn("n", F.monotonically_increasing_id()))
    a, b = (nodes.select("topic_id", F.col("id").alias(f"{k}_id"), F.col("n").alias(k[0])) for k in ("source", "target"))
    return written(edges.join(a, ["topic_id", "source_id"]).join(b, ["topic_id", "target_id"]).withColumn("g", F.col("g") if "g" in edges.columns else F.lit(0).cast("long"))), nodes


def concept_edges(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """topic_edges with their ends as numbers s and t, in the order of topic and id, in one graph g: concepts are
    numbered, so that two joins do for both and edges are read once."""
    ids = concepts.select("topic_id", "id").distinct()
    nodes = written(ids.repartitionByRange("topic_id", "id").sortWithinPartitions("topic_id", "id").withColumn("n", F.monotonically_increasing_id()))
    a, b = (nodes.select("topic_id", F.col("id").alias(f"{k}_id"), F.col("n").alias(k[0])) for k in ("source", "target"))
    strength = F.coalesce(F.col("strength").cast("double"), F.lit(1.0))
    return edges.withColumn("strength", strength).join(a, ["topic_id", "source_id"]).join(b, ["topic_id", "target_id"]).withColumn("g", F.lit(0).cast("long"))


class Reach:
    """What each node reaches, as blocks of 64 bits: bit k of block b stands for the node with number
    64 b + k. Nodes are numbered by topic and layer, so that what one reaches lies close together.
    Blocks are pushed from the deepest layer upwards, where those of a node's targets are or-ed
    together; each edge is joined once, and no pair of nodes is ever a row."""

    def __init__(self, found: list[DataFrame], nodes: DataFrame):
        """found: edges by layer of their source (peeled); nodes (topic_id, id, layer) of all ends."""
        self.numbers = written(ranked(nodes.select("topic_id", "id", "layer"), ["topic_id", "layer", "id"], "n").drop("layer"))
        own = self.numbers.select("topic_id", "id", *_bit())
        levels: list[DataFrame] = []
        for edges in reversed(found):
            # a target's own bit and what it reaches itself
            known = union([own, *levels]).withColumnRenamed("id", "target_id")
            pushed = edges.select("topic_id", "source_id", "target_id").join(known, ["topic_id", "target_id"])
            levels.append(written(pushed.groupBy("topic_id", F.col("source_id").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))))
        self.blocks = union(levels) if levels else own.limit(0)

    def counts(self) -> DataFrame:
        """(topic_id, id, fanout) of the nodes that reach any."""
        return self.blocks.groupBy("topic_id", "id").agg(F.sum(F.bit_count("bits")).alias("fanout"))

    def holds(self, pairs: DataFrame) -> DataFrame:
        """pairs (topic_id, src, dst) with `reached`, whether dst's bit is set in src's blocks."""
        bits = self.numbers.select("topic_id", F.col("id").alias("dst"), *_bit("block", "bit"))
        asked = pairs.join(bits, ["topic_id", "dst"], "left")
        found = asked.join(self.blocks.withColumnRenamed("id", "src"), ["topic_id", "src", "block"], "left")
        return found.select(*pairs.columns, F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)).alias("reached"))


def _bit(block: str = "block", bits: str = "bits") -> list[Column]:
    return [F.shiftright("n", 6).alias(block), F.expr("shiftleft(1L, cast(n & 63 AS INT))").alias(bits)]


def _graph_of(edges: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Edges by layer and nodes (topic_id, id, layer), with components contracted where there are
    cycles; their members are given then."""
    edges = written(edges.select("topic_id", "source_id", "target_id").distinct())
    found, left = peeled(edges)
    members = None
    if not left.isEmpty():
        edges, members = condensed(edges)
        edges = written(edges)
        found, left = peeled(edges)
    return found, written(_layers(_ends(edges), found, left)), members


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("topic_id", F.col("source_id").alias("id")).union(edges.select("topic_id", "target_id")).distinct()


def fan_out(concepts: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Number of concepts that depend on each one, directly or not, itself left out. Weakly connected
    parts of up to local_edges edges are counted in tasks, the others by blocks of bits, layer by layer."""
    rows, nodes = _parted(edges)
    sizes = written(rows.groupBy("part").agg(F.count("*").alias("e")))
    small = sizes.filter(F.col("e") <= local_edges)
    tasks = max(1, -(-(small.agg(F.sum("e")).first()[0] or 0) // max(1, local_edges)))
    dealt = rows.join(small.select("part", F.pmod(F.xxhash64("part"), F.lit(tasks)).alias("task")), "part")
    n = dealt.select("task", "part", "s", "t").groupBy("task").applyInPandas(_small_fan_out, "n long, fanout long")
    n = nodes.join(n, "n").select("topic_id", "id", "fanout")
    large = sizes.filter(F.col("e") > local_edges).select("part")
    if not large.isEmpty():
        inside = written(nodes.join(large, "part", "left_semi").select("topic_id", "id"))
        found, layered, members = _graph_of(rows.join(large, "part", "left_semi"))
        n = n.unionByName(_fan_out(inside, found, layered, members))
    return concepts.select("topic_id", "id").join(n, ["topic_id", "id"], "left").select("topic_id", "id", F.coalesce("fanout", F.lit(0)).cast("long").alias("fanout"))


def _parted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (part, s, t, topic_id, source_id, target_id), their ends as numbers s and t, and the
    nodes (topic_id, id, n, part): part tells weakly connected parts apart."""
    rows, nodes = numbered(edges.select("topic_id", "source_id", "target_id").distinct())
    parts = weak_parts(rows.select("g", "s", "t")).select("n", "part")
    nodes = written(nodes.join(parts, "n", "left").select("topic_id", "id", "n", F.coalesce("part", "n").alias("part")))
    return written(rows.join(nodes.select(F.col("n").alias("s"), "part"), "s").select("part", "s", "t", "topic_id", "source_id", "target_id")), nodes


def _small_fan_out(frame: pd.DataFrame) -> pd.DataFrame:
    """(n, fanout) of the nodes of some small parts by their edges (part, s, t)."""
    after, places = {}, {}
    for p, s, t in zip(frame["part"].tolist(), frame["s"].tolist(), frame["t"].tolist(), strict=True):
        after.setdefault(s, []).append(t)
        bits = places.setdefault(p, {})
        for n in (s, t):
            bits.setdefault(n, len(bits))
    bit = {n: k for bits in places.values() for n, k in bits.items()}
    # components come with those that they reach before them
    heads, members = tarjan(after), {}
    for n, c in heads.items():
        members.setdefault(c, []).append(n)
    reached, found = {}, []
    for c, inside in members.items():
        seen = 0
        for n in inside:
            seen |= 1 << bit[n]
            for d in {heads[t] for t in after.get(n, ())} - {c}:
                seen |= reached[d]
        reached[c] = seen
        found += [(n, seen.bit_count() - 1) for n in inside]
    return pd.DataFrame({k: pd.Series([x[i] for x in found], dtype="int64") for i, k in enumerate(("n", "fanout"))})


def _fan_out(concepts: DataFrame, found: list[DataFrame], nodes: DataFrame, members: DataFrame | None) -> DataFrame:
    ids = concepts.select("topic_id", "id")
    if members is None:
        n = Reach(found, nodes).counts()
    else:
        # a component's members reach what its head does, and each other: heads weigh their members
        sizes = members.groupBy("topic_id", F.col("head").alias("id")).agg((F.count("*") - 1).alias("more"))
        reach = Reach(found, nodes.unionByName(members.select("topic_id", F.col("head").alias("id"), F.lit(0).cast("long").alias("layer"))).dropDuplicates(["topic_id", "id"]))
        heavy = reach.numbers.join(sizes, ["topic_id", "id"]).select("topic_id", *_bit("block", "bit"), "more")
        extra = reach.blocks.join(heavy, ["topic_id", "block"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("topic_id", "id").agg(F.sum("more").alias("extra"))
        by_head = reach.counts().join(extra, ["topic_id", "id"], "full_outer").join(sizes, ["topic_id", "id"], "full_outer").fillna(0, ["fanout", "extra", "more"])
        by_head = by_head.select("topic_id", "id", (F.col("fanout") + F.col("extra") + F.col("more")).alias("fanout"))
        inside = members.join(by_head.withColumnRenamed("id", "head"), ["topic_id", "head"]).select("topic_id", "id", "fanout")
        n = by_head.join(members.select("topic_id", "id"), ["topic_id", "id"], "left_anti").unionByName(inside)
    return ids.join(n, ["topic_id", "id"], "left").select("topic_id", "id", F.coalesce("fanout", F.lit(0)).alias("fanout"))


def reaches(edges: DataFrame, pairs: DataFrame, labels: int = 4, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """pairs (topic_id, src, dst) with `reached`, whether a path of one edge or more leads from src to
    dst, without a closure. Weakly connected parts of up to local_edges edges, and ten times as many
    pairs, are searched in tasks; pairs in the others by labels and rounds."""
    rows, nodes = _parted(edges)
    a, b = (nodes.select("topic_id", F.col("id").alias(k), F.col("n").alias(x), F.col("part").alias(f"{x}_part")) for k, x in (("src", "a"), ("dst", "b")))
    asked = pairs.select("topic_id", "src", "dst").distinct().join(a, ["topic_id", "src"]).join(b, ["topic_id", "dst"])
    asked = written(asked.filter("a_part = b_part").select("topic_id", "src", "dst", "a", "b", F.col("a_part").alias("part")))
    sizes = rows.select("part", F.lit(1).alias("e"), F.lit(0).alias("q")).unionByName(asked.select("part", F.lit(0).alias("e"), F.lit(1).alias("q"))).groupBy("part").agg(F.sum("e").alias("e"), F.sum("q").alias("q"))
    sizes = written(sizes.withColumn("large", (F.col("e") > local_edges) | (F.col("q") > 10 * local_edges)))
    tasks = max(1, -(-(sizes.filter("not large and q > 0").agg(F.sum(F.greatest("e", F.col("q") / 10))).first()[0] or 0) // max(1, local_edges)))
    dealt = sizes.filter("not large and q > 0").select("part", F.pmod(F.xxhash64("part"), F.lit(int(tasks))).alias("task"))
    steps = rows.join(dealt, "part").select("task", "s", "t").groupBy("task")
    hits = written(steps.cogroup(asked.join(dealt, "part").select(F.col("task").alias("at"), "a", "b").groupBy("at")).applyInPandas(_small_reaches, "a long, b long"))
    reached = asked.join(hits, ["a", "b"], "left_semi").select("topic_id", "src", "dst")
    large = sizes.filter("large").select("part")
    if not large.isEmpty():
        far = _searched(rows.join(large, "part", "left_semi"), asked.join(large, "part", "left_semi").select("topic_id", "src", "dst"), labels)
        reached = reached.unionByName(far.filter("reached").drop("reached"))
    return pairs.join(reached.withColumn("reached", F.lit(True)), ["topic_id", "src", "dst"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def _small_reaches(steps: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b) of those asked for where b is reached from a by steps (s, t) of some small parts."""
    after: dict = {}
    for s, t in zip(steps["s"].tolist(), steps["t"].tolist(), strict=True):
        after.setdefault(s, []).append(t)
    goals: dict = {}
    for a, b in zip(asked["a"].tolist(), asked["b"].tolist(), strict=True):
        goals.setdefault(a, set()).add(b)
    found = []
    for a, left in goals.items():
        seen: set = set()
        todo = [a]
        while todo and left:
            for t in after.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
                    if t in left:
                        left.discard(t)
                        found.append((a, t))
    return pd.DataFrame({k: pd.Series([x[i] for x in found], dtype="int64") for i, k in enumerate("ab")})


def _searched(edges: DataFrame, pairs: DataFrame, labels: int) -> DataFrame:
    """pairs (topic_id, src, dst) with `reached`, as reaches says. Every node is labelled with its layer and, for some random orders of the
    nodes, the smallest place among those it reaches and itself: a node that reaches another has a
    smaller layer and no label above the other's. A search for all pairs at once takes only steps to
    nodes whose labels still allow the goal; a pair that is found is not searched on."""
    found, nodes, members = _graph_of(edges)
    asked = pairs.select("topic_id", "src", "dst").distinct()
    ends = asked.withColumn("a", F.col("src")).withColumn("b", F.col("dst"))
    if members is not None:
        for end in ("a", "b"):
            ends = ends.join(members.select("topic_id", F.col("id").alias(end), "head"), ["topic_id", end], "left").withColumn(end, F.coalesce("head", end)).withColumn(f"{end}_cycle", F.col("head").isNotNull()).drop("head")
        same = ends.filter("a = b and a_cycle").select("topic_id", "src", "dst")
    else:
        same = asked.limit(0)
    ends = written(ends.filter("a <> b").select("topic_id", "src", "dst", "a", "b"))
    places = [F.xxhash64("topic_id", "id", F.lit(k)).alias(f"l{k}") for k in range(labels)]
    names = [f"l{k}" for k in range(labels)]
    own, levels = nodes.select("topic_id", "id", *places), []
    for step in reversed(found):
        below = own.unionByName(union([x.select(own.columns) for x in levels])) if levels else own
        low = step.select("topic_id", F.col("source_id").alias("id"), "target_id").join(below.withColumnRenamed("id", "target_id"), ["topic_id", "target_id"]).drop("target_id")
        levels.append(written(low.groupBy("topic_id", "id").agg(*(F.min(k).alias(k) for k in names))))
    lows = union([own, *levels]).groupBy("topic_id", "id").agg(*(F.min(k).alias(k) for k in names))
    lows = written(lows.join(nodes, ["topic_id", "id"]))
    goal = lows.select("topic_id", F.col("id").alias("b"), F.col("layer").alias("b_layer"), *(F.col(k).alias(f"b_{k}") for k in names))
    allowed = reduce(Column.__and__, [F.col(k) <= F.col(f"b_{k}") for k in names], F.col("layer") < F.col("b_layer"))
    fits = lambda front: front.join(lows.withColumnRenamed("id", "a"), ["topic_id", "a"]).filter((F.col("a") == F.col("b")) | allowed).drop("layer", *names)
    hops = union([e.select("topic_id", F.col("source_id").alias("a"), F.col("target_id").alias("next")) for e in found]) if found else None
    front = written(fits(ends.join(goal, ["topic_id", "b"])))
    hits = [same]
    while hops is not None and not front.isEmpty():
        step = front.join(hops, ["topic_id", "a"]).drop("a").withColumnRenamed("next", "a").distinct()
        step = written(fits(step))
        done = step.filter("a = b").select("topic_id", "src", "dst").distinct()
        hits.append(done)
        front = written(step.join(done, ["topic_id", "src", "dst"], "left_anti"))
    reached = union([x.select("topic_id", "src", "dst") for x in hits]).withColumn("reached", F.lit(True))
    return pairs.join(reached, ["topic_id", "src", "dst"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def topological_order(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic_id, id, position): prerequisites first, by layer and id. Raises on cycles."""
    levels, left = layers(concepts, edges)
    if not left.isEmpty():
        raise ValueError("the graph has cycles")
    w = Window.partitionBy("topic_id").orderBy("layer", "id")
    return levels.select("topic_id", "id", F.row_number().over(w).cast("long").alias("position"))


def cycle_core(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic_id, id) of all concepts on a cycle."""
    return _cyclic_nodes(topic_edges(edges, concepts)).select("topic_id", "id")


def _cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(topic_id, id, component) of all nodes on a cycle."""
    rows, nodes = numbered(edges.select("topic_id", "source_id", "target_id").distinct())
    return strong_components(rows.select("g", "s", "t")).join(nodes, "n").select("topic_id", "id", "component")


def cyclic_edges(concepts: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The edges that lie on a cycle, with the number of their component as column g and those of their
    ends, in the order of topic and id, as s and t. Cycles that are left when some of them are gone lie
    inside these components, so that later searches are parted by g and number nothing anew."""
    rows = written(concept_edges(concepts, edges).select(*edges.columns, "g", "s", "t"))
    small, large = parted(rows, local_edges)
    found = small.groupBy("task").applyInArrow(_small_cyclic_edges, rows.schema)
    return found if large is None else found.unionByName(_inside(large))


def _small_cyclic_edges(table: pa.Table) -> pa.Table:
    """The edges (task, g, s, t, ...) of some small parts that lie on a cycle, with the number of their component as g."""
    s, t = (table.column(k).to_numpy() for k in "st")
    names, codes = np.unique(np.concatenate([s, t]), return_inverse=True)
    label = strong_labels(codes[: len(s)], codes[len(s) :], len(names))
    a, b = label[codes[: len(s)]], label[codes[len(s) :]]
    out = table.set_column(table.column_names.index("g"), "g", pa.array(names[a])).drop_columns(["task"])
    return out.filter(pa.array(a == b))


def _inside(edges: DataFrame) -> DataFrame:
    """The edges (g, s, t, ...) that lie on a cycle, with the number of their component as g."""
    found, rows = written(strong_components(edges.select("g", "s", "t"))), edges
    for end in ("s", "t"):
        rows = rows.join(found.select("g", F.col("n").alias(end), F.col("component").alias(f"{end}_c")), ["g", end])
    return rows.filter("s_c = t_c").withColumn("g", F.col("s_c")).select(edges.columns)


def detect_cycles(concepts: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(topic_id, nodes) with one cycle of each topic that has any: a shortest one through the
    topic's smallest concept on a cycle, the first of these in order. It lies in that concept's component:
    one of up to local_edges edges is searched in a task, larger ones by levels for all topics at once,
    where every concept keeps one path, so that a level has no more rows than concepts. edges may be
    those of cyclic_edges, or some of them."""
    if "g" not in edges.columns:
        edges = written(cyclic_edges(concepts, edges.select("topic_id", "source_id", "target_id").distinct().withColumn("strength", F.lit(1.0)), local_edges))
    small, large = dealt(edges.select("g", "s", "t", "topic_id", "source_id", "target_id"), ["g"], local_edges)
    found = small.drop("target_id").groupBy("task").applyInArrow(_small_cycles, "topic_id string, first long, nodes array<string>")
    found = found.groupBy("topic_id").agg(F.min("first").alias("first"), F.min_by("nodes", "first").alias("nodes"))
    if large is None:
        return found.drop("first")
    found, inside = written(found), written(_inside(large).distinct())
    first = inside.groupBy("topic_id").agg(F.min("g").alias("g")).join(found.select("topic_id", "first"), "topic_id", "left")
    first = written(first.filter("first is null or g < first").select("topic_id", "g"))
    steps = inside.join(first, ["topic_id", "g"]).select("topic_id", F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    steps = written(steps.join(steps.groupBy("topic_id").agg(F.min("id").alias("first")), "topic_id"))
    far = written(steps.groupBy("topic_id").agg(F.count("*").alias("size")).filter(F.col("size") > local_edges).select("topic_id"))
    near = steps.join(far, "topic_id", "left_anti").groupBy("topic_id").applyInPandas(_small_cycle, "topic_id string, nodes array<string>")
    found = found.join(first, "topic_id", "left_anti").select("topic_id", "nodes").unionByName(near)
    return found if far.isEmpty() else found.unionByName(_searched_cycles(written(steps.join(far, "topic_id", "left_semi"))))


def _small_cycles(table: pa.Table) -> pa.Table:
    """(topic_id, first, nodes): of each topic the cycle that detect_cycles finds in some small graphs by their
    edges (g, s, t, topic_id, source_id), and the number of its first node."""
    s, t = (table.column(k).to_numpy() for k in "st")
    names, codes = np.unique(np.concatenate([s, t]), return_inverse=True)
    label = strong_labels(codes[: len(s)], codes[len(s) :], len(names))[codes]
    component = label[: len(s)]
    on = np.flatnonzero(component == label[len(s) :])
    topics = table.column("topic_id").combine_chunks().dictionary_encode()
    topic = topics.indices.to_numpy()
    on = on[np.lexsort((s[on], topic[on]))]
    heads = on[np.unique(topic[on], return_index=True)[1]]
    found = []
    for k in heads.tolist():
        rows = on[component[on] == component[k]]
        path = _shortest_cycle(s[rows].tolist(), t[rows].tolist(), int(s[k]))
        at = dict(zip(s[rows].tolist(), rows.tolist(), strict=True))
        found.append((topics.dictionary[int(topic[k])].as_py(), int(s[k]), table.column("source_id").take([at[n] for n in path]).to_pylist()))
    kinds = (("topic_id", pa.string()), ("first", pa.int64()), ("nodes", pa.list_(pa.string())))
    return pa.table({name: pa.array([x[i] for x in found], kind) for i, (name, kind) in enumerate(kinds)})


def _shortest_cycle(sources: list, targets: list, first: object) -> list:
    """The nodes of a shortest cycle through first, the first of these in order, in a component by its edges."""
    after: dict = {}
    for a, b in zip(sources, targets, strict=True):
        after.setdefault(a, []).append(b)
    # the nodes of a level in the order of their paths, so that the first to reach a node has its path
    before, front = {}, [first]
    while True:
        level: dict = {}
        for a in front:
            for b in after[a]:
                if b == first:
                    path = [a]
                    while path[-1] != first:
                        path.append(before[path[-1]])
                    return path[::-1]
                if b not in before and b not in level:
                    level[b] = a
        place = {a: k for k, a in enumerate(front)}
        before |= level
        front = sorted(level, key=lambda b: (place[level[b]], b))


def _small_cycle(frame: pd.DataFrame) -> pd.DataFrame:
    """The cycle of a topic whose steps (id, next) are few, as detect_cycles says."""
    nodes = _shortest_cycle(frame["id"].tolist(), frame["next"].tolist(), frame["first"].iloc[0])
    return pd.DataFrame({"topic_id": [frame["topic_id"].iloc[0]], "nodes": [nodes]})


def _searched_cycles(steps: DataFrame) -> DataFrame:
    """The cycles of topics by their steps (topic_id, id, next, first), as detect_cycles says."""
    front = written(steps.filter("id = first").select("topic_id", "id", F.array("id").alias("nodes")).distinct())
    known, found = None, []
    hops = steps.select("topic_id", "id", "next")
    while not front.isEmpty():
        known = front.select("topic_id", "id") if known is None else known.unionByName(front.select("topic_id", "id"))
        reached = front.join(hops, ["topic_id", "id"]).groupBy("topic_id", F.col("next").alias("id")).agg(F.min("nodes").alias("nodes"))
        reached = written(reached)
        closed = reached.filter(F.col("id") == F.col("nodes")[0]).select("topic_id", "nodes")
        found.append(closed)
        further = reached.join(closed, "topic_id", "left_anti").join(known, ["topic_id", "id"], "left_anti")
        front = written(further.select("topic_id", "id", F.concat("nodes", F.array("id")).alias("nodes")))
    return union(found)


def weakest_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """The weakest edge of each cycle (cycle_id, nodes in order): by strength, source and
    target; the closing edge if none of the cycle's edges exists."""
    spots = cycles.select("cycle_id", F.col("nodes")[F.size("nodes") - 1].alias("last"), F.col("nodes")[0].alias("head"), F.posexplode("nodes"), F.col("nodes"))
    pairs = spots.select("cycle_id", "last", "head", F.col("col").alias("source_id"), F.coalesce(F.get("nodes", F.col("pos") + 1), "head").alias("target_id"))
    ends = pairs.select("source_id", "target_id")  # few: only their edges are shuffled
    found = pairs.join(edges.select("source_id", "target_id", "strength").join(ends, ["source_id", "target_id"], "left_semi"), ["source_id", "target_id"], "left")
    best = F.min(F.when(F.col("strength").isNotNull(), F.struct("strength", "source_id", "target_id")))
    out = found.groupBy("cycle_id").agg(best.alias("b"), F.first("last").alias("last"), F.first("head").alias("head"))
    return out.select("cycle_id", F.coalesce("b.source_id", "last").alias("source_id"), F.coalesce("b.target_id", "head").alias("target_id"))


def chosen_edges(cycles: DataFrame, choices: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge of each cycle (cycle_id, nodes) to remove: the one that choices (cycle_id, source,
    target) name, if both names are those of nodes of the cycle and the edge exists, else the
    weakest. Of nodes with one name the last by id counts."""
    nodes = cycles.select("cycle_id", F.explode("nodes").alias("id")).join(concepts.select("id", "name"), "id")
    named = nodes.groupBy("cycle_id", "name").agg(F.max("id").alias("id"))
    a, b = (named.select("cycle_id", F.col("name").alias(k), F.col("id").alias(f"{k}_id")) for k in ("source", "target"))
    chosen = choices.join(a, ["cycle_id", "source"]).join(b, ["cycle_id", "target"]).select("cycle_id", "source_id", "target_id")
    asked = edges.select("source_id", "target_id").join(chosen.select("source_id", "target_id"), ["source_id", "target_id"], "left_semi")
    chosen = chosen.join(asked, ["source_id", "target_id"], "left_semi").select("cycle_id", "source_id", "target_id")
    return chosen.unionByName(weakest_edges(cycles.join(chosen, "cycle_id", "left_anti"), edges))


def resolve_cycles(concepts: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(topic_id, source_id, target_id) of edges to remove so that no cycle is left: each edge that is
    the weakest of some cycle, by strength, source and target (of repeated edges the strongest
    counts). Weakly connected parts of up to local_edges edges, or components if edges are those of
    cyclic_edges, are finished in tasks, the others by closing_edges."""
    known = "g" in edges.columns
    strength = F.max(F.coalesce(F.col("strength").cast("double"), F.lit(1.0))).alias("strength")
    rows = (edges if known else concept_edges(concepts, edges)).groupBy("topic_id", "source_id", "target_id", "g", "s", "t").agg(strength)
    rows = written(rows)
    small, large = dealt(rows, ["g"], local_edges) if known else parted(rows, local_edges)
    gone = small.groupBy("task").applyInArrow(_small_closing, "topic_id string, source_id string, target_id string")
    if large is None:
        return gone
    rows = written(ranked(large, [F.desc("strength"), F.desc("source_id"), F.desc("target_id"), "topic_id"], "r"))
    closing = closing_edges(rows.select("g", "r", "s", "t"), local_edges).select("r")
    return gone.unionByName(rows.join(closing, "r", "left_semi").select("topic_id", "source_id", "target_id"))


def _small_closing(table: pa.Table) -> pa.Table:
    """(topic_id, source_id, target_id) of the edges of some small graphs that are the weakest of a cycle."""
    g, s, t, strength = (table.column(k).to_numpy() for k in ("g", "s", "t", "strength"))
    rank = np.empty(len(g), dtype="int64")
    rank[np.lexsort((-t, -s, -strength, ~np.isnan(strength)))] = np.arange(len(g))
    return table.select(["topic_id", "source_id", "target_id"]).take(closing_places(g, rank, s, t))


def cycle_questions(cycles: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """What a model is asked about cycles (cycle_id, topic_id, nodes): (cycle_id, topic_id, key, names,
    lines), the names in order, a line for each edge of the cycle, and the key of the answer."""
    spots = cycles.select("cycle_id", "topic_id", F.posexplode("nodes").alias("pos", "id"), F.col("nodes"))
    spots = spots.select("cycle_id", "topic_id", "pos", "id", F.coalesce(F.get("nodes", F.col("pos") + 1), F.col("nodes")[0]).alias("next"))
    # cycles are few: only their concepts and edges are shuffled
    names = concepts.select("topic_id", "id", "name").join(spots.select("topic_id", "id"), ["topic_id", "id"], "left_semi")
    rows = spots.join(names, ["topic_id", "id"], "left").join(names.withColumnsRenamed({"id": "next", "name": "next_name"}), ["topic_id", "next"], "left")
    steps = edges.withColumnsRenamed({"source_id": "id", "target_id": "next"}).join(spots.select("topic_id", "id", "next"), ["topic_id", "id", "next"], "left_semi")
    known = steps.groupBy("topic_id", "id", "next").agg(F.max(F.struct("strength", F.coalesce("rationale", F.lit("")).alias("rationale"))).alias("e"))
    rows = rows.join(known, ["topic_id", "id", "next"], "left").withColumn("name", F.coalesce("name", "id")).withColumn("next_name", F.coalesce("next_name", "next"))
    line = F.format_string("  %s → %s (strength=%.2f, rationale='%s')", "name", "next_name", F.col("e.strength").cast("double"), "e.rationale")
    cell = F.struct("pos", "name", F.when(F.col("e").isNotNull(), line).alias("line"))
    out = rows.groupBy("cycle_id", "topic_id").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    out = out.withColumn("names", F.array_join(F.transform("c", lambda x: x["name"]), " → ")).withColumn("lines", F.array_join(F.transform("c", lambda x: x["line"]), "\n"))
    return out.select("cycle_id", "topic_id", F.sha2(F.concat(F.lit("cycle||"), "topic_id", F.lit("||"), "names", F.lit("||"), "lines"), 256).alias("key"), "names", "lines")


def answered_cycles(cycles: DataFrame, answers: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic_id, source_id, target_id): the edge of each cycle (cycle_id, topic_id, nodes) that answers
    (key, response_json) name, else its weakest."""
    said = cycle_questions(cycles, concepts, edges).join(answers, "key").select("cycle_id", F.from_json("response_json", "remove_source string, remove_target string").alias("r"))
    choices = said.select("cycle_id", F.col("r.remove_source").alias("source"), F.col("r.remove_target").alias("target")).dropDuplicates(["cycle_id"])
    chosen = chosen_edges(cycles.select("cycle_id", "nodes"), choices, concepts, edges)
    return chosen.join(cycles.select("cycle_id", "topic_id"), "cycle_id").select("topic_id", "source_id", "target_id")


def criticality(concepts: DataFrame, edges: DataFrame, progress: DataFrame) -> DataFrame:
    """The node table of the graph: fan-out, score (umbrella names with a fan-out of 5 or more
    count 0.3), tier by order statistics of the topic's scores, layer, status."""
    edges = written(edges.select("topic_id", "source_id", "target_id").distinct())
    found, left = peeled(edges)
    levels = _layers(concepts, found, left)
    n = fan_out(concepts, edges) if not left.isEmpty() else _fan_out(concepts, found, written(_layers(_ends(edges), found, left)), None)
    umbrella = F.arrays_overlap(tokens(F.lower("name")), F.array(*map(F.lit, UMBRELLA_WORDS))) & (F.col("fanout") >= 5)
    nodes = concepts.join(n, ["topic_id", "id"]).withColumn("score", F.col("fanout") * F.when(umbrella, 0.3).otherwise(1.0))
    # scores repeat: ranks are counted over the distinct ones, which are few and pre-aggregated
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"))
    ranks = nodes.groupBy("topic_id", "score").agg(F.count("*").alias("n"))
    ranks = ranks.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranks = ranks.withColumn("total", F.sum("n").over(Window.partitionBy("topic_id"))).withColumn("before", F.col("upto") - F.col("n"))
    # the score at index floor(total * p): ranks before or at it
    cut = lambda up, down: F.col("before") <= F.expr(f"total * {up} div {down}")
    tier = F.when((F.col("score") > 0) & cut(2, 25), "CORE").when((F.col("score") > 0) & cut(1, 4), "IMPORTANT").when((F.col("score") > 0) & cut(3, 5), "STANDARD").otherwise("SUPPLEMENTARY")
    ranks = ranks.select("topic_id", "score", tier.alias("tier"))
    status = progress.select("topic_id", F.col("concept_id").alias("id"), "status")
    out = nodes.join(ranks, ["topic_id", "score"]).join(levels, ["topic_id", "id"]).join(status, ["topic_id", "id"], "left")
    return out.select(
        "id", "topic_id", "name", F.col("difficulty").cast("int").alias("difficulty"), "fanout", F.round("score", 2).alias("score"), "tier", "layer",
        F.coalesce("status", F.lit("locked")).alias("status"),
    )


def layer_layout(nodes: DataFrame, most: DataFrame) -> DataFrame:
    """Places of nodes (criticality's columns) in columns by layer; most has each topic's
    max_fanout. Order in a column: tier, then name and id."""
    order = F.when(F.col("tier") == "CORE", 0).when(F.col("tier") == "IMPORTANT", 1).when(F.col("tier") == "STANDARD", 2).otherwise(3)
    scale = 0.6 + F.pow(F.col("fanout") / F.col("max_fanout"), 0.4) * 0.8
    t = nodes.join(most, "topic_id").withColumn("scale", scale).withColumn("tier_order", order)
    t = t.withColumn("w", F.round(160 * F.col("scale")).cast("long")).withColumn("h", F.round(48 * F.greatest(0.8 * F.col("scale"), F.lit(0.7))).cast("long"))
    column = Window.partitionBy("topic_id", "layer")
    ordered = column.orderBy("tier_order", "name", "id")
    total = F.sum(F.col("h") + 10).over(column)
    above = F.coalesce(F.sum(F.col("h") + 10).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("topic_id", "id", "layer", F.row_number().over(ordered).cast("long").alias("rank"), "w", "h", (F.col("layer") * 240).alias("x"), (28 - total / 2 + above).alias("y"))


def graph_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(topic_id, source, target, strength, rationale) of the edges whose ends are both in their topic."""
    e = topic_edges(edges, concepts)
    return e.select("topic_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.round("strength", 3).alias("strength"), F.coalesce("rationale", F.lit("")).alias("rationale"))


def graph_payload(concepts: DataFrame, edges: DataFrame, progress: DataFrame) -> DataFrame:
    """(topic_id, nodes, edges) of each topic that has concepts, as a page shows it: nodes by name and id
    with description, status, fan-out, score, tier and layer, and the edges between them. A topic's
    graph is one value, as the page reads it whole."""
    nodes = criticality(concepts, edges, progress).join(concepts.select("topic_id", "id", F.coalesce("description", F.lit("")).alias("description")), ["topic_id", "id"])
    cell = F.struct("name", "id", "description", "difficulty", "status", F.col("fanout").alias("transitive_fanout"), F.col("score").alias("criticality_score"), "tier", "layer")
    a = nodes.groupBy("topic_id").agg(F.sort_array(F.collect_list(cell)).alias("nodes"))
    e = graph_edges(edges, concepts)
    b = e.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "strength", "rationale"))).alias("edges"))
    none = F.array().cast(b.schema["edges"].dataType)
    return a.join(b, "topic_id", "left").select("topic_id", "nodes", F.coalesce("edges", none).alias("edges"))


def serializable(concepts: DataFrame, edges: DataFrame, mastered: DataFrame, unlocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of topics: nodes (topic_id, id, data {name, description, difficulty, status}) with the
    id for a missing name and 3 for a missing difficulty, mastered before unlocked before locked;
    edges (topic_id, id, source, target, data {strength, rationale})."""
    m = mastered.select("topic_id", "id", F.lit("mastered").alias("m")).distinct()
    u = unlocked.select("topic_id", "id", F.lit("unlocked").alias("u")).distinct()
    t = concepts.join(m, ["topic_id", "id"], "left").join(u, ["topic_id", "id"], "left")
    status = F.coalesce("m", "u", F.lit("locked")).alias("status")
    data = F.struct(
        F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.nullif("difficulty", F.lit(0)), F.lit(3)).alias("difficulty"), status,
    )
    e = topic_edges(edges, concepts)
    link = F.struct("strength", F.coalesce("rationale", F.lit("")).alias("rationale"))
    return t.select("topic_id", "id", data.alias("data")), e.select("topic_id", F.concat_ws("->", "source_id", "target_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), link.alias("data"))
