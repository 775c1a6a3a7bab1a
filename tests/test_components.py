"""Components, edges that close cycles, reachability and the model's choices against brute force."""

import json

import numpy as np
import pytest

from trellis.jobs import build_queries, registry
from trellis.jobs import views as V
from trellis.operators import build as B
from trellis.operators import components as C
from trellis.operators import graph as G

DATA = "/root/testdata/sf0.001"
EDGES = "topic_id string, source_id string, target_id string, strength double"


def reach(pairs):
    after = {}
    for s, t in pairs:
        after.setdefault(s, set()).add(t)
    out = {}
    for root in {x for p in pairs for x in p}:
        seen, todo = set(), [root]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[root] = seen
    return out


@pytest.fixture(scope="module")
def tangle():
    """Two random graphs, one with a chain of rings, loops and a long path behind."""
    r = np.random.default_rng(3)
    pairs = {(0, int(a), int(b)) for a, b in r.integers(0, 40, (70, 2))}
    pairs |= {(1, k, k + 1) for k in range(12)} | {(1, 3, 0), (1, 7, 5), (1, 12, 12), (1, 9, 8)}
    return sorted(pairs)


@pytest.mark.parametrize("local", [0, 60, 1000])
def test_strong_components(spark, tangle, local):
    got = {(r.g, r.n): r.component for r in C.strong_components(spark.createDataFrame(tangle, "g long, s long, t long"), local).collect()}
    want = {}
    for g in (0, 1):
        to = reach([(s, t) for h, s, t in tangle if h == g])
        for n in to:
            if n in to[n]:
                want[g, n] = min(m for m in to[n] if n in to.get(m, ()))
    assert got == want and len(set(got.values())) > 3
    assert C.strong_components(spark.createDataFrame([], "g long, s long, t long")).count() == 0


@pytest.mark.parametrize("local", [4, 1000])
def test_closing_edges(spark, tangle, local):
    order = np.random.default_rng(5).permutation(len(tangle))
    rows = [(g, int(order[i]), s, t) for i, (g, s, t) in enumerate(tangle)]
    want = set()
    for g, r, s, t in rows:
        to = reach([(a, b) for h, q, a, b in rows if h == g and q <= r])
        if s in to.get(t, ()) or s == t:
            want.add((g, r))
    got = C.closing_edges(spark.createDataFrame(rows, "g long, r long, s long, t long"), local)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 8
    left = [(g, s, t) for g, r, s, t in rows if (g, r) not in want]
    assert all(n not in seen for g in (0, 1) for n, seen in reach([(s, t) for h, s, t in left if h == g]).items())


def test_fan_out_and_reaches_with_cycles(spark, tangle):
    pairs = [(str(g), f"n{s}", f"n{t}") for g, s, t in tangle]
    edges = spark.createDataFrame(pairs, "topic_id string, source_id string, target_id string")
    ids = sorted({(g, x) for g, *p in pairs for x in p}) + [("0", "alone")]
    concepts = spark.createDataFrame(ids, "topic_id string, id string")
    to = {g: reach([p[1:] for p in pairs if p[0] == g]) for g in ("0", "1")}
    want = {(g, x): len(to[g].get(x, set()) - {x}) for g, x in ids}
    assert {(r.topic_id, r.id): r.fanout for r in G.fan_out(concepts, edges).collect()} == want
    asked = [("0", f"n{a}", f"n{b}") for a in range(0, 40, 3) for b in range(0, 40, 2)] + [("1", f"n{a}", f"n{b}") for a in range(13) for b in range(13)] + [("0", "nowhere", "n1"), ("2", "n1", "n2"), ("1", "n1", None)]
    got = G.reaches(edges, spark.createDataFrame(asked, "topic_id string, src string, dst string")).collect()
    assert len(got) == len(asked)
    assert all(r.reached == (r.dst in to.get(r.topic_id, {}).get(r.src, ())) for r in got)


def test_deep_chain(spark):
    edges = spark.createDataFrame([("t", f"{k:03}", f"{k + 1:03}") for k in range(30)], "topic_id string, source_id string, target_id string")
    concepts = spark.createDataFrame([("t", f"{k:03}") for k in range(31)], "topic_id string, id string")
    assert {int(r.id): r.fanout for r in G.fan_out(concepts, edges).collect()} == {k: 30 - k for k in range(31)}


def test_model_chooses_first(spark):
    rows = [("t", *e) for e in (("a", "b", 0.9, ""), ("b", "c", 0.8, "why"), ("c", "a", 0.7, ""), ("c", "d", 0.6, ""), ("d", "c", 0.5, ""), ("d", "e", 0.4, ""), ("e", "d", 0.95, ""))]
    edges = spark.createDataFrame(rows, EDGES + ", rationale string")
    concepts = spark.createDataFrame([("t", x, x.upper(), 1) for x in "abcde"], "topic_id string, id string, name string, difficulty int")
    cycle = spark.createDataFrame([("t", "t", ["a", "b", "c"])], "cycle_id string, topic_id string, nodes array<string>")
    asked = G.cycle_questions(cycle, concepts, edges).first()
    assert asked.names == "A → B → C" and asked.lines.split("\n")[1] == "  B → C (strength=0.80, rationale='why')"
    answers = spark.createDataFrame([(asked.key, json.dumps({"remove_source": "A", "remove_target": "B"}))], "key string, response_json string")
    assert {tuple(r) for r in G.answered_cycles(cycle, answers, concepts, edges).collect()} == {("t", "a", "b")}
    assert {(r.source_id, r.target_id) for r in B.cut_cycles(concepts, edges, answers).collect()} == {("a", "b"), ("d", "c"), ("d", "e")}
    # without an answer the weakest edge of a cycle goes
    assert {(r.source_id, r.target_id) for r in B.cut_cycles(concepts, edges).collect()} == {("c", "a"), ("d", "c"), ("d", "e")}


def test_answers_on_the_table(spark):
    concepts, edges = V.concepts(spark, DATA), B.written(V.edges_cyclic(spark, DATA))
    gone = {(r.topic_id, r.source_id, r.target_id) for r in registry.queries()["build_graph_with_answers"](spark, DATA).collect()}
    rows = [tuple(r) for r in edges.select("topic_id", "source_id", "target_id").collect()]
    left = [r for r in rows if r not in gone]
    assert len(left) == len(rows) - len(gone)
    for topic in {r[0] for r in left}:
        assert all(n not in seen for n, seen in reach([r[1:] for r in left if r[0] == topic]).items())
    first = G.detect_cycles(concepts, edges).collect()
    closing = {(r.topic_id, r.nodes[-1], r.nodes[0]) for r in first}
    names = {r.id: r.name for r in concepts.collect()}
    for r in first:  # where names are told apart, the model's edge is gone
        if len({names[n] for n in r.nodes}) == len(r.nodes):
            assert (r.topic_id, r.nodes[-1], r.nodes[0]) in gone
    assert closing and build_queries.model_answers(concepts, edges.selectExpr("*", "'' as rationale")).count() == len(first)


def test_parts_are_finished_in_tasks(spark, monkeypatch):
    """Many parts of a bounded size take no rounds of their own, however long their rings are."""
    rings = [(g, 100 * k + i, 100 * k + (i + 1) % 12) for g in (0, 1) for k in range(8) for i in range(12)]
    rows = rings + [(0, 5, 905), (0, 905, 906), (1, 950, 950)]  # a tail, and a loop alone
    tables, plain = [], C.written
    monkeypatch.setattr(C, "written", lambda df: tables.append(1) or plain(df))
    got = {(r.g, r.n): r.component for r in C.strong_components(spark.createDataFrame(rows, "g long, s long, t long"), 30).collect()}
    assert got == {(g, s): s // 100 * 100 for g, s, _ in rings} | {(1, 950): 950}
    assert len(tables) < 16


def test_components_are_parted_once(spark, monkeypatch):
    """With answers the components are sought in the whole graph once; later searches go by component."""
    rows = [(f"t{k % 2}", f"{k}-{i}", f"{k}-{(i + 1) % 4}", 1 - i / 10, "") for k in range(6) for i in range(4)] + [("t0", "0-0", "2-0", 0.5, "")]
    edges = spark.createDataFrame(rows, EDGES + ", rationale string")
    concepts = spark.createDataFrame(sorted({(r[0], x) for r in rows for x in r[1:3]}), "topic_id string, id string").selectExpr("*", "id AS name")
    parted, plain = [], C.weak_parts
    monkeypatch.setattr(C, "weak_parts", lambda e: parted.append(1) or plain(e))
    monkeypatch.setattr(C.strong_components, "__defaults__", (6,))
    answers = spark.createDataFrame([], "key string, response_json string")
    gone = {(r.source_id, r.target_id) for r in B.cut_cycles(concepts, edges, answers).collect()}
    assert gone == {(f"{k}-3", f"{k}-0") for k in range(6)}
    assert len(parted) == 1


def test_cycles_are_searched_in_tasks(spark, monkeypatch):
    """A long ring takes no level for each step; larger components give the same by levels."""
    rings = [(t, f"{t}{i:02}", f"{t}{(i + 1) % n:02}", 1.0) for t, n in (("a", 15), ("b", 9)) for i in range(n)]
    rows = rings + [("a", "a00", "a07", 1.0), ("a", "a03", "a08", 1.0), ("b", "b02", "b02", 1.0), ("c", "c0", "c1", 1.0), ("d", "d1", "d1", 1.0)]
    edges, concepts = spark.createDataFrame(rows, EDGES), spark.createDataFrame(sorted({(r[0], x) for r in rows for x in r[1:3]}), "topic_id string, id string")
    want = {"a": ["a00"] + [f"a{i:02}" for i in range(7, 15)], "b": [f"b{i:02}" for i in range(9)], "d": ["d1"]}
    tables, plain = [], G.written
    monkeypatch.setattr(G, "written", lambda df: tables.append(1) or plain(df))
    assert {r.topic_id: r.nodes for r in G.detect_cycles(concepts, edges).collect()} == want
    assert len(tables) < 12
    assert {r.topic_id: r.nodes for r in G.detect_cycles(concepts, edges, 10).collect()} == want


def test_parts_are_joined_in_tasks(spark, monkeypatch):
    """A path in one range of nodes is one star without a round; batches of a task are joined by rounds."""
    path = spark.createDataFrame([(0, k, k + 1) for k in range(50)] + [(1, 9, 9), (1, 7, 5)], "g long, s long, t long").coalesce(1)
    tables, plain = [], C.written
    monkeypatch.setattr(C, "written", lambda df: tables.append(1) or plain(df))
    want = {(0, k): 0 for k in range(51)} | {(1, 5): 5, (1, 7): 5}
    assert {(r.g, r.n): r.part for r in C.weak_parts(path).collect()} == want
    assert len(tables) <= 4
    stars = list(C._stars(iter([C.pd.DataFrame({"g": [0, 0], "a": [3, 2], "b": [2, 1]})])))
    assert sorted(stars[0].itertuples(index=False, name=None)) == [(0, 2, 1), (0, 3, 1)]


@pytest.mark.parametrize("local", [2, 1000])
def test_reaches_by_part(spark, monkeypatch, local):
    """Parts of a bounded size take no rounds, however long their paths are; larger ones give the same."""
    edges = [("t", f"{k}-{i:02}", f"{k}-{i + 1:02}") for k in range(3) for i in range(12)] + [("t", "r0", "r1"), ("t", "r1", "r0"), ("t", "s", "s")]
    asked = [("t", f"{k}-{i:02}", f"{m}-{j:02}") for k, m in ((0, 0), (1, 2)) for i in (0, 5, 12) for j in (0, 6, 12)] + [("t", "r0", "r0"), ("t", "s", "s"), ("u", "s", "s"), ("t", None, "s"), ("t", "r0", "s")]
    rounds, plain = [], G.peeled
    monkeypatch.setattr(G, "peeled", lambda e: rounds.append(1) or plain(e))
    to = reach([e[1:] for e in edges])
    got = G.reaches(spark.createDataFrame(edges, "topic_id string, source_id string, target_id string"), spark.createDataFrame(asked, "topic_id string, src string, dst string"), local_edges=local).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((t, a, b, t == "t" and b in to.get(a, ())) for t, a, b in asked), key=str)
    assert bool(rounds) == (local == 2)


@pytest.mark.parametrize("local", [0, 3, 1000])
def test_fan_out_by_part(spark, monkeypatch, local):
    """Parts of a bounded size take no layers, however long their paths are; larger ones give the same."""
    rows = [("t", f"{k}-{i:02}", f"{k}-{i + 1:02}") for k in range(3) for i in range(8)] + [("t", "1-04", "1-02"), ("t", "1-02", "1-02"), ("t", "r0", "r1"), ("t", "r1", "r0"), ("t", "s", "s"), ("u", "r0", "r1"), ("u", "r0", "r1")]
    concepts = sorted({(t, x) for t, *e in rows for x in e} | {("t", "alone"), ("u", "s")})
    rounds, plain = [], G.peeled
    monkeypatch.setattr(G, "peeled", lambda e: rounds.append(1) or plain(e))
    to = {t: reach([e[1:] for e in rows if e[0] == t]) for t in "tu"}
    got = G.fan_out(spark.createDataFrame(concepts, "topic_id string, id string"), spark.createDataFrame(rows, "topic_id string, source_id string, target_id string"), local)
    assert sorted(map(tuple, got.collect())) == [(t, x, len(to[t].get(x, set()) - {x})) for t, x in concepts]
    assert bool(rounds) == (local < 1000)


def test_graphs_in_a_task():
    """Labels, closing edges and shortest cycles of random graphs, against brute force."""
    rng = np.random.default_rng(7)
    for nodes, many in ((6, 5), (12, 30), (25, 40), (40, 60)):
        ends = sorted({(int(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 2, many), rng.integers(0, nodes, many), rng.integers(0, nodes, many), strict=True)})
        g, s, t = (np.array(x) for x in zip(*ends, strict=True))
        to = {k: reach([e[1:] for e in ends if e[0] == k]) for k in (0, 1)}
        label = C.strong_labels(s[g == 0], t[g == 0], nodes)
        assert label.tolist() == [min({n} | {m for m in to[0].get(n, ()) if n in to[0].get(m, ())}) for n in range(nodes)]
        rank = rng.permutation(len(ends))
        rank[: len(ends) // 5] = -1
        want = set()
        for k, (h, a, b) in enumerate(ends):
            early = reach([e[1:] for e, q in zip(ends, rank, strict=True) if e[0] == h and q <= rank[k]])
            if rank[k] >= 0 and (a == b or a in early.get(b, ())):
                want.add(k)
        assert sorted(C.closing_places(g, rank, s, t).tolist()) == sorted(want)
        on = [n for n in to[0] if n in to[0][n]]
        if on:
            first = min(on)
            inside = [(a, b) for h, a, b in ends if h == 0 and label[a] == label[first] == label[b]]
            paths = [(first,)]
            while not any((p[-1], first) in inside for p in paths):
                paths = [(*p, b) for p in paths for a, b in inside if a == p[-1] and b not in p]
            assert tuple(G._shortest_cycle(*zip(*inside, strict=True), first)) == min(p for p in paths if (p[-1], first) in inside)
    empty = np.array([], dtype="int64")
    assert len(C.closing_places(empty, empty, empty, empty)) == 0 == len(C.strong_labels(empty, empty, 0))


@pytest.mark.parametrize("local", [9, 1000])
def test_bounded_components_are_cut_in_tasks(spark, monkeypatch, local):
    """Nothing is searched for components of a bounded size but in tasks; larger ones give the same."""
    rng = np.random.default_rng(11)
    pairs = sorted({(f"t{k % 2}", f"{k}-{a}", f"{k}-{b}") for k in range(6) for a, b in rng.integers(0, 4 + 2 * k, (8 + 3 * k, 2))})
    rows = [(*p, float(x) / 8, "") for p, x in zip(pairs, rng.integers(0, 8, len(pairs)), strict=True)] + [(*pairs[0], None, "again")]
    edges = spark.createDataFrame(rows, EDGES + ", rationale string")
    concepts = spark.createDataFrame(sorted({(r[0], x) for r in rows for x in r[1:3]}), "topic_id string, id string").selectExpr("*", "id AS name")
    best = {}
    for *e, x, _ in rows:
        best[tuple(e)] = max(best.get(tuple(e), 0), 1.0 if x is None else x)
    order = sorted(best, key=lambda e: (best[e], *e[1:]), reverse=True)
    want = {e for k, e in enumerate(order) if e[1] == e[2] or e[1] in reach([o[1:] for o in order[: k + 1] if o[0] == e[0]]).get(e[2], ())}
    searched, plain = [], C.strong_components
    monkeypatch.setattr(C, "strong_components", lambda *a: searched.append(1) or plain(*a))
    monkeypatch.setattr(G, "strong_components", lambda *a: searched.append(1) or plain(*a))
    assert {tuple(r) for r in G.resolve_cycles(concepts, edges, local).collect()} == want and len(want) > 20
    inside = B.written(G.cyclic_edges(concepts, edges, local))
    to = {t: reach([e[1:] for e in order if e[0] == t]) for t in ("t0", "t1")}
    on = [r for r in rows if r[1] in to[r[0]].get(r[2], ()) or r[1] == r[2]]
    assert sorted(tuple(r)[:3] for r in inside.collect()) == sorted(r[:3] for r in on)
    assert {tuple(r) for r in G.resolve_cycles(concepts, inside, local).collect()} == want
    cycles = {r.topic_id: r.nodes for r in G.detect_cycles(concepts, inside, local).collect()}
    assert {t: n[0] for t, n in cycles.items()} == {t: min(r[1] for r in on if r[0] == t) for t in to}
    assert bool(searched) == (local == 9)


def test_concepts_are_numbered_once(spark):
    """Edges are numbered by the concepts, without a look at the edges' own ends, and are those of topic_edges."""
    rows = [("t", "b", "a", None), ("t", "a", "b", 0.5), ("t", "a", "b", 0.5), ("t", "a", "x", 0.5), ("u", "a", "b", 0.5), ("u", "c", "c", 0.25), (None, "a", "b", 1.0), ("t", None, "a", 1.0)]
    edges = spark.createDataFrame(rows, EDGES)
    concepts = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "c"), ("u", "a"), (None, "a"), ("t", None)], "topic_id string, id string")
    got = G.concept_edges(concepts, edges).collect()
    assert sorted((r.topic_id, r.source_id, r.target_id, r.strength) for r in got) == sorted((r.topic_id, r.source_id, r.target_id, r.strength) for r in G.topic_edges(edges, concepts).collect())
    number = {(r.topic_id, i): n for r in got for i, n in ((r.source_id, r.s), (r.target_id, r.t))}
    assert len(got) == 4 and sorted(number) == sorted(number, key=number.get) and len(set(number.values())) == 3
    assert sorted((r.source_id, r.target_id) for r in G.resolve_cycles(concepts, edges).collect()) == [("a", "b"), ("c", "c")]
