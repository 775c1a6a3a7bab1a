"""Exact n-gram Jaccard join by set relations: block-skipping lists and derived answers.

A document's set is that of its word shingles, as 64-bit hashes. Equal sets are one class,
known by a 64-bit hash of the set, its mark. All sets are put in one order of shingles, rare
ones first, and each set is indexed by its prefix: two sets that are similar enough share a
shingle in their prefixes. The order comes from counts of all documents: each task counts its
sets' shingles in a fixed number of buckets, and the sums of all tasks are the order's levels.
So it does not depend on how the rows are cut into tasks, and any order gives the same links.

Index-level relations. The entries of a list are sorted by set size and by the shingle's
position in its set. A block holds the entries of one size; from a block and another one only
the entries up to a position can be similar, as what lies behind the position bounds the
overlap, so the rest of either block is skipped, and so are all blocks of too different sizes.
Short lists (at most short_list entries) give all pairs that are left. In a longer list each
set is first paired only with the leaders of its size grade and of the grade below: the set
with the fewest shingles before the list's (of equals the smallest mark). In a family of edited
copies that is the text they were made from, as edits are rare shingles and come first.

Answer-level relations. The overlap of a set with its leader is a computed answer. Long lists
whose sets are not all in one component by then are read once more, for pairs across
components. From such a pair's leaders l and m, whose overlap is computed once for all sets
that follow them, the pair's own follows up to what the sets differ from their leaders:
|l & m| - |l - x| - |m - y| <= |x & y| <= |l & m| + |x - l| + |y - m|. Where that decides, the
answer is derived; only pairs that it leaves open are verified on the sets themselves.

Sets are read from the texts again for the classes that candidates name; a bitmap of bounded
size keeps most others from being sent, and a join drops what it lets through.

Defined cases: null text and texts without words have the empty set, which links with nothing;
texts with fewer words than a shingle have their whole word sequence as one; a null doc_id
links with nothing; repeated rows and doc_ids count as copies; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import U64, batches, materialize, mix64, small_batches, tidy
from trellis.llm.components import connected_components
from trellis.llm.words import SPACED, windows_hash, word_hashes

WORDS = 5
#: Similarity as a fraction, so that tests on whole numbers are exact.
SIMILAR = (75, 100)
SHORT_LIST = 8
BLOCK = 1_000_000
#: Buckets of the shingle counts: 2 ** BUCKET_BITS, in slices of 2 ** SLICE_BITS.
BUCKET_BITS, SLICE_BITS = 22, 14
#: Places of the bitmap of classes whose sets are asked for: 2 ** ASKED_BITS.
ASKED_BITS = 24
#: Entries of a list that are held at once when leaders are sought.
HELD_ENTRIES = 500_000


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes(texts, SPACED)
    grams = windows_hash(h, tuple(range(words)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(windows_hash(h[a:b], tuple(range(b - a))) ^ U64(b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def set_mark(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        a = mix64(s).sum(dtype=U64) * U64(0x9E3779B97F4A7C15) + (mix64(s ^ U64(0x5851F42D4C957F2D)) * (s | U64(1))).sum(dtype=U64)
    return int(mix64(np.array([a + U64(len(s))], dtype=U64)).view(np.int64)[0])


def prefix_length(size: int, similar=SIMILAR) -> int:
    """Places of the order at which a set of this size must meet a similar one."""
    p, q = similar
    return size - -(-size * p // q) + 1


def needed_overlap(x, y, similar=SIMILAR):
    """Least common shingles of similar sets with x and y shingles: q * o >= p * (x + y - o)."""
    p, q = similar
    return -(-(x + y) * p // (p + q))


def _needed(x: str, y: str, similar):
    p, q = similar
    return F.expr(f"(({x} + {y}) * {p} + {p + q - 1}) div {p + q}")


def _summary(words: int):
    """Size and mark of each row's set, and at the end this task's counts by bucket."""

    def run(frames):
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for frame in frames:
            texts, ids = frame["text"].to_pylist(), frame["doc_id"]
            for i, j in batches(texts, BLOCK):
                sets = shingle_sets(texts[i:j], words)
                np.add.at(counts, (np.concatenate(sets) >> U64(64 - BUCKET_BITS)).astype(np.int64), 1)
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_mark(s) for s in sets], pa.int64()), none, pa.nulls(j - i, pa.binary())],
                    ["doc_id", "n", "mark", "slice", "counts"],
                )
        if counts.any():
            # most counts are small: a byte each, and the rest of those that are not
            low, high = np.minimum(counts, 255).astype(np.uint8), np.flatnonzero(counts > 255)
            size = 1 << SLICE_BITS
            blobs = []
            for k in range(len(counts) // size):
                more = high[(high >= k * size) & (high < (k + 1) * size)]
                blobs.append(zlib.compress(low[k * size : (k + 1) * size].tobytes() + (more - k * size).astype("<i8").tobytes() + counts[more].astype("<i8").tobytes(), 1))
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n", "mark", "slice", "counts"])

    return run


def _levels(frames):
    """Level of each bucket of a slice: its count in eighths of an octave."""
    size, sums = 1 << SLICE_BITS, {}
    for frame in frames:
        for k, blob in zip(frame["slice"].to_pylist(), frame["counts"].to_pylist(), strict=True):
            raw = zlib.decompress(blob)
            own = sums.setdefault(k, np.zeros(size, dtype=np.int64))
            low = np.frombuffer(raw, np.uint8, size)
            at, many = np.frombuffer(raw, "<i8", offset=size).reshape(2, -1)
            own += low
            own[at] += many - 255
    for k, own in sums.items():
        level = np.minimum(255, np.floor(8 * np.log2(1.0 + own))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "level"])


def order_levels(summary: DataFrame) -> np.ndarray:
    """The level of every bucket, 2 ** BUCKET_BITS bytes, from the counts of all tasks."""
    sliced = summary.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(_levels, "slice int, level binary")
    out = np.zeros((1 << (BUCKET_BITS - SLICE_BITS), 1 << SLICE_BITS), dtype=np.uint8)
    for r in sliced.collect():
        out[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the common order: by the level of a shingle's bucket, then by hash."""
    return s[np.argsort(levels[(s >> U64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")]


def _index(levels, words: int, similar):
    def run(frames):
        given: set = set()
        for frame in frames:
            texts = frame["text"].to_pylist()
            for i, j in batches(texts, BLOCK):
                out = []
                for s in shingle_sets(texts[i:j], words):
                    if not len(s):
                        continue
                    mark = set_mark(s)
                    if mark in given:  # a copy of what this task has indexed
                        continue
                    if len(given) >= 300_000:
                        given.clear()
                    given.add(mark)
                    p = ordered(s, levels.value)[: prefix_length(len(s), similar)]
                    out.append((p, np.full(len(p), mark), (len(s) << 32) + np.arange(len(p))))
                if out:
                    token, mark, place = (np.concatenate(x) for x in zip(*out, strict=True))
                    for k in range(0, len(token), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (token.view(np.int64), mark, place)], ["token", "mark", "place"])

    return run


def block_pairs(size: np.ndarray, pos: np.ndarray, similar=SIMILAR, component=None):
    """Pairs (i, j) of a list sorted by (size, pos) that may be similar, in arrays. A block is a
    run of one size. With component only pairs across components."""
    p, q = similar
    sizes, first = np.unique(size, return_index=True)
    end = np.append(first[1:], len(size))
    last = np.searchsorted(sizes * p, sizes * q, side="right")
    for u in range(len(sizes)):
        need = needed_overlap(sizes[u], sizes[u : last[u]], similar)
        # positions up to size - need are left, a beginning of each block
        left = first[u] + np.searchsorted(pos[first[u] : end[u]], sizes[u] - need, side="right")
        for v in np.flatnonzero(left > first[u]).tolist():
            w = u + v
            right = first[w] + int(np.searchsorted(pos[first[w] : end[w]], sizes[w] - need[v], side="right"))
            i, j = np.arange(first[u], left[v]), np.arange(first[w], right)
            if not len(j):
                continue
            if component is None:
                a, b = np.repeat(i, len(j)), np.tile(j, len(i))
            else:
                j = j[np.argsort(component[j], kind="stable")]
                low, high = (np.searchsorted(component[j], component[i], side=s) for s in ("left", "right"))
                many = low + len(j) - high
                a = np.repeat(i, many)
                at = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
                at += np.where(at >= np.repeat(low, many), np.repeat(high - low, many), 0)
                b = j[at]
            if v == 0:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield a, b


def leader_pairs(mark: np.ndarray, size: np.ndarray, pos: np.ndarray, similar=SIMILAR, held: dict | None = None):
    """Pairs (mark, size, pos of i; of the leader) with the leaders of i's own size grade and the
    grade below. held keeps the leaders of a list that comes in parts."""
    p, q = similar
    held = {} if held is None else held
    grade = np.floor(np.log(size) / np.log(q / p) + 1e-9).astype(np.int64)
    by = np.lexsort((mark, pos, grade))
    grades, first = np.unique(grade[by], return_index=True)
    for g, k in zip(grades.tolist(), by[first].tolist(), strict=True):
        mine = (int(pos[k]), int(mark[k]), int(size[k]))
        held[g] = min(held.get(g, mine), mine)
    none = (0, 0, 0)
    for d in (0, 1):
        lead = np.array([held.get(g - d, none) for g in grades.tolist()], dtype=np.int64)[np.searchsorted(grades, grade)]
        at, by, of = lead.T
        low, high = np.minimum(size, of), np.maximum(size, of)
        ok = (of > 0) & (by != mark) & (low * q >= high * p)
        ok &= np.minimum(size - pos, of - at) >= needed_overlap(size, of, similar)
        yield mark[ok], by[ok]


def _lists(frames, columns):
    """(arrays, whole): what a stream sorted by token holds of whole lists, and parts of lists
    of more than HELD_ENTRIES, each class once in a list. whole is False for such parts."""
    held, long = None, False
    for frame in frames:
        data = [frame[c].to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            data = [np.concatenate([h, d]) for h, d in zip(held, data, strict=True)]
        if len(data[0]) > 1:
            new = np.concatenate([[True], (data[0][1:] != data[0][:-1]) | (data[1][1:] != data[1][:-1])])
            data = [d[new] for d in data]
        token = data[0]
        cut = int(np.searchsorted(token == token[-1], True)) if len(token) else 0
        if cut:
            if long:  # the rest of the list that came in parts
                end = int(np.argmax(token != token[0])) if token[-1] != token[0] else len(token)
                yield [d[:end] for d in data], False
                data = [d[end:] for d in data]
                cut, long = cut - end, False
            if cut:
                yield [d[:cut] for d in data], True
            held = [d[cut:] for d in data]
        elif len(token) > HELD_ENTRIES:
            yield data, False
            held, long = [d[-1:] for d in data], True
        else:
            held = data
    if held is not None and len(held[0]):
        yield held, not long


def _scan(similar, short_list: int):
    """Candidates of the index: kind 0 (a, b), marks; and the entries of long lists: kind 1
    (a: mark, b: place, token)."""
    p, q = similar

    def run(frames):
        out, rows = [], 0

        def pairs(a, b):
            return np.zeros(len(a), np.int32), np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)

        def batch():
            kind, a, b, token = (np.concatenate(x) for x in zip(*out, strict=True))
            # a pair is sent once of all lists held
            order = np.lexsort((token, b, a, kind))
            kind, a, b, token = kind[order], a[order], b[order], token[order]
            new = np.concatenate([[True], (kind[1:] == 1) | (kind[1:] != kind[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(kind)]
            return pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (kind, a, b, token)], ["kind", "a", "b", "token"])

        leaders: dict = {}
        for (token, mark, place), whole in _lists(frames, ["token", "mark", "place"]):
            size, pos = place >> 32, place & 0xFFFFFFFF
            bounds = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            length = np.diff(bounds)
            if not whole:
                out += [pairs(*x) for x in leader_pairs(mark, size, pos, similar, leaders)]
                out.append((np.ones(len(mark), np.int32), mark, place, token))
            else:
                leaders = {}
                of = np.repeat(length, length)
                for d in range(1, short_list):  # all pairs of short lists, d entries apart
                    if d >= len(token):
                        break
                    i = np.flatnonzero((token[d:] == token[:-d]) & (of[d:] <= short_list))
                    j = i + d
                    ok = (size[j] * p <= size[i] * q) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= needed_overlap(size[i], size[j], similar))
                    out.append(pairs(mark[i[ok]], mark[j[ok]]))
                for k in np.flatnonzero(length > short_list).tolist():
                    s = slice(bounds[k], bounds[k + 1])
                    out += [pairs(*x) for x in leader_pairs(mark[s], size[s], pos[s], similar)]
                    out.append((np.ones(length[k], np.int32), mark[s], place[s], token[s]))
            rows = sum(len(x[0]) for x in out)
            if rows > 300_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def _across(similar):
    """Pairs across components of whole long lists."""

    def run(frames):
        held = None

        def given(token, mark, place, component):
            bounds = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (component[x:y] == component[x]).all():
                    continue
                for i, j in block_pairs(place[x:y] >> 32, place[x:y] & 0xFFFFFFFF, similar, component[x:y]):
                    a, b = mark[x + i], mark[x + j]
                    for k in range(0, len(a), 100_000):
                        s = slice(k, k + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[s], b[s])), pa.array(np.maximum(a[s], b[s]))], ["a", "b"])

        for frame in frames:
            data = [frame[c].to_numpy(zero_copy_only=False) for c in ("token", "mark", "place", "component")]
            if held is not None:
                data = [np.concatenate([h, d]) for h, d in zip(held, data, strict=True)]
            cut = int(np.searchsorted(data[0] == data[0][-1], True)) if len(data[0]) else 0
            if cut:
                yield from given(*(d[:cut] for d in data))
            held = [d[cut:] for d in data]
        if held is not None and len(held[0]):
            yield from given(*held)

    return run


def _sets(words: int, asked):
    def run(frames):
        given: set = set()
        for frame in frames:
            texts = frame["text"].to_pylist()
            for i, j in batches(texts, BLOCK):
                marks, members = [], []
                for s in shingle_sets(texts[i:j], words):
                    if len(s):
                        mark = set_mark(s)
                        at = (mark & 0xFFFFFFFFFFFFFFFF) >> (64 - ASKED_BITS)
                        if asked.value[at >> 3] >> (at & 7) & 1 and mark not in given:
                            if len(given) >= 300_000:
                                given.clear()
                            given.add(mark)
                            marks.append(mark)
                            members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(members, pa.binary())], ["mark", "members"])

    return run


def asked_bitmap(marks: DataFrame) -> np.ndarray:
    """Bits of the first ASKED_BITS bits of marks; at most 2 ** ASKED_BITS small numbers come
    to the driver, however many marks there are."""
    at = marks.select(F.shiftrightunsigned("mark", 64 - ASKED_BITS).cast("int").alias("at")).distinct()
    rows = at.groupBy(F.shiftright("at", 15).alias("high")).agg(F.collect_list((F.col("at") % (1 << 15)).cast("short")).alias("low"))
    bits = np.zeros(1 << ASKED_BITS, dtype=bool)
    for r in rows.toLocalIterator():
        bits[(r["high"] << 15) + np.array(r["low"], dtype=np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _overlaps(frames):
    for frame in frames:
        x, y = frame["x"].to_pylist(), frame["y"].to_pylist()
        an, bn, common = [], [], []
        for s, t in zip(x, y, strict=True):
            s, t = np.frombuffer(s, U64), np.frombuffer(t, U64)
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            an.append(len(s))
            bn.append(len(t))
            common.append(int((t[at] == s).sum()))
        yield pa.RecordBatch.from_arrays([frame["a"], frame["b"], *(pa.array(c, pa.int64()) for c in (an, bn, common))], ["a", "b", "an", "bn", "common"])


def jaccard_components(docs: DataFrame, words: int = WORDS, similar=SIMILAR, short_list: int = SHORT_LIST) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id, the smallest
    doc_id reachable by links of similar sets."""
    context = small_batches(docs.sparkSession).sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    summary = materialize(texts.mapInArrow(tidy(_summary(words)), f"doc_id {kind}, n long, mark long, slice int, counts binary"))
    levels = context.broadcast(order_levels(summary))
    own = summary.filter("slice is null").select("doc_id", "n", "mark")
    classes = materialize(own.filter("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    known = texts.filter("doc_id is not null").select("text")
    entries = known.mapInArrow(tidy(_index(levels, words, similar)), "token long, mark long, place long")
    lists = entries.repartition("token").sortWithinPartitions("token", "place", "mark")
    lists = lists.select("token", "mark", "place")
    scanned = materialize(lists.mapInArrow(tidy(_scan(similar, short_list)), "kind int, a long, b long, token long"))
    candidates = materialize(scanned.filter("kind = 0").select("a", "b").distinct())
    long_lists = scanned.filter("kind = 1").select("token", F.col("a").alias("mark"), F.col("b").alias("place"))

    def overlaps(pairs: DataFrame, marks: DataFrame) -> DataFrame:
        """(a, b, an, bn, common): the pairs' sizes and overlaps, from the sets of marks, which
        are shuffled once: both joins start from the same exchange."""
        bits = context.broadcast(asked_bitmap(marks))
        sets = known.mapInArrow(tidy(_sets(words, bits)), "mark long, members binary").groupBy("mark").agg(F.first("members").alias("members"))
        x = pairs.join(sets.select(F.col("mark").alias("b"), F.col("members").alias("y")), "b")
        both = x.join(sets.select(F.col("mark").alias("a"), F.col("members").alias("x")), "a")
        return materialize(both.select("a", "b", "x", "y").mapInArrow(tidy(_overlaps), "a long, b long, an long, bn long, common long"))

    answers = overlaps(candidates, candidates.select(F.explode(F.array("a", "b")).alias("mark")))
    links = answers.filter(F.col("common") >= _needed("an", "bn", similar)).select("a", "b", "an", "bn", "common")
    components = connected_components(links.select("a", "b"))
    # lists whose sets are not all in one component
    parted = long_lists.join(components.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    parted = materialize(parted.select("token", "mark", "place", "component"))
    mixed = parted.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("token")
    again = parted.join(mixed, "token", "left_semi").select("token", "mark", "place", "component")
    again = again.repartition("token").sortWithinPartitions("token", "place", "mark")
    cross = materialize(again.mapInArrow(tidy(_across(similar)), "a long, b long").distinct())
    if not cross.isEmpty():
        # a set's leader: of the smaller marks that it is linked with, the one with most in common
        best = links.groupBy(F.col("b").alias("mark")).agg(F.max(F.struct("common", (-F.col("a")).alias("back"), "an")).alias("m"))
        homes = classes.select("mark", "n").join(best, "mark", "left").select(
            "mark", "n", F.coalesce(-F.col("m.back"), F.col("mark")).alias("leader"),
            F.coalesce(F.col("n") - F.col("m.common"), F.lit(0)).alias("own"), F.coalesce(F.col("m.an") - F.col("m.common"), F.lit(0)).alias("lost"),
        )
        both = cross.join(homes.select(F.col("mark").alias("a"), F.col("n").alias("an"), F.col("leader").alias("l"), F.col("own").alias("aown"), F.col("lost").alias("alost")), "a")
        both = both.join(homes.select(F.col("mark").alias("b"), F.col("n").alias("bn"), F.col("leader").alias("m"), F.col("own").alias("bown"), F.col("lost").alias("blost")), "b")
        both = materialize(both.withColumn("p", F.least("l", "m")).withColumn("q", F.greatest("l", "m")))
        led = both.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
        led = overlaps(led, led.select(F.explode(F.array("a", "b")).alias("mark")))
        bound = both.join(led.select(F.col("a").alias("p"), F.col("b").alias("q"), "common"), ["p", "q"])
        bound = bound.withColumn("need", _needed("an", "bn", similar)).withColumn("least", F.expr("common - alost - blost")).withColumn("most", F.expr("common + aown + bown"))
        bound = materialize(bound.select("a", "b", "need", "least", "most"))
        open_ = bound.filter("least < need and most >= need").select("a", "b")
        open_ = overlaps(open_, open_.select(F.explode(F.array("a", "b")).alias("mark")))
        more = bound.filter("least >= need").select("a", "b").unionByName(open_.filter(F.col("common") >= _needed("an", "bn", similar)).select("a", "b"))
        components = connected_components(links.select("a", "b").unionByName(more))
    placed = classes.join(components.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    placed = materialize(placed.select("mark", "rep", "component"))
    group = placed.join(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("mark", "component_id")
    linked = F.col("n") > 0
    grouped = own.filter(linked & F.col("doc_id").isNotNull()).join(group, "mark").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.filter(~linked | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the documents whose component has a smaller doc_id. Rows
    that share a doc_id stay or go together."""
    gone = jaccard_components(docs, **options).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_set_relation_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at a 5-word shingle similarity of 0.75."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
g AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT rep, n, unnest(s) AS t FROM g),
c AS (SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep
        AND a.n * 100 >= b.n * 75 AND b.n * 100 >= a.n * 75 GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * o >= 75 * (an + bn - o) UNION ALL SELECT b, a FROM c WHERE 100 * o >= 75 * (an + bn - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE least(g.rep, coalesce(m.b, g.rep)) END AS BIGINT) AS component_id
FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN m ON m.a = g.rep"""
