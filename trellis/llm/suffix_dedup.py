"""Removal of repeated byte strings with a distributed, sparse suffix array.

Which bytes go: those covered by a string of `length` bytes that also starts anywhere else.

Sparse suffixes. Each start p of a window of `length` bytes has an anchor, the place of the
window's smallest hash of GRAM bytes (the first of equals). The anchor depends on the window's
bytes alone, so equal windows have equal anchors at equal distances. Starts with a common
anchor form an interval. Only intervals whose anchor's GRAM bytes occur more than once in the
corpus can hold a repeated window; they are found by a sharded count join of anchor hashes.

Merge sort. For each such interval the suffix from its anchor is the sort key, with the bytes
before the anchor, read backwards, behind it. Every task sorts its suffixes into runs and sends
them front-coded: the length of the prefix that a suffix shares with the one before it, and the
rest. All suffixes with an anchor's bytes go to one shard, whose task merges the runs with a
loser tree that keeps for each player the prefix it shares with the last winner: longer known
prefixes win at once, and bytes within a known prefix are never compared again.

Intervals that are equal as a whole meet in the sort and repeat entirely; within a run they
are counted before they are sent. For the others, the shared prefixes to their neighbours,
to the right and (sorted once more) to the left of the anchor, bound the starts that can still
repeat, and those windows are compared as bytes.

Hot anchors (more than hot_anchor occurrences) are split: their intervals are cut into blocks
of SPLIT starts, which go to shards by the bytes that all windows of the block share, so one
frequent passage with many surroundings is spread over the shards.

Defined cases: null text counts as empty; texts shorter than length lose nothing by
themselves; repeated rows repeat each other; a null doc_id is an id like others; an empty table
gives no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import U64, materialize, mix64, small_batches, tidy

LENGTH = 200
GRAM = 32
HOT_ANCHOR = 20_000
SPLIT = 16
SHARD_BYTES = 16_000_000
RUN_BYTES = 8_000_000
_PART = 1 << 19  # longer texts are read in parts that overlap
_BATCH = 1 << 19
_CODE = mix64(np.arange(1001, 1257, dtype=U64)) | U64(1)
_AT = U64((1 << 21) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, n, base = _CODE[b], 1, 0x9E3779B97F4A7C15
    while n < GRAM:
        h = h[:-n] * U64(base) + h[n:]
        n, base = 2 * n, base * base & 0xFFFFFFFFFFFFFFFF
    h ^= h >> U64(31)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(29)
    return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def _parts(raw: list[bytes], length: int):
    """(text's place, offset in it, bytes) of bounded parts; their starts cover each text once."""
    for i, r in enumerate(raw):
        if len(r) < length:
            continue
        for s in range(0, len(r) - length + 1, _PART):
            yield i, s, r[s : s + _PART + length - 1]


def intervals(raw: list[bytes], length: int = LENGTH):
    """Arrays (text, first start, last start, anchor, hash) of all intervals, in order."""
    out, some, size = [], [], 0

    def solve():
        b = np.frombuffer(b"".join(p for _, _, p in some), dtype=np.uint8)
        ends = np.cumsum([len(p) for _, _, p in some])
        h = gram_hashes(b)
        least = _sliding_min((h & ~_AT) | np.arange(len(h), dtype=U64), length - GRAM + 1)
        anchor = (least & _AT).astype(np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        new = np.empty(len(anchor), dtype=bool)
        new[0] = True
        new[1:] = anchor[1:] != anchor[:-1]
        live = np.ones(len(anchor) + 1, dtype=bool)
        for s, e in zip(begin.tolist(), ends.tolist(), strict=True):
            if s < len(new):
                new[s] = True
            live[e - length + 1 : e] = False  # windows that leave their text
        live = live[: len(anchor)]
        first = np.flatnonzero(live & new)
        stop = np.flatnonzero(live & np.concatenate([new[1:] | ~live[1:], [True]]))
        part = np.searchsorted(ends, first, side="right")
        text = np.array([i for i, _, _ in some])[part]
        shift = np.array([s for _, s, _ in some])[part] - begin[part]
        out.append((text, first + shift, stop + shift, anchor[first] + shift, h[anchor[first]]))

    for p in _parts(raw, length):
        if size + len(p[2]) > _BATCH + _PART and some:
            solve()
            some, size = [], 0
        some.append(p)
        size += len(p[2])
    if some:
        solve()
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, np.zeros(0, dtype=U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _raw(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8") for t in texts]


def _anchors(length: int):
    def run(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for i in range(0, len(texts), 500):
                part = frame.iloc[i : i + 500]
                text, _, _, _, h = intervals(_raw(part["text"]), length)
                first = np.searchsorted(text, text)
                yield pd.DataFrame({"doc": part["doc"].to_numpy()[text], "tag": part["tag"].to_numpy()[text], "at": np.arange(len(text)) - first, "anchor": h.view(np.int64)})

    return run


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least known."""
    n = min(len(a), len(b))
    step = 16
    high = min(n, known + step)
    while known < n and a[known:high] == b[known:high]:
        known, step = high, step * 2
        high = min(n, known + step)
    if known >= n:
        return n
    while high - known > 1:  # a[:known] is shared, a[:high] is not
        mid = (known + high) // 2
        if a[known:mid] == b[known:mid]:
            known = mid
        else:
            high = mid
    return known


def front_code(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the row before, length of the rest, and the rests, of sorted rows."""
    shared, rest, last = [], [], b""
    for r in rows:
        n = shared_prefix(last, r, 0)
        shared.append(n)
        rest.append(r[n:])
        last = r
    return np.array(shared, dtype=np.uint32), np.array([len(r) for r in rest], dtype=np.uint32), b"".join(rest)


class Run:
    """A front-coded sorted run as a player of the loser tree."""

    def __init__(self, shared: np.ndarray, size: np.ndarray, rests: bytes):
        self.shared, self.size, self.rests = shared.tolist(), size.tolist(), rests
        self.next, self.begin, self.row, self.known = 0, 0, b"", 0

    def advance(self) -> bool:
        """To the next row; known becomes what it shares with the one before, which won last."""
        if self.next >= len(self.shared):
            return False
        k, n = self.shared[self.next], self.size[self.next]
        self.row = self.row[:k] + self.rests[self.begin : self.begin + n]
        self.known = k
        self.begin += n
        self.next += 1
        return True


class LoserTree:
    """Merges runs. Each loser's known is its prefix shared with the winner it lost to, which
    is what the next comparison on that path needs: the longer known prefix wins, and only
    players with equal ones are compared, from there on."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.live = [r.advance() for r in runs]
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._start(1)

    def _plays(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); -1 and ended runs lose."""
        if j < 0 or not self.live[j]:
            return i, j
        if i < 0 or not self.live[i]:
            return j, i
        a, b = self.runs[i], self.runs[j]
        if a.known != b.known:
            return (i, j) if a.known > b.known else (j, i)
        n = shared_prefix(a.row, b.row, a.known)
        if a.row[n:] <= b.row[n:]:
            b.known = n
            return i, j
        a.known = n
        return j, i

    def _start(self, node: int) -> int:
        if node >= self.size:
            i = node - self.size
            if i < len(self.runs):
                self.runs[i].known = 0
                return i
            return -1
        win, self.losers[node] = self._plays(self._start(2 * node), self._start(2 * node + 1))
        return win

    def merge(self):
        """(run, prefix shared with the row given before) in sorted order; the run holds the row."""
        while self.winner >= 0 and self.live[self.winner]:
            i = self.winner
            yield i, self.runs[i].known
            self.live[i] = self.runs[i].advance()
            node = (i + self.size) // 2
            while node:
                i, self.losers[node] = self._plays(i, self.losers[node])
                node //= 2
            self.winner = i


_COLUMNS = ["shard", "shared", "size", "rests", "right", "many", "doc", "tag", "anchor", "known"]
_RUNS = "shard int, shared binary, size binary, rests binary, right binary, many binary, doc binary, tag binary, anchor binary, known binary"


def _sorted_runs(length: int, shards: int, run_bytes: int):
    def run(frames):
        held: dict[int, list] = {}
        size = 0

        def given():
            for shard, rows in held.items():
                rows.sort(key=lambda r: (r[0], r[1]))
                keys, right, many, doc, tag, anchor, known = [], [], [], [], [], [], []
                i = 0
                while i < len(rows):
                    j = i + 1
                    while j < len(rows) and rows[j][:2] == rows[i][:2]:
                        j += 1
                    key, r = rows[i][:2]
                    keys.append(key)
                    right.append(r)
                    many.append(j - i > 1)
                    if j - i > 1:  # these repeat each other as a whole
                        known += [(d, t, a - (len(key) - r), a + r) for _, _, d, t, a in rows[i:j]]
                    else:
                        doc.append(rows[i][2])
                        tag.append(rows[i][3])
                        anchor.append(rows[i][4])
                    i = j
                shared, rest, rests = front_code(keys)
                blobs = [shared.tobytes(), rest.tobytes(), rests, np.array(right, np.uint32).tobytes(), np.array(many, np.uint8).tobytes()]
                blobs += [np.array(x, np.int64).tobytes() for x in (doc, tag, anchor, known)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], _COLUMNS)
            held.clear()

        for frame in frames:
            texts = frame["row"].field("text")
            for i in range(0, len(frame), 500):
                raw = _raw(texts.slice(i, 500).to_pylist())
                text, first, last, anchor, h = intervals(raw, length)
                begin = np.searchsorted(text, np.arange(len(raw)))
                keys = (frame[c].slice(i, 500).to_pylist() for c in ("doc", "tag", "at", "hot"))
                for k, (doc, tag, at, hot) in enumerate(zip(*keys, strict=True)):
                    r, hot = raw[k], set(hot)
                    for n in at:
                        x = begin[k] + n
                        p, q, a, shard = int(first[x]), int(last[x]), int(anchor[x]), int(h[x] % U64(shards))
                        if n not in hot:
                            blocks = [(p, q, shard)]
                        else:
                            # blocks by distance to the anchor, the same for equal windows
                            cuts = sorted({p, q + 1} | {a - d + 1 for d in range(0, length, SPLIT) if p < a - d + 1 <= q})
                            blocks = []
                            for s, e in zip(cuts, cuts[1:], strict=False):
                                far = (a - s) // SPLIT * SPLIT + SPLIT - 1
                                common = r[a - far + SPLIT - 1 : a - far + length]
                                blocks.append((s, e - 1, int.from_bytes(hashlib.blake2b(common, digest_size=8).digest(), "big") % shards))
                        for s, e, to in blocks:
                            row = (r[a : e + length] + r[s:a][::-1], e + length - a, doc, tag, a)
                            held.setdefault(to, []).append(row)
                            size += len(row[0]) + 80
                if size > run_bytes:
                    yield from given()
                    size = 0
        yield from given()

    return run


class _Entry:
    __slots__ = ("holders", "key", "left", "many", "right", "shared")

    def __init__(self, key: bytes, right: int, shared: int):
        self.key, self.right, self.shared, self.many, self.holders = key, right, shared, False, []
        self.left = key[right:]


def _bounds(group: list[_Entry], length: int) -> list[tuple[int, int]]:
    """For each entry the distances to the anchor, low to high, at which its windows may
    equal those of another entry: at d, the first length - d bytes from the anchor and the
    last d before it must be shared with a neighbour in the two sorted orders."""
    m = len(group)
    right = [0] * m
    for i in range(1, m):
        n = group[i].shared
        right[i] = max(right[i], n)
        right[i - 1] = max(right[i - 1], n)
    left = [0] * m
    order = sorted(range(m), key=lambda i: group[i].left)
    for i, j in zip(order, order[1:], strict=False):
        n = shared_prefix(group[i].left, group[j].left, 0)
        left[i], left[j] = max(left[i], n), max(left[j], n)
    return [(max(length - min(g.right, right[i]), length - g.right), min(len(g.left), left[i])) for i, g in enumerate(group)]


def repeated_distances(group: list[_Entry], length: int) -> dict[int, list[int]]:
    """Of each entry that is there once, the distances whose windows some other entry has."""
    bounds = _bounds(group, length)
    by_distance: dict[int, list[int]] = {}
    for i, (low, high) in enumerate(bounds):
        for d in range(low, high + 1):
            by_distance.setdefault(d, []).append(i)
    found: dict[int, list[int]] = {}
    for d in sorted(by_distance):
        at: dict[bytes, list[int]] = {}
        for i in by_distance[d]:
            g = group[i]
            at.setdefault(g.key[: length - d] + g.left[:d], []).append(i)
        for members in at.values():
            if len(members) > 1:
                for i in members:
                    if not group[i].many:
                        found.setdefault(i, []).append(d)
    return found


def _resolve(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, holders, right, many, out = [], [], [], [], []
        for row in frame.itertuples(index=False):
            runs.append(Run(np.frombuffer(row.shared, np.uint32), np.frombuffer(row.size, np.uint32), row.rests))
            right.append(np.frombuffer(row.right, np.uint32).tolist())
            many.append(np.frombuffer(row.many, np.uint8).tolist())
            holders.append(iter(list(zip(*(np.frombuffer(x, np.int64).tolist() for x in (row.doc, row.tag, row.anchor)), strict=True))))
            out.append(np.frombuffer(row.known, np.int64).reshape(-1, 4))
        group: list[_Entry] = []
        extra: list[tuple] = []

        def close():
            for g in group:
                if g.many:
                    extra.extend((d, t, a - len(g.left), a + g.right) for d, t, a in g.holders)
            if len(group) > 1:
                for i, found in repeated_distances(group, length).items():
                    d, t, a = group[i].holders[0]
                    s = found[0]
                    for x, y in zip(found, [*found[1:], None], strict=True):
                        if y != x + 1:
                            extra.append((d, t, a - x, a - s + length))
                            s = y
            group.clear()

        for i, shared in LoserTree(runs).merge():
            k = runs[i].next - 1
            r = right[i][k]
            if group and shared < GRAM:
                close()
            last = group[-1] if group else None
            if last is not None and last.right == r and last.key == runs[i].row:
                last.many = True
            else:
                last = _Entry(runs[i].row, r, shared)
                group.append(last)
            if many[i][k]:
                last.many = True
            else:
                last.holders.append(next(holders[i]))
        close()
        every = np.concatenate([*out, np.array(extra, dtype=np.int64).reshape(-1, 4)])
        return pd.DataFrame(every, columns=["doc", "tag", "start", "end"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc, tag): all columns of docs as one, whatever their names, and what a document
    is known by, its id and a hash of its text."""
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), tag.alias("tag"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, hot_anchor: int = HOT_ANCHOR, shard_bytes: int = SHARD_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(doc, tag, start, end): byte ranges of repeated strings, not merged, for documents that
    have any, of rows as _keyed gives them."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    rows = keyed.select("doc", "tag", F.col("row.text").alias("text"))
    anchors = materialize(rows.mapInPandas(tidy(_anchors(length)), "doc long, tag long, at int, anchor long"))
    shards = max(8, -(-anchors.count() * (length + 80) // shard_bytes))
    counts = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot_anchor).alias("hot"))
    shared = anchors.join(counts, "anchor").groupBy("doc", "tag").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("hot")
    )
    # whole rows go along, so that the documents are shuffled once for both joins
    carried = keyed.join(shared, ["doc", "tag"]).select("row", "doc", "tag", "at", "hot")
    runs = carried.mapInArrow(tidy(_sorted_runs(length, shards, run_bytes)), _RUNS)
    return runs.groupBy("shard").applyInPandas(_resolve(length), "doc long, tag long, start long, end long")


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(docs: DataFrame, **options) -> DataFrame:
    """(row, removed, kept, cut text) of each row of docs; the last is null where nothing goes."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, **options).groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = keyed.join(spans, ["doc", "tag"], "left").select("row", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("row", keyed.schema["row"].dataType), T.StructField("removed", span), T.StructField("kept", T.BinaryType()), T.StructField("cut", T.StringType())]
    return both.mapInArrow(tidy(_apply), T.StructType(fields))


def _apply(frames):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for frame in frames:
        removed, kept, cut = [], [], []
        for r, spans in zip(_raw(frame["row"].field("text").to_pylist()), frame["spans"].to_pylist(), strict=True):
            ranges = merged([(s["start"], s["end"]) for s in spans or ()])
            at, out = 0, []
            for s, e in ranges:
                out.append(r[at:s])
                at = e
            removed.append([{"start": s, "end": e} for s, e in ranges])
            kept.append(b"".join([*out, r[at:]]))
            cut.append(kept[-1].decode("utf-8", "ignore") if ranges else None)
        yield pa.RecordBatch.from_arrays([frame["row"], pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(cut, pa.string())], ["row", "removed", "kept", "cut"])


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with removed (array of merged byte ranges [start, end), empty if
    none) and kept (the remaining bytes), which replace columns of these names."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("removed", "kept")]
    return _removed(docs, **options).select(*own, "removed", "kept")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with the repeats cut out of text; a character that a cut went through
    goes as a whole. n_chars, if there, is counted anew where text was cut."""
    out = _removed(docs, **options)
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    row = F.col("row")
    return out.select(*[F.coalesce(new[c], row.getField(c)).alias(c) if c in new else row.getField(c).alias(c) for c in docs.columns])


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 200 bytes leaves of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
