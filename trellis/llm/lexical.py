"""Ranked lexical search of whole texts, with documents of one bag scored once.

A text's terms are the runs of ASCII letters and digits and of all other characters, with A-Z
lowered. Items are taken in blocks of a bounded number of postings, in order of item_id; one pass
over the documents serves a block (a benchmark of a few thousand items is one block). In a pass

1. tasks count each text's terms and keep those of the block's vocabulary: n, and the
   frequencies of the restricted bag, written once;
2. sums over all documents give N, L and the document frequencies, so each term's weight and
   each document's length class m;
3. documents that agree in the restricted frequencies and in m score alike for every item. They are
   grouped by a hash of both and by the values themselves, so a hash shared by different
   bags parts them again; a class keeps its smallest doc_id;
4. classes are scored in tasks against the block, and of each item the ten best by score and
   smallest doc_id are kept: members of further classes cannot be among its ten documents;
5. only those classes are expanded, to their ten smallest doc_ids.

Scores are sums of integers; they are taken in doubles where the block's largest possible score
is below 2 ** 53, where doubles are exact, and in 64-bit integers beyond.

doc_id is an integer. Defined cases: null and empty texts, and texts without terms, match nothing and count for
nothing; documents with a null doc_id count for the statistics and come after all others in
ties; rows sharing a doc_id are documents of their own; an item without terms, or without a
document that has one, gives no rows; rows sharing an item_id are searched as one item; a null
item_id is an item too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import batches, materialize, small_batches, tidy

TOP = 10
#: Distinct (item, term) pairs of a block, which tasks hold with its vocabulary: some 50 MB.
BLOCK_POSTINGS = 1_000_000
#: Bytes of a text that are split into terms at once.
PART = 1 << 20
#: Cells of scores, and pairs of a class's term and an item, that are held at once.
CELLS = 2_000_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_EXACT = float(1 << 53)


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term, as UTF-8, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    if len(raw) <= PART:
        return Counter(_TERM.findall(raw))
    out, at = Counter(), 0
    while at < len(raw):
        gap = _GAP.search(raw, min(len(raw), at + PART))
        end = gap.start() if gap else len(raw)
        out.update(_TERM.findall(raw, at, end))
        at = end
    return out


def _item_terms(batches_):
    for batch in batches_:
        ids, terms = [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            own = sorted(term_counts(text))
            ids += [i] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary())], ["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term binary").distinct()


def _bags(vocabulary):
    def run(frames):
        known = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in frames:
            texts = batch["text"].to_pylist()
            for i, j in batches(texts):
                n, ids, tfs = [], [], []
                for text in texts[i:j]:
                    counts = term_counts(text)
                    own = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                    n.append(counts.total())
                    ids.append([k for k, _ in own])
                    tfs.append([c for _, c in own])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"]
                )

    return tidy(run)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Items as lists of terms. A term that an eighth of the items have is a row of a dense
    matrix; the others are postings from term to items."""

    def __init__(self, weights: np.ndarray, item_of: np.ndarray, term_of: np.ndarray, n_items: int):
        self.weights, self.n_items, n = weights, n_items, len(weights)
        count = np.bincount(term_of, minlength=n)
        self.common = np.flatnonzero(count * 8 > n_items)
        self.row = np.full(n, -1, dtype=np.int64)
        self.row[self.common] = np.arange(len(self.common))
        dense = self.row[term_of] >= 0
        self.matrix = np.zeros((len(self.common), n_items))
        self.matrix[self.row[term_of[dense]], item_of[dense]] = 1.0
        rare = np.argsort(term_of[~dense], kind="stable")
        self.items = item_of[~dense][rare]
        self.start = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.bincount(term_of[~dense], minlength=n), out=self.start[1:])
        most = np.bincount(item_of, weights=weights[term_of].astype(np.float64), minlength=n_items).max(initial=0.0) * 1e6
        self.exact = most < _EXACT

    def scores(self, size: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """classes by items; size says how many of ids and tfs each class has."""
        k = len(size)
        of = np.repeat(np.arange(k), size)
        part = self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, size)))
        kind = np.float64 if self.exact else np.int64
        out = np.zeros((k, self.n_items), dtype=kind)
        dense = self.row[ids] >= 0
        if dense.any():
            given = np.zeros((k, len(self.common)), dtype=kind)
            given[of[dense], self.row[ids[dense]]] = part[dense]
            out += given @ self.matrix.astype(kind, copy=False)
        of, ids, part = of[~dense], ids[~dense], part[~dense]
        reach = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(reach)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
            r = reach[a:b]
            at = np.repeat(self.start[ids[a:b]] - np.concatenate([[0], np.cumsum(r)[:-1]]), r) + np.arange(int(r.sum()))
            cell = np.repeat(of[a:b], r) * self.n_items + self.items[at]
            if self.exact:
                out += np.bincount(cell, weights=np.repeat(part[a:b], r), minlength=out.size).reshape(out.shape)
            else:
                np.add.at(out.reshape(-1), cell, np.repeat(part[a:b], r))
            a = b
        return out


_NO_ID = np.iinfo(np.int64).max


def _best(shared, top: int):
    """The top classes of each item among those of a task: larger scores, then smaller ids."""

    def run(frames):
        block = Block(*shared.value)
        score = np.zeros((top, block.n_items), dtype=np.int64)
        first = np.full((top, block.n_items), _NO_ID)
        place = np.full((top, block.n_items), -1, dtype=np.int64)
        for batch in frames:
            size = np.diff(batch["ids"].offsets.to_numpy()).astype(np.int64)
            ids, tfs = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("ids", "tfs"))
            m, least, own = (batch[c].to_numpy() for c in ("m", "least", "class"))
            starts = np.concatenate([[0], np.cumsum(size)])
            step = max(1, CELLS // max(1, block.n_items))
            for a in range(0, len(size), step):
                b = min(len(size), a + step)
                s = slice(starts[a], starts[b])
                got = block.scores(size[a:b], ids[s], tfs[s], m[a:b]).astype(np.int64)
                score = np.concatenate([score, got])
                shape = (b - a, block.n_items)
                first = np.concatenate([first, np.broadcast_to(least[a:b, None], shape)])
                place = np.concatenate([place, np.broadcast_to(own[a:b, None], shape)])
                if len(score) > 8 * top:  # most rows are worse than the worst kept: sort only the others
                    cut = np.partition(score, len(score) - top, axis=0)[len(score) - top]
                    rows = (score >= np.maximum(cut, 1)).any(axis=1)
                    score, first, place = score[rows], first[rows], place[rows]
                order = np.lexsort((first, -score), axis=0)[:top]
                score, first, place = (np.take_along_axis(x, order, axis=0) for x in (score, first, place))
        rank, item = np.nonzero((score > 0) & (place >= 0))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score[rank, item]), pa.array(first[rank, item]), pa.array(place[rank, item])], ["item", "score", "least", "class"])

    return tidy(run)


def _block_search(docs: DataFrame, item_of: np.ndarray, term_of: np.ndarray, terms: list[bytes], n_items: int, top: int) -> DataFrame:
    """(item, doc_id, score) with the top documents of each item of a block."""
    spark = small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = spark.sparkContext.broadcast(terms)
    bags = materialize(docs.select("doc_id", "text").mapInArrow(_bags(vocabulary), f"doc_id {kind}, n long, ids array<int>, tfs array<long>"))
    all_ = bags.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = {r["id"]: r["df"] for r in bags.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()}
    weights = np.array([weight(all_["docs"], found.get(i, 0)) for i in range(len(terms))], dtype=np.int64)
    shared = spark.sparkContext.broadcast((weights, item_of, term_of, n_items))
    m = F.expr(f"10 + (90 * n * {all_['docs']}L) div {max(1, all_['terms'])}L")
    tagged = bags.filter(F.size("ids") > 0).select("doc_id", "ids", "tfs", m.alias("m")).withColumn("hash", F.xxhash64("ids", "tfs", "m"))
    least = F.coalesce(F.min(F.col("doc_id").cast("long")), F.lit(_NO_ID))
    classes = tagged.groupBy("hash", "m", "ids", "tfs").agg(least.alias("least")).withColumn("class", F.monotonically_increasing_id())
    classes = materialize(classes)
    best = classes.select("ids", "tfs", "m", "least", "class").mapInArrow(_best(shared, top), "item int, score long, least long, class long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    best = materialize(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item", "score", "class"))
    needed = classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "hash", "m", "ids", "tfs")
    members = tagged.join(needed, ["hash", "m", "ids", "tfs"]).select("class", "doc_id")
    w = Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= top)
    out = best.join(members, "class")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return materialize(out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the top documents with a score above 0."""
    spark = docs.sparkSession
    pairs = materialize(item_terms(items))
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("size"))
    # blocks of consecutive items: postings before an item, counted over ranges of item_id
    ordered = materialize(sizes.repartitionByRange("item_id").sortWithinPartitions("item_id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = ordered.groupBy(part.alias("part")).agg(F.sum("size").alias("rows"))
    starts = runs.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ordered.withColumn("part", part).join(starts, "part").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    numbered = materialize(numbered.select("item_id", F.floor(F.col("before") / block_postings).cast("long").alias("block")))
    blocks = sorted(r["block"] for r in numbered.select("block").distinct().collect())
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for k in blocks:
        some = numbered.filter(F.col("block") == k).select("item_id")
        rows = pairs.join(some, pairs["item_id"].eqNullSafe(some["item_id"]), "left_semi").toArrow()
        keys = rows["item_id"].to_pylist()
        ids = sorted(set(keys), key=lambda x: (x is not None, x))
        number = {x: i for i, x in enumerate(ids)}
        terms = sorted(set(rows["term"].to_pylist()))
        of = {t: i for i, t in enumerate(terms)}
        item_of = np.array([number[x] for x in keys], dtype=np.int64)
        term_of = np.array([of[t] for t in rows["term"].to_pylist()], dtype=np.int64)
        found = _block_search(docs, item_of, term_of, terms, len(ids), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op13_bag_dedup_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, term, count(*) AS tf, any_value(m) AS m FROM (SELECT doc_id, 10 + (90 * len(t) * docs) // terms AS m, unnest(t) AS term FROM d, n WHERE len(t) > 0) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, n GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN f USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
