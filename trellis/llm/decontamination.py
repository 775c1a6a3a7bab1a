"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some places of a window of words, so that a window whose words were
replaced at ignored places keeps its hash. The hashes of all windows of the test items are
joined with those of the documents; each hit fixes an alignment of item and document, which
is verified word by word: along it the best run of words is found with +1 for an equal word
and -1 for a replaced one. An item leaks into a document if the runs of its alignments cover
at least `coverage` of its words with equal ones and have min_words such words, or all words
of a shorter item, or if one run alone has run_words equal words, however long the item is.
Items shorter than a mask are sought as a whole.

Both sides are hashed in tasks. A bitmap of fixed size of the items' hashes is broadcast and
keeps most hashes of the documents from being shuffled; the rest are made distinct and joined
with the items' on the hash, salted, so a passage that many documents or items share is spread
over SALTS tasks. A hash that returns at a constant distance in a text, as in one repeated word, is
a run, one row, on either side, and a pair of runs stands for all its alignments. Texts are known
by their digest: copies of a document or an item are verified once. Only texts with a hit are
read again, and sent once with all items that hit them, in parts of PART_ITEMS. Both sides match by lower-case words of
ASCII letters, digits and all other characters beyond ASCII.

Defined cases: null or empty text on either side has no words and matches nothing; equal
items are reported each; repeated rows are reported each; empty tables give no rows; a null
item_id is reported as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import batches, materialize, small_batches, tidy
from trellis.llm.words import ALNUM, windows_hash, word_hashes

MASKS = ("1101100101", "1110010011", "1011010011")
COVERAGE = 0.5
MIN_WORDS = 8
RUN_WORDS = 13
#: Characters of items hashed at once in a task are twice as many.
BLOCK_WORDS = 400_000
#: Parts that the documents of one hash are dealt to.
SALTS = 16
_FILTER_BITS = 24
#: Items that are verified against a text at once; a text is sent once for each such part.
PART_ITEMS = 1000
_SEEDS = "text_key binary, seed long, mask int, place int, step int, many int"
_RUN = ["place", "step", "many"]


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _places(masks) -> list[tuple]:
    """Places that count, of each mask and then of the masks for whole items that are shorter."""
    span = min(len(m) for m in masks)
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in masks] + [tuple(range(n)) for n in range(1, span)]


def _runs(owner: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with one owner and hash as arithmetic runs: where each starts in `at` and its step and
    length. A text that repeats itself at a constant distance has one run for each hash."""
    order = np.lexsort((at, h, owner))
    owner, h, at = owner[order], h[order], at[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    step = np.zeros(len(at), dtype=np.int64)
    step[1:] = at[1:] - at[:-1]
    new = first.copy()
    new[2:] |= ~first[1:-1] & (step[2:] != step[1:-1])
    begins = np.flatnonzero(new)
    many = np.diff(np.append(begins, len(at)))
    second = np.minimum(begins + 1, max(0, len(at) - 1))
    return order[begins], np.where(many > 1, step[second], 0), many


def _seeds(keys: pa.Array, texts: list, places: list[tuple], used: list[int], whole_from: int, seen=None):
    """Batches of (text_key, seed, mask, place, step, many) of the windows of texts under the masks in used, as runs;
    under those from whole_from on only windows that are the whole text if seen is None, else
    only windows whose bit in seen is set."""
    words, first = word_hashes(texts, ALNUM)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for k in used:
        h = windows_hash(words, places[k]) + np.uint64(k)
        if seen is None:
            at = np.arange(len(h))
            if k >= whole_from:
                at = at[sizes[owner[at]] == len(places[k])]
        else:
            bit = (h >> np.uint64(64 - _FILTER_BITS)) & np.uint64(63)
            word = (h >> np.uint64(64 - _FILTER_BITS + 6)).astype(np.int64)
            at = np.flatnonzero((seen[word] >> bit) & np.uint64(1))
        at = at[owner[at] == owner[at + places[k][-1]]]
        if len(at):
            begins, step, many = _runs(owner[at], h[at], at)
            at = at[begins]
            columns = [keys.take(pa.array(owner[at])), pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), k, np.int32)), *(pa.array(x.astype(np.int32)) for x in (at - first[owner[at]], step, many))]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "seed", "mask", *_RUN])


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """The run [a, b) with the highest score, +1 for True and -1 for False; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(total)
    b = int(np.argmax(total - low))
    return int(np.argmin(total[: b + 1])), b


def alignments(pairs) -> np.ndarray:
    """The distinct starts of an item in a text that pairs of runs of equal windows fix; a pair has the
    run (place, step, many) of the text and that of the item."""
    out = []
    for a, s, m, p, t, n in pairs:
        if s == t or m == 1 or n == 1:  # one run again
            step = s if m > 1 else t
            out.append(a - p + step * np.arange(-(n - 1), m, dtype=np.int64))
        else:
            out.append(((a + s * np.arange(m, dtype=np.int64))[:, None] - (p + t * np.arange(n, dtype=np.int64))[None, :]).ravel())
    return np.unique(np.concatenate(out))


def _verified(words: np.ndarray, item: np.ndarray, starts, coverage: float, min_words: int, run_words: int):
    """(equal words, item's words, first and last + 1 word of the text, alignments) if the item
    leaks into the text with these words, else None."""
    have, low, high, longest = np.zeros(len(item), dtype=bool), None, None, 0
    for start in starts:
        a, b = max(0, -start), min(len(item), len(words) - start)
        equal = words[start + a : start + b] == item[a:b]
        x, y = best_run(equal)
        have[a + x : a + y] |= equal[x:y]
        longest = max(longest, int(equal[x:y].sum()))
        low = start + a + x if low is None else min(low, start + a + x)
        high = start + a + y if high is None else max(high, start + a + y)
    n = int(have.sum())
    if longest >= run_words or n >= coverage * len(item) and n >= min(min_words, len(item)):
        return n, len(item), low, high, len(starts)
    return None


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which leading _FILTER_BITS bits the seeds have, 64 to a word; its size does not depend
    on the number of seeds."""
    bits = seeds.select(F.shiftrightunsigned("seed", 64 - _FILTER_BITS).alias("bits"))
    words = bits.groupBy(F.shiftright("bits", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bits & 63L)))").alias("held")).toPandas()
    out = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["held"].to_numpy(np.int64).view(np.uint64)
    return out


SCHEMA = "matched_words int, item_words int, first_word int, last_word int, alignments int"


def leaking_texts(docs: DataFrame, benchmark: DataFrame, masks=MASKS, coverage: float = COVERAGE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_key, item_key, figures), a row for each distinct text of docs and of benchmark of
    which the second leaks into the first; keys are digests of the texts. Written."""
    spark = small_batches(docs.sparkSession)
    places, n_masks = _places(masks), len(masks)
    texts = docs.filter("text is not null").select(_key(F.col("text")).alias("text_key"), "text")
    items = benchmark.filter("text is not null").select("text").distinct().select(_key(F.col("text")).alias("text_key"), "text")

    def of_items(frames):
        for frame in frames:
            keys, them = frame.column("text_key"), frame.column("text").to_pylist()
            for i, j in batches(them, 2 * block_words):
                yield from _seeds(keys.slice(i, j - i), them[i:j], places, range(len(places)), n_masks)

    item_seeds = materialize(items.mapInArrow(tidy(of_items), _SEEDS))
    used = sorted(r["mask"] for r in item_seeds.select("mask").distinct().collect())  # one for each mask at most
    seen = spark.sparkContext.broadcast(_bitmap(item_seeds))

    def of_docs(frames):
        for frame in frames:
            keys, them = frame.column("text_key"), frame.column("text").to_pylist()
            for i, j in batches(them, 1_000_000):
                yield from _seeds(keys.slice(i, j - i), them[i:j], places, used, n_masks, seen.value)

    found = texts.mapInArrow(tidy(of_docs), _SEEDS).select(F.col("text_key").alias("doc_key"), "seed", *(F.col(c).alias(f"at_{c}") for c in _RUN)).distinct()
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_key", "at_place"), F.lit(SALTS)).cast("int"))
    sought = item_seeds.select(F.col("text_key").alias("item_key"), "seed", *_RUN, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    runs = F.struct(*(f"at_{c}" for c in _RUN), *_RUN)
    hits = materialize(found.join(sought, ["seed", "salt"]).groupBy("doc_key", "item_key").agg(F.collect_set(runs).alias("runs")))

    # a document's text is sent once for every PART_ITEMS items that hit it
    parts = hits.groupBy("doc_key").agg(F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("item_key"), F.col("parts")).cast("int").alias("part")
    known = hits.join(items.select(F.col("text_key").alias("item_key"), F.col("text").alias("item_text")), "item_key")
    cells = F.collect_list(F.struct("item_key", "item_text", "runs")).alias("items")
    asked = known.join(parts, "doc_key").select("doc_key", part, "item_key", "item_text", "runs").groupBy("doc_key", "part").agg(cells)
    # few texts have a hit: a bitmap of their keys keeps the others from being shuffled
    wanted = hits.select("doc_key").distinct()
    held = spark.sparkContext.broadcast(_bitmap(wanted.select(F.xxhash64("doc_key").alias("seed"))))

    def of_hits(frames):
        for frame in frames:
            seed = frame.column("seed").to_numpy().view(np.uint64)
            bit = (seed >> np.uint64(64 - _FILTER_BITS)) & np.uint64(63)
            word = (seed >> np.uint64(64 - _FILTER_BITS + 6)).astype(np.int64)
            keep = ((held.value[word] >> bit) & np.uint64(1)).astype(bool)
            yield frame.filter(pa.array(keep)).select(["doc_key", "text"])

    keyed = texts.select(F.col("text_key").alias("doc_key"), "text", F.xxhash64("text_key").alias("seed"))
    hit = keyed.mapInArrow(tidy(of_hits), "doc_key binary, text string").join(wanted, "doc_key", "left_semi")
    pairs = asked.join(hit.groupBy("doc_key").agg(F.first("text").alias("doc_text")), "doc_key").select("doc_key", "doc_text", "items")

    def verify(frames):
        for frame in frames:
            doc_keys, doc_texts = (frame.column(c).to_pylist() for c in ("doc_key", "doc_text"))
            for k, (doc_key, text) in enumerate(zip(doc_keys, doc_texts, strict=True)):
                words, rows = word_hashes([text], ALNUM)[0], []
                them = frame.column("items")[k].as_py()
                for i, j in batches([x["item_text"] for x in them], 1_000_000):
                    item_words, first = word_hashes([x["item_text"] for x in them[i:j]], ALNUM)
                    for x, a, b in zip(them[i:j], first, first[1:], strict=False):
                        starts = alignments([tuple(r.values()) for r in x["runs"]])
                        if got := _verified(words, item_words[a:b], starts.tolist(), coverage, min_words, run_words):
                            rows.append((doc_key, x["item_key"], *got))
                if rows:
                    doc, item, *figures = zip(*rows, strict=True)
                    columns = [pa.array(doc, pa.binary()), pa.array(item, pa.binary()), *(pa.array(f, pa.int32()) for f in figures)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_key", "item_key", *(c.split()[0] for c in SCHEMA.split(", "))])

    return materialize(pairs.mapInArrow(tidy(verify), f"doc_key binary, item_key binary, {SCHEMA}"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, coverage: float = COVERAGE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """A row for each document (doc_id) and item (item_id) that leaks into it: equal words,
    the item's words, the words [first_word, last_word) of the document, alignments."""
    pairs = leaking_texts(docs, benchmark, masks, coverage, min_words, block_words, run_words)
    ids = docs.select(_key(F.col("text")).alias("doc_key"), "doc_id")
    item_ids = benchmark.select(_key(F.col("text")).alias("item_key"), "item_id")
    return ids.join(pairs, "doc_key").join(item_ids, "item_key").select("doc_id", "item_id", *(c.split()[0] for c in SCHEMA.split(", ")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, masks=MASKS, coverage: float = COVERAGE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs, all columns, without the rows into whose text an item leaks."""
    gone = leaking_texts(docs, benchmark, masks, coverage, min_words, block_words, run_words).select("doc_key").distinct()
    return docs.join(gone, _key(docs["text"]) == gone["doc_key"], "left_anti")


def op4_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that leaks into it."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
