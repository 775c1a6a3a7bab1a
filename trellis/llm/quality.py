"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are of unfolded characters, `order` of them at most, inside words: a word
is read with one space before and after it, and no context crosses a space. The tables are
sharded and grow with the corpus; they never pass through the driver or a broadcast as a whole.

Training covers all trusted text but one document in `calibration`, chosen by hash, which only
sets the limits. Each document is reduced to its counted words, which meet the labels in a
shuffle join; tasks add up words and deal out n-grams. An n-gram that starts a word, or has
the full order, keeps its count; all others count the distinct characters before them. Every
order's discounted shares come from joins of the count table with the totals of its contexts.

The n-grams of all documents are counted in the tasks and joined, order by order, with those
tables. Documents are then scored where they are read: the `frequent` n-grams with the highest
counts, at most, are broadcast, and the stretches with any other n-gram are joined with the
surprisals in a shuffle and summed for each document. Results do not depend on `frequent`.

A document is judged by two measures, each against the quantile of the same measure in its
language's calibration documents. The score is the mean surprisal in nats for each character,
with `prior` characters of the mean of its language added, which steadies short texts; its
limit is `margin` times the quantile. For the second, words (long ones in stretches) that hold
a letter and no digit are strange if their mean surprisal is above the `unit_quantile` of such
words in the calibration documents; worst is their number over that of all such words and
`worst_prior` more, so that a few strange words among many good ones show; its limit is
`worst_margin` times the quantile. Languages with fewer than min_trusted calibration documents
use the limits of all languages.

Defined cases: null or empty text scores the mean of its language and is kept; a null lang is
a language of its own; a null doc_id is never trusted; without calibration documents every
document is kept; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellis.llm.common import U64, batches, materialize, mix64, small_batches, tidy

ORDER = 5
STRETCH = 32
FREQUENT = 200_000
CALIBRATION = 4
QUANTILE = 0.99
MARGIN = 1.1
PRIOR = 40.0
UNIT_QUANTILE = 0.999
WORST_PRIOR = 20.0
WORST_MARGIN = 1.25
MIN_TRUSTED = 50
#: Distinct words that a task gathers before it passes their n-grams on.
_HELD = 200_000
_MULTIPLY = 0x9E3779B97F4A7C15


class Grams:
    """The n-grams of words: one ends at each character of a word and at the space after it."""

    def __init__(self, words: list[str], order: int):
        self.text, self.order = " " + " ".join(words) + " ", order
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        space = np.flatnonzero(code == 32)
        size = np.diff(space)  # with the space after the word
        self.word = np.repeat(np.arange(len(words)), size)
        self.at = np.arange(len(code) - 1) + 1
        self.back = self.at - np.repeat(space[:-1], size)  # places since the space before the word
        h = np.zeros(len(self.at), dtype=U64)
        own = code.astype(U64) + U64(1)
        for j in range(order - 1, -1, -1):  # characters before the word's space count as 0
            c = np.zeros(len(self.at), dtype=U64)
            if j < len(self.at) + 1:
                c[max(j - 1, 0) :] = own[max(1 - j, 0) : len(own) - j]
            h = (h + np.where(self.back >= j, c, U64(0))) * U64(_MULTIPLY)
            h ^= h >> U64(29)
        self.hashes = mix64(h)

    def gram(self, i: int) -> str:
        at = int(self.at[i])
        return self.text[at - min(int(self.back[i]), self.order - 1) : at + 1]


def gram_hash(grams: list[str], order: int) -> np.ndarray:
    """Hashes, as in Grams, of single n-grams."""
    code = np.zeros((len(grams), order), dtype=U64)
    for i, g in enumerate(grams):
        code[i, order - len(g) :] = np.frombuffer(g.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64) + U64(1)
    h = np.zeros(len(grams), dtype=U64)
    for j in range(order):
        h = (h + code[:, j]) * U64(_MULTIPLY)
        h ^= h >> U64(29)
    return mix64(h)


def _dealt(held: Counter, order: int):
    """Batches of (gram, c) of counted words."""
    words, counts = list(held), np.fromiter(held.values(), np.int64, len(held))
    if words:
        grams = Grams(words, order)
        where, distinct = pd.factorize(grams.hashes)
        first = np.empty(len(distinct), dtype=np.int64)
        first[where[::-1]] = np.arange(len(where))[::-1]
        c = np.bincount(where, counts[grams.word]).astype(np.int64)
        for a in range(0, len(first), 50_000):
            some = first[a : a + 50_000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([grams.gram(i) for i in some], pa.string()), pa.array(c[a : a + 50_000])], ["gram", "c"])


def _bags(frames):
    """Each document's distinct words and their counts."""
    for frame in frames:
        words, counts = [], []
        for t in frame["text"].to_pylist():
            bag = Counter((t or "").split())
            words.append(" ".join(bag))
            counts.append(np.fromiter(bag.values(), "<i4", len(bag)).tobytes())
        yield pa.RecordBatch.from_arrays([frame["doc_id"], pa.array(words, pa.string()), pa.array(counts, pa.binary())], ["doc_id", "words", "counts"])


def _summed(read, order: int):
    def run(frames):
        held: Counter = Counter()
        for frame in frames:
            for part in read(frame):
                held.update(part)
                if len(held) >= _HELD:
                    yield from _dealt(held, order)
                    held.clear()
        yield from _dealt(held, order)

    return run


def _read_texts(frame):
    return ((t or "").split() for t in frame["text"].to_pylist())


def _read_bags(frame):
    for words, counts in zip(frame["words"].to_pylist(), frame["counts"].to_pylist(), strict=True):
        yield dict(zip(words.split(), np.frombuffer(counts, "<i4").tolist(), strict=True))


def gram_counts(rows: DataFrame, order: int = ORDER, bags: bool = False) -> DataFrame:
    """(gram, c) of all rows: texts, or bags of words."""
    run = _summed(_read_bags if bags else _read_texts, order)
    return rows.mapInArrow(tidy(run), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _suffixes(grams: DataFrame) -> DataFrame:
    return grams.select(F.explode(F.expr("transform(sequence(1, length(gram)), k -> right(gram, k))")).alias("gram")).distinct()


def discounted(top: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From the counts of n-grams as Grams has them: (gram, share), what each n-gram of any
    order has for itself, and (context, n, left), what a context leaves to the lower order."""
    below = _suffixes(top).filter("length(gram) > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
    counts = materialize(top.select("gram", "c").unionByName(below).withColumn("n", F.length("gram")))
    have = {(r["n"], r["c"]): r["m"] for r in counts.filter("c <= 4").groupBy("n", "c").agg(F.count("*").alias("m")).collect()}  # 4 rows an order
    cut = F.lit(0.5)
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (float(have.get((n, k), 0)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("n") == n, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
    keyed = counts.withColumn("context", F.expr("left(gram, n - 1)")).withColumn("cut", cut)
    totals = keyed.groupBy("context", "n").agg(F.sum("c").alias("total"), F.sum("cut").alias("kept"))
    shares = keyed.join(totals, ["context", "n"]).select("gram", ((F.col("c") - F.col("cut")) / F.col("total")).alias("share"))
    return shares, totals.select("context", "n", (F.col("kept") / F.col("total")).alias("left"))


def surprisals(learnt: DataFrame, every: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c, nats) of the n-grams of every, (gram, c), in the model of learnt, (gram, c)."""
    shares, left = discounted(learnt, order)
    asked = _suffixes(every).withColumn("n", F.length("gram")).withColumn("context", F.expr("left(gram, n - 1)"))
    rows = materialize(asked.join(shares, "gram", "left").join(left, ["context", "n"], "left").select("gram", "n", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("left", F.lit(1.0)).alias("left")))
    letters = rows.filter("n = 1")
    p, out = letters.select("gram", (F.col("share") + F.col("left") / float(1 + letters.count())).alias("p")), None
    for n in range(2, order + 1):
        own = rows.filter(F.col("n") == n).withColumn("lower", F.expr("substring(gram, 2)"))
        low = p.select(F.col("gram").alias("lower"), F.col("p").alias("q"))
        p = materialize(own.join(low, "lower").select("gram", (F.col("share") + F.col("left") * F.col("q")).alias("p")))
        out = p if out is None else out.unionByName(p)
    return materialize(every.join(out, "gram").select("gram", "c", (-F.log("p")).alias("nats")))


def _scored(table, order: int, stretch: int, names, types):
    """Per document a head row with the sums over stretches whose n-grams are all in the
    table, histogram of strangeness included, and a row for each other stretch."""

    def run(frames):
        hashes, nats_of = table.value
        starts = np.searchsorted(hashes, np.arange(1 << 20, dtype=U64) << U64(44))
        for frame in frames:
            ids, docs, langs, texts = (frame[c] for c in ("row", "doc_id", "lang", "text"))
            texts = texts.to_pylist()
            for i, j in batches(texts, 2_000_000):
                said, ends = [], []
                for t in texts[i:j]:
                    said += (t or "").split()
                    ends.append(len(said))
                place = {w: k for k, w in enumerate(dict.fromkeys(said))}
                heads = np.zeros((5, j - i))
                rest = []
                if place:
                    words = list(place)
                    g = Grams(words, order)
                    k, hit = _found(hashes, starts, g.hashes)
                    nats = np.where(hit, nats_of[k], 0.0) if len(hashes) else np.zeros(len(g.hashes))
                    part = (g.back - 1) // stretch
                    new = np.flatnonzero(np.concatenate([[True], (g.word[1:] != g.word[:-1]) | (part[1:] != part[:-1])]))
                    sums, chars = np.add.reduceat(nats, new), np.diff(np.append(new, len(nats)))
                    whole = np.add.reduceat(hit.astype(np.int64), new) == chars
                    of = g.word[new]  # each stretch's word
                    first = np.searchsorted(of, np.arange(len(words) + 1))
                    spoken = np.fromiter(map(_spoken, words), bool, len(words))
                    fine = np.bincount(of, np.where(whole, sums, 0.0), len(words)), np.bincount(of, np.where(whole, chars, 0), len(words))
                    mean = sums / chars
                    tokens = np.fromiter(map(place.__getitem__, said), np.int64, len(said))
                    doc_of = np.repeat(np.arange(j - i), np.diff([0, *ends]))
                    heads[0] = np.bincount(doc_of, fine[0][tokens], j - i)
                    heads[1] = np.bincount(doc_of, fine[1][tokens], j - i)
                    # strangeness of each stretch that counts, by document
                    per = np.diff(first)
                    at = np.repeat(first[tokens], per[tokens]) + _ranges(per[tokens])
                    on = np.repeat(doc_of, per[tokens])
                    say = spoken[of[at]]
                    heads[2] = np.bincount(on[say], minlength=j - i)
                    good = say & whole[at]
                    levels = (on[good], np.ceil(100 * mean[at[good]]).astype(np.int64))
                    odd = ~whole[at]
                    pair, times = np.unique(np.stack([on[odd], at[odd]]), axis=1, return_counts=True)
                    for d, u, n in zip(*pair.tolist(), times.tolist(), strict=True):
                        a, b = int(new[u]), int(new[u] + chars[u])
                        missing = Counter(g.gram(x) for x in range(a, b) if not hit[x])
                        rest.append((ids[i + d].as_py(), u, n, float(sums[u]), int(chars[u]), bool(spoken[of[u]]), list(missing), list(missing.values())))
                else:
                    levels = (np.zeros(0, np.int64),) * 2
                keys, m = np.unique(levels[0] << 32 | levels[1], return_counts=True)
                cut = np.searchsorted(keys >> 32, np.arange(j - i + 1))
                low, m = (keys & 0xFFFFFFFF).astype("<i4"), m.astype("<i4")
                size = j - i
                none = [None] * size
                head = [ids.slice(i, size), docs.slice(i, size), langs.slice(i, size), pa.array([True] * size), pa.array(heads[0]), pa.array(heads[1].astype(np.int64)), pa.array(heads[2].astype(np.int64)),
                        pa.array([low[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)], pa.list_(pa.int32())), pa.array([m[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)], pa.list_(pa.int32())),
                        pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.bool_()), pa.array(none, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(head, names)
                for a in range(0, len(rest), 20_000):
                    row, unit, times, nats, chars, spoken, missing, many = zip(*rest[a : a + 20_000], strict=True)
                    n = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row, pa.int64()), pa.nulls(n, types[1]), pa.nulls(n, types[2]), pa.array([False] * n), pa.array(nats, pa.float64()), pa.array(chars, pa.int64()), pa.nulls(n, pa.int64()),
                         pa.nulls(n, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int32())), pa.array(unit, pa.int64()), pa.array(times, pa.int64()), pa.array(spoken, pa.bool_()), pa.array(missing, pa.list_(pa.string()))],
                        names,
                    )

    return run


def _spoken(word: str) -> bool:
    """Holds a letter and no digit."""
    return word.isalpha() or (any(map(str.isalpha, word)) and not any(map(str.isdigit, word)))


def _found(hashes: np.ndarray, starts: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked in the sorted hashes, and whether they are there; starts has the first place
    of each value of the first 20 bits, behind which few hashes lie."""
    first = starts[(asked >> U64(44)).astype(np.int64)]
    at, hit = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    for j in range(int(np.diff(np.append(starts, len(hashes))).max()) if len(hashes) else 0):
        k = np.minimum(first + j, len(hashes) - 1)
        same = hashes[k] == asked
        at = np.where(same, k, at)
        hit |= same
    return at, hit


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of sizes."""
    end = np.cumsum(sizes)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - sizes, sizes)


def _most_frequent(known: DataFrame, most: int) -> DataFrame:
    """The n-grams above a count, most of them or fewer: a histogram of counts in steps of a
    sixteenth of an octave, some hundred rows, says which count. No sort."""
    step = F.floor(16 * F.log2("c"))
    rows, total, least = known.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect(), 0, None
    for r in rows:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return known.filter(step >= least) if least is not None else known.limit(0)


def score(docs: DataFrame, known: DataFrame, order: int = ORDER, frequent: int = FREQUENT, stretch: int = STRETCH) -> DataFrame:
    """docs' doc_id and lang with nats (sum of surprisals), chars, units (stretches of words
    with a letter and no digit), and strange: their mean surprisals in hundredths, rounded up,
    as an array of (level, times)."""
    top = _most_frequent(known, frequent).select("gram", "nats").toPandas()  # frequent rows at most
    hashes = gram_hash(top["gram"].tolist(), order)
    by = np.argsort(hashes)
    table = docs.sparkSession.sparkContext.broadcast((hashes[by], top["nats"].to_numpy(float)[by]))
    kinds = [docs.schema[c].dataType for c in ("doc_id", "lang")]
    fields = [("row", "long"), ("doc_id", kinds[0].simpleString()), ("lang", kinds[1].simpleString()), ("head", "boolean"), ("nats", "double"), ("chars", "long"), ("units", "long"),
              ("level", "array<int>"), ("many", "array<int>"), ("unit", "long"), ("times", "long"), ("spoken", "boolean"), ("grams", "array<string>")]
    types = [pa.int64(), *map(to_arrow_type, kinds)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text")
    rows = materialize(rows.mapInArrow(tidy(_scored(table, order, stretch, [n for n, _ in fields], types)), ", ".join(f"`{n}` {k}" for n, k in fields)))
    rest = rows.filter("not head").select("row", "unit", "times", "nats", "chars", "spoken", F.explode(F.arrays_zip("grams", "many")).alias("g"))
    rest = rest.select("row", "unit", "times", "nats", "chars", "spoken", F.col("g.grams").alias("gram"), F.col("g.many").alias("many"))
    rest = rest.join(known.select("gram", F.col("nats").alias("x")), "gram").groupBy("row", "unit", "times", "nats", "chars", "spoken").agg(F.sum(F.col("x") * F.col("many")).alias("x"))
    rest = rest.withColumn("x", F.col("nats") + F.col("x"))
    level = F.ceil(100 * F.col("x") / F.col("chars")).cast("int")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("x") * F.col("times")).alias("more_nats"), F.sum(F.col("chars") * F.col("times")).alias("more_chars"),
        F.collect_list(F.when(F.col("spoken"), F.struct(level.alias("level"), F.col("times").cast("int").alias("many")))).alias("more"),
    )
    zero = F.expr("cast(array() as array<struct<level:int,many:int>>)")
    return rows.filter("head").join(rest, "row", "left").select(
        "doc_id", "lang", (F.col("nats") + F.coalesce("more_nats", F.lit(0.0))).alias("nats"), (F.col("chars") + F.coalesce("more_chars", F.lit(0))).alias("chars"), "units",
        F.concat(F.arrays_zip("level", "many"), F.coalesce("more", zero)).alias("strange"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")).filter("good = 1").select("doc_id")


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR, min_trusted: int = MIN_TRUSTED, calibration: int = CALIBRATION,
    unit_quantile: float = UNIT_QUANTILE, worst_prior: float = WORST_PRIOR, worst_margin: float = WORST_MARGIN, frequent: int = FREQUENT,
) -> DataFrame:
    """A row per row of docs: doc_id, lang, perplexity, score, limit, worst, worst_limit, keep."""
    small_batches(docs.sparkSession)
    good = trusted_ids(labels)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(calibration)) == 0
    # labels grow with the documents, so the ids are never broadcast: the same hash join at every size
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = docs.select("doc_id", "text").mapInArrow(tidy(_bags), f"doc_id {kind}, words string, counts binary")
    taught = bags.join(good.filter(~apart).hint("shuffle_hash"), "doc_id", "left_semi")
    learnt = materialize(gram_counts(taught, order, bags=True))
    known = surprisals(learnt, materialize(gram_counts(docs.select("text"), order)), order)
    scored = materialize(score(docs.select("doc_id", "lang", "text"), known, order, frequent))
    judges = scored.join(good.filter(apart), "doc_id", "left_semi").filter("chars > 0")
    levels = judges.select(F.explode("strange").alias("s")).filter("s is not null").groupBy("s.level").agg(F.sum("s.many").alias("n"))
    total, strange = 0, 1 << 30
    counted = levels.orderBy("level").collect()  # a few thousand levels: hundredths of nats
    for r in counted:
        total += r["n"]
        if total >= unit_quantile * sum(x["n"] for x in counted):
            strange = r["level"]
            break
    odd = F.aggregate("strange", F.lit(0).cast("long"), lambda n, s: n + F.when(s["level"] > strange, s["many"]).otherwise(0))
    worst = odd / (F.col("units") + F.lit(worst_prior))
    means = judges.groupBy("lang").agg((F.sum("nats") / F.sum("chars")).alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= min_trusted)
    means = means.select(F.col("lang").alias("own_lang"), "mean")
    all_mean = judges.agg(F.sum("nats") / F.sum("chars")).first()[0] or 0.0

    def measured(rows: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(float(all_mean)))
        out = rows.join(means, rows["lang"].eqNullSafe(means["own_lang"]), "left").drop("own_lang")
        return out.withColumn("score", (F.col("nats") + prior * mean) / (F.col("chars") + prior)).withColumn("worst", worst)

    tops = [F.percentile_approx("score", quantile, 10_000) * margin, F.percentile_approx("worst", quantile, 10_000) * worst_margin]
    own = measured(judges)
    overall = own.agg(*tops).first()
    limits = own.filter("mean is not null").groupBy("lang").agg(tops[0].alias("own_limit"), tops[1].alias("own_worst")).withColumnRenamed("lang", "own_lang")
    scores = measured(scored)
    out = scores.join(limits, scores["lang"].eqNullSafe(limits["own_lang"]), "left")
    out = out.withColumn("limit", F.coalesce("own_limit", F.lit(overall[0]).cast("double"))).withColumn("worst_limit", F.coalesce("own_worst", F.lit(overall[1]).cast("double")))
    return out.select(
        "doc_id", "lang", F.exp(F.col("nats") / F.greatest(F.col("chars"), F.lit(1))).alias("perplexity"), "score", "limit", "worst", "worst_limit",
        F.coalesce((F.col("score") <= F.col("limit")) & (F.col("worst") <= F.col("worst_limit")), F.lit(True)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects. A document is
    known by doc_id; of rows that share one, all go if one is rejected."""
    rejected = classify(docs, labels, **options).filter("not keep").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def op10_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity, score and verdict of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
