"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of each run without white space (longer ones in parts of at most `MAX_RUN` bytes)
in both directions, starting anew at each run, and labels every byte with a distribution over
the languages. A document's probabilities pool those of all its bytes: the normalised
geometric mean. As a run's labels do not depend on its neighbours, a worker reads each
distinct run once and keeps its sums in a bounded memo.

It is trained in numpy by backpropagation through time (Adam, cross-entropy at every byte) on
a bounded sample of the labelled documents: about docs_per_language documents of each language,
chosen by hash of doc_id, and of each a stretch of slice_chars characters at a hashed place; with more
than sample_docs / docs_per_language languages there are fewer of each. Only text and lang of the
sample are learned from.

Defined cases: null text and texts without letters give `und` with score 0, as do all texts if
there is nothing to learn from; repeated rows give a row each; an empty table gives no rows;
keys, null ones too,
are given back as they are; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import batches, small_batches, tidy

MAX_RUN = 32
HIDDEN = 24
MEMO_RUNS = 200_000
DOCS_PER_LANGUAGE = 400
SLICE_CHARS = 1500
#: Documents learned from in all: with very many languages there are fewer of each.
SAMPLE_DOCS = 40_000
STEPS, BATCH, RATE = 500, 256, 0.01


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Direction:
    """One gated recurrent layer; its input is a table row for each byte (256: padding)."""

    def __init__(self, rng, hidden: int):
        self.h = hidden
        self.p = {
            "x": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "c": (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
        }

    def forward(self, seq: np.ndarray, keep: bool = False):
        """seq: time by run. States after each step; with keep also what backward needs."""
        n, h = self.h, np.zeros((seq.shape[1], self.h), dtype=np.float32)
        states, cache = np.empty((*seq.shape, n), dtype=np.float32), []
        for t, b in enumerate(seq):
            x = self.p["x"][b]
            gates = _sigmoid(x[:, : 2 * n] + h @ self.p["u"])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ self.p["c"])
            new = h + z * (c - h)
            if keep:
                cache.append((b, h, z, r, c))
            states[t] = h = new
        return (states, cache) if keep else states

    def backward(self, cache, d_states: np.ndarray) -> dict:
        n = self.h
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(d_states[0])
        for t in range(len(cache) - 1, -1, -1):
            b, h, z, r, c = cache[t]
            dh = dh + d_states[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            rh = r * h
            drh = dc @ self.p["c"].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            g["c"] += rh.T @ dc
            g["u"] += h.T @ dg
            np.add.at(g["x"], b, np.concatenate([dg, dc], axis=1))
            dh = dh * (1 - z) + drh * r + dg @ self.p["u"].T
        return g


class ByteNetwork:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, len(languages)
        self.ways = (Direction(rng, hidden), Direction(rng, hidden))
        self.out = {"w": (rng.standard_normal((2 * hidden, k)) * 0.1).astype(np.float32), "b": np.zeros(k, np.float32)}

    @staticmethod
    def _log_softmax(x):
        x = x - x.max(axis=-1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))

    def labels(self, seq: np.ndarray) -> np.ndarray:
        """log p of each language at each byte; seq: time by run, no padding."""
        both = np.concatenate([self.ways[0].forward(seq), self.ways[1].forward(seq[::-1])[::-1]], axis=2)
        return self._log_softmax(both @ self.out["w"] + self.out["b"])

    def run_sums(self, runs: list[bytes]) -> np.ndarray:
        """Sums of log p over the bytes of each run, and the number of bytes last."""
        out = np.empty((len(runs), len(self.languages) + 1), dtype=np.float32)
        size = np.array([len(r) for r in runs])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for a in range(0, len(at), 4096):
                some = at[a : a + 4096]
                seq = np.frombuffer(b"".join([runs[i] for i in some]), dtype=np.uint8).reshape(len(some), n).T
                out[some, :-1] = self.labels(seq).sum(axis=0)
        out[:, -1] = size
        return out

    def fit(self, runs: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        """runs of each language; every step takes as many of each."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        params = [(w.p, n) for w in self.ways for n in w.p] + [(self.out, n) for n in self.out]
        mean, square = [np.zeros_like(p[n]) for p, n in params], [np.zeros_like(p[n]) for p, n in params]
        each = max(1, batch // k)
        for step in range(1, steps + 1):
            some = [r for of in runs for r in (of[i] for i in rng.integers(0, len(of), each))]
            label = np.repeat(np.arange(k), each)
            longest = max(map(len, some))
            seq = np.full((longest, len(some)), 256, dtype=np.int64)
            back = seq.copy()
            for j, r in enumerate(some):
                seq[: len(r), j] = np.frombuffer(r, np.uint8)
                back[: len(r), j] = np.frombuffer(r, np.uint8)[::-1]
            size = np.array([len(r) for r in some])
            live = np.arange(longest)[:, None] < size
            turn = np.where(live, size - 1 - np.arange(longest)[:, None], np.arange(longest)[:, None])
            (f, cf), (b, cb) = self.ways[0].forward(seq, True), self.ways[1].forward(back, True)
            column = np.arange(len(some))
            both = np.concatenate([f, b[turn, column]], axis=2)
            d = np.exp(self._log_softmax(both @ self.out["w"] + self.out["b"]))
            d[:, column, label] -= 1
            d *= live[:, :, None] / live.sum()
            d_both = d @ self.out["w"].T
            h = f.shape[2]
            grads = [*self.ways[0].backward(cf, d_both[:, :, :h]).values(), *self.ways[1].backward(cb, d_both[:, :, h:][turn, column]).values()]
            grads += [both.reshape(-1, 2 * h).T @ d.reshape(-1, k), d.sum(axis=(0, 1))]
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for i, ((p, n), g) in enumerate(zip(params, grads, strict=True)):
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.01 * (g * g - square[i])
                p[n] -= (pace * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def runs_of(text: str | None) -> list[bytes]:
    """Bytes between white space, in parts of at most MAX_RUN bytes."""
    runs = (text or "").encode("utf-8", "replace").split()
    if any(len(r) > MAX_RUN for r in runs):
        runs = [part for r in runs for part in ([r] if len(r) <= MAX_RUN else _cut(r))]
    return runs


def _cut(run: bytes) -> list[bytes]:
    """Parts of at most MAX_RUN bytes that end with a whole character."""
    parts, a = [], 0
    while a < len(run):
        b = min(len(run), a + MAX_RUN)
        while b < len(run) and run[b] & 0xC0 == 0x80:  # inside a character
            b -= 1
        parts.append(run[a:b])
        a = b
    return parts


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, slice_chars: int = SLICE_CHARS, sample_docs: int = SAMPLE_DOCS) -> ByteNetwork | None:
    """A network from labelled (doc_id, text, lang); None if nothing can be learned."""
    good = labelled.filter("lang is not null and text is not null")
    counts = good.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    docs_per_language = min(docs_per_language, max(1, sample_docs // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(docs_per_language / r["n"]))])
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - slice_chars + 1))
    sample = good.filter(draw < share[F.col("lang")])
    rows = sample.select("lang", F.substring(F.col("text"), start.cast("int") + 1, F.lit(slice_chars)).alias("text")).collect()
    runs: dict[str, list[bytes]] = {}
    for lang, text in sorted((r["lang"], r["text"]) for r in rows):
        runs.setdefault(lang, []).extend(r for r in runs_of(text) if has_letter(r.decode("utf-8", "ignore")))
    languages = sorted(k for k, v in runs.items() if v)
    if not languages:
        return None
    net = ByteNetwork(languages)
    if len(languages) > 1:
        net.fit([runs[k] for k in languages])
    return net


def predict(docs: DataFrame, net: ByteNetwork | None, memo_runs: int = MEMO_RUNS) -> DataFrame:
    """docs' doc_id with lang_pred and score. Only text is looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(net)

    def run(frames):
        net = shared.value
        memo: dict[bytes, int] = {}
        table = None if net is None else np.zeros((0, len(net.languages) + 1), dtype=np.float32)
        for frame in frames:
            texts = frame["text"].to_pylist()
            for i, j in batches(texts, 2_000_000):
                part = texts[i:j]
                known = list(map(has_letter, part))
                lang, score = ["und"] * len(part), np.zeros(len(part))
                if net is not None and any(known):
                    runs = [runs_of(t) for t in part]
                    every = set().union(*runs)
                    new = every - memo.keys()
                    if len(memo) + len(new) > memo_runs:
                        memo, table, new = {}, table[:0], every
                    new = list(new)
                    memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                    table = np.concatenate([table, net.run_sums(new)])
                    at = np.fromiter((memo[r] for rs in runs for r in rs), dtype=np.int64)
                    end = np.cumsum([len(rs) for rs in runs])
                    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[at], axis=0, dtype=np.float64)])
                    sums = total[end] - total[np.concatenate([[0], end[:-1]])]
                    mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for k, best in enumerate(p.argmax(axis=1)):
                        if known[k]:
                            lang[k], score[k] = net.languages[best], p[k, best]
                yield pa.RecordBatch.from_arrays([frame["doc_id"].slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def op2_byte_gru_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document; those with crc32(doc_id) mod 4 = 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    net = learn(docs.filter(~held_out))
    return predict(docs.drop("lang"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
