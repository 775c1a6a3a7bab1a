"""Token counts of whole texts, huge documents by overlap resynchronisation.

A huge text is cut into chunks that overlap, the chunks are dealt out and encoded with
offsets, and neighbours are spliced where both have a token boundary at the same proven
stable place inside their overlap. A place is proven stable if the text has a space there
and no white space behind it: the pre-tokenizer starts a piece at that space whatever comes
before, so what an arbitrary chunk start has upset ends there, and the chunk's end lies
beyond. A document whose neighbours share no such place is encoded again with an overlap
twice as wide, in the end as one chunk. Shorter texts are one chunk: they are cut at all of
their stable places, and pieces that came up before are taken from a bounded memo.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and keys, null ones
too, give a row each; an empty table gives no rows; other columns are ignored. Special strings inside a
text are what the library's default makes of them.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import batches, materialize, small_batches, tidy
from trellis.llm.pieces import load, worker_encoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
TASK_CHARS = 4_000_000
_STABLE = re.compile(r" (?=\S)")


def stable_places(text: str) -> list[int]:
    return [m.start() for m in _STABLE.finditer(text)]


def _small(path: str):
    def run(frames):
        enc = worker_encoder(path)
        for frame in frames:
            texts = frame["text"].to_pylist()
            for i, j in batches(texts):
                cut = [_STABLE.split(t or "") for t in texts[i:j]]
                # the first piece has no space before it
                memo = enc.learn(set().union(*(c[1:] for c in cut)), lambda k: " " + k, len)
                heads = enc.encode([c[0] for c in cut])
                counts = [len(h) + sum(map(memo.__getitem__, c[1:])) for h, c in zip(heads, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([frame["rid"].slice(i, j - i), frame["n_bytes"].slice(i, j - i), pa.array(counts, pa.int64())], ["rid", "n_bytes", "n_tokens"])
        enc.release()

    return run


def _chunks(path: str, chunk: int, overlap: int):
    """Of each chunk its stable token boundaries in both overlaps, as places in the document,
    with the tokens before each."""

    def run(frames):
        tok = load(path)
        for frame in frames:
            rows = []
            for no, k, start, piece, last in frame.itertuples(index=False):
                enc = tok.encode(piece, add_special_tokens=False)
                begins = [b for b, _ in enc.offsets]
                # the first token that begins at a place; some tokens are part of a character
                at = {b: i for i, b in reversed(list(enumerate(begins)))}
                good = [(p, at[p]) for p in stable_places(piece) if p in at]
                left = [(start + p, n) for p, n in good if p < overlap] if k else []
                right = [(start + p, n) for p, n in good if p >= chunk] if not last else []
                rows.append((no, k, last, len(begins), [p for p, _ in left], [n for _, n in left], [p for p, _ in right], [n for _, n in right]))
            yield pd.DataFrame(rows, columns=["no", "k", "last", "n", "lp", "ln", "rp", "rn"])

    return run


def _splice(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("k")
    rows = list(frame.itertuples(index=False))
    total, since = 0, 0
    for a, b in zip(rows, rows[1:], strict=False):
        common = sorted(set(a.rp) & set(b.lp))
        if not common:
            return pd.DataFrame({"no": frame["no"].iloc[:1], "n_tokens": [-1]})
        place = common[len(common) // 2]
        total += a.rn[list(a.rp).index(place)] - since
        since = b.ln[list(b.lp).index(place)]
    return pd.DataFrame({"no": frame["no"].iloc[:1], "n_tokens": [total + rows[-1].n - since]})


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """A row per row of docs: key, n_bytes and n_tokens (long). Texts of more than chunk code
    points go by overlapping chunks, dealt over the tasks by (key, chunk)."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small = rows.filter(F.length("text") <= chunk).select("rid", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = small.mapInArrow(tidy(_small(tokenizer_path)), f"rid {kind}, n_bytes long, n_tokens long")
    # copies of a huge text with the same key are counted once and given back as often
    huge = rows.filter(F.length("text") > chunk).groupBy("rid", "text").agg(F.count("*").alias("copies"))
    huge = materialize(huge.withColumn("no", F.monotonically_increasing_id()))
    done = None
    while not huge.isEmpty():
        spots = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / chunk).cast("int") - 1))
        cut = F.transform(spots, lambda k: F.struct(k.alias("k"), (k * chunk).alias("start"), F.substring(F.col("text"), k * chunk + 1, F.lit(chunk + overlap)).alias("piece")))
        pieces = huge.select("no", F.size(spots).alias("all"), F.explode(cut).alias("c"))
        pieces = pieces.select("no", "c.*", (F.col("c.k") == F.col("all") - 1).alias("last"))
        # as many tasks as the texts need, not a default number
        tasks = int(huge.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // TASK_CHARS) + 8
        encoded = pieces.repartition(tasks, "no", "k").mapInPandas(
            _chunks(tokenizer_path, chunk, overlap), "no long, k int, last boolean, n long, lp array<long>, ln array<long>, rp array<long>, rn array<long>",
        )
        spliced = materialize(encoded.groupBy("no").applyInPandas(_splice, "no long, n_tokens long"))
        found = huge.join(spliced.filter("n_tokens >= 0"), "no")
        found = found.select("rid", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
        done = found if done is None else done.unionByName(found)
        failed = spliced.filter("n_tokens < 0").select("no")
        if failed.isEmpty():
            break
        huge, chunk, overlap = materialize(huge.join(failed, "no", "left_semi")), 2 * chunk, 2 * overlap
    whole = counted if done is None else counted.unionByName(done)
    return whole.select(F.col("rid").alias(key), "n_bytes", "n_tokens")


LIMIT = 1024


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    import public_tokenizers

    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
