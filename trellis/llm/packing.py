"""Hierarchical multi-length packing of token sequences.

Context sizes are powers of two (tiers). A document gives as many pieces of the longest size
as it fills; the rest is routed to the shortest tier that holds it. Windows are packed from
the longest tier down: a window opens with the tier's longest rest, its gap is filled with
the largest rests of the shorter tiers that fit, and what then is open is filled by cutting a
rest, whose end goes back to the tiers by its new length. When a task's documents end, the
rests that fill no window of their tier are packed into windows of ever shorter power-of-two
sizes, so no window is padded. Full windows are put into step groups, longest first, each
group of the same number of tokens but the last of a task.

Every task packs the documents of its own partition and keeps at most pool_tokens of rests
besides one batch; nothing is shuffled. Windows are numbered from the partition's number, so
a task that runs again gives the same numbers.

Defined cases: null text counts as empty and gives a piece with the closing id alone;
repeated rows are packed one by one; keys, null ones too, are given back as they are; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellis.llm.common import batches, small_batches, tidy
from trellis.llm.pieces import WordEncoder, worker_encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
POOL_TOKENS = 4_000_000
CLOSING_ID = 1


class Packer:
    """Packs pieces (length, token start in its document, document's place in docs)."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.top = sorted(tiers), max(tiers)
        self.step_tokens = step_tokens
        self.rests: list[tuple] = []  # sorted by length; the tier of a rest is the shortest that holds it
        self.size = 0
        self.windows: list[tuple[int, list]] = []

    def add(self, doc, length: int) -> None:
        """A document: full windows at once, the rest into the pool."""
        at = 0
        while length - at >= self.top:
            self.windows.append((self.top, [(self.top, at, doc)]))
            at += self.top
        if length > at:
            self._put((length - at, at, doc))

    def _put(self, rest) -> None:
        insort(self.rests, rest, key=lambda r: r[0])
        self.size += rest[0]

    def _take(self, i: int):
        rest = self.rests.pop(i)
        self.size -= rest[0]
        return rest

    def _window(self, size: int) -> None:
        """One full window of this size out of the pool, which holds enough."""
        window, gap = [], size
        while gap:
            i = bisect_right(self.rests, gap, key=lambda r: r[0]) - 1
            if i >= 0:
                window.append(self._take(i))
            else:  # all are longer: cut the shortest
                n, at, doc = self._take(0)
                window.append((gap, at, doc))
                self._put((n - gap, at + gap, doc))
            gap -= window[-1][0]
        self.windows.append((size, window))

    def pack(self, last: bool) -> None:
        """Fill windows tier by tier: as many of a tier as it has rests and the pool fills."""
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while self.size >= tier and self.rests[-1][0] > below:
                self._window(tier)
        if last:
            size = self.top
            while self.size:
                while size > self.size:
                    size //= 2
                self._window(size)

    def steps(self, last: bool):
        """(step group, size, window) of full groups, or of all."""
        self.windows.sort(key=lambda w: -w[0])
        filled, group, out = 0, 0, []
        whole = sum(w[0] for w in self.windows) // self.step_tokens
        for k, (size, window) in enumerate(self.windows):
            if group >= whole and not last:
                self.windows = self.windows[k:]
                break
            out.append((group, size, window))
            filled += size
            if filled >= self.step_tokens:
                filled, group = 0, group + 1
        else:
            self.windows = []
        return out


def _packed(path: str, closing: int, tiers, step_tokens: int, pool_tokens: int, names: list[str], types: list):
    def run(frames):
        enc = worker_encoder(path, WordEncoder)
        packer, ids_of, count = Packer(tiers, step_tokens), {}, 0
        base = TaskContext.get().partitionId() << 40
        sequence, step = base, base
        end = np.array([closing], dtype="<u4").tobytes()

        def given(last: bool):
            nonlocal sequence, step
            packer.pack(last)
            rows, most = [], -1
            for group, size, window in packer.steps(last):
                at = 0
                for n, start, doc in window:
                    rid, ids = ids_of[doc]
                    rows.append((rid, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, at, size, step + group))
                    at += n
                sequence += 1
                most = max(most, group)
            step += most + 1
            kept = {d for _, w in packer.windows for *_, d in w} | {d for *_, d in packer.rests}
            for d in ids_of.keys() - kept:
                del ids_of[d]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for frame in frames:
            rids, texts = frame["rid"].to_pylist(), frame["text"].to_pylist()
            for i, j in batches(texts, 2_000_000):
                for rid, t in zip(rids[i:j], texts[i:j], strict=True):
                    raw = (t or "").encode("utf-8")
                    # the tokenizer lowers letters, but takes special strings as they are
                    ids_of[count] = (rid, enc.ids((raw if b"<|" in raw else raw.lower()).split()) + end)
                    packer.add(count, len(ids_of[count][1]) // 4)
                    count += 1
                if packer.size > pool_tokens or len(packer.windows) > 256:
                    yield given(False)
        yield given(True)
        enc.release()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS, closing: int = CLOSING_ID) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens
    (with the closing id), sequence_id, offset, sequence_tokens (its window's size) and
    step_group. The tokenizer must drop white space, lower its input and split at it, so a
    text's ids are those of its words."""
    kind = docs.schema[key].dataType
    fields = [("rid", kind.simpleString(), to_arrow_type(kind)), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids", "binary", pa.binary())]
    fields += [(n, "long", pa.int64()) for n in ("doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")]
    rows = docs.select(F.col(key).alias("rid"), F.col(text).alias("text"))
    run = _packed(tokenizer_path, closing, tuple(tiers), step_tokens, pool_tokens, [n for n, _, _ in fields], [t for _, _, t in fields])
    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidy(run), ", ".join(f"{n} {k}" for n, k, _ in fields)).withColumnRenamed("rid", key)


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"
    )


def op6_tiered_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens by word_bpe_49k.json."""
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
