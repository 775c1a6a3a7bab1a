"""Words of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from trellis.llm.common import U64, mix64

#: Bytes hashed at once; temporaries take about forty times as much.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODE = mix64(np.arange(1, 257, dtype=U64)) | U64(1)

#: Folding tables: the byte a word has for it, GAP where it parts words; no UTF-8 text has that byte.
GAP = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACED = _LOWER.copy()
SPACED[[9, 10, 11, 12, 13, 32]] = GAP
ALNUM = np.full(256, GAP, dtype=np.uint8)
ALNUM[128:] = _LOWER[128:]
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = _LOWER[_a:_b]

_powers: dict[int, np.ndarray] = {}


def _power(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded bytes, and where they begin."""
    inside = np.zeros(len(b) + 2, dtype=bool)
    inside[1:-1] = b != GAP
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=U64)
    np.cumsum(_CODE[b] * _power(len(b), _BASE)[: len(b)], out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    h = (sums[ends] - sums[starts]) * _power(len(b), inverse)[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts, fold: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (None: no words) in order, and the first word of
    each text, n + 1 of them. fold says what bytes words are made of."""
    raw = [b"" if t is None else t.encode("utf-8") for t in texts]
    size = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=size[1:])
    b = fold[np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)]
    out, begins, at = [], [], 0
    while at < len(b):
        end = min(len(b), at + BLOCK)
        if end < len(b):
            gaps = np.flatnonzero(b[at:end] == GAP)
            while not len(gaps) and end < len(b):
                at_end, end = end, min(len(b), end + BLOCK)
                gaps = np.flatnonzero(b[at_end:end] == GAP) + (at_end - at)
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        h, starts = _hashed(b[at:end])
        out.append(h)
        begins.append(starts + at)
        at = end
    h = np.concatenate(out) if out else np.zeros(0, dtype=U64)
    starts = np.concatenate(begins) if begins else np.zeros(0, dtype=np.int64)
    return h, np.searchsorted(starts, size)


def windows_hash(h: np.ndarray, offsets) -> np.ndarray:
    """For each place i the hash of the words at i + o, o in offsets (ascending from 0)."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k, o in enumerate(offsets):
        out += h[o : o + n] * U64((0xA0761D6478BD642F * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        out ^= out >> U64(29)
    return mix64(out)
