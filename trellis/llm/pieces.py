"""Encoding by pieces: a bounded memo of pieces whose ids do not depend on their neighbours."""

from __future__ import annotations

import os
import unicodedata
from itertools import islice

import numpy as np

#: Entries of a worker's memo, and bytes of its keys; beyond either only those in use stay.
MEMO_ENTRIES = 400_000
MEMO_BYTES = 32_000_000
#: Entries that outlive a task, those that its last batches had in common.
KEPT_ENTRIES = 20_000


def load(path: str):
    """The tokenizers library's encoder of a .json file, with one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """ids(pieces) of pieces that the tokenizer encodes alike alone and in their text.

    Unknown pieces are encoded in one call, parted by a special token, which the library
    takes out before anything else; pieces that might hold such a token go one by one."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES, most_bytes: int = MEMO_BYTES):
        self.tokenizer = load(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0]
        self.first = [c[0] for _, c in special]
        self.entries, self.most_bytes, self.bytes = entries, most_bytes, 0
        self.memo: dict = {}
        self.common: set = set()  # keys of the last batch that were known before

    def _risky(self, piece: str) -> bool:
        return any(c in piece for c in self.first)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if not self._risky(p)]
        if plain:
            joined = self.mark.join([pieces[i] for i in plain])
            # the same ids as encode, without the offsets, which nobody needs here
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(plain) - 1:
                raise RuntimeError("the tokenizer did not keep the marks between pieces")
            begin = 0
            for i, end in zip(plain, [*cuts.tolist(), len(ids)], strict=True):
                out[i] = ids[begin:end]
                begin = end + 1
        for i, p in enumerate(pieces):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4")
        return out

    def _keep(self, keys) -> None:
        kept = {k: self.memo[k] for k in keys}
        self.memo.clear()
        self.memo.update(kept)
        self.bytes = sum(map(len, kept))

    def learn(self, keys: set, text, value) -> dict:
        """Bring keys into the memo: text(key) is encoded, value(ids) is kept."""
        new = list(keys - self.memo.keys())
        self.common = keys.difference(new)
        if len(self.memo) + len(new) > self.entries or self.bytes > self.most_bytes:
            self._keep(self.common)  # common pieces are among these too and stay; the rare ones go
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            self.memo.update(zip(some, map(value, self.encode(list(map(text, some)))), strict=True))
        self.bytes += sum(map(len, new))
        return self.memo

    def release(self, kept: int = KEPT_ENTRIES) -> None:
        """At the end of a task: all but the common pieces go."""
        self._keep(list(self.common & self.memo.keys())[:kept])
        self.common = set()


#: ASCII punctuation of which a run is a piece of its own after a letter; the apostrophe is not.
_TAIL = ".,;:!?|*&%$#\"()"
_TAIL_BYTES = _TAIL.encode()


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte: printable ones stand for
    themselves, the others are numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _lowered(word: str) -> str | None:
    """A word of letters in lower case, if it is letters in a normal form before and after; the capital
    sigma, whose lower case depends on its place, is left to the tokenizer."""
    low = word.lower()
    if word.isascii():
        return low
    if low == word:
        return word if unicodedata.is_normalized("NFC", word) else None
    good = low.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)
    return low if good else None


def _letters_stay(core: bytes) -> bool:
    """Whether a core is letters that end in a letter after lowering and normalising, too: marks
    behind a letter that is taken apart would belong to the same piece."""
    if core.isalpha():  # of bytes: ASCII letters
        return True
    text = core.decode("utf-8")
    return text.isalpha() and _lowered(text) is not None


class WordEncoder(Encoder):
    """An encoder of words for a tokenizer that lowers its input, takes runs of letters and
    runs of other marks as pieces, and spells pieces in bytes. Such pieces go to the library's
    model without the steps before it; all other words, and all words of a tokenizer that
    differs on a few probes, are encoded as Encoder does it. Its memo has two generations of
    half the entries each."""

    def __init__(self, path: str, **options):
        super().__init__(path, **options)
        self.letters = _byte_letters()
        self.tokenize, self.older = self.tokenizer.model.tokenize, {}
        self.direct = True
        probes = ["a", "word", "word.", "näher", "été,", "über||", "слово", "日本", "the)", "don", "ll", "s", "re.", "!!", "$$$", "ß", "ñandú", "Word", "WORD.", "Été!", "ÜBER"]
        exact = super().encode(probes)
        got = [self._direct(p) for p in probes]
        self.direct = all(g is not None and np.array_equal(g, e) for g, e in zip(got, exact, strict=True))

    def _direct(self, word: str) -> np.ndarray | None:
        tail = ""
        if not word.isalpha():
            core = word.rstrip(_TAIL)
            word, tail = core, word[len(core) :]
            if core and not core.isalpha():
                return None
        word = _lowered(word)
        if word is None:
            return None
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(word)] if word else []
        if tail:
            ids += [t.id for t in self.tokenize(tail)]
        return np.array(ids, dtype="<u4")

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        if not self.direct:
            return super().encode(pieces)
        out = list(map(self._direct, pieces))
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, super().encode([pieces[i] for i in left]), strict=True):
            out[i] = ids
        return out

    def ids(self, words: list[bytes]) -> bytes:
        """The little-endian unsigned 32-bit ids of UTF-8 words."""
        found = list(map(self.memo.get, words))
        if None in found:
            for k, v in enumerate(found):
                if v is None:
                    found[k] = self._learnt(words[k])
        return b"".join(found)

    def _learnt(self, word: bytes) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.older.get(word)
        else:
            return ids
        if ids is None:
            core = word.rstrip(_TAIL_BYTES)
            if core and len(core) < len(word) and self.direct and _letters_stay(core):
                ids = self._learnt(core) + self._learnt(word[len(core) :])
            else:
                ids = self.encode([word.decode("utf-8")])[0].tobytes()
        if len(self.memo) >= self.entries // 2:
            self.older, self.memo = self.memo, {}
        self.memo[word] = ids
        return ids

    def release(self, kept: int = KEPT_ENTRIES) -> None:
        """At the end of a task: a bounded number of the first words since the last turn stays,
        as frequent words come first."""
        self.memo, self.older = dict(islice(self.memo.items(), kept)), {}


_ENCODERS: dict = {}


def worker_encoder(path: str, kind: type = Encoder) -> Encoder:
    """This worker's encoder of a kind. The tokenizer serves all tasks that the worker runs;
    a task ends with release(), after which the memo holds common pieces alone. Another
    tokenizer or kind replaces it, so a worker never holds two."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind] = kind(path)
    return _ENCODERS[path, kind]
