"""Token ids of whole texts by a public tokenizer, with the words' ids kept per worker.

The vocabulary's pieces never cross white space, so a text's ids are its words' ids in a row. All words
of a chunk are hashed at once (64 bits); distinct hashes are looked up in a bounded cache, and only
words that it lacks go through the tokenizer, many in one call.
"""

from __future__ import annotations

import os

import numpy as np

from sozgar.llm.common import worker_cache
from sozgar.llm.words import BLANK, CHUNK, LOWER, hash_runs, lay

#: Words kept per worker; beyond it the cache is emptied.
CACHE_WORDS = 1_000_000
#: Words that are encoded in one call.
TOGETHER = 2_000
#: Texts that may hold a special token are encoded whole.
SPECIAL = b"<|"
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = True
CLOSING = np.zeros(256, bool)
CLOSING[[0x2C, 0x2E]] = True


def word_runs(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of non-blanks; a full stop or comma between an ASCII letter and a blank is a run of its own, as it is a piece of its own."""
    inside = ~BLANK[buffer]
    closing = np.zeros(len(buffer), bool)
    closing[1:-1] = CLOSING[buffer[1:-1]] & LETTER[buffer[:-2]] & ~inside[2:]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | closing))
    ends = np.flatnonzero(before & (~inside | closing))
    return starts, ends


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[int, int] = {}
        self.size = np.zeros(1 << 12, np.int64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, "<u4")
        self.used = 0

    def _add(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.slot), len(self.slot) + len(hashes)
        while m > len(self.size):
            self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.size[n:m] = sizes
        self.begin[n:m] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(hashes, range(n, m), strict=True))

    def _learn(self, unseen: dict[int, bytes]) -> None:
        """A word of letters is one piece, so the ids of several such words part after each word end."""
        letters, others = [], []
        for h, w in unseen.items():
            s = w.decode()
            (letters if s.isalpha() else others).append((h, s))
        for k in range(0, len(letters), TOGETHER):
            some = letters[k : k + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join([s for _, s in some]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self._add([h for h, _ in some], np.diff(cuts, prepend=0), ids)
            else:
                others += some
        found = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in others], add_special_tokens=False)]
        self._add([h for h, _ in others], np.array([len(i) for i in found], np.int64), np.array([i for ids in found for i in ids], "<u4"))

    def _chunk(self, texts: list[bytes]) -> list[bytes]:
        buffer, at = lay(texts)
        buffer = LOWER[buffer]
        starts, ends = word_runs(buffer)
        distinct, first, which = np.unique(hash_runs(buffer, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        slots = list(map(self.slot.get, keys))
        if None in slots:
            missing = [i for i, s in enumerate(slots) if s is None]
            if len(self.slot) + len(missing) > CACHE_WORDS:
                self._empty()
                missing = list(range(len(keys)))
            raw = buffer.tobytes()
            a, b = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            self._learn({keys[i]: raw[x:y] for i, x, y in zip(missing, a, b, strict=True)})
            slots = list(map(self.slot.get, keys))
        slot = np.array(slots, np.int64)[which] if keys else np.zeros(0, np.int64)
        size = self.size[slot]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        flat = self.pool[np.repeat(self.begin[slot] - upto[:-1], size) + np.arange(upto[-1])]
        raw, cut = flat.tobytes(), (4 * upto[np.searchsorted(starts, at)]).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if SPECIAL in t:
                out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            some.append(i)
            held += len(t)
            if held >= CHUNK:
                for k, ids in zip(some, self._chunk([texts[k] for k in some]), strict=True):
                    out[k] = ids
                some, held = [], 0
        for k, ids in zip(some, self._chunk([texts[k] for k in some]) if some else [], strict=True):
            out[k] = ids
        return out


def encoder(path: str) -> WordEncoder:
    return worker_cache("encoder:" + path, lambda: WordEncoder(path))
