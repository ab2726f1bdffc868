"""Token ids by a public tokenizer, encoded a distinct piece at a time.

Both kinds of vocabulary file used here part a text before merging, so the ids of a text are the
ids of its pieces in a row: for byte-level vocabularies a piece begins at a space that a
non-space follows, for word-end vocabularies the pieces are the words between white space.
Pieces repeat, so the library sees each once per worker and the rest is a table look-up. Texts
that can't be parted safely go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

os.environ.setdefault("RAYON_NUM_THREADS", "1")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Distinct pieces that a worker keeps; beyond them it begins anew. Pieces that go to the library in one text.
KEPT, TOGETHER = 1_200_000, 128
_UNSAFE = re.compile(r" (?=\s|$)")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Stands between words of a word-end vocabulary, where it is a token of its own.
MARK = "|"


def raw(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


class Encoder:
    def __init__(self, path: str, word_ends: bool, kept: int = KEPT):
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.word_ends = word_ends
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.mark = self._ids([MARK])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Looks up distinct pieces, many to a text: their ids are told apart by the spaces that begin them, or by marks between them."""
        odd = []
        if self.word_ends:
            odd = [p for p in new if MARK in p or "<|" in p]
            new = [p for p in new if not (MARK in p or "<|" in p)] if odd else new
            runs = [new[k : k + TOGETHER] for k in range(0, len(new), TOGETHER)]
            texts = [f" {MARK} ".join(r) for r in runs]
        else:
            odd = [p for p in new if not p or "<|" in p]
            new = [p for p in new if p and "<|" not in p] if odd else new
            runs = [new[k : k + TOGETHER] for k in range(0, len(new), TOGETHER)]
            texts = [" " + " ".join(r) for r in runs]
        for run, ids in zip(runs, self._ids(texts)):
            ids = np.array(ids, "<u4")
            if self.word_ends:
                at = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0, np.int64)
                first, last = np.r_[0, at + 1], np.r_[at, len(ids)]
            else:
                first = np.flatnonzero(self.begins[ids])
                last = np.r_[first[1:], len(ids)]
            if len(first) == len(run) and (not len(first) or first[0] == 0):
                data = ids.tobytes()
                self.pieces.update(zip(run, [data[a:z] for a, z in zip((4 * first).tolist(), (4 * last).tolist())]))
            else:
                odd += run
        if odd:
            self.pieces.update(zip(odd, map(raw, self._ids(odd if self.word_ends else [" " + p for p in odd]))))

    def parts(self, text: str) -> list[str] | None:
        """Words of a word-end vocabulary; for a byte-level one what stands between spaces, or None where white space is irregular."""
        if self.word_ends:
            # the four separators are white space to Python alone
            return None if _SEPARATORS.search(text) else text.split()
        return None if _UNSAFE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        get = self.pieces.get
        split = [self.parts(t) for t in texts]
        whole = [i for i, p in enumerate(split) if p is None]
        heads = [] if self.word_ends else [i for i, p in enumerate(split) if p is not None]
        given = self._ids([texts[i] for i in whole] + [split[i][0] for i in heads])
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, given):
            out[i] = raw(ids)
        first = {i: raw(ids) for i, ids in zip(heads, given[len(whole) :])}
        missing: dict[str, None] = {}
        waiting = []
        for i, parts in enumerate(split):
            if parts is not None:
                if not self.word_ends:
                    del parts[0]
                found = list(map(get, parts))
                if not all(found):  # some are unknown, or have no ids
                    missing.update((p, None) for p, f in zip(parts, found) if f is None)
                    waiting.append(i)
                else:
                    out[i] = first.get(i, b"") + b"".join(found)
        if waiting:
            self._learn(list(missing))
            for i in waiting:
                out[i] = first.get(i, b"") + b"".join(map(get, split[i]))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, word_ends: bool, kept: int = KEPT) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, word_ends, kept)
