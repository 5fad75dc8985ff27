"""Byte-pair merges of many distinct words at once, in numpy, from a tokenizer file.

The tokenizers library spends about 20 microseconds on a word; corpora of hundreds of millions of words
repeat most of them. Operators here keep a bounded memo of whole words and send only unseen ones to
``MergeTable.encode``, which applies one merge to every word of a batch in each round.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: ASCII white space; the tokenizers split there, so what stands between is independent.
SPACE = b" \t\n\x0b\x0c\r"
#: Characters whose case, normal form and class are plain table look-ups: printable Latin without
#: combining marks. A word with any other goes to the library as a whole.
_PLAIN = [c for c in map(chr, range(0x21, 0x180)) if c.isprintable() and c not in "İŉ ­"]
ODD = re.compile("[^" + re.escape("".join(_PLAIN)) + "]")
ODD_LINES = re.compile("[^\n" + re.escape("".join(_PLAIN)) + "]")
LETTERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L"))
NUMBERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N"))
#: Bytes of a word from which on the library encodes it, as rounds grow with the length.
LONG = 400
NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in kept else next(free)) for b in range(256)]


class MergeTable:
    """Vocabulary and ranked merges of a BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_characters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + suffix] for c in names], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.int64)
        # A piece loses the word-end mark only at its right edge, so the merged name is a + b.
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        bits = 21
        self.shift, self.factor = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        slot = self._slot(keys)
        self.key_at = np.full(1 << bits, -1, np.int64)
        self.rank_at = np.full(1 << bits, NONE, np.int32)
        order = np.arange(len(keys))[::-1]  # of equal slots the first key stays
        self.key_at[slot[order]], self.rank_at[slot[order]] = keys[order], order
        rest = np.flatnonzero(self.key_at[slot] != keys)
        by_key = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_ranks = keys[by_key], by_key.astype(np.int32)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[rest]] = True
        self.tokens = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no merge joins it."""
        keys = (left.astype(np.int64) << 16) | right
        slot = self._slot(keys)
        out = np.where(self.key_at[slot] == keys, self.rank_at[slot], NONE).astype(np.int32)
        again = np.flatnonzero(self.crowded[slot] & (out == NONE))
        if len(again) and len(self.more_keys):
            at = np.minimum(np.searchsorted(self.more_keys, keys[again]), len(self.more_keys) - 1)
            out[again] = np.where(self.more_keys[at] == keys[again], self.more_ranks[at], NONE)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Words are not empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        sym = self.first[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, begins)
            count = np.diff(np.r_[begins, len(sym)])
            if (stay := best < NONE).mean() < 0.7:
                kept = np.repeat(stay, count)
                done.append((owner[~kept], sym[~kept]))
                owner, sym, rank = owner[kept], sym[kept], rank[kept]
                continue
            at = np.flatnonzero((rank == np.repeat(best, count)) & (rank < NONE))
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]  # the leftmost in its word
            sym[at] = self.made[rank[at]]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            owner, sym, rank = owner[kept], sym[kept], rank[kept]
            at -= np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                rank[p] = NONE
                q = p[p + 1 < len(sym)]
                q = q[owner[q] == owner[q + 1]]
                rank[q] = self.ranks(sym[q], sym[q + 1])
        owner, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, sym)
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))
