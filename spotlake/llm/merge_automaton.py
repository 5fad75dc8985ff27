"""Byte-pair merges as a deterministic finite-state transducer over bytes, with token counts on its transitions.

Among the ways to write a byte string as tokens, the one that the merges give is the only one whose neighbours fit: two tokens fit
if merging their bytes alone gives these two again. So the last token of a prefix is the token that ends there and fits the
last token of the prefix before it. What can still matter of what was read are the suffixes that begin some longer token:
for each its place in the trie of tokens, the last token before it, and how many tokens fewer that prefix has. These are bounded by the
longest token, so there are finitely many: they are the states. A transition by a byte goes on in the trie, finds the one token that
ends there and fits, and is labelled with the change of the count, which may fall when tokens join. States and
transitions are made when first met and numbered; beyond ``STATES`` of them the automaton starts anew, at the cost of time only.

Many strings are walked at once in numpy, a byte of each at a time, through an open-addressed table of the transitions.
"""

from __future__ import annotations

import json

import numpy as np

from .bpe_core import byte_characters

#: States that are kept, slots of the transitions' table, and strings below which they are walked one by one.
STATES, SLOTS, FEW = 250_000, 1 << 22, 24


class MergeAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in enumerate(byte_characters())}
        plain = lambda name: bytes(byte[c] for c in name)
        self.words = {i: plain(name) for name, i in model["vocab"].items() if all(c in byte for c in name)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(plain(a), plain(b)): k for k, (a, b) in enumerate(pairs)}
        self.below: list[dict[int, int]] = [{}]  # trie: byte -> node
        self.token: list[int] = [-1]
        for i, w in self.words.items():
            node = 0
            for c in w:
                if c not in self.below[node]:
                    self.below[node][c] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                node = self.below[node][c]
            self.token[node] = i
        self.factor, self.shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (SLOTS.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        """Only the state before any byte."""
        first = ((0, -1, 0),)
        self.states, self.number = [first], {first: 0}
        self.fits: dict[tuple[int, int], bool] = {}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> state << 8 | change of the count + 128
        self.key_at, self.move_at = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)

    def fit(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, merged alone, give the two."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        left = self.words[a]
        parts = [bytes([c]) for c in left + self.words[b]]
        while True:
            ranks = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out = self.fits[a, b] = parts == [left, self.words[b]]
        return out

    def move(self, key: int) -> int:
        """The transition of state << 8 | byte, made if need be."""
        if (known := self.moves.get(key)) is not None:
            return known
        open_, last, count = [], -1, 0
        for node, before, less in self.states[key >> 8]:
            there = self.below[node].get(key & 255)
            if there is None:
                continue
            t = self.token[there]
            if t >= 0 and last < 0 and (before < 0 or self.fit(before, t)):
                last, count = t, less + 1
            if self.below[there]:
                open_.append((there, before, less))
        state = (*((n, t, k - count) for n, t, k in open_), (0, last, 0))
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        out = self.moves[key] = at << 8 | count + 128
        slot = ((key * int(self.factor)) & (1 << 64) - 1) >> int(self.shift)
        while self.key_at[slot] >= 0:
            slot = slot + 1 & SLOTS - 1
        self.key_at[slot], self.move_at[slot] = key, out
        return out

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of many keys."""
        slot = ((keys.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)
        out, found = self.move_at[slot], self.key_at[slot]
        for_next = np.flatnonzero(found != keys)
        new = []
        while len(for_next):  # another's slot: the next one; an empty one: not made yet
            empty = found[for_next] < 0
            new.append(for_next[empty])
            for_next = for_next[~empty]
            slot[for_next] = slot[for_next] + 1 & SLOTS - 1
            found[for_next], out[for_next] = self.key_at[slot[for_next]], self.move_at[slot[for_next]]
            for_next = for_next[found[for_next] != keys[for_next]]
        if new and len(new := np.concatenate(new)):
            made, which = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self.move(k) for k in made.tolist()], np.int64)[which]
        return out

    def walk(self, data: bytes, move: int = 128) -> tuple[int, int]:
        """Tokens of one string from a transition's state on, and the last transition."""
        total, moves = 0, self.moves
        for b in data:
            key = move & -256 | b
            move = moves.get(key)
            if move is None:
                move = self.move(key)
            total += move & 255
        return total - 128 * len(data), move

    def counts(self, data: bytes, size: np.ndarray) -> np.ndarray:
        """Tokens of each of many strings, given end to end."""
        if len(self.states) > STATES or len(self.moves) > SLOTS // 4:
            self.clear()
        raw = np.frombuffer(data, np.uint8)
        order = np.argsort(-size, kind="stable")
        begin, length = (np.cumsum(size) - size)[order], size[order]
        move, total = np.full(len(size), 128, np.int64), np.zeros(len(size), np.int64)
        at = 0
        while True:
            k = int(np.searchsorted(-length, -at, "left"))  # those longer than so many bytes
            if k < FEW:
                break
            move[:k] = self.step(move[:k] & -256 | raw[begin[:k] + at])
            total[:k] += (move[:k] & 255) - 128
            at += 1
        for i in range(k):
            more, move[i] = self.walk(data[begin[i] + at : begin[i] + length[i]], int(move[i]))
            total[i] += more
        out = np.empty(len(size), np.int64)
        out[order] = total
        return out
