"""Token counts without token ids, by finite-state transducers.

The tokenizer splits a text by a pattern and merges bytes within each piece. The split is a regular language; the merges are
a deterministic transducer over bytes whose transitions are labelled with emitted tokens (``merge_automaton``). No words
are kept: a piece is read byte by byte.

No token reaches from a character that isn't white space over to a following white space. Those places cut a text into segments (a
run of white space and the word after it). Every text is read in chunks, whatever its length. A chunk's state map tells, for any
open segment that the text before it left, what is emitted and which segment is left open: it is held as (head, count, tail),
where the head completes the segment that came in. Maps compose associatively: for a total they are reduced in pairs, and
where the counts of all prefixes are wanted, by a parallel prefix scan, both in a logarithmic number of rounds.

Segments with a special token's text, or with a character that has no class yet, go to the library.

Defined results: a null text is as an empty one (0 bytes, 0 tokens, not over the limit); rows are
independent, so ties, repeated rows and empty tables need no rule; further columns are dropped. No shuffle;
memory is bounded by the automaton's states and one Arrow batch.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_core import LETTERS, NUMBERS, ODD
from .common import tune
from .merge_automaton import MergeAutomaton

#: Characters of a chunk, and texts whose pieces are found at once.
CHUNK, TEXTS = 1 << 12, 2000
#: Unicode's white space, as the tokenizers' patterns take it. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The byte-level tokenizer's split pattern (fixed values) over plain Latin text and over any, each with a mark between two texts.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}\x00{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}\x00])|[{WHITE}]+|\x00")
SPLIT_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\x00\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}\x00])|[{WHITE}]+|\x00")
#: Characters besides plain Latin ones and the usual white space, and those without a class.
ODD_TEXT = re.compile("[^ \t\n\r" + ODD.pattern.removeprefix("[^"))
UNKNOWN = regex.compile(r"[\p{Cn}\p{Cs}]")


class StateMap(NamedTuple):
    """What a chunk does: its first segment, tokens of its closed ones, its last (None: one segment only)."""

    head: str
    count: int
    tail: str | None


class CountTransducer:
    """Byte-level BPE of a tokenizers file, counting tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.automaton = Tokenizer.from_file(path), MergeAutomaton(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def counts(self, segments: list[list[str]]) -> list[int]:
        """Tokens of each list of segments."""
        out, plain, other, library = np.zeros(len(segments), np.int64), [], [], []
        for i, own in enumerate(segments):
            text = "".join(own)
            if text and not ODD_TEXT.search(text) and not any(x in text for x in self.special):
                plain.append((i, text))
                continue
            for s in own:
                if any(x in s for x in self.special) or "\0" in s or UNKNOWN.search(s):
                    library.append((i, s))
                else:
                    (other if ODD_TEXT.search(s) else plain).append((i, s))
        for texts, split in ((plain, SPLIT), (other, SPLIT_ANY)):
            for k in range(0, len(texts), TEXTS):
                own = texts[k : k + TEXTS]
                pieces = split.findall("\0".join(t for _, t in own))
                out += np.bincount([i for i, _ in own], self._of_texts(pieces, len(own)), len(out)).astype(np.int64)
        if library:
            found = self.library.encode_batch([s for _, s in library], add_special_tokens=False)
            for (i, _), e in zip(library, found, strict=True):
                out[i] += len(e)
        return out.tolist()

    def _of_texts(self, pieces: list[str], texts: int) -> np.ndarray:
        """Tokens of each text, of the pieces of all with a mark between two texts."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        joined = "".join(pieces)
        data = joined.encode()
        if len(data) > len(joined):  # lengths in bytes
            c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))[np.cumsum(size) - 1]
            size = np.diff(ends, prepend=0)
        raw = np.frombuffer(data, np.uint8)
        mark = raw[np.cumsum(size) - size] == 0 if len(size) else np.zeros(0, bool)
        owner = np.cumsum(mark)
        n = self.automaton.counts(raw[raw != 0].tobytes(), size[~mark])
        return np.bincount(owner[~mark], n, texts).astype(np.int64)

    def state_maps(self, chunks: list[str]) -> list[StateMap]:
        """The map of each chunk; what is closed in any of them is counted together."""
        found = [SEGMENT.findall(c) for c in chunks]
        inside = self.counts([s[1:-1] for s in found])
        return [StateMap(c, 0, None) if len(s) < 2 else StateMap(s[0], n, s[-1]) for c, s, n in zip(chunks, found, inside, strict=True)]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two chunks in a row."""
        s = SEGMENT.findall((a.head if a.tail is None else a.tail) + b.head)
        if not s:
            return StateMap("", 0, None)
        first, s = ([s[0]], s[1:]) if a.tail is None else ([a.head], s)
        if b.tail is None:
            tail, s = (s[-1], s[:-1]) if s else (None, s)
            return StateMap(first[0], a.count + self.counts([s])[0], tail)
        return StateMap(first[0], a.count + self.counts([s])[0] + b.count, b.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix scan: the map of the first chunk, of the first two, and so on."""
        out, step = [*maps], 1
        while step < len(out):
            out = [self.compose(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
            step *= 2
        return out

    def reduce(self, maps: list[StateMap]) -> StateMap:
        """The map of all chunks in a row, in pairs."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def emitted(self, maps: list[StateMap]) -> list[int]:
        """Tokens of whole texts that have these maps."""
        edges = self.counts([[x for x in (m.head, m.tail) if x] for m in maps])
        return [m.count + n for m, n in zip(maps, edges, strict=True)]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text, from the maps of its chunks."""
        chunks = [[t[k : k + CHUNK] for k in range(0, len(t), CHUNK)] or [""] for t in (t or "" for t in texts)]
        maps = iter(self.state_maps([c for own in chunks for c in own]))
        return self.emitted([self.reduce([next(maps) for _ in own]) for own in chunks])


@lru_cache(maxsize=4)
def count_transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every whole text."""
    tune(docs.sparkSession)

    def run(batches):
        machine = count_transducer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.array(machine.count(texts), np.int64)
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
