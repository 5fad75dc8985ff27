"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes has a fixed pattern, so equal passages of different
documents give equal chunks. A chunk's inside, from its first to its last white space, is encoded once and
kept for every later document of the worker; nothing else is kept, no words either. Where two chunks meet, the cut piece of text between the two
nearest white spaces is encoded anew; if a chunk has none, the piece reaches over it to the next. The tokenizer
splits at white space before it merges, so these pieces agree exactly with the ids that the library gives for the whole text.

Defined results: a null text is as an empty one (no ids); rows are independent, so ties, repeated rows and
empty tables need no rule; further columns are dropped, whatever their names. Memory is bounded by the
memo limits and one Arrow batch, whatever the partition holds. No shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_core import LETTERS, LONG, NUMBERS, ODD, ODD_LINES, MergeTable
from .common import tune

#: Words that a coder keeps between batches and chunks that an encoder keeps; a full memo starts again, which costs time and not exactness.
WORDS, CHUNKS = 500_000, 60_000
#: Mean bytes of a chunk (a power of two) and bytes that the rolling hash sees.
MEAN, WINDOW = 1024, 8
#: The pieces that the tokenizer's merges see, over a lower-case word. Fixed values of the tokenizer file.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+|\n")
_GEAR = np.frombuffer(hashlib.shake_128(b"gear").digest(512), np.uint16)
_EDGE = re.compile(rb"[ \t\n\x0b\x0c\r]")


class WordCoder:
    """Ids of white-space separated words, as little-endian 32-bit bytes, by way of a bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table, self.library = MergeTable(path), Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        top = max(self.table.tokens) + 1
        self.digits = [str(i) for i in range(top)]
        self.names = [self.table.tokens.get(i, "") for i in range(top)]

    def learn(self, words: set[bytes]) -> None:
        if len(self.memo) + len(words) > WORDS:
            self.memo = {}
        if len(self.pieces) > WORDS:
            self.pieces = {}
        todo = [*words]
        joined = b"\n".join(todo).decode("utf-8", "replace")
        if ODD_LINES.search(joined) or "<|" in joined or max(map(len, todo)) > LONG:
            lines = joined.split("\n")
            plain = [not (ODD.search(s) or "<|" in s or len(w) > LONG) for w, s in zip(todo, lines, strict=True)]
            for w, s, ok in zip(todo, lines, plain, strict=True):
                if not ok:
                    self.memo[w] = np.array(self.library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
            todo = [*compress(todo, plain)]
            joined = "\n".join(compress(lines, plain))
        if not todo:
            return
        low = joined.lower().split("\n")
        whole = [s.isalpha() for s in low]  # one piece
        found = PIECES.findall("\n".join(compress(low, map(not_, whole))))
        new = [p for p in {*found, *compress(low, whole)} if p not in self.pieces and p != "\n"]
        if new:
            ids, count = self.table.encode([p.encode() for p in new])
            raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
            self.pieces.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        known = self.pieces
        self.memo.update(zip(compress(todo, whole), map(known.__getitem__, compress(low, whole)), strict=True))
        rest, own = compress(todo, map(not_, whole)), b""
        for p in [*found, "\n"]:
            if p == "\n":
                if (w := next(rest, None)) is not None:
                    self.memo[w] = own
                own = b""
            else:
                own += known[p]

    def know(self, words: list[list[bytes]]) -> None:
        """Learn what is new in a batch of word lists."""
        new = {w for w in set().union(*words) if w not in self.memo}
        if new:
            if len(self.memo) + len(new) > WORDS:
                new = set().union(*words)
                self.memo = {}
            step = max(WORDS // 4, 1)
            todo = [*new]
            if len(todo) <= step:
                self.learn(new)
            else:  # one batch may hold more than the memo: its words stay until the next batch
                kept: dict[bytes, bytes] = {}
                for i in range(0, len(todo), step):
                    self.learn({*todo[i : i + step]})
                    kept.update(self.memo)
                self.memo = kept

    def forget(self) -> None:
        self.memo, self.pieces = {}, {}

    def ids(self, words: list[bytes]) -> bytes:
        """Ids of words that ``know`` has seen in this batch."""
        return b"".join(map(self.memo.__getitem__, words))


@lru_cache(maxsize=4)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def chunk_cuts(data: bytes) -> list[int]:
    """Where a text is cut: after each byte at which the hash of the last WINDOW bytes ends in zeros."""
    if len(data) <= WINDOW:
        return []
    b = _GEAR[np.frombuffer(data, np.uint8)]
    h = b.copy()
    for k in range(1, WINDOW):
        h[k:] += b[:-k] << np.uint16(k)
    return (np.flatnonzero((h & np.uint16(MEAN - 1)) == 0) + 1).tolist()


def chunk_pieces(data: bytes) -> list[tuple[bool, bytes]]:
    """A text as (reusable, piece): insides of chunks, and between them the text at each join.

    Every piece begins and ends at white space or at an end of the text, so the ids of the pieces, one
    after the other, are those of the text.
    """
    out, held, begin = [], b"", 0
    for end in [*chunk_cuts(data), len(data)]:
        chunk, begin = data[begin:end], end
        found = _EDGE.search(chunk)
        if not found:  # no white space: the join reaches over the whole chunk
            held += chunk
            continue
        last = max(chunk.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        held += chunk[: found.start()]
        if held:
            out.append((False, held))
        if last > found.start():
            out.append((True, chunk[found.start() : last]))
        held = chunk[last + 1 :]
    if held:
        out.append((False, held))
    return out


class ChunkEncoder:
    """Encodes batches of texts; what one chunk has given serves each later document with that chunk."""

    def __init__(self, path: str):
        self.words, self.chunks = WordCoder(path), {}
        self.encoded = 0  # chunks so far, each once as long as it is kept

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        plans = [chunk_pieces((t or "").encode("utf-8", "replace")) for t in texts]
        new = {p for plan in plans for reuse, p in plan if not (reuse and p in self.chunks)}
        self.encoded += len({p for plan in plans for reuse, p in plan if reuse and p in new})
        # All that is new in the batch is merged together: each different word of it once, and then forgotten.
        parts = [p.split() for p in new]
        self.words.know(parts)
        fresh = {p: self.words.ids(w) for p, w in zip(new, parts, strict=True)}
        self.words.forget()
        out = [np.frombuffer(b"".join(fresh[p] if p in fresh else self.chunks[p] for _, p in plan), "<u4") for plan in plans]
        if len(self.chunks) > CHUNKS:
            self.chunks = {}
        self.chunks.update((p, fresh[p]) for plan in plans for reuse, p in plan if reuse and p in fresh)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode without a decoder: the pieces' names, one space between."""
        return " ".join(map(self.words.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): every whole text's token ids."""
    tune(docs.sparkSession)

    def run(batches):
        coder = chunk_encoder(path)
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    tune(docs.sparkSession)

    def run(batches):
        coder = chunk_encoder(path)
        digits, sha = coder.words.digits, hashlib.sha256
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            a = [sha(" ".join(map(digits.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            d = [sha(coder.decode(x).encode()).hexdigest() for x in ids]
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
