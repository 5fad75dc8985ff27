"""Vector bin packing of documents (or instruction examples) into sequences.

Every piece is a vector of tokens, segments (1) and loss-bearing tokens, and a sequence has a limit on each.
Sequences are filled one at a time: of the pieces that fit, the next is the one whose vector has the
largest dot product with what the sequence has left, both in parts of the limits (the part of the segments is
the same for every piece). If no piece fits, one that doesn't is cut to what is left (``cut=True``). Long documents first give full pieces of the capacity.

Pieces are placed within the task that reads their documents, a window of documents at a time, so nothing is
shuffled and no group is gathered. Sequences that end short of the capacity (the last of a task, and those that
another limit closes) are dealt to lengths that are powers of two, as those aren't padded.

Defined results: a null text is as an empty one (just the end id, one piece); each row is packed by itself,
so repeated rows give repeated pieces; ties go to the earlier row; an empty table gives an empty result;
further columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import word_coder
from .common import tune

#: Tokens, pieces and loss-bearing tokens of a sequence.
LIMITS = (4096, 256, 4096)
#: Documents that are placed together, and tokens, whichever come first: a worker holds no more, but for one batch.
WINDOW, TOKENS = 3000, 1 << 22


class Queue:
    """Pieces that wait, by (length, loss, -item)."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces)
        self.length, self.loss = (np.array([p[x] for p in self.pieces], np.int64) for x in (0, 1))

    def best(self, left: list[int], limits: tuple[int, int, int]) -> int | None:
        """Where the fitting piece of the largest dot product with ``left`` is; of equal ones the longest, then the earliest."""
        top = int(np.searchsorted(self.length, left[0], "right"))
        if top and self.pieces[top - 1][0] == self.pieces[top - 1][1] <= left[2]:
            return top - 1  # no shorter one, nor one with less loss, can have a larger product
        tokens, segments, loss = (x / limit**2 for x, limit in zip(left, limits, strict=True))
        product = np.where(self.loss[:top] <= left[2], self.length[:top] * tokens + segments + self.loss[:top] * loss, -1.0)
        k = top - 1 - int(np.argmax(product[::-1])) if top else None
        return k if k is not None and product[k] >= 0 else None

    def cuttable(self, left: list[int]) -> int | None:
        """Where the piece to cut is: the shortest that is too long, else the longest, which then bears too much loss."""
        k = min(int(np.searchsorted(self.length, left[0], "right")), len(self.pieces) - 1)
        return k if left[2] or not self.pieces[k][1] else None

    def pop(self, k: int) -> int:
        self.length, self.loss = np.delete(self.length, k), np.delete(self.loss, k)
        return -self.pieces.pop(k)[2]

    def add(self, piece: tuple[int, int, int]) -> None:
        k = bisect_left(self.pieces, piece)
        self.pieces.insert(k, piece)
        self.length, self.loss = np.insert(self.length, k, piece[0]), np.insert(self.loss, k, piece[1])


class Items:
    """Lengths and losses of items; the loss-bearing tokens of one are taken as spread evenly over it."""

    def __init__(self, lengths: np.ndarray, losses: np.ndarray):
        self.length, self.loss = lengths.tolist(), losses.tolist()
        self.start = [0] * len(self.length)

    def bears(self, i: int, take: int) -> int:
        """Loss of the next ``take`` tokens of an item."""
        n, loss, s = self.length[i], self.loss[i], self.start[i]
        return loss * (s + take) // n - loss * s // n

    def takes(self, i: int, tokens: int, loss: int) -> int:
        """The most next tokens of an item, up to ``tokens``, whose loss is at most ``loss``."""
        n, own, s = self.length[i], self.loss[i], self.start[i]
        return min(tokens, n - s, ((loss + own * s // n + 1) * n - 1) // own - s if own else tokens)

    def rest(self, i: int) -> tuple[int, int, int]:
        n = self.length[i] - self.start[i]
        return n, self.bears(i, n), -i


def place(lengths: np.ndarray, losses: np.ndarray, limits: tuple[int, int, int], cut: bool, last: bool):
    """Sequences of (item, start, length), and the items' parts left over.

    A sequence that still has room when the items end is given only if ``last``; else its pieces are left for
    the next window. A loss is at most its length.
    """
    if min(limits) < 1:
        raise ValueError("limits are positive")
    items, done, todo = Items(lengths, losses), [], []
    for i, n in enumerate(items.length):
        while cut and n - items.start[i] >= limits[0] and items.bears(i, limits[0]) <= limits[2]:  # full sequences of one document
            done.append([(i, items.start[i], limits[0])])
            items.start[i] += limits[0]
        if n > items.start[i]:
            todo.append(items.rest(i))
    queue = Queue(todo)
    while queue.pieces:
        left, own = list(limits), []
        while left[0] > 0 and left[1] > 0 and queue.pieces:
            k = queue.best(left, limits)
            take = queue.pieces[k][0] if k is not None else 0
            if k is None and cut and (k := queue.cuttable(left)) is not None:
                take = items.takes(-queue.pieces[k][2], left[0], left[2])
            if not take:
                break
            i = queue.pop(k)
            left = [left[0] - take, left[1] - 1, left[2] - items.bears(i, take)]
            own.append((i, items.start[i], take))
            items.start[i] += take
            if items.start[i] < items.length[i]:
                queue.add(items.rest(i))
        if not own:
            raise ValueError("a piece exceeds the limits")
        if not queue.pieces and left[0] > 0 and left[1] > 0 and not last:
            return done, own
        done.append(own)
    return done, []


def by_powers(sequence: list[tuple[int, int, int]], room: int) -> list[list[tuple[int, int, int]]]:
    """One sequence's pieces dealt to sequences whose lengths are powers of two, cut where they end."""
    total = sum(n for _, _, n in sequence)
    if total in (0, room):
        return [sequence]
    out, own = [], []
    goals = [1 << b for b in range(total.bit_length()) if total >> b & 1]  # the largest last
    left = goals.pop()
    for i, s, n in sequence:
        while n:
            take = min(n, left)
            own.append((i, s, take))
            s, n, left = s + take, n - take, left - take
            if not left:
                out.append(own)
                own, left = [], goals.pop() if goals else 0
    return out


def pack_tokens(docs: DataFrame, path: str, end_id: int = 2, limits: tuple[int, int, int] = LIMITS, loss: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs``, each a run of a document's ids (its text's, then ``end_id``) in one sequence.

    ``loss``: a column with how many of a row's tokens bear loss (null or absent: all of them).
    """
    tune(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        coder, task = word_coder(path), TaskContext.get()
        made = (task.partitionId() if task else 0) << 40
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []  # (doc_id, ids, loss, start)

        def emit(sequences, items):
            nonlocal made
            rows = []
            for seq in (p for s in sequences for p in by_powers(s, limits[0])):
                at = 0
                for i, s, n in seq:
                    key, ids, _, base = items[i]
                    b = base + s
                    rows.append((key, b, n, zlib.crc32(ids[4 * b : 4 * (b + n)]), len(ids) // 4, made, at))
                    at += n
                made += 1
            cols = [*zip(*rows, strict=True)] or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        def placed(items, last):
            lengths = np.array([len(ids) // 4 - base for _, ids, _, base in items], np.int64)
            whole = np.array([len(ids) // 4 for _, ids, _, _ in items], np.int64)
            bear = np.array([n if x is None else min(max(x, 0), n) for (_, _, x, _), n in zip(items, whole, strict=True)], np.int64)
            return place(lengths, bear * lengths // np.maximum(whole, 1), limits, True, last)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            texts = [(t or "").encode("utf-8", "replace").split() for t in b.column(1).to_pylist()]
            coder.know(texts)
            ids = [coder.ids(w) + end for w in texts]
            bears = b.column(2).to_pylist() if loss else [None] * len(ids)
            held += zip(b.column(0).to_pylist(), ids, bears, [0] * len(ids), strict=True)
            if len(held) >= window or sum(len(x) for _, x, _, _ in held) >= 4 * TOKENS:
                seqs, rest = placed(held, False)
                yield emit(seqs, held)
                held = keep(held, rest)
        if key_type is not None:
            seqs, rest = placed(held, True)
            yield emit(seqs, held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "text", *([loss] if loss else [])]
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def keep(items: list[tuple], rest: list[tuple[int, int, int]]) -> list[tuple]:
    """What one window leaves for the next: a part that is the end of its document."""
    out = []
    for i, s, n in rest:
        key, ids, bear, base = items[i]
        assert base + s + n == len(ids) // 4, "only a document's end is left over"
        out.append((key, ids, bear, base + s))
    return out
