"""Language model scores of documents by class-based bigrams (Brown et al. 1992).

Training words are put into classes by exchange clustering: a word goes to the class that raises the likelihood
of the class bigrams most. A text's probability is the product over its tokens (its words, then one end) of the
transition from the class of the token before, and the emission of the token by its class.

How it runs. Texts are read three times: for the words' counts, for the bigrams, for the scores.

* Counts of all words are a table. At most ``words`` of them are exchanged: those seen ``SEEN`` times or more, above the
  least count that leaves so few (found from a histogram of logarithms), and of at most ``BYTES`` bytes; so the dictionary
  sent to the tasks is bounded. All other words form one class of rare words, to which unknown words belong.
* Bigrams of ids are counted in each task by sorting, packed by blocks of words and shuffled, so that a block
  holds all neighbours of its words; their number is bounded by the dictionary's.
* A round of the exchange is a pass over the blocks. Its turn takes every ``TURNS``-th word; each is taken out of its class
  and put where the gain is largest, in the light of the class bigrams of the round's start and of the task's own
  moves. Then the class bigrams are counted anew; the best of all rounds is kept.
* Scores: everything but the counts of rare words is known in the task that reads the text. Rare words are written with
  their document's key, meet the table of counts in a join by word and come back as sums by key.

Smoothing: transitions are interpolated with the classes' frequencies (``PRIOR`` pseudo-counts), emissions add
0.5; the unknown word has as many pseudo-counts as there are words seen once. For each class before, the
probabilities of all training words, the end and the unknown word add up to 1.

Defined results: a null text is as an empty one (the end alone). A null id counts as the empty text for ``held_out``, so such
rows are learned from. Repeated rows are separate rows. Without training rows nothing is known and both scores are 0.
An empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, tune

#: Classes of exchanged words; at most so many of those; how often and how long they may be.
CLASSES, WORDS, SEEN, BYTES = 64, 1 << 15, 3, 64
#: Rounds of the exchange, and of how many of them a word is moved in one.
ROUNDS, TURNS = 9, 3
#: Pseudo-counts of the classes' frequencies in a transition.
PRIOR = 10.0
#: Blocks of words; pairs, and different words, that a task holds before it merges or sends them.
BLOCKS, PAIRS, HELD = 256, 1 << 21, 300_000
REST, END = 0, 1
#: What stands for the end of a text; no word has it.
END_WORD = b"\n"
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_WORD, _GAP = re.compile(rb"[^\x20\x09-\x0d]+"), re.compile(rb"[\x20\x09-\x0d]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.lower(), 0  # of bytes: A-Z alone
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Model:
    """``counts``: (w, c) of the training words that weren't exchanged; ``ids`` and ``classes`` of the others and the end."""

    counts: DataFrame
    tokens: int
    kinds: int
    once: int
    ids: dict[bytes, int]
    seen: np.ndarray  # count by id
    classes: np.ndarray  # class by id
    table: np.ndarray  # class bigrams

    def class_words(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for w, i in self.ids.items():
            out.setdefault(int(self.classes[i]), []).append(w.decode("utf-8", "replace"))
        return out

    def kinds_of(self) -> np.ndarray:
        """Different words of each class."""
        n = np.bincount(self.classes[1:], minlength=len(self.table)).astype(float)
        n[REST] = self.kinds - (len(self.classes) - 1)
        return n

    def transitions(self) -> np.ndarray:
        """Probability of each class after each."""
        kinds = self.kinds_of()
        kinds[REST] += 1
        base = (self.table.sum(0) + 0.5 * kinds) / (self.tokens + 0.5 * (self.kinds + 1))
        return (self.table + PRIOR * base) / (self.table.sum(1, keepdims=True) + PRIOR)

    def rare_total(self) -> float:
        return self.table.sum(0)[REST] + self.once + 0.5 * (self.kinds_of()[REST] + 1)

    def emissions(self) -> np.ndarray:
        """Probability of each exchanged word (and the end) in its class; 1 for rare words, whose counts aren't here."""
        total = (self.table.sum(0) + 0.5 * self.kinds_of())[self.classes]
        out = (self.seen + 0.5) / np.maximum(total, 1e-300)
        out[REST] = 1.0
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c) of every word of the texts, and the end."""

    def send(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            if b.num_rows:
                held[END_WORD] += b.num_rows
            for t in b.column(0).to_pylist():
                for ws in word_lists(t or b""):
                    held.update(ws)
                    if len(held) > HELD:
                        yield send(held)
                        held = Counter()
        if held:
            yield send(held)

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def encode(texts: Iterable[bytes | None], ids: dict[bytes, int]) -> tuple[np.ndarray, list[list[bytes]]]:
    """Ids of all tokens, an end after each text, and each text's rare words."""
    parts, rare, end = [], [], np.array([END], np.int32)
    for t in texts:
        mine: list[bytes] = []
        for ws in word_lists(t or b""):
            x = np.fromiter(map(ids.get, ws, repeat(REST)), np.int32, len(ws))
            parts.append(x)
            mine += [ws[i] for i in np.flatnonzero(x == REST)]
        parts.append(end)
        rare.append(mine)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), rare


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with their summed counts (1 each if None)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begins], np.diff(np.r_[begins, len(keys)]) if counts is None else np.add.reduceat(counts, begins)


class Pairs:
    """Counts of keys, merged whenever ``PAIRS`` of them wait."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(runs(keys, counts))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            self.parts = [runs(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))] if self.parts else [runs(np.zeros(0, np.int64))]
        self.waiting = 0
        return self.parts[0]


def neighbours(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """One row a block of words: counts of their right and left neighbours (keys: word * size + neighbour), packed."""
    size = len(ids) + 1
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def send(pairs: Pairs):
        keys, n = pairs.merge()
        a, b = np.divmod(keys, size)
        rows = []
        for side, (w, nb) in enumerate(((a, b), (b, a))):
            order = np.argsort(w % BLOCKS, kind="stable")
            packed, count, of = (w * size + nb)[order], n[order], (w % BLOCKS)[order]
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            for i, j in zip(begins, np.append(begins, len(of))[1:], strict=True):
                rows.append((int(of[i]), side, packed[i:j].astype("<i8").tobytes(), count[i:j].astype("<i8").tobytes()))
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "side", "keys", "counts"])

    def run(batches):
        pairs = Pairs()
        for b in batches:
            x, _ = encode(b.column(0).to_pylist(), shared.value)
            pairs.add(np.r_[END, x[:-1]].astype(np.int64) * size + x)
            if pairs.parts and len(pairs.parts[0][0]) > 2 * PAIRS:
                yield send(pairs)
                pairs = Pairs()
        yield send(pairs)

    def gather(batches):
        block, sides = None, (Pairs(), Pairs())

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for p in sides for x in p.merge())], ["block", "right", "right_n", "left", "left_n"])

        for b in batches:
            for of, side, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != block:
                    if block is not None:
                        yield done()
                    block, sides = of, (Pairs(), Pairs())
                sides[side].add(np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8"))
        if block is not None:
            yield done()

    sent = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "block int, side int, keys binary, counts binary")
    dealt = sent.repartition(min(BLOCKS, 4 * partitions(docs)), "block").sortWithinPartitions("block")
    return cut(dealt.mapInArrow(gather, "block int, right binary, right_n binary, left binary, left_n binary"))


def xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)  # moves of one round don't see each other exactly
    return x * np.log(np.maximum(x, 1e-300))


def worth(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for a constant."""
    return float(xlogx(table).sum() - xlogx(table.sum(1)).sum() - xlogx(table.sum(0)).sum())


class Exchange:
    """Moves words one by one, keeping the class bigrams up to date."""

    def __init__(self, table: np.ndarray):
        self.table, self.rows, self.cols = table.astype(float), table.sum(1).astype(float), table.sum(0).astype(float)

    def shift(self, k: int, right: np.ndarray, left: np.ndarray, own: float, sign: int) -> None:
        """A word with these neighbours by class (itself apart: ``own``) joins class ``k`` or leaves it."""
        self.table[k] += sign * right
        self.table[:, k] += sign * left
        self.table[k, k] += sign * own
        self.rows += sign * left
        self.cols += sign * right
        self.rows[k] += sign * (right.sum() + own)
        self.cols[k] += sign * (left.sum() + own)

    def gains(self, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
        """What a word outside of all classes adds to the likelihood in each."""
        t = self.table
        cells = xlogx(t + right) - (old := xlogx(t)) + (xlogx(t + left[:, None]) - old).T
        d = np.arange(len(t))
        both = t[d, d] + right + left + own
        corner = xlogx(both) - old[d, d]
        cells[d, d] = corner
        r, c = right.sum() + own, left.sum() + own
        # The margins change for the class and for its neighbours; of the latter only the class's own share differs by class.
        rows, cols = self.rows + left, self.cols + right
        return cells.sum(1) - (xlogx(rows + r) - xlogx(rows)) - (xlogx(cols + c) - xlogx(cols))

    def place(self, k: int, right: np.ndarray, left: np.ndarray, own: float) -> int:
        """Take a word out of class ``k`` and put it where it is worth most; only classes of words are open."""
        right, left = right.copy(), left.copy()
        right[k] -= own
        left[k] -= own
        self.shift(k, right, left, own, -1)
        gain = self.gains(right, left, own)
        best = END + 1 + int(gain[END + 1 :].argmax())
        if gain[best] <= gain[k] + 1e-9 * abs(gain[k]):
            best = k
        self.shift(best, right, left, own, 1)
        return best


def cluster(blocks: DataFrame, classes: np.ndarray, size: int, number: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes by id and their bigrams after the exchange, from first ``classes``; ``number`` with the two fixed ones."""
    sc = blocks.sparkSession.sparkContext

    def table(classes: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(classes)

        def run(batches):
            total = np.zeros(number * number)
            for b in batches:
                for keys, n in zip(b.column(0), b.column(1), strict=True):
                    w, nb = np.divmod(np.frombuffer(keys.as_buffer(), "<i8"), size)
                    total += np.bincount(shared.value[w] * number + shared.value[nb], np.frombuffer(n.as_buffer(), "<i8"), number * number)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

        out = np.zeros(number * number, np.int64)
        for r in blocks.select("right", "right_n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        shared.unpersist()
        return out.reshape(number, number)

    def moved(classes: np.ndarray, now: np.ndarray, turn: int) -> np.ndarray:
        shared = sc.broadcast((classes, now))

        def run(batches):
            of, start = shared.value
            for b in batches:
                for row in zip(*(c for c in b.columns), strict=True):
                    block = row[0].as_py()
                    words = np.arange(block, size, BLOCKS)
                    vectors, own = [], np.zeros(len(words))
                    for keys, n in ((row[1], row[2]), (row[3], row[4])):
                        w, nb = np.divmod(np.frombuffer(keys.as_buffer(), "<i8"), size)
                        n = np.frombuffer(n.as_buffer(), "<i8")
                        vectors.append(np.bincount(w // BLOCKS * number + of[nb], n, len(words) * number).reshape(-1, number))
                        own[w[w == nb] // BLOCKS] = n[w == nb]
                    state, out = Exchange(start), []
                    for i, w in enumerate(words.tolist()):
                        # Words of a block are ``BLOCKS`` apart, so the turn goes by their place in it.
                        if w > END and (i + block) % TURNS == turn and (best := state.place(int(of[w]), vectors[0][i], vectors[1][i], own[i])) != of[w]:
                            out.append((w, best))
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in (0, 1)], ["w", "k"])

        new = classes.copy()
        for r in blocks.mapInArrow(run, "w int, k int").collect():  # within the dictionary's size
            new[r["w"]] = r["k"]
        shared.unpersist()
        return new

    now = table(classes)
    best = (worth(now), classes, now)
    for i in range(rounds if size > END + 1 else 0):
        classes = moved(classes, now, i % TURNS)
        now = table(classes)
        best = max(best, (worth(now), classes, now), key=lambda x: x[0])
    return best[1], best[2]


def train(docs: DataFrame, classes: int = CLASSES, words: int = WORDS, rounds: int = ROUNDS) -> Model:
    """The model of the texts of ``docs``."""
    tune(docs.sparkSession)
    counts = cut(count_words(docs))
    step = F.floor(8 * F.log2("c")).cast("int")
    able = (F.col("c") >= SEEN) & (F.octet_length("w") <= BYTES) & (F.col("w") != F.lit(bytearray(END_WORD)))
    steps = counts.groupBy(step.alias("step"), able.alias("able")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("int")).alias("once"), F.max(F.when(F.col("w") == F.lit(bytearray(END_WORD)), F.col("c"))).alias("ends")).collect()
    tokens, kinds, once = (sum(r[k] for r in steps) for k in ("c", "n", "once"))
    ends = max([r["ends"] for r in steps if r["ends"]], default=0)
    least, chosen = None, 0
    for r in sorted((r for r in steps if r["able"]), key=lambda r: -r["step"]):
        if chosen + r["n"] > words:
            break
        least, chosen = r["step"], chosen + r["n"]
    found = counts.where(able & (step >= least)).collect() if least is not None else []
    found = sorted(((bytes(r["w"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))
    ids = {END_WORD: END} | {w: END + 1 + i for i, (w, _) in enumerate(found)}
    seen = np.array([0, ends, *(c for _, c in found)], float)
    number = classes + END + 1
    first = np.array([REST, END, *(END + 1 + i % classes for i in range(len(found)))], np.int64)
    of, table = cluster(neighbours(docs, ids), first, len(first), number, rounds) if tokens else (first, np.zeros((number, number), np.int64))
    return Model(counts if least is None else counts.where(~(able & (step >= least))), tokens, kinds, once, ids, seen, of, table)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (logarithms to base 10) of every document."""
    tune(docs.sparkSession)
    total, known = model.tokens + 0.5 * (model.kinds + 1), model.tokens > 0
    tables = (model.ids, model.classes, np.log10(np.maximum(model.transitions(), 1e-300)), np.log10(model.emissions()), np.log10((model.seen + 0.5) / total)) if known else (model.ids, model.classes, np.zeros(model.table.shape), np.zeros(len(model.classes)), np.zeros(len(model.classes)))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids, of, moves, emit, base = shared.value
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            x, rare = encode(b.column(1).to_pylist(), ids)
            ends = np.flatnonzero(x == END)
            begins = np.r_[0, ends[:-1] + 1]
            k = of[x]
            common = x != REST
            add = lambda v: np.add.reduceat(v, begins)  # noqa: E731, B023
            cols = [np.arange(at, at + b.num_rows), ends - begins + 1, add((common & known).astype(np.int64)), add(np.where(common, base[x], 0.0)), add(moves[np.r_[of[END], k[:-1]], k] + emit[x] * common)]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), b.column(0), *(pa.array(c) for c in cols[1:]), pa.array(rare, pa.list_(pa.binary()))], ["key", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    read = docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"key long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<binary>")
    read = cut(read)
    c = F.coalesce("c", F.lit(0))
    z = model.rare_total() if known else 1.0
    rare = read.select("key", F.explode("rare").alias("w")).join(model.counts, "w", "left").select(
        "key", (c > 0).cast("long").alias("r_known"),
        F.log10((c + 0.5) / total).alias("r_base") if known else F.lit(0.0).alias("r_base"),
        F.log10((F.when(c > 0, c).otherwise(F.lit(model.once)) + 0.5) / z).alias("r_score") if known else F.lit(0.0).alias("r_score"),
    )
    sums = rare.groupBy("key").agg(*(F.sum(n).alias(n) for n in ("r_known", "r_base", "r_score")))
    plus = lambda n, m: (F.col(n) + F.coalesce(m, F.lit(0))).alias(n)
    return read.drop("rare").join(sums, "key", "left").select("doc_id", "n_tokens", plus("n_known", "r_known"), plus("base_score", "r_base"), plus("score", "r_score"))


def scored(docs: DataFrame) -> DataFrame:
    """Every document scored by the model of those that aren't held out."""
    model = train(docs.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
