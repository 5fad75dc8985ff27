"""Homomorphic multiset hash of documents.

A text is the multiset of its paragraphs: its lines, and within a line its sentences, trimmed. Each is
hashed to two wide vectors that are added up: ``WIDE`` lanes of uniform numbers modulo 2**32, by which equal
multisets are told, and ``SIGNS`` lanes of +1 or -1 modulo 2**32, whose differences estimate how much two
multisets share. Sums don't depend on order, and a paragraph is inserted or deleted by adding or
subtracting its vectors (``Fingerprint.added``, ``removed``).

The likeness of two fingerprints is 2 <a, b> / (|a|^2 + |b|^2) as their sign lanes estimate it, between 0
and 1; it is 1 for equal fingerprints. With 128 lanes its standard error is below 0.09. Sums of signs hold up to
2**31 paragraphs, whatever their length.

Defined results: a null text is as an empty one (no paragraphs; two such are alike). The next document goes
by descending doc_id, null ids last, rows of one id by a hash of their text; after the last row comes the
first, which for a single row is itself. An empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tune

WIDE, SIGNS = 16, 128
#: Paragraphs that are hashed at once; rows and characters that are held until they are.
STEP, ROWS, CHARS = 8192, 500, 1 << 20
_PARAGRAPH = re.compile(r"[^\n.!?|]*[^\n.!?|\s][^\n.!?|]*[.!?|]*")
_STEP = np.arange(1, WIDE // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in _PARAGRAPH.findall(text)]


def vectors(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Wide and sign vectors of paragraphs, one row each."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u.encode("utf-8", "replace")) for u in units), np.uint8).reshape(-1, 16)
    z = raw[:, :8].copy().view(np.uint64) + _STEP
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z.view(np.uint32), np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


class Fingerprint:
    """Sum of a multiset's vectors."""

    def __init__(self, wide: np.ndarray, signs: np.ndarray):
        self.wide, self.signs = wide.astype(np.uint32), signs.astype(np.int32)

    @classmethod
    def of(cls, units: list[str]) -> Fingerprint:
        if not units:
            return cls(np.zeros(WIDE, np.uint32), np.zeros(SIGNS, np.int32))
        w, s = vectors(units)
        return cls(w.sum(0, dtype=np.uint32), s.sum(0, dtype=np.int32))

    def added(self, units: list[str]) -> Fingerprint:
        other = Fingerprint.of(units)
        return Fingerprint(self.wide + other.wide, self.signs + other.signs)

    def removed(self, units: list[str]) -> Fingerprint:
        other = Fingerprint.of(units)
        return Fingerprint(self.wide - other.wide, self.signs - other.signs)

    def text(self) -> str:
        return base64.b64encode(self.wide.astype("<u4").tobytes() + self.signs.astype("<i4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 4 * WIDE], "<u4"), np.frombuffer(raw[4 * WIDE :], "<i4"))


def likeness(wide_a, signs_a, wide_b, signs_b) -> np.ndarray:
    """Row by row, from the lanes of two fingerprints."""
    a, b = signs_a.astype(np.float64), signs_b.astype(np.float64)
    norms = (a * a).sum(1) + (b * b).sum(1)
    near = np.clip(2 * (a * b).sum(1) / np.maximum(norms, 1e-9), 0, 1)
    return np.where((wide_a == wide_b).all(1) & (signs_a == signs_b).all(1), 1.0, near)


def sums(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Wide and sign sums of each list of paragraphs, so many paragraphs at a time."""
    wide, signs = np.zeros((len(lists), WIDE), np.uint32), np.zeros((len(lists), SIGNS), np.int32)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = chain.from_iterable(lists)
    for i in range(0, len(owner), STEP):
        own = owner[i : i + STEP]
        w, s = vectors([*islice(flat, STEP)])
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        wide[own[begins]] += np.add.reduceat(w, begins, axis=0, dtype=np.uint32)
        signs[own[begins]] += np.add.reduceat(s, begins, axis=0, dtype=np.int32)
    return wide, signs


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last half replaced by the next one's beginning, and code points kept."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2], n - n // 2


def edited_units(text: str, units: list[tuple[int, int]], new: str, kept: int) -> tuple[int, list[str]]:
    """How many first paragraphs the edited text still has, and its further ones."""
    # A paragraph that ends before the last kept character isn't touched by what follows.
    same = bisect_right(units, kept - 1, key=lambda x: x[1])
    return same, paragraphs(new[units[same - 1][1] if same else 0 :])


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness with each other and the next."""
    spark = docs.sparkSession
    tune(spark)
    nk = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long")).alias("nk")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), nk).withColumn("th", F.xxhash64("text"))
    parts = 2 * partitions(docs)
    # Ranges of (nk, th), so that rows with one id (or none) are dealt too: the least key of each, one row a range.
    ranges = base.select("nk", "th").repartitionByRange(parts, "nk", "th").groupBy(F.spark_partition_id()).agg(F.min(F.struct("nk", "th")).alias("x"))
    bounds = sorted({(r["x"]["nk"], r["x"]["th"]) for r in ranges.collect()})[1:]
    root = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + root] for i in range(0, len(bounds), root)] or [[]]
    pair = lambda x: F.struct(F.lit(x[0]).cast("long").alias("nk"), F.lit(x[1]).cast("long").alias("th"))
    kind = "array<struct<nk:bigint,th:bigint>>"
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.struct("nk", "th")))
    rows = F.array(*[F.array(*map(pair, x)).cast(kind) for x in fine])
    base = base.withColumn("g", below(F.array(*[pair(x[0]) for x in fine[1:]]).cast(kind)))
    base = base.withColumn("part", F.col("g") * root + below(F.element_at(rows, F.col("g") + 1))).drop("g")

    # The first row of each part follows the last row of the part above it: one row a part is copied there.
    heads = base.select("part", "nk", "th").groupBy("part").agg(F.min(F.struct("nk", "th")).alias("h")).collect()
    order = sorted((r["part"], r["h"]["nk"], r["h"]["th"]) for r in heads)
    guests = [(nk, th, order[i - 1][0]) for i, (_, nk, th) in enumerate(order)]  # the first row of all goes to the last part
    # One row a part, so within the bound of the parts' number.
    guests = spark.createDataFrame(guests, "gk long, gh long, target int") if guests else spark.createDataFrame([], "gk long, gh long, target int")
    both = base.join(F.broadcast(guests), (F.col("nk") == F.col("gk")) & (F.col("th") == F.col("gh")), "left")
    places = F.when(F.col("target").isNull(), F.array(F.struct("part", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("target").alias("part"), F.lit(1).alias("guest"))))
    both = both.select("doc_id", "text", "nk", "th", F.explode(places).alias("to")).select("doc_id", "text", "nk", "th", "to.part", "to.guest")
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "nk", "th").select("part", "guest", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def digest(rows, following):
        """``following``: the row after the last of ``rows``."""
        texts = [t for _, t in rows]
        spans = [[(m.start(), m.end()) for m in _PARAGRAPH.finditer(t)] for t in texts]
        units = [[t[a:b].strip() for a, b in s] for t, s in zip(texts, spans, strict=True)]
        news = [edited(t, n) for t, n in zip(texts, [*texts[1:], following], strict=True)]
        more = [edited_units(t, s, *new) for t, s, new in zip(texts, spans, news, strict=True)]
        wide, signs = sums([*units, paragraphs(following)])
        # Edited: delete the paragraphs past the kept ones, insert the new ones.
        out_w, out_s = sums([u[m[0] :] for u, m in zip(units, more, strict=True)])
        in_w, in_s = sums([m[1] for m in more])
        new_w, new_s = wide[:-1] - out_w + in_w, signs[:-1] - out_s + in_s
        pack = lambda w, s: [base64.b64encode(a.astype("<u4").tobytes() + b.astype("<i4").tobytes()).decode() for a, b in zip(w, s, strict=True)]
        cols = [
            pa.array([k for k, _ in rows], key_type[0]),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(n.encode("utf-8", "replace")).hexdigest() for n, _ in news]),
            pa.array(pack(wide[:-1], signs[:-1])),
            pa.array(pack(new_w, new_s)),
            pa.array(likeness(wide[:-1], signs[:-1], new_w, new_s)),
            pa.array(likeness(wide[:-1], signs[:-1], wide[1:], signs[1:])),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    key_type = [pa.int64()]

    def run(batches):
        held, part, chars = [], None, 0  # rows of a part that wait for what follows
        for b in batches:
            key_type[0] = b.column(2).type
            for p, guest, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and not (held and part == p):
                    continue
                if held and (guest or len(held) >= ROWS or chars >= CHARS):
                    yield digest(held, text)
                    held, chars = [], 0
                if not guest:
                    held.append((key, text))
                    part, chars = p, chars + len(text)
        assert not held, "each part ends with a guest"

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
