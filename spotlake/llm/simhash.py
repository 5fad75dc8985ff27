"""SimHash near-duplicates, found by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of 32 segments of two bits. The Manhattan distance of
two such points is at most the number of differing bits, so fingerprints within ``radius`` bits are points
within that Manhattan distance. The points are joined in grids: the segments are dealt to radius + 3 blocks;
two points in reach agree in at least 3 blocks, hence share a cell of the grid of those blocks. Within a
cell, pairs beyond the Manhattan bound are dropped, and the others verified on the bits.

Cells of more than ``CELL`` fingerprints aren't paired as rows. Up to ``HUGE``, parts of the cell meet two at a
time in a task, which gives a spanning forest of their links. Beyond, each fingerprint is put to itself and its
neighbours up to half the radius away, and those who meet are linked with the smallest. Either way finds
exactly the same classes, with rows in proportion to the fingerprints.

Equal fingerprints are one point from the start. Links go by classes: (smaller point, point) rows of which
none between different classes is lost, then connected components.

Defined results: a null text is as an empty one, with fingerprint zero, which links like any other; ties
of the bits (exactly half the hashes) give 0; repeated rows are one point; a null doc_id takes part in the
links but isn't a component's id unless no other is there; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tune
from .components import components

#: Seed of the hashes; fingerprints of a cell up to which it is joined with itself; up to which its parts (of
#: about PART) are; beyond, neighbours are named one by one.
SEED, CELL, HUGE, PART = 42, 48, 30_000, 2000
LOW = 0x5555555555555555
#: Hashes whose bits are counted at once.
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned SimHash of a whole text: of its word shingles' XXH64 values, repeats included."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        values = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        begins = [0, *(ends[: len(w) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        values = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    raw = np.array(values, "<u8")
    for i in range(0, len(raw), _STEP):
        ones += np.unpackbits(raw[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, of every row."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: Column) -> Column:
    """The 32 bit counts of two-bit segments, two bits each."""
    high = F.shiftrightunsigned(fp, 1)
    two, one = high.bitwiseAND(fp).bitwiseAND(F.lit(LOW)), high.bitwiseXOR(fp).bitwiseAND(F.lit(LOW))
    return F.shiftleft(two, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two points; the lanes hold 0, 1 or 2."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grids(radius: int) -> list[int]:
    """Lane masks of the grids: every choice of 3 of radius + 3 blocks, one radius for at most each block."""
    n = radius + 3
    edges = [round(32 * i / n) for i in range(n + 1)]
    block = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, 3)]


def links(points: DataFrame, radius: int = 2, bits: bool | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp``, enough to join every two within ``radius`` bits.

    ``bits`` (unless said, beyond 2 bits): cells are of the blocks' bits themselves. Two in reach differ in ``radius`` blocks at most, so they share
    a cell of these too, while a cell of 3 in 7 blocks tells 27 bits apart instead of about 20: fewer meet by chance.
    """
    if radius % 2:
        raise ValueError("the radius is even")
    e = F.col("fp") if (radius > 2 if bits is None else bits) else popcounts(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), e.bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(grids(radius))])
    put = points.select("fp", F.explode(cells).alias("at")).select("fp", "at.grid", "at.cell")
    sizes = put.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    put = cut(put.join(sizes.hint("merge"), ["grid", "cell"]))
    cold = put.where(F.col("n") <= CELL)
    x, y = cold.select("grid", "cell", F.col("fp").alias("a")), cold.select("grid", "cell", F.col("fp").alias("b"))
    pairs = x.join(y.hint("merge"), ["grid", "cell"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(manhattan(popcounts(F.col("a")), popcounts(F.col("b"))) <= radius).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    hot = put.where(F.col("n") > HUGE).select("fp").distinct()
    one_bit = F.array(*[F.lit(signed(1 << i)) for i in range(64)])
    hot = hot.withColumn("m", F.col("fp"))
    for _ in range(radius // 2):
        hot = hot.select("fp", F.explode(F.array_append(F.transform(one_bit, lambda f: f.bitwiseXOR(F.col("m"))), F.col("m"))).alias("m")).distinct()
    least = hot.groupBy("m").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = hot.join(least.hint("merge"), "m").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").union(_warm_links(put.where((F.col("n") > CELL) & (F.col("n") <= HUGE)), radius)).union(met).distinct()


def _warm_links(put: DataFrame, radius: int) -> DataFrame:
    """Links within cells of some size: pairs of parts of a cell meet, each giving a spanning forest at most."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    put = put.withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    put = put.select("grid", "cell", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def forest(table):
        fp = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        rest, a, b = fp.copy(), [], []
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    found = rest[near]
                    a.append(np.full(len(found), x)), b.append(found)
                    todo += [*found]
                    rest = rest[~near]
        a, b = (np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return put.groupBy("grid", "cell", "lo", "hi").applyInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that it is linked with) of every row."""
    own = cut(fingerprints(docs, words))
    points = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(points.select("fp"), radius))
    classes = points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    heads = classes.groupBy("c").agg(F.min("first").alias("component_id"))
    return own.join(classes.join(heads, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Of near copies: words of a shingle, least share of shingles in common as a fraction, bands of least hashes and
#: hashes of a band, texts of a part when a large bucket is verified part by part, and of all least hashes those that
#: have to agree (in one byte) before texts are compared: at the share a pair falls short with a probability below 1e-8.
WORDS, SHARE, BANDS, ROWS, TEXTS, AGREE = 5, (4, 5), 16, 4, 200, 32
#: Differing bits up to which the pipeline's SimHash makes texts candidates; each is checked exactly then.
REACH = 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's five-word shingles, as sorted 64-bit hashes of words in their order; a shorter text is one."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(len(w), WORDS)
    g = np.full(max(1, len(w) - size + 1), size, np.uint64)
    for k in range(size):
        g += h[k : k + len(g)] * _POWERS[k]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(32)))


def signature(text: str | None) -> tuple[np.ndarray, bytes]:
    """A number for each band of least hashes, and a byte of each.

    Texts with a share s in common agree in one band or more with 1 - (1 - s^ROWS)^BANDS.
    """
    values = shingles(text)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(values), 2048):
        least = np.minimum(least, ((values[i : i + 2048, None] ^ _MIX[0]) * _MIX[1]).min(0))
    bands = (least * _MIX[2]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + _MIX[0, :BANDS]
    return bands, (least >> np.uint64(56)).astype(np.uint8).tobytes()


def alike(both, one, other):
    """Whether sets of sizes ``one`` and ``other`` with ``both`` in common have the share or more; exact."""
    return SHARE[1] * both >= SHARE[0] * (one + other - both)


def forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that join the same sets as all pairs that are alike."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(n), size)[np.argsort(codes, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(codes))]
    rest, a, b = np.ones(n, bool), [], []
    for first in range(n):
        todo = [first] if rest[first] else []
        rest[first] = False
        while todo and rest.any():
            x = todo.pop()
            held = [holders[at[c] : at[c + 1]] for c in codes[ends[x] - size[x] : ends[x]]]
            found = np.flatnonzero(rest & alike(np.bincount(np.concatenate(held), minlength=n), size[x], size))
            rest[found] = False
            a.append(np.full(len(found), x)), b.append(found)
            todo += found.tolist()
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))


def _text_key(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _verified(pairs: DataFrame, sketches: DataFrame | None, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of texts those that are alike: first by their sketches (if there are), then exactly."""

    def agree(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint8).reshape(len(t), -1) for i in (2, 3))
            yield t.select(["a", "b"]).filter(pa.array((x == y).sum(1) > AGREE, pa.bool_()))

    if sketches is None:
        pairs = cut(pairs)
    else:
        both = pairs.join(sketches.toDF("a", "sa").hint("merge"), "a").join(sketches.toDF("b", "sb").hint("merge"), "b")
        pairs = cut(both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = cut(texts.join(named.hint("merge"), "h", "left_semi").dropDuplicates(["h"]))
    both = pairs.join(texts.toDF("a", "ta").hint("merge"), "a").join(texts.toDF("b", "tb").hint("merge"), "b")

    def exact(batches):
        held: dict[int, np.ndarray] = {}  # of the latest keys
        for t in batches:
            keep = []
            for pair in zip(*(t.column(i).to_pylist() for i in range(4)), strict=True):
                for h, text in zip(pair[:2], pair[2:], strict=True):
                    if h not in held:
                        if len(held) > 30:
                            held.clear()
                        held[h] = shingles(text)
                one, other = (held[h] if h in held else shingles(x) for h, x in zip(pair[:2], pair[2:], strict=True))
                keep.append(bool(alike(len(np.intersect1d(one, other, True)), len(one), len(other))))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"))


def similar_links(docs: DataFrame) -> DataFrame:
    """(a, b): links of texts (by their keys), each of two that have 0.8 or more of their five-word shingles in common.

    Candidates are texts that meet in a bucket of MinHash bands (two with 0.8 in common meet with a probability of
    0.9997, of whatever length); every link is verified on the sets of shingles. First each text of a bucket is compared
    with the bucket's first, which joins most groups of copies with work in proportion to the texts. Then only
    texts of a bucket that are still in different components are: all pairs in buckets of up to ``CELL`` texts; in larger
    ones the texts outside the bucket's most frequent component meet all, part by part in a task, which gives a spanning
    forest of the links there.
    """
    tune(docs.sparkSession)
    texts = docs.select(_text_key("text").alias("h"), "text")

    def run(batches):
        for b in batches:
            got = [signature(t) for t in b.column(1).to_pylist()]
            at = np.array([g[0] for g in got], np.uint64).reshape(-1, BANDS).view(np.int64)
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * BANDS, pa.int32()), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), at, pa.array([g[1] for g in got], pa.binary())], ["h", "at", "sketch"])

    signatures = cut(texts.mapInArrow(run, "h long, at array<long>, sketch binary").dropDuplicates(["h"]))
    sketches = signatures.select("h", "sketch")
    return _bucket_links(signatures.select("h", F.explode("at").alias("bucket")), sketches, texts)


def simhash_links(docs: DataFrame, radius: int = REACH) -> DataFrame:
    """(a, b): links of texts (by their keys) that SimHash joins and the exact check confirms.

    A bucket is a class of fingerprints that are chained by at most ``radius`` differing bits. Its texts are compared on
    their sets of five-word shingles, as in ``similar_links``: so unlike texts of a class aren't linked.
    """
    tune(docs.sparkSession)
    texts = docs.select(_text_key("text").alias("h"), "text")
    own = fingerprints(texts.withColumnRenamed("h", "doc_id")).withColumnRenamed("doc_id", "h")
    own = cut(own.dropDuplicates(["h"]))
    near = components(links(own.select("fp").distinct(), radius)).toDF("fp", "c")
    put = own.join(near.hint("merge"), "fp", "left").select("h", F.coalesce("c", "fp").alias("bucket"))
    return _bucket_links(put, None, texts)


def _bucket_links(put: DataFrame, sketches: DataFrame | None, texts: DataFrame) -> DataFrame:
    """Links within buckets (h, bucket), enough to join all texts of a bucket that are alike."""
    firsts = put.groupBy("bucket").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    put = cut(put.join(firsts.hint("merge"), "bucket"))
    stars = _verified(put.where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct(), sketches, texts)
    known = components(stars).toDF("h", "c")
    put = put.join(known.hint("merge"), "h", "left").select("bucket", "n", "h", F.coalesce("c", "h").alias("c"))
    open_ = put.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    put = cut(put.join(open_.hint("merge"), "bucket", "left_semi"))
    cold = put.where(F.col("n") <= CELL)
    x, y = (cold.select("bucket", F.col("h").alias(k), F.col("c").alias(f"c{k}")) for k in "ab")
    pairs = x.join(y.hint("merge"), "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
    return stars.union(_verified(pairs, sketches, texts)).union(_hot_links(put.where(F.col("n") > CELL), texts)).distinct()


def _hot_links(put: DataFrame, texts: DataFrame) -> DataFrame:
    """Links in large buckets between texts of different components."""
    most = put.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.sum("k").alias("n"), F.max("k").alias("k"))
    parts = lambda n: F.greatest(F.ceil(n / TEXTS), F.lit(1)).cast("int")
    put = put.drop("n").join(most.select("bucket", "most", parts(F.col("n")).alias("pn"), parts(F.col("n") - F.col("k")).alias("po")).hint("merge"), "bucket")
    part = lambda n: F.pmod(F.xxhash64("h"), n).cast("int")
    meets = put.select("bucket", "h", part(F.col("pn")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("po") - 1)).alias("y"))
    others = put.where(F.col("c") != F.col("most")).select("bucket", "h", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("x"), part(F.col("po")).alias("y"))
    dealt = meets.union(others).distinct().join(texts.join(put.select("h").distinct().hint("merge"), "h", "left_semi").dropDuplicates(["h"]).hint("merge"), "h")

    def joined(table):
        h = table.column("h").to_numpy()
        a, b = (h[i] for i in forest([shingles(t) for t in table.column("text").to_pylist()]))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(joined, "a long, b long")


def similar_components(docs: DataFrame) -> DataFrame:
    """(h, component) of every text that has a near copy, by the texts' keys."""
    return components(similar_links(docs)).withColumnRenamed("node", "h")


def keep_first_simhash(docs: DataFrame) -> DataFrame:
    """As ``keep_first_similar``, with groups of texts that SimHash links and the exact check confirms."""
    return keep_first_similar(docs, simhash_links)


def keep_first_similar(docs: DataFrame, by=similar_links) -> DataFrame:
    """One row of ``docs`` (all columns) of each group of near copies: that of the smallest doc_id.

    Rows are told apart by doc_id and text: of a repeated id, the text of the smaller key stays, and of repeated
    rows the smallest by its JSON. Rows with a null doc_id form groups of their own, of which one row stays. A null
    text is as an empty one; all such rows are copies of each other. An empty table stays empty. Further columns are
    kept, whatever their names.
    """
    whole = docs.select(F.col("doc_id").alias("id"), _text_key("text").alias("h"), F.struct(*docs.columns).alias("row"))
    rows = whole.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    points = rows.groupBy("h", F.isnull("id").alias("none")).agg(F.min(F.struct("id", "n")).alias("x"))
    classes = points.join(components(by(docs.select("text"))).toDF("h", "component").hint("merge"), "h", "left")
    heads = classes.groupBy(F.coalesce("component", "h").alias("c"), "none").agg(F.min(F.struct("x.id", "h", "x.n")).alias("x"))
    stays = cut(heads.select(F.col("x.id").alias("i"), F.col("x.h").alias("t"), F.col("x.n").alias("n")))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t"))
    once = whole.join(stays.where("n = 1").hint("merge"), same, "left_semi").select("row.*")
    again = whole.join(stays.where("n > 1").hint("merge"), same).groupBy("i", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.union(again.select("row.*"))
