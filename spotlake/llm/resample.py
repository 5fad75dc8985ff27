"""Importance resampling of documents towards a target distribution, by an external sort-count.

Words (runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case) and their runs of up
to ``longest`` words, joined by one space, are features; a feature's bucket is its unsigned CRC-32 modulo
``buckets``. Every batch of documents is written once as a packed stream of uint16 buckets with the documents'
offsets in it. Each stream is then sorted and run-length encoded, and the runs are added up: a task sends at
most ``buckets`` counts, and the driver holds as many. The gains of the buckets, logarithms of the smoothed ratio
of the target's frequency to the corpus's, are gathered along the streams and summed by document with
``np.add.reduceat``, so texts are read once.

The draw is without replacement: a document's key is its weight plus Gumbel noise hashed from its id, and the
largest keys are taken. Keys are whole numbers of thousandths; with 64-bit counts a gain lies within 88,000 of 0
and the noise between -3,128 and 22,871, so there are about 200,000 different keys at most, whatever the input. Their
counts are what is ranked at the driver; rows are ranked within their key only.

Defined results: a null text has no words, weight 0 and, like every text of less than ``least_words`` words, no
rank; a null id is hashed as an empty text and comes last among ties; rows that repeat an id are separate rows
with the same noise, and of equal keys and ids the one with fewer features, then less weight comes first. Without
any target text the target is uniform. An empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tune

BUCKETS = 10_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: On bytes, where every byte from 0x80 belongs to a character beyond ASCII.
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, so many bytes at a time."""
    text, at = text.lower(), 0  # of bytes: A-Z alone
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def stream(text: bytes, longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Buckets of a text's features and the number of its words."""
    parts, words, last = [], 0, []
    for found in word_lists(text):
        words += len(found)
        parts.append(np.fromiter(map(crc32, found), np.uint32, len(found)))
        if longest > 1:
            held = [*last, *found]
            spaced = [b" " + w for w in held]
            crc = list(map(crc32, held))
            for k in range(2, longest + 1):  # runs of k words that end among the new ones
                crc = list(map(crc32, spaced[k - 1 :], crc))
                crc = crc[: max(0, len(held) - k + 1)]
                new = max(0, k - 1 - len(last))  # runs can't begin before the text
                ends = len(last) + new - (k - 1)
                parts.append(np.array(crc[ends:], np.uint32))
            last = held[-(longest - 1) :]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return (flat % np.uint32(buckets)).astype("<u2"), words


def streams(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row a batch: ids, words and features of its documents, and their features' buckets, packed."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets have to fit into 16 bits")
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [stream(t or b"", longest, buckets) for t in b.column(1).to_pylist()]
            packed = b"".join(s.tobytes() for s, _ in found)
            one = lambda xs, kind: pa.array([xs], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([one(b.column(0).to_pylist(), b.column(0).type), one([n for _, n in found], pa.int64()), one([len(s) for s, _ in found], pa.int64()), pa.array([packed], pa.binary())], ["ids", "words", "features", "stream"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"ids array<{kind}>, words array<long>, features array<long>, stream binary")


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: every stream is sorted and run-length encoded, runs are added up."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column(0):
                ordered = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[begins]] += np.diff(np.r_[begins, len(ordered)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket."""
    k, a, b = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (a + k) / ((s + 1) * (b + k)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every document."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, words = b.column(0)[i].values, b.column(1)[i].values
                n = b.column(2)[i].values.to_numpy()
                got = shared.value[np.frombuffer(b.column(3)[i].as_buffer(), "<u2")]
                some = n > 0  # reduceat gives an empty segment its next value
                total = np.zeros(len(n), np.int64)
                if some.any():
                    total[some] = np.add.reduceat(got, (np.cumsum(n) - n)[some])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(weighted: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    spark = weighted.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = cut(weighted.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    found = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    keys = sorted(((r["score"], r["n"]) for r in found), reverse=True)
    wanted = percent * sum(n for _, n in keys) // 100
    before, above = [], 0
    for score, n in keys:
        if above >= wanted:
            break
        before.append((score, above))
        above += n
    least = before[-1][0] if before else None
    taken = able & (F.col("score") >= least) if before else F.lit(False)
    cols = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~taken).select(*cols, F.lit(None).cast("long").alias("rank"))
    if not before:
        return rest
    # As many rows as there are keys above the cut, see above.
    places = F.broadcast(spark.createDataFrame(before, "score long, above long"))
    own = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = scored.where(taken).join(places, "score").withColumn("rank", F.col("above") + own)
    return ranked.select(*cols, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")).union(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; drawn like the texts of ``target``."""
    packed = cut(streams(docs, longest, buckets))
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(packed, buckets), bucket_counts(aim, buckets))
    return draw(weights(packed, gain), percent, least_words, seed)


#: The same in DuckDB, for runs of one word. crc32 is worked out byte by byte from a table built by its rule.
ORACLE = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), words AS (SELECT k, unnest(ws) AS w FROM docs
), aims AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark
), crcs AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM aims), tab
), counts AS (SELECT bucket, count(*) AS s FROM words JOIN crcs USING (w) GROUP BY bucket
), targets AS (SELECT bucket, count(*) AS t FROM aims JOIN crcs USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)::DOUBLE))) AS gain FROM counts LEFT JOIN targets USING (bucket)
), sums AS (SELECT k, count(*) AS n, sum(gain) AS g FROM words JOIN crcs USING (w) JOIN gains USING (bucket) GROUP BY k
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN floor(g / n) ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN sums USING (k)
), keyed AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n, weight) END AS r FROM keyed
)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
  CASE WHEN r <= (10 * (SELECT count(*) FROM ranked WHERE n >= 20)) // 100 THEN r END::BIGINT AS rank FROM ranked
"""
