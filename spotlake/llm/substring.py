"""Removal of repeated word windows, by compressed FM-indexes of content shards.

A window is ``WINDOW`` words in a row. Its anchor is the smallest hash among its runs of ``GRAM`` words, so
equal windows have equal anchors wherever they stand, and windows in a row mostly share one. Documents are
cut to fragments of windows with one anchor, and a fragment goes to the shard of its anchor; a shard so
holds every occurrence of its windows, and documents are matched with one shard's index a fragment, not
with every shard's. Fragments whose anchor occurs once in the corpus can't repeat and are not sent.

Each shard builds an FM-index of its fragments and streams them through it: backward search over a wavelet
matrix gives each window's interval; the window goes if the interval's first occurrence, by (doc_id, start),
is earlier than its own.

A task sends equal fragments once: of those that it has seen, all but the first are known to repeat. An
anchor with more than ``HOT`` fragments has them cut to single windows, sent by the window's own hash, so
that a passage of very many documents neither gathers in one shard nor grows with them.

Defined results: a null text has no words; a null doc_id comes after all others; rows of one doc_id with
different texts are ordered by a hash of the text; rows of one doc_id and text are one document and get the
same result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, tune
from .fm_index import FMIndex

WINDOW, GRAM, HOT = 20, 5, 400
#: Windows in a fragment at most, fragments for which there is one shard, and contents that a task holds.
RUN, SHARD, HELD = 64, 30_000, 60_000
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor, first window, windows and multiplicity of each fragment of a document, from its words' hashes.

    The multiplicity is 2 where the document has the anchor's words more than once, as one fragment may then
    hold equal windows.
    """
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(3))
    g = np.zeros(len(h) - GRAM + 1, np.uint64)
    for k, p in enumerate(_POWERS):
        g += h[k : k + len(g)] * np.uint64(p)
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    span, least, goal = 1, g, window - GRAM + 1
    while span * 2 <= goal:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[goal - span : goal - span + n])
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([begins, [n]]))
    if (size > RUN).any():  # long runs in pieces
        pieces = -(-size // RUN)
        owner = np.repeat(np.arange(len(begins)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins, size = begins[owner] + k * RUN, np.minimum(RUN, size[owner] - k * RUN)
    anchor, ordered = least[begins], np.sort(g)
    again = np.isin(anchor, ordered[1:][ordered[1:] == ordered[:-1]])
    # 48 bits tell anchors apart; a chance meeting only sends a fragment that needn't be.
    return (anchor >> np.uint64(16)).view(np.int64), begins.astype(np.int32), size.astype(np.int32), 1 + again.astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """__d and __t, the order of documents and what tells them apart, and each whole row as one column ``row``.

    Both joins with the texts are of just this, so Spark shuffles the texts once.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__d")
    return docs.select(d, F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int").alias("__t"), F.struct(*docs.columns).alias("row"))


def _runs(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [anchors(word_hashes(words_of(t)), window) for t in b.column(2).to_pylist()]
            times = np.array([len(g[0]) for g in got])
            d, t = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
            cols = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, (np.int64, *[np.int32] * 3)[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int32()), *map(pa.array, cols)], ["__d", "__t", "anchor", "w", "n", "m"])

    return rows.select("__d", "__t", "row.text").mapInArrow(run, "__d long, __t int, anchor long, w int, n int, m int")


def _fragments(rows: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard, __d, __t, w, n, words): what goes to the shards; shard -1: windows known to repeat."""
    names = ["shard", "__d", "__t", "w", "n", "words"]
    schema = pa.schema([("shard", pa.int32()), ("__d", pa.int64()), ("__t", pa.int32()), ("w", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], names)

    def run(batches):
        first: dict[bytes, tuple] = {}  # by content: the first place in this task, windows, words, shard

        def drain():
            rest = [(shard, d, t, w, n, piece) for (d, t, w), n, piece, shard in first.values()]
            first.clear()
            for i in range(0, len(rest), 5000):
                yield batch(rest[i : i + 5000])

        def later(own, n, piece, shard):
            """The place of these words that is now known to repeat another, if one is."""
            key = xxhash.xxh3_128_digest(piece)
            held = first.get(key)
            if held is None or own < held[0]:
                first[key] = (own, n, piece, shard)
                return held and held[0]
            return own if own > held[0] else None

        for b in batches:
            out = []
            cols = [b.column(b.schema.get_field_index(c)) for c in ("__d", "__t", "row", "found")]
            cols[2] = cols[2].field("text")
            for d, t, text, found in zip(*(c.to_pylist() for c in cols), strict=True):
                if not found:
                    continue
                words = words_of(text)
                for f in found:
                    w, n = f["w"], f["n"]
                    if not f["hot"]:
                        if gone := later((d, t, w), n, b" ".join(words[w : w + n + window - 1]), f["anchor"] % shards):
                            out.append((-1, *gone, n, b""))
                        continue
                    run_of = 0  # windows in a row that repeat
                    for at in range(w, w + n):
                        piece = b" ".join(words[at : at + window])
                        gone = later((d, t, at), 1, piece, xxhash.xxh3_64_intdigest(piece) % shards)
                        if gone == (d, t, at):
                            run_of += 1
                            continue
                        if gone:
                            out.append((-1, *gone, 1, b""))
                        if run_of:
                            out.append((-1, d, t, at - run_of, run_of, b""))
                        run_of = 0
                    if run_of:
                        out.append((-1, d, t, w + n - run_of, run_of, b""))
            yield batch(out)
            if len(first) > HELD:
                yield from drain()
        yield from drain()

    return rows.mapInArrow(run, "shard int, __d long, __t int, w int, n int, words binary")


def match_shard(d: np.ndarray, t: np.ndarray, w: np.ndarray, n: np.ndarray, pieces: list[bytes], window: int) -> np.ndarray:
    """Of one shard's fragments: (fragment, first window, windows) of the runs that repeat an earlier occurrence."""
    split = [p.split(b" ") for p in pieces]
    h = word_hashes([x for s in split for x in s])
    _, number = np.unique(h, return_inverse=True)
    length = n.astype(np.int64) + window - 1
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int((length + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + length] = False
    text[inside] = number + 1
    index = FMIndex(text, window)
    # The order of windows among all of the shard, by document and start.
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place, start = begin[owner] + offset, w[owner] + offset
    by = np.lexsort((start, t[owner], d[owner]))
    new = np.concatenate([[True], (np.diff(d[owner][by]) != 0) | (np.diff(t[owner][by]) != 0) | (np.diff(start[by]) != 0)])
    turn = np.full(len(text), np.iinfo(np.int64).max)
    turn[place[by]] = np.cumsum(new)
    earliest = np.minimum.reduceat(turn[index.order], index.begins)
    gone = np.zeros(len(text), bool)
    for _, at, lo, _ in index.statistics(text, begin, length):
        gone[at] = earliest[index.group[lo]] < turn[at]
    flag = gone[place]
    starts = np.flatnonzero(flag & np.concatenate([[True], ~flag[:-1] | (owner[1:] != owner[:-1])])) if len(flag) else np.zeros(0, np.int64)
    ends = np.flatnonzero(flag & np.concatenate([~flag[1:] | (owner[1:] != owner[:-1]), [True]])) if len(flag) else starts
    return np.stack([owner[starts], start[starts], ends - starts + 1])


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__d, __t, gone): by document the runs (first window, windows) that occur earlier; ``rows``: from keyed()."""
    tune(rows.sparkSession)
    runs = cut(_runs(rows, window))
    shards = max(partitions(rows), -(-runs.count() // SHARD))
    often = runs.groupBy("anchor").agg(F.sum("m").alias("times")).where("times > 1")
    found = runs.join(often, "anchor").select("__d", "__t", F.struct("anchor", "w", "n", (F.col("times") > HOT).alias("hot")).alias("f"))
    found = found.groupBy("__d", "__t").agg(F.collect_set("f").alias("found"))
    sent = _fragments(rows.join(found.hint("shuffle_hash"), ["__d", "__t"], "left"), shards, window)

    def match(key, table):
        d, t, w, n = (table.column(c).to_numpy() for c in ("__d", "__t", "w", "n"))
        if len(d) and key[0].as_py() >= 0:
            own, w, n = match_shard(d, t, w, n, table.column("words").to_pylist(), window)
            d, t = d[own], t[own]
        return pa.table({"__d": pa.array(d, pa.int64()), "__t": pa.array(t, pa.int32()), "w": pa.array(w, pa.int32()), "n": pa.array(n, pa.int32())})

    # Rows that need no index are dealt to as many groups, below zero.
    sent = sent.withColumn("shard", F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("__d", "w"), F.lit(shards)).cast("int")).otherwise(F.col("shard")))
    gone = sent.groupBy("shard").applyInArrow(match, "__d long, __t int, w int, n int")
    return gone.groupBy("__d", "__t").agg(F.collect_list(F.struct("w", "n")).alias("gone"))


def covered(n_words: int, gone: list | None, window: int) -> np.ndarray:
    """Which words lie in a window that goes."""
    edge = np.zeros(n_words + 1, np.int64)
    for g in gone or []:
        edge[g["w"]] += 1
        edge[g["w"] + g["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = keyed(docs.select("doc_id", "text"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        for b in batches:
            out = []
            ids, texts = b.column(b.schema.get_field_index("row")).flatten()
            for key, text, gone in zip(ids.to_pylist(), texts.to_pylist(), b.column(b.schema.get_field_index("gone")).to_pylist(), strict=True):
                words = words_of(text)
                lost = covered(len(words), gone, window) if gone else None
                kept = words if lost is None else [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                out.append((key, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = [*zip(*out, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (ids.type, pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = rows.join(repeats(rows, window).hint("shuffle_hash"), ["__d", "__t"], "left")
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def without(text: str, gone: list, window: int) -> str:
    """The text without the words of the windows, and without the white space after each."""
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in _WORD.finditer(raw)]
    lost = covered(len(spans), gone, window)
    ends = [a for a, _ in spans[1:]] + [len(raw)]
    return (raw[: spans[0][0]] + b"".join(raw[a:e] for (a, _), e, x in zip(spans, ends, lost.tolist(), strict=True) if not x)).decode().strip()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (all columns, whatever their names) with repeated windows taken out of text, and n_chars following.

    Null, empty and repeated rows, ties of doc_id and empty tables are as the module says; every row stays.
    """
    names = docs.columns
    rows = keyed(docs)
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            row, gone = (b.column(b.schema.get_field_index(c)) for c in ("row", "gone"))
            cols, gone = row.flatten(), gone.to_pylist()
            old = cols[at].to_pylist()
            new = [without(t, g, window) if g and t else t for t, g in zip(old, gone, strict=True)]
            cols[at] = pa.array(new, cols[at].type)
            if count is not None:
                n = [len(x) if g and x is not None else c for x, g, c in zip(new, gone, cols[count].to_pylist(), strict=True)]
                cols[count] = pa.array(n, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = docs.schema
    return rows.join(repeats(rows, window).hint("shuffle_hash"), ["__d", "__t"], "left").mapInArrow(run, schema)


#: The same in DuckDB.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), wins AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM docs WHERE len(w) >= 20)
), marked AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM wins) WHERE nth > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS g FROM marked GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n_words,
    CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(len(w)), lambda i: NOT list_contains(g, i)), lambda i: w[i + 1]) END AS k
  FROM docs d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
