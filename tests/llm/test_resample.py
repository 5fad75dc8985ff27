"""Importance resampling against a plain version, with longer runs, odd tables and ties."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spotlake.llm import resample

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) % resample.BUCKETS for r in runs], len(words)


def plain(docs, target, percent, least, longest):
    """docs: (doc_id, text)."""
    found = [plain_features(t, longest) for _, t in docs]
    s, t = Counter(b for f, _ in found for b in f), Counter(b for x in target for b in plain_features(x, longest)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for (key, _), (f, n) in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(order[: percent * len(order) // 100])}
    return sorted((str(r[:4]), rank.get(id(r), 0)) for r in rows)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 50)])
def test_same_as_the_plain_version(spark, longest, percent):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "x1", "größe", "Ünder", "don't", "a b", "日本", "-", " "]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(120)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1] + " more"), (200, None), (201, ""), (202, "--- !!!"), (203, "w" * 3_000_000 + " tail"), (204, "one two three " * 200_000)]
    target = ["alpha alpha größe 日本", None, "", "one two"]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS weight", "2 AS score", "3 AS ids", "4 AS n_words").repartition(7)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(df, aim, percent, 20, longest).collect()
    assert sorted((str([r["doc_id"], r["n_features"], r["weight"], r["score"]]), r["rank"] or 0) for r in got) == plain(docs, target, percent, 20, longest)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    some = spark.createDataFrame([(i, "w " * 30) for i in range(10)], "doc_id long, text string")
    got = resample.resample(some, none).collect()
    assert len(got) == 10 and [r["rank"] for r in got if r["rank"]] == [1]


def test_draw_follows_the_target(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["red", "green"] if i % 2 else ["blue", "black"], 40))) for i in range(400)]
    aim = spark.createDataFrame([(0, "red green " * 500)], "item_id long, text string")
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), aim).where("rank IS NOT NULL").collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got) == list(range(1, 41)) and sum(r["doc_id"] % 2 for r in got) >= 36


def test_streams_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string").coalesce(1)
    row = resample.streams(docs).first()
    assert row["ids"] == [1, 2, 3] and row["features"] == row["words"] == [2, 0, 1] and len(row["stream"]) == 6
    with pytest.raises(ValueError):
        resample.streams(docs, 1, 1 << 17)
