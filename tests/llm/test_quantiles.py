"""Quantile summaries against plain sorting: bounds, sizes, exact ranks, skewed groups and odd tables."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import quantiles as q

ONE = ["stream", "grp", "batch", "i"]


def plain_rows(clicks, lines, items):
    """(stream, grp, batch) -> x of every row."""
    out, seen = defaultdict(list), {}
    put = lambda stream, grp, key, money: [out[stream, grp, b].append(math.floor(100 * money + 0.5) + 1000 * batch) for batch in [zlib.crc32(("" if key is None else str(key)).encode()) % 4] for b in (batch, -1)]
    for key, client, value in clicks:
        if client is not None and value is not None and math.isfinite(value):
            seen[key] = min(seen.get(key, (client, value)), (client, value))
    for key, (client, value) in seen.items():
        put("value", str(client), key, value)
    for item, vendor in lines:
        for i, brand, price in items:
            if item is not None and i == item and brand is not None and price is not None:
                put("price", brand, vendor, price)
    return out


def check(got, want, parts=4):
    keys = {(*k, i) for k, v in want.items() if len(v) >= 20 for i in range(1, parts)}
    assert {tuple(r[c] for c in ONE) for r in got} == keys and len(got) == len(keys)
    last = {}
    for r in sorted(got, key=lambda r: tuple(r[c] for c in ONE)):
        xs = np.sort(want[r["stream"], r["grp"], r["batch"]])
        n = len(xs)
        target = -(-r["i"] * n // parts)
        assert (r["n"], r["target"], r["exact_x"]) == (n, target, xs[target - 1])
        assert r["n_below"] == np.searchsorted(xs, r["answer"]) and r["n_upto"] == np.searchsorted(xs, r["answer"], "right")
        assert r["rank_error"] == max(0, r["n_below"] + 1 - target, target - r["n_upto"]) and r["within"] is True and 1000 * r["rank_error"] <= 20 * n
        assert min(10, len(set(xs.tolist()))) <= r["points"] <= min(n, 1000) and xs[0] <= r["answer"] <= xs[-1]
        k = (r["stream"], r["grp"], r["batch"])
        assert r["answer"] >= last.get(k, r["answer"])
        last[k] = r["answer"]


@pytest.mark.parametrize("partitions,fan", [(3, 64), (9, 2)])
def test_answers_against_sorting(spark, monkeypatch, partitions, fan):
    monkeypatch.setattr(q, "FAN", fan)
    monkeypatch.setattr(q, "BLOCK", 700)
    rng = np.random.default_rng(partitions)
    client = lambda i: None if i % 50 == 0 else int(7 if i % 3 == 0 else rng.integers(0, 60))
    clicks = [(i, client(i), None if i % 70 == 0 else round(float(rng.lognormal(3, 1.5)) - 5, 2)) for i in range(6000)]
    clicks += clicks[:300] + [(9999, 3, 5.0), (9999, 3, 1.0), (None, 3, 2.0), (None, 4, 2.5), (10000, 5, float("nan")), (10001, 5, float("inf"))]
    items = [(i, None if i == 9 else f"B{i % 4}", None if i == 8 else 10.0 if i % 5 else round(i * 1.37, 2)) for i in range(200)]
    lines = [(None if i % 40 == 0 else int(rng.integers(0, 210)) if i % 3 else 12, None if i % 45 == 0 else int(rng.integers(0, 30))) for i in range(3000)]
    a = spark.createDataFrame(clicks, "click_id long, client_id long, value double").withColumns({c: F.lit("a") for c in ("batch", "x", "n", "stream")}).repartition(partitions)
    b = spark.createDataFrame(lines, "item_id long, vendor_id long").withColumns({c: F.lit(1.5) for c in ("brand", "price", "batch", "money")}).repartition(partitions)
    c = spark.createDataFrame(items, "item_id long, brand string, price double").withColumn("batch", F.lit(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.files.openCostInBytes", "100000000")  # a task a file
        got = q.shop_quantiles(a, b, c).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    check(got, plain_rows(clicks, lines, items))
    assert len({r["grp"] for r in got if r["stream"] == "value"}) > 40


def test_tuples_bound_every_rank(spark, monkeypatch):
    monkeypatch.setattr(q, "BLOCK", 500)
    rng = np.random.default_rng(8)
    rows = [("a", int(rng.integers(0, 3)), int(x), 1) for x in rng.integers(0, 100_000, 9000)] + [("b", 0, 5, 10_000), ("b", 1, 9, 1), *(("b", 1, 100 + i, 1) for i in range(300)), (None, 0, 1, 1), ("c", None, 1, 1), ("c", 0, None, 1)]
    df = spark.createDataFrame(rows, "k string, batch int, x long, n long").repartition(6)
    want = defaultdict(list)
    for k, b, x, n in rows:
        if None not in (k, b, x):
            for at in (b, -1):
                want[k, at] += [x] * n
    found = defaultdict(list)
    for r in q.summarise(q.counted(df, ["k"]), ["k"]).collect():
        found[r["k"], r["batch"]].append((r["x"], r["g"], r["delta"]))
    assert set(found) == set(want)
    for key, tuples in found.items():
        xs, low = np.sort(want[key]), 0
        tuples.sort()
        assert sum(g for _, g, _ in tuples) == len(xs) and tuples[0][0] == xs[0] and tuples[-1][0] == xs[-1]
        assert min(q.LEAST, len(set(xs.tolist()))) <= len(tuples) <= 1000
        for x, g, d in tuples:
            low += g
            assert low <= np.searchsorted(xs, x, "right") <= low + d


def test_compression_keeps_its_bound():
    rng = np.random.default_rng(0)
    for n in (101, 5000, 20000):
        x, g = np.arange(n), rng.integers(1, 9, n)
        for most in (2, 40, 0.004 * g.sum()):
            a, b, d = q.compress(x, g, np.zeros(n, np.int64), most)
            assert b.sum() == g.sum() and a[0] == 0 and a[-1] == n - 1 and (np.cumsum(b) == np.cumsum(g)[a]).all()
            assert ((b <= max(most, 8)) & (d == 0)).all() and len(a) >= q.LEAST


def test_empty_tables(spark):
    clicks = spark.createDataFrame([], "click_id long, client_id long, value double")
    lines, items = spark.createDataFrame([], "item_id long, vendor_id long"), spark.createDataFrame([], "item_id long, brand string, price double")
    out = q.shop_quantiles(clicks, lines, items)
    assert out.count() == 0 and out.columns == ["stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
