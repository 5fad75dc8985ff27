"""Class bigram scores against plain versions: counts, probabilities, gains of the exchange, odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import brown

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def is_held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"Verb{i}" for i in range(30)]
    out = []
    for i in range(300):
        text = " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}s a\t{rng.choice(nouns)}\n" for _ in range(rng.integers(1, 8)))
        out.append((i, text + (f"rare{i} Ünique{i % 90}" if i % 3 else "")))
    return [*out, (7, out[7][1]), (7, out[7][1]), (None, out[8][1]), (None, None), (400, None), (401, ""), (402, " \n\t"), (403, "x" * 2_500_000 + " the noun1"), (404, "the noun1 verb2s " * 150_000)]


@pytest.fixture(scope="module")
def model(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return brown.train(df.where(~brown.held_out()), classes=8)


def test_scores_by_their_definition(spark, rows, model):
    seen = Counter(t for k, x in rows if not is_held(k) for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    of = {w.decode(): int(model.classes[i]) for w, i in model.ids.items()}
    assert {w for w, c in seen.items() if c >= brown.SEEN and len(w.encode()) <= brown.BYTES} | {"\n"} == set(of)
    number = len(model.table)
    table, total, kinds = np.zeros((number, number)), np.zeros(number), np.zeros(number)
    for k, x in rows:
        if not is_held(k):
            ts = tokens(x)
            for a, b in zip(["\n", *ts], ts):
                table[of.get(a, 0), of.get(b, 0)] += 1
    assert (table == model.table).all()
    for w, c in seen.items():
        total[of.get(w, 0)] += c
        kinds[of.get(w, 0)] += 1
    once = sum(c == 1 for c in seen.values())
    share = (total + 0.5 * (kinds + (np.arange(number) == 0))) / (n + 0.5 * (v + 1))

    def step(a, b):
        i, j = of.get(a, 0), of.get(b, 0)
        move = (table[i, j] + brown.PRIOR * share[j]) / (table[i].sum() + brown.PRIOR)
        if j:
            return move * (seen[b] + 0.5) / (total[j] + 0.5 * kinds[j])
        return move * ((seen[b] or once) + 0.5) / (total[0] + once + 0.5 * (kinds[0] + 1))

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "w", "c", "score", "rare")})
    got = brown.score(df.repartition(5), model).collect()
    want = []
    for k, x in rows:
        ts = tokens(x)
        base = sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((str(k), len(ts), sum(t in seen for t in ts), base, sum(math.log10(step(a, b)) for a, b in zip(["\n", *ts], ts))))
    assert len(got) == len(want)
    for g, w in zip(sorted(tuple([str(r[0]), *r[1:]]) for r in got), sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)
    for a in ("\n", "the", "noun1", "never seen"):
        assert sum(step(a, b) for b in [*seen, "never seen"]) == pytest.approx(1)
    held = [g for g in got if g["doc_id"] is not None and is_held(g["doc_id"]) and g["n_tokens"] > 3]
    assert sum(g["score"] for g in held) > 0.8 * sum(g["base_score"] for g in held) and held


def test_words_of_one_use_share_classes(model):
    lists = [set(ws) for ws in model.class_words().values()]
    assert sum(max(sum(w.startswith(k) for w in ws) for k in ("noun", "verb")) / 60 for ws in lists) > 0.9


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    text, of = rng.integers(1, 30, 2000), np.r_[0, 1, rng.integers(2, 7, 28)]

    def table(of):
        t = np.zeros((7, 7))
        np.add.at(t, (of[text[:-1]], of[text[1:]]), 1)
        return t

    w = 9
    right, left = np.bincount(of[text[1:][text[:-1] == w]], minlength=7).astype(float), np.bincount(of[text[:-1][text[1:] == w]], minlength=7).astype(float)
    own = float(((text[:-1] == w) & (text[1:] == w)).sum())
    right[of[w]] -= own
    left[of[w]] -= own
    state = brown.Exchange(table(of))
    state.shift(of[w], right, left, own, -1)
    gain = state.gains(right, left, own)
    worth = [brown.worth(table(np.r_[of[:w], k, of[w + 1 :]])) for k in range(2, 7)]
    assert np.diff(gain[2:]) == pytest.approx(np.diff(worth))
    state.shift(4, right, left, own, 1)
    assert (state.table == table(np.r_[of[:w], 4, of[w + 1 :]])).all() and (state.rows == state.table.sum(1)).all() and (state.cols == state.table.sum(0)).all()


def test_dictionary_is_bounded(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = brown.train(df, classes=3, words=20, rounds=1)
    assert 1 < len(small.ids) <= 21 and small.counts.count() + len(small.ids) - 1 == small.kinds  # the end is in both
    got = brown.score(df, small).collect()
    assert len(got) == len(rows) and all(r["n_known"] == r["n_tokens"] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert brown.scored(none).count() == 0
    held = next(i for i in range(99) if is_held(i))
    got = brown.scored(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(held, True, 4, 0, 0, 0.0, 0.0)]
    got = brown.scored(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in got] == [(None, False, 1, 1, 1)]
