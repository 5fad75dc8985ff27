import numpy as np
import pytest
import xxhash

from spotlake.llm import simhash as sh
from spotlake.llm.components import components


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b c", "a b c d " * 50, "é Ü ß\tx\x0by z\x85q r", "x" * 5000])
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_fingerprint(text)


def classes(points, radius):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if bin(int(a) ^ int(points[j])).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {frozenset(i for i in range(len(points)) if find(i) == r) for r in map(find, range(len(points)))}


@pytest.mark.parametrize("cell, huge, part, radius", [(48, 1000, 100, 2), (1, 1000, 7, 2), (1, 1, 100, 2), (48, 1000, 100, 4), (1, 1000, 9, 4)])
def test_links_give_the_classes_of_all_pairs(spark, monkeypatch, cell, huge, part, radius):
    monkeypatch.setattr(sh, "CELL", cell), monkeypatch.setattr(sh, "HUGE", huge), monkeypatch.setattr(sh, "PART", part)
    rng = np.random.default_rng(cell + radius)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    pts = {0, *map(int, base)}
    for b in base:
        x = int(b)
        for _ in range(8):
            for bit in rng.integers(0, 64, rng.integers(1, radius + 2)):
                x ^= 1 << int(bit)
            pts.add(x)
    pts = sorted(pts)
    df = spark.createDataFrame([(sh.signed(p),) for p in pts], "fp long")
    got = {r["node"]: r["component"] for r in components(sh.links(df, radius)).collect()}
    by = {}
    for i, p in enumerate(pts):
        by.setdefault(got.get(sh.signed(p), sh.signed(p)), set()).add(i)
    assert {frozenset(v) for v in by.values()} == classes(pts, radius)


def test_embedding_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 64, 200, dtype=np.uint64) for _ in "ab")
    df = spark.createDataFrame([(sh.signed(int(x)), sh.signed(int(y))) for x, y in zip(a, b, strict=True)], "a long, b long")
    r = df.select(sh.manhattan(sh.popcounts(F.col("a")), sh.popcounts(F.col("b"))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect()
    lanes = lambda x: [bin(int(x) >> 2 * i & 3).count("1") for i in range(32)]
    assert [x["m"] for x in r] == [sum(abs(p - q) for p, q in zip(lanes(x), lanes(y), strict=True)) for x, y in zip(a, b, strict=True)]
    assert all(x["m"] <= x["h"] for x in r)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (4, "A  B\nc"), (4, "A  B\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sh.near_duplicates(df).collect()
    assert len(got) == 6 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 2), (None, 1), (4, 1)}
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    words = ["w%05d" % i for i in range(5000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    near = texts[0].split()
    near[50], near[120] = "changed", "words"
    rows = [*enumerate(texts), (20, texts[3]), (21, " ".join(near)), (22, None), (23, "short text"), (24, "another short text"), (None, texts[3])]
    df = spark.createDataFrame([(i, t, "src", "x") for i, t in rows], "doc_id long, text string, source string, __id string")
    kept = sh.keep_first_similar(df.drop("__id"))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [*range(20), 22, 23, 24]
    assert kept.columns == ["doc_id", "text", "source"] and kept.where("doc_id is null").count() == 1


def share(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def kept_ids(spark, texts):
    return {r["doc_id"] for r in sh.keep_first_similar(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).select("doc_id").collect()}


def test_near_copies_of_short_texts_go(spark):
    rng = np.random.default_rng(3)
    words = ["v%04d" % i for i in range(3000)]
    texts = [" ".join(rng.choice(words, n)) for n in [*range(50, 70)] * 3]
    near = [" ".join([*(w := t.split())[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]) for t in texts]
    assert all(share(a, b) >= 0.8 for a, b in zip(texts, near, strict=True))
    thirty = [" ".join(f"{c}{i} of" for i in range(34)) for c in ("alpha", "beta", "gamma")]
    assert len(kept_ids(spark, [*texts, *thirty, *near, *(f"{t} end" for t in thirty)])) == len(texts) + len(thirty)


@pytest.mark.parametrize("cell, part", [(48, 500), (1, 500), (1, 7)])
def test_components_are_those_of_verified_pairs(spark, monkeypatch, cell, part):
    monkeypatch.setattr(sh, "CELL", cell), monkeypatch.setattr(sh, "TEXTS", part)
    rng = np.random.default_rng(4)
    words = ["u%04d" % i for i in range(2000)]
    texts = []
    for _ in range(8):
        base = [*rng.choice(words, 150)]
        for changed in (0, 1, 2, 2, 3, 5, 9):
            w = [*base]
            for i in rng.choice(150, changed, replace=False):
                w[i] = "other"
            texts.append(" ".join(w))
        texts.append(" ".join(rng.permutation(base)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if share(texts[i], texts[j]) >= 0.8]
    root = [*range(len(texts))]
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert kept_ids(spark, texts) == {i for i, r in enumerate(root) if i == r}


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i:02}" for i in range(30)) for x in "abc")
    rows = [(1, a, "x"), (2, f"{a} end", "x"), (2, b, "x"), (3, c, "y"), (3, c, "x"), (None, a, "x"), (None, f"{a} end", "x"), (None, None, "x")]
    kept = sh.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    named = sorted((r["doc_id"], r["text"], r["source"]) for r in kept if r["doc_id"] is not None)
    assert named == [(1, a, "x"), (2, b, "x"), (3, c, "x")]
    assert sorted((r["text"] or "")[:3] for r in kept if r["doc_id"] is None) == ["", "a00"]


def test_the_pipeline_goes_by_fingerprints_and_an_exact_check(spark, monkeypatch):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(reversed(words))), (4, " ".join(words)), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda: {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, "").collect()}
    assert bin(sh.fingerprint(rows[0][1]) ^ sh.fingerprint(rows[1][1])).count("1") <= sh.REACH
    assert ids() == {1, 2, 5}
    # All in one class of fingerprints: the check alone tells them apart.
    monkeypatch.setattr(sh, "links", lambda points, radius=2: points.agg(sh.F.min("fp").alias("a")).crossJoin(points.withColumnRenamed("fp", "b")))
    assert ids() == {1, 2, 5}
    # Without links of fingerprints only equal texts are left to find.
    monkeypatch.setattr(sh, "links", lambda points, radius=2: points.select(points["fp"].alias("a"), points["fp"].alias("b")).limit(0))
    assert ids() == {1, 2, 3, 5}
