"""Density clusters of a spanning tree against a version from the top, on all distances."""

from collections import defaultdict

import numpy as np
import pytest

from spotlake.operators import hierarchy as H


def reach(p, k):
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    core = np.sort(d, 1)[:, min(k, len(p) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def spanning(w):
    inside, best, out = {0}, {i: (w[0, i], 0) for i in range(1, len(w))}, []
    while best:
        i = min(best, key=lambda i: best[i])
        out.append((best[i][0], best[i][1], i))
        inside.add(i)
        del best[i]
        for j in best:
            best[j] = min(best[j], (w[i, j], i))
    return out


def parts(members, edges):
    up = {m: m for m in members}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for _, a, b in edges:
        up[root(a)] = root(b)
    out = defaultdict(set)
    for m in members:
        out[root(m)].add(m)
    return list(out.values())


def from_the_top(p, least, k):
    """The chosen clusters as sets of rows."""
    tree = spanning(reach(p, k))

    def best(members, edges, birth):
        """Stability of the best choice here and below, that choice, and all rows."""
        value, rows, left = 0.0, set(members), members
        while True:
            if not edges:
                return value, [rows]
            top = max(w for w, _, _ in edges)
            rate = 1 / max(top, H.NEAR)
            edges = [e for e in edges if e[0] < top]
            split = parts(left, edges)
            large = [s for s in split if len(s) >= least]
            value += (len(left) - sum(map(len, large)) if len(large) == 1 else len(left)) * (rate - birth)
            if len(large) == 1:
                left, edges = large[0], [e for e in edges if e[1] in large[0]]
                continue
            below = [best(s, [e for e in edges if e[1] in s], rate) for s in large]
            if large and sum(b[0] for b in below) > value or birth == -np.inf:
                return sum(b[0] for b in below), [s for b in below for s in b[1]]
            return value, [rows]

    return tree, best(set(range(len(p))), tree, -np.inf)[1] if len(p) >= least else []


@pytest.mark.parametrize("seed,least,k,held", [(0, 10, 10, 20_000), (1, 8, 4, 30)])
def test_same_as_from_the_top(spark, monkeypatch, seed, least, k, held):
    monkeypatch.setattr(H, "HELD", held)
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 20, 70), ((140, 0), 12, 40), ((150, 60), 8, 30), ((900, 900), 30, 60), ((1500, 0), 5, 12))]
    p = np.concatenate([*(blobs[seed:] if seed else blobs), rng.uniform(-500, 2000, (60 if not seed else 20, 2)), np.repeat([[300.0, 700.0]], 15, 0)])
    df = spark.createDataFrame([(int(i), float(x), float(y), "a") for i, (x, y) in enumerate(p)] + [(5000, float("nan"), 0.0, "b")], "row_id long, x_nm double, y_nm double, comp string").repartition(3)
    tree, want = from_the_top(p, least, k)
    edges, clusters, entries = H.condensed(df, least, k, 150.0)
    got = edges.collect()
    assert len(got) == len(p) - 1 and sum(r["w"] for r in got) == pytest.approx(sum(w for w, _, _ in tree))
    assert clusters.select("cluster").distinct().count() == clusters.count() and entries.select("row").distinct().count() == entries.count() == len(p)
    out = H.hdbscan(df, least, k, 150.0).collect()
    labels = defaultdict(set)
    for r in out:
        assert r["comp"] in "ab"
        labels[r["cluster_id"]].add(r["row_id"])
    none = labels.pop(-1)
    assert 5000 in none and len(want) >= 3
    assert sorted(map(sorted, labels.values())) == sorted(map(sorted, want))
    assert sorted(map(len, labels.values()), reverse=True) == [len(labels[i + 1]) for i in range(len(labels))]
    assert all(r["n_in_cluster"] == (len(labels[r["cluster_id"]]) if r["cluster_id"] > 0 else 0) for r in out)


def test_few_rows(spark):
    none = spark.createDataFrame([], "row_id long, x_nm double, y_nm double")
    assert H.hdbscan(none, 5).count() == 0
    few = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], none.schema)
    assert [r["cluster_id"] for r in H.hdbscan(few, 5).collect()] == [-1] * 3
