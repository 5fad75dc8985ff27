"""Steps whose cost at size was found wanting in round 3."""

import numpy as np
from pyspark.sql import functions as F

from spotlake.operators import joins as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spots(spark, n=300, seed=3):
    g = np.random.default_rng(seed)
    return spark.createDataFrame([(i, int(g.integers(0, 40)), float(g.uniform(0, 100)), float(g.uniform(0, 100))) for i in range(n)], "row_id long, frame long, x_nm double, y_nm double")


def test_copies_of_rows_are_never_broadcast(spark, tmp_path):
    spots(spark).write.parquet(str(tmp_path / "spots"))
    df = spark.read.parquet(str(tmp_path / "spots"))  # a small file
    assert "Broadcast" not in plan(J.lag_pairs(df, 15.0, 4))
    assert "Broadcast" not in plan(J.cell_pairs(df, df, 15.0, same=True))
    spans = df.select(F.col("row_id").alias("id"), F.col("frame").alias("start"), (F.col("frame") + 3).alias("end"))
    assert "Broadcast" not in plan(J.overlapping(spans, spans, 5))


def test_lag_pairs_by_blocks_are_all_pairs(spark):
    df = spots(spark)
    rows = df.collect()
    for memory in (0, 4):
        got = {(r["a"], r["b"], r["lag"]) for r in J.lag_pairs(df, 15.0, memory).collect()}
        want = {(p["row_id"], q["row_id"], q["frame"] - p["frame"]) for p in rows for q in rows if 1 <= q["frame"] - p["frame"] <= memory + 1 and np.hypot(p["x_nm"] - q["x_nm"], p["y_nm"] - q["y_nm"]) <= 15}
        assert got == want


def test_least_edges_are_those_of_all_pairs(spark):
    from spotlake.operators import hierarchy as H

    g = np.random.default_rng(8)
    rows = [(i, float(x), float(y), float(c), int(k)) for i, (x, y, c, k) in enumerate(zip(g.uniform(0, 60, 200), g.uniform(0, 60, 200), g.uniform(0, 6, 200), g.integers(0, 30, 200)))]
    got = {r["comp"]: (r["w"], r["a"], r["b"]) for r in H.least_edges(spark.createDataFrame(rows, "row long, x double, y double, core double, comp long"), 5.0).collect()}
    want = {}
    for p in rows:
        for q in rows:
            w = max(float(np.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)), p[3], q[3])
            if p[4] != q[4] and w <= 5:
                want[p[4]] = min(want.get(p[4], (np.inf, 0, 0)), (w, min(p[0], q[0]), max(p[0], q[0])))
    assert got == want


def test_ranges_dont_gather_all_values(spark, monkeypatch):
    from spotlake.operators import filters as L

    g = np.random.default_rng(9)
    x = [*g.normal(0, 10, 500).tolist(), float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    monkeypatch.setattr(F, "percentile", None)
    lo, hi = L.quantile_range(df, "x", 0.1, 0.9).first()
    assert np.allclose((lo, hi), np.quantile(x[:500], [0.1, 0.9]))
    a, b, c, d = np.quantile(x[:500], [0.01, 0.25, 0.75, 0.99])
    assert np.allclose(tuple(L.display_range(df, "x").first()), (max(a, b - 3 * (c - b)), min(d, c + 3 * (c - b))))


def test_hidden_sums_side_by_side_are_those_of_single_traces():
    from spotlake.operators import traces as T

    g = np.random.default_rng(4)
    mean, dev, move = np.array([0.0, 3.0]), np.array([1.0, 2.0]), np.array([[0.9, 0.1], [0.3, 0.7]])
    traces = [g.normal(0, 3, n) for n in (1, 7, 2, 7, 30, 1)]
    want = [np.zeros(2), np.zeros(2), np.zeros(2), np.zeros((2, 2))]
    for x in traces:
        e = np.exp(-0.5 * ((x[:, None] - mean) / dev) ** 2) / dev
        f, b = [e[0]], [np.ones(2)]
        for t in range(1, len(x)):
            f.append((f[-1] @ move) * e[t])
            b.insert(0, move @ (e[len(x) - t] * b[0]))
        w = np.array(f) * np.array(b)
        w /= w.sum(1, keepdims=True)
        for k, v in enumerate((np.ones_like(x), x, x * x)):
            want[k] += (w * v[:, None]).sum(0)
        for t in range(len(x) - 1):
            xi = f[t][:, None] * move * (e[t + 1] * b[t + 1])
            want[3] += xi / xi.sum()
    assert all(np.allclose(a, b) for a, b in zip(T._hidden_sums(traces, mean, dev, move), want, strict=True))


def test_cells_of_bits_part_points_of_equal_bit_counts(spark, monkeypatch):
    from spotlake.llm import simhash as S
    from spotlake.llm.components import components

    g = np.random.default_rng(6)
    fps = {sum((1 + int(c)) << 2 * i for i, c in enumerate(g.integers(0, 2, 32))) for _ in range(150)}  # one bit of each two
    fps |= {f ^ 0b11 ^ (0b11 << 20) for f in list(fps)[:20]} | {f ^ (1 << 63) for f in list(fps)[:10]}
    warm, n = S._warm_links, []
    monkeypatch.setattr(S, "_warm_links", lambda put, radius: n.append(put.count()) or warm(put, radius))
    found = components(S.links(spark.createDataFrame([(S.signed(f),) for f in fps], "fp long"), 4, bits=True)).collect()
    assert n == [0]
    got = {r["node"]: r["component"] for r in found}
    want = {f: f for f in fps}
    while True:
        now = {f: min((want[h] for h in fps if (f ^ h).bit_count() <= 4), key=S.signed) for f in fps}
        if now == want:
            break
        want = now
    assert {f: got.get(S.signed(f), S.signed(f)) for f in fps} == {f: S.signed(h) for f, h in want.items()}


def test_colours_meet_by_blocks_without_a_row_for_each_match(spark, monkeypatch):
    from spotlake.operators import colours as C

    g = np.random.default_rng(11)
    rows = [(int(k), int(k) % 2, float(g.integers(0, 60)), float(g.integers(0, 9)), float(g.integers(0, 3))) for k in g.integers(0, 14, 400)]
    df = C.traces(spark.createDataFrame([*rows, *rows[:20]], "trace_id long, channel int, t double, x_nm double, y_nm double"))
    monkeypatch.setattr(C, "matches", None)
    want = []
    for a in range(0, 14, 2):
        for b in range(1, 14, 2):
            d = []
            for t, x, y in {r[2:] for r in rows if r[0] == b}:
                dt, _, p, q = min((abs(u - t), u, p, q) for k, _, u, p, q in rows if k == a)
                if dt <= 1:
                    d.append(np.hypot(x - p, y - q))
            close = sum(v <= 4 for v in d)
            if len(d) >= 4 and close >= 0.6 * len(d):
                want.append((0, a, b, len(d), close, round(float(np.median(d)), 9)))
    for size in (C.BLOCK, (40, 40)):
        monkeypatch.setattr(C, "BLOCK", size)
        got = sorted((*r[:5], round(r[5], 9)) for r in C.pair_candidates(df, 1.0, 4.0, 4, 0.6, -1e9).collect())
        assert got == want and want


def test_molecules_by_rounds_are_those_of_the_walk(spark, monkeypatch):
    from spotlake.operators import colours as C

    g = np.random.default_rng(13)
    spans = {k: (float(a), float(a + g.integers(0, 12))) for k, a in enumerate(g.integers(0, 20, 40))}
    df = C.traces(spark.createDataFrame([(k, k % 2, t, 0.0, 0.0) for k, v in spans.items() for t in v], "trace_id long, channel int, t double, x_nm double, y_nm double"))
    edges = [(0, a, b, 9, int(g.integers(3, 6)), float(g.integers(0, 3))) for a in range(0, 40, 2) for b in range(1, 40, 2) if g.random() < 0.5]
    pairs = spark.createDataFrame(edges, "file long, a long, b long, matched long, close long, separation double")
    of = {k: {k} for k in spans}
    for _, a, b, _, _, _ in sorted(edges, key=lambda e: (-e[4], e[5], e[1], e[2])):
        if not any(i % 2 == j % 2 and max(spans[i][0], spans[j][0]) < min(spans[i][1], spans[j][1]) for i in of[a] for j in of[b]):
            both = of[a] | of[b]
            of |= {k: both for k in both}
    for left in (C.LEFT, 0):
        monkeypatch.setattr(C, "LEFT", left)
        got = {}
        for r in C.pair_traces(df, pairs).collect():
            got.setdefault(r["pair_id"], set()).add(r["trace"])
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in of.values()}


def test_intervals_are_paired_without_their_pairs_as_rows(spark, monkeypatch):
    from spotlake.operators import matching as M

    g = np.random.default_rng(15)
    made = lambda n, top: [(i, float(s), float(s + d), i % 2) for i, (s, d) in enumerate(zip(g.integers(0, top, n), g.integers(0, 30, n)))]
    a, b = made(150, 200), made(120, 200)
    pairs = sorted((-(min(p[2], q[2]) - max(p[1], q[1])), p[0], q[0]) for p in a for q in b if p[3] == q[3] and min(p[2], q[2]) - max(p[1], q[1]) >= 2)
    used, want = set(), set()
    for _, i, j in pairs:
        if (0, i) not in used and (1, j) not in used:
            used |= {(0, i), (1, j)}
            want.add((i, j))
    schema = "id long, start double, end double, file int"
    one, two = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for partners in (M.PARTNERS, 3):
        monkeypatch.setattr(M, "PARTNERS", partners)
        got = M.greedy_overlaps(*(tuple(np.array([r[c] for r in t if r[3] == 1]) for c in range(3)) for t in (a, b)), 2.0)
        assert set(got) == {w for w in want if w[0] % 2}
    monkeypatch.setattr("spotlake.operators.joins.overlapping", None)
    found = M.pair_intervals(one, two, 10.0, 2.0, ("file",)).collect()
    assert {(r["a"], r["b"]) for r in found if r["a"] >= 0 and r["b"] >= 0} == want
    assert len(found) == len(a) + len(b) - len(want)


def test_best_rows_by_rounds_are_those_of_the_walk(spark, monkeypatch):
    from spotlake.operators import matching as M

    g = np.random.default_rng(17)
    score = g.integers(0, 6, 80).tolist()
    links = {(i, j) for i in range(80) for j in range(i + 1, 80) if g.random() < 0.06}
    kept = set()
    for i in sorted(range(80), key=lambda i: (-score[i], i)):
        if not any((min(i, j), max(i, j)) in links for j in kept):
            kept.add(i)
    df = spark.createDataFrame([(i, float(score[i])) for i in range(80)], "row_id long, score double")
    pairs = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a long, b long")
    for left in (M.LEFT, 0):
        monkeypatch.setattr(M, "LEFT", left)
        assert {r["row_id"] for r in M.keep_best(df, pairs, "score").collect()} == kept


def counted(monkeypatch, *modules):
    """The numbers of pairs that ``cell_pairs`` gives from here on."""
    real, n = J.cell_pairs, []

    def spy(*a, **k):
        pairs = real(*a, **k)
        n.append(pairs.count())
        return pairs

    for m in modules:
        monkeypatch.setattr(m, "cell_pairs", spy)
    return n


def crowd(spark, n=600, seed=21):
    """Places in a small field, some of them many times."""
    g = np.random.default_rng(seed)
    p = g.uniform(0, 50, (n, 2))
    p[: n // 4] = p[0]
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "row_id long, x_nm double, y_nm double"), p


def test_nearest_rows_meet_few(spark, monkeypatch):
    df, p = crowd(spark)
    n = counted(monkeypatch, J)
    got = {(r["row_id"], r["rank"]): r["d"] for r in J.nearest_neighbours(df, df, 3, 50.0, same=True).collect()}
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose([[got[i, k] for k in (1, 2, 3)] for i in range(len(p))], np.sort(d, 1)[:, :3])
    assert sum(n) < 40 * len(p)


def test_mutual_rows_meet_few(spark, monkeypatch):
    from spotlake.operators import measure as M

    df, p = crowd(spark)
    n = counted(monkeypatch, J, M)
    a, b = df.where("row_id % 3 = 0"), df.where("row_id % 3 > 0")
    d = np.sqrt(((p[::3, None] - p) ** 2).sum(2))
    d[:, ::3] = np.inf
    to, back = d.argmin(1), d.argmin(0) * 3
    want = {(3 * i, int(j)) for i, j in enumerate(to) if d[i, j] <= 40 and back[j] == 3 * i}
    assert {(r["a"], r["b"]) for r in M.mutual_nearest(a, b, 40.0).collect()} == want and len(want) > 20
    r = M.channel_offset(a, b, 40.0).first()
    off = np.array([p[j] - p[i] for i, j in want])
    assert np.allclose((r["dx"], r["dy"]), np.median(off, axis=0)) and r["n"] == len(want)
    assert sum(n) < 60 * len(p)


def test_pair_sums_of_blocks_are_those_of_pairs(spark, monkeypatch):
    from spotlake.operators import blocks as B

    df, p = crowd(spark, 400)
    df = df.withColumn("sim", F.col("row_id") % 2)
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    apart = ~np.eye(len(p), dtype=bool)
    for size in (B.BLOCK, 30):
        monkeypatch.setattr(B, "BLOCK", size)
        assert B.blocks(df, 20.0).selectExpr("max(size(x))").first()[0] <= max(3 * size, 250)
        got = {(r["sim"], r["bin"]): r["n"] for r in B.histogram(df, df, 17.0, 5.0, True, ("sim",)).collect()}
        for s in (0, 1):
            inside = d[s::2, s::2][apart[s::2, s::2]]
            assert [got[s, k] for k in range(4)] == np.bincount((inside[inside < 17] / 5).astype(int)).tolist()
        a, b = df.where("row_id < 150"), df.where("row_id >= 150")
        of = {r["bin"]: r["n"] for r in B.histogram(a, b, 17.0, 5.0).collect()}
        inside = d[:150, 150:]
        assert [of[k] for k in range(4)] == np.bincount((inside[inside < 17] / 5).astype(int)).tolist()
        means = {r["row_id"]: (r["x_nm"], r["y_nm"], r["n"]) for r in B.near_means(a, B.blocks(b, 6.0), 6.0).collect()}
        near = d[:150, 150:] <= 6
        assert set(means) == set(np.flatnonzero(near.any(1)).tolist())
        assert all(np.allclose(v, [*p[150:][near[i]].mean(0), near[i].sum()]) for i, v in means.items())


def test_sums_over_pairs_make_no_rows_of_pairs(spark, monkeypatch):
    from spotlake.operators import matching as M
    from spotlake.operators import spatial as X
    from spotlake.operators import window_stats as W

    df, _ = crowd(spark, 120)
    n = counted(monkeypatch, J, M, X)
    assert not hasattr(W, "cell_pairs")
    assert X.envelope(df, (0, 0, 50, 50), 20, 10, 3).count() == 2
    assert M.mean_shift(df, df, 10.0, 2).count() == 120
    assert n == []


def test_cuts_dont_gather_all_values(spark, monkeypatch):
    from spotlake.operators import filters as L
    from spotlake.operators import phase as P

    g = np.random.default_rng(23)
    inf = float("inf")
    for more in ([], [float("nan"), None, inf], [-inf] * 3 + [inf] * 150, [inf] * 400, [None] * 3):
        x = [*g.normal(0, 10, 300).round(1).tolist(), *more]
        df = spark.createDataFrame([(v,) for v in x], "x double")
        known = F.when(~F.isnan("x"), F.col("x"))
        for held in (100_000, 20):
            for q in (0.0, 0.2, 0.5, 0.77, 1.0):
                want = df.agg(F.percentile(known, q)).first()[0]
                assert np.array_equal([P.percentile(df, known, q, held)], [want], equal_nan=True)
    monkeypatch.setattr(F, "percentile", None)
    monkeypatch.setattr(F, "median", None)
    few = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100, inf)], "x double")
    assert sorted(r["x"] for r in L.mad_cut(few, "x", 1.0).collect()) == [1.0, 2.0, 3.0, 4.0]
    assert sorted(r["x"] for r in L.below_quantile(few, "x", 0.5).collect()) == [1.0, 2.0, 3.0]
    assert L.mad_cut(few.limit(0), "x").count() == 0


def test_walk_by_frames_is_the_walk_of_the_whole(spark):
    import pandas as pd

    from spotlake.operators import graph as G

    g = np.random.default_rng(21)
    for turn in range(12):
        n = 200
        f = np.sort(g.integers(0, 400 if turn % 2 else 30, n))
        x, y, v = g.uniform(0, 60, n), g.uniform(0, 60, n), g.uniform(1, 9, n)
        o = np.lexsort((x, f))
        x, y, v, ids = x[o], y[o], v[o], np.arange(n) + 5
        precise = turn % 3 == 0
        want = G.walk_links(f, x, y, 9.0, 3, v if precise else None, 2.0, 1.0)
        rows = pd.DataFrame({"component": 1, "__f": f, "__x": x, "__y": y, "__v": v, "row_id": ids})
        walk = G.Walk(9.0, 3, precise, 2.0, 1.0)
        got = pd.concat(list(G.walks((rows.iloc[i : i + 7] for i in range(0, n, 7)), "row_id", lambda: walk)))  # noqa: B023
        assert got["__head"].tolist() == ids[np.unique(want, return_index=True)[1]][want].tolist()
    # However long a component is, only groups of the last frames are held.
    walk = G.Walk(9.0, 3)
    for now in range(20_000):
        walk.frame(now, [float(now % 7 * 100)], [0.0], [0.0], [now])
    assert sum(map(len, walk.cells.values())) <= 1001


def test_linking_reaches_no_farther_than_the_precision(spark, monkeypatch):
    from spotlake.operators import graph as G

    seen, near = [], G.near_in_time
    monkeypatch.setattr(G, "near_in_time", lambda rows, reach, *a: seen.append(reach) or near(rows, reach, *a))
    df = spots(spark).withColumn("err", F.lit(2.0))
    rows = df.orderBy("frame", "x_nm", "row_id").toPandas()
    want = G.walk_links(*(rows[c].to_numpy() for c in ("frame", "x_nm", "y_nm")), 30.0, 2, rows["err"].to_numpy() ** 2, 1.5, 1.0)
    got = {r["row_id"]: r["group_id"] for r in G.link_blinks(df, 30.0, 2, "err", 1.5, 1.0).collect()}
    assert [got[r] for r in rows["row_id"]] == want.tolist() and seen[0] < 7


def test_assignment_over_pairs_is_the_dense_one(spark, monkeypatch):
    from spotlake.operators import graph as G
    from spotlake.operators import spatial as X

    g = np.random.default_rng(4)
    for _ in range(150):
        n, m = g.integers(1, 14, 2)
        pairs = np.unique(np.stack([g.integers(0, n, 40), g.integers(0, m, 40)]), axis=1)
        a, b = (np.unique(p, return_inverse=True)[1] for p in pairs)
        d = g.integers(0, 9, len(a)) / 2 if _ % 2 else g.uniform(0, 5, len(a))
        far = 5.0 * (min(a.max(), b.max()) + 2) + 1
        dense = np.full((a.max() + 1, b.max() + 1), far)
        dense[a, b] = d
        p, q = G.assign(dense)
        want = dense[p, q][dense[p, q] < far]
        for x, y in ((a, b), (b, a)):
            got = G.assign_sparse(x, y, d, far)
            assert len(set(x[got])) == len(set(y[got])) == len(got) == len(want) and np.isclose(d[got].sum(), want.sum())
    # A long chain of rows: a dense matrix of it would take 3.2 GB.
    n = 20_000
    a, b = np.r_[np.arange(n), np.arange(n - 1)], np.r_[np.arange(n), np.arange(1, n)]
    got = G.assign_sparse(a, b, np.r_[np.ones(n), np.full(n - 1, 2.0)], 1e6)
    assert sorted(got.tolist()) == list(range(n))
    monkeypatch.setattr(G, "assign", None)
    f = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 3.0, 0.0)], "row_id long, frame long, x_nm double, y_nm double")
    assert {(r["found"], r["truth"]) for r in X.matched(f, f, 9.0).collect()} == {(0, 0), (1, 1)}


def test_beads_are_judged_side_by_side(spark, monkeypatch):
    from spotlake.operators import beads as B

    g = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 5, 7, 12, 40, 1200):
        x = g.normal(0, 1, (3, n, 2))
        assert np.array_equal(B.largest_steps(x), [B.largest_step(r) for r in x])
    rows = [(b, float(t), float(g.normal())) for b in range(40) for t in range(1 + b % 9)]
    df = spark.createDataFrame(rows, "bead long, t double, x_nm double")
    curves = {None: B.Curve(np.zeros((5, 1)), 0.0, 8.0), 7: B.Curve(np.ones((5, 1)) * np.arange(5)[:, None], 0.0, 8.0)}
    calls, plain = [], B.bead_metrics
    got = plain(df, curves, 0.0, 8.0, ("x_nm",))
    for b in range(40):
        r = np.array([[x] for k, _, x in rows if k == b])
        r = r - curves.get(b, curves[None])(np.arange(len(r)))
        r = r - r.mean(0)
        noise = np.nan
        if len(r) >= 3:
            d = np.diff(r, axis=0)
            noise = float((1.4826 * np.median(np.abs(d - np.median(d)))) ** 2 / 2)
        slow = max(float((r**2).mean()) - (0 if np.isnan(noise) else noise), 0)
        want = [np.sqrt(noise), np.sqrt(slow), B.largest_step(r), len(r)]
        assert np.allclose(got.loc[b, ["noise_nm", "wander_nm", "jump_nm", "n"]].to_numpy(float), want, equal_nan=True)
    # A group of pandas holds many beads, not one each.
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    group = Classic.groupBy
    monkeypatch.setattr(Classic, "groupBy", lambda self, *c: calls.append(c) or group(self, *c))
    plain(df, curves, 0.0, 8.0, ("x_nm",))
    assert calls and "bead" not in [str(c) for k in calls for c in k]


def test_quantiles_share_their_scans(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from spotlake.operators import phase as P

    g = np.random.default_rng(2)
    x = np.r_[g.normal(0, 10, 700), np.full(50, 3.5), 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in [*x, np.nan, np.inf]], "x double")
    qs, scans, collect = (0.0, 0.01, 0.25, 0.6, 0.75, 0.99, 1.0), [], Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: scans.append(1) or collect(self))
    got = P.quantiles(df, F.col("x"), qs, held=20, bins=10)
    assert np.allclose(got, np.quantile(x, qs), rtol=1e-12) and len(scans) < 20
    scans.clear()
    assert np.allclose(P.quantiles(df, F.col("x"), qs), np.quantile(x, qs), rtol=1e-12) and len(scans) <= 3
    assert P.quantiles(df.where("x > 1e10 AND x < 1e300"), F.col("x"), qs) == (None,) * 7
