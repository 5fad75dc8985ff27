import math

import numpy as np
import pytest

from spotlake.operators import spectrum as S


@pytest.fixture(scope="module")
def tracks(spark):
    rng, rows = np.random.default_rng(7), []
    for t in range(160):
        d, n = (0.05 if t % 3 else 2.0), int(rng.integers(2, 30))
        frame = np.sort(rng.choice(60, n, replace=False))
        p = np.cumsum(rng.normal(0, np.sqrt(2 * d * 0.02 * np.diff(frame, prepend=frame[0]))[:, None], (n, 2)), 0) * 1000 + rng.normal(0, 20, (n, 2))
        rows += [(len(rows) + i, t, int(f), float(x), float(y), 20.0) for i, (f, (x, y)) in enumerate(zip(frame, p))]
    rows += [(90000, 0, None, 1.0, 1.0, 20.0), (90001, None, 1, 1.0, 1.0, 20.0), (90002, 1, 3, float("nan"), 1.0, 20.0)]
    return rows, spark.createDataFrame(rows, "row_id long, track_id long, frame long, x_nm double, y_nm double, err double").repartition(4)


def plain(rows, d, split=10):
    """Pieces' log-likelihoods from whole covariance matrices."""
    out = {}
    by = {}
    for _, t, f, x, y, e in rows:
        if t is not None and f is not None and math.isfinite(x):
            by.setdefault(t, []).append((f, x / 1000, y / 1000, (e / 1000) ** 2))
    for t, own in by.items():
        own.sort()
        for k in range(0, len(own) - 1, split):
            part = own[k : k + split + 1]
            n, ll = len(part) - 1, np.zeros(len(d))
            for i, g in enumerate(d):
                c = np.zeros((n, n))
                for j in range(n):
                    c[j, j] = 2 * g * 0.02 * (part[j + 1][0] - part[j][0]) + part[j][3] + part[j + 1][3]
                    if j:
                        c[j, j - 1] = c[j - 1, j] = -part[j][3]
                for axis in (1, 2):
                    x = np.diff([p[axis] for p in part])
                    ll[i] -= 0.5 * (x @ np.linalg.solve(c, x) + np.linalg.slogdet(c)[1] + n * math.log(2 * math.pi))
            out[t, k // split] = (n, ll)
    return out


def test_likelihoods_and_occupations(tracks):
    rows, df = tracks
    d = S.grid(1e-2, 10, 25)
    want = plain(rows, d)
    found = S.pieces(df, errors=("err", "err"))
    lik = S.likelihoods(found, 0.02, d)
    got = {(r["track"], r["piece"]): r for r in lik.collect()}
    assert set(got) == set(want)
    for k, (n, ll) in want.items():
        assert got[k]["n_jumps"] == n and got[k]["lik"] == pytest.approx(np.exp(ll - ll.max()), rel=1e-6, abs=1e-12)
    m, w = np.array([np.exp(v - v.max()) for _, v in want.values()]), np.array([n for n, _ in want.values()])
    alpha = np.ones(25) + w.sum() / 25
    for _ in range(4000):
        e = np.exp(S.digamma(alpha) - S.digamma(alpha.sum()))
        alpha = 1 + e * (m.T @ (w / (m @ e)))
    share = alpha / alpha.sum()
    _, seen, post = S.spectrum(df, 0.02, d, rounds=60, errors=("err", "err"))
    assert seen == pytest.approx(share, abs=2e-3) and seen.sum() == pytest.approx(1)
    e = np.exp(S.digamma(alpha) - S.digamma(alpha.sum()))
    for r in post.collect():
        i = list(want).index((r["track"], r["piece"]))
        assert r["d_post"] == pytest.approx(np.exp(m[i] * e @ np.log(d) / (m[i] @ e)), rel=0.02)
    tops = S.peaks(d, seen)
    assert len(tops) == 2 and tops[0][0] == pytest.approx(0.05, rel=0.4) and tops[1][0] == pytest.approx(2, rel=0.4)
    jumps = {k: sum(n for (t, _), (n, _) in want.items() if bool(t % 3) == k) for k in (True, False)}
    assert tops[0][1] == pytest.approx(jumps[True] / sum(jumps.values()), abs=0.06)


def test_pieces_share_a_row(tracks):
    got = S.pieces(tracks[1], split=4).where("track = 2").orderBy("piece").collect()
    for a, b in zip(got, got[1:]):
        assert a["n_jumps"] == 4 and a["rows"][-1] == b["rows"][0]


def test_digamma_and_nothing(spark):
    assert S.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])
    none = spark.createDataFrame([], "row_id long, track_id long, frame long, x_nm double, y_nm double")
    d, seen, post = S.spectrum(none, 0.02, rounds=5)
    assert post.count() == 0 and seen == pytest.approx(np.full(100, 0.01))
