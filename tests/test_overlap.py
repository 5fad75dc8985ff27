import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import overlap as O


@pytest.fixture(scope="module")
def moving(spark):
    """Sites seen again and again while everything drifts."""
    rng = np.random.default_rng(4)
    site = rng.uniform(0, 3000, (40, 2))
    drift = lambda f: np.array([0.35 * f, 25 * np.sin(f / 40)])
    rows = []
    for f in range(120):
        for s in rng.choice(40, 12, replace=False):
            rows.append((len(rows), f, *map(float, site[s] + drift(f) + rng.normal(0, 3, 2))))
    return spark.createDataFrame([*rows, (9999, 3, float("nan"), 1.0)], "row_id long, frame long, x_nm double, y_nm double"), drift


def test_pairs_value_and_gradient(spark, moving):
    df = O.time_windows(moving[0].where("row_id < 300"), 10)
    pairs = O.drift_pairs(df, 60.0)
    rows = df.where("NOT isnan(x_nm)").collect()
    p, w = np.array([[r["x_nm"], r["y_nm"]] for r in rows]), np.array([r["window"] for r in rows])
    mu = np.arange(2 * (w.max() + 1), dtype=float).reshape(-1, 2) * 0.7
    d = p[None] - p[:, None]
    use = (np.hypot(d[..., 0], d[..., 1]) <= 60) & (w[:, None] < w[None])
    assert pairs.count() == use.sum() > 50
    cost = lambda mu: (np.exp(-((d - mu[w][None] + mu[w][:, None]) ** 2).sum(-1) / (4 * 20.0**2)) / 20)[use].sum()
    got = O.overlap(pairs, mu, 20.0).collect()
    assert sum(r["value"] for r in got) == pytest.approx(cost(mu))
    for r in got:
        for k, g in enumerate((r["gx"], r["gy"])):
            step = np.zeros_like(mu)
            step[r["window"], k] = 1e-4
            assert g == pytest.approx((cost(mu + step) - cost(mu - step)) / 2e-4, rel=1e-4, abs=1e-7)


def test_known_drift_is_found(moving):
    df, drift = moving
    got = O.overlap_drift(df, 10, 90.0, 6.0)
    want = np.array([drift(10 * i + 4.5) - drift(4.5) for i in range(12)])
    assert got.shape == (12, 2) and np.abs(got - want).max() < 3.5 and np.abs(got - want).mean() < 1.5
    curve = O.drift_curve(df, got, 10).orderBy("frame").toPandas()
    assert list(curve["frame"]) == list(range(120))
    for i in range(12):
        middle = curve[["d_x_nm", "d_y_nm"]].to_numpy()[10 * i + 4 : 10 * i + 6].mean(0)
        assert np.abs(middle - got[i]).max() < 0.5
    flat = O.drift_curve(df, np.array([[1.0, 2.0], [3.0, 2.0]]), 60).where("frame IN (0, 119)").orderBy("frame").collect()
    assert flat[0]["d_x_nm"] == pytest.approx(1 - 29.5 / 30) and flat[1]["d_x_nm"] == pytest.approx(3 + 29.5 / 30)


def test_descent():
    f = lambda x: (float(((x - [3, -2]) ** 2 * [1, 40]).sum()), 2 * (x - [3, -2]) * [1, 40])
    assert O.minimise(f, np.zeros(2), tolerance=1e-14) == pytest.approx([3, -2], abs=1e-4)
    assert O.widths(90, 6)[0] == 30 and O.widths(90, 6)[-1] == 6


def test_nothing_to_do(spark):
    none = spark.createDataFrame([], "row_id long, frame long, x_nm double, y_nm double")
    assert O.overlap_drift(none, 10, 50.0, 5.0).shape == (0, 2) and O.drift_curve(none, np.zeros((0, 2)), 10).count() == 0
    one = spark.createDataFrame([(1, 5, 0.0, 0.0)], none.schema)
    assert (O.overlap_drift(one, 10, 50.0, 5.0) == 0).all() and O.drift_curve(one, np.zeros((1, 2)), 10).collect()[0]["frame"] == 5
    assert O.time_windows(one.withColumn("w", F.lit(1)), 3).first()["window"] == 0
