import math

import numpy as np
import pytest

from spotlake.operators import window_stats as W


@pytest.fixture(scope="module")
def window(spark):
    """An L of pixels 10 wide."""
    cells = [(i, j) for i in range(30) for j in range(30) if i < 12 or j < 12]
    return cells, spark.createDataFrame(cells, "px long, py long").repartition(3)


def test_lags_and_covariance(window):
    cells, df = window
    mask = np.zeros((30, 30))
    for i, j in cells:
        mask[j, i] = 1
    got = W.lag_array(df, 6)
    for lx in range(-6, 7):
        for ly in range(-6, 7):
            moved = np.zeros_like(mask)
            moved[max(ly, 0) : 30 + min(ly, 0), max(lx, 0) : 30 + min(lx, 0)] = mask[max(-ly, 0) : 30 + min(-ly, 0), max(-lx, 0) : 30 + min(-lx, 0)]
            assert got[ly + 6, lx + 6] == (mask * moved).sum()
    area = mask.sum() * 100
    c = W.covariance(got, 10.0, np.array([0.0, 5.0, 50.0]))
    assert c[0] == pytest.approx(area) and c[0] > c[1] > c[2] > 0
    # For short distances what is lost is the outline's length times r / pi.
    assert c[1] == pytest.approx(area - 1200 * 5 / math.pi, rel=0.02)


def test_random_rows_are_as_expected(spark, window):
    cells, df = window
    places = W.uniform(df, 10.0, 1500, 1, seed=5).drop("sim")
    inside = places.collect()
    assert len(inside) == 1500 and {(int(r["x_nm"] // 10), int(r["y_nm"] // 10)) for r in inside} <= set(cells)
    rows, test = W.pair_statistics(places, df, 10.0, 60.0, 10.0, simulations=19)
    g = np.array([r["g"] for r in rows])
    assert np.abs(g - 1).max() < 0.12 and test["p"] > 0.05 and all(r["g_low"] <= r["g_high"] for r in rows)
    p = np.array([[r["x_nm"], r["y_nm"]] for r in inside])
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))[~np.eye(1500, dtype=bool)]
    assert [r["n"] for r in rows] == list(np.histogram(d, np.arange(0, 70, 10))[0])
    again, _ = W.pair_statistics(places, df, 10.0, 60.0, 10.0, simulations=19)
    assert again == rows


def test_clusters_leave_the_band(spark, window):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(c, 4, (12, 2)) for c in rng.uniform(20, 100, (30, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(9999, -500.0, 0.0), (9998, float("nan"), 1.0)], "row_id long, x_nm double, y_nm double")
    rows, test = W.pair_statistics(df, window[1], 10.0, 60.0, 10.0, simulations=19)
    assert test["p"] == 0.05 and test["T"] > test["T_crit"] and rows[0]["g"] > 3 * rows[0]["g_high"] > 0


def test_nothing(spark, window):
    none = spark.createDataFrame([], "row_id long, x_nm double, y_nm double")
    rows, test = W.pair_statistics(none, window[1], 10.0, 60.0, 10.0)
    assert rows == [] and math.isnan(test["p"])
    assert W.lag_array(window[1].limit(0), 2).sum() == 0
