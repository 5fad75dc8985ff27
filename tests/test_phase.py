import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import phase as P

K = 2 * math.pi / 250


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 3000
    frame, z = rng.integers(0, 6000, n), rng.uniform(-400, 400, n)
    err = rng.uniform(15, 40, n)
    phase = np.angle(np.exp(1j * (K * z + 0.9 * frame / 1000 + rng.normal(0, 0.15, n))))
    env = z + 1.5 * err * rng.normal(size=n)
    got = [(i, int(frame[i]), float(phase[i]), 0.15, float(env[i]), float(err[i]), float(z[i])) for i in range(n)]
    got += [(n, 5, float("nan"), 0.1, 1.0, 1.0, 0.0), (n + 1, 5, 1.0, 0.1, float("nan"), 1.0, 0.0), (n + 2, 5, 1.0, 0.1, 2.0, None, 0.0)]
    return spark.createDataFrame(got, "row_id long, frame long, phase_rad double, phase_err_rad double, z_env_nm double, z_env_err_nm double, z_true double")


@pytest.mark.parametrize("smoothing", [1, 2, 3])
def test_windows(rows, smoothing):
    d = rows.dropna().toPandas()
    d = d[np.isfinite(d["phase_rad"]) & np.isfinite(d["z_env_nm"])]
    w = 1 / (d["phase_err_rad"] ** 2 + (K * d["z_env_err_nm"]) ** 2)
    win = ((d["frame"] - d["frame"].min()) // 500).to_numpy()
    sums, weight, square, count = np.zeros(win.max() + 1, complex), *np.zeros((3, win.max() + 1))
    np.add.at(sums, win, w * np.exp(1j * (d["phase_rad"] - K * d["z_env_nm"])))
    for a, v in ((weight, w), (square, w * w), (count, 1)):
        np.add.at(a, win, v)
    sums, weight, square, count = (np.convolve(v, np.ones(smoothing), "same") for v in (sums, weight, square, count))
    got = P.cavity_phase(rows, K, 500, smoothing).orderBy("window").toPandas()
    assert got["phase0"].to_numpy() == pytest.approx(np.unwrap(np.angle(sums / weight))) and list(got["n"]) == list(count)
    assert got["error"].to_numpy() == pytest.approx(np.sqrt(-2 * np.log(np.abs(sums / weight))) / np.sqrt(weight**2 / square))
    assert np.diff(got["phase0"]).mean() == pytest.approx(0.45, abs=0.15)


def test_known_fringes_are_found(rows):
    windows = P.cavity_phase(rows, K, 500)
    at = P.with_cavity_phase(rows, windows.where("window NOT IN (0, 4, 5)"), 500)
    d = at.dropna().toPandas()
    assert np.abs(d["phase0_rad"] - 0.9 * d["frame"] / 1000).max() < 0.5
    out = P.unwrapped(P.with_cavity_phase(rows, windows, 500), K)
    d = out.toPandas().set_index("row_id")
    good = d[d.index < 3000]
    right = (good["z_nm"] - good["z_true"]).abs() < 100
    assert right.mean() > 0.93 and good["fringe_probability"].mean() == pytest.approx(right.mean(), abs=0.03)
    assert good["z_err_nm"].iloc[0] == pytest.approx(0.15 / K) and (good["z_nm"] - good["z_true"])[right].std() < 9
    assert d.loc[3000:3002, "z_nm"].isna().all() and (d.loc[3000:3002, "fringe"] == 0).all()
    loose = P.unwrapped(P.with_cavity_phase(rows, windows, 500), K, calibrate=False).toPandas().set_index("row_id")
    assert loose["fringe_probability"].mean() > d["fringe_probability"].mean()


def test_slope(rows):
    known = rows.withColumn("z_env_err_nm", F.col("z_env_err_nm") * 1.5)  # as large as they are
    assert P.refined_slope(known, K * 1.05, 500) == pytest.approx(K, rel=0.01)
    assert P.refined_slope(rows.limit(10), K) == K


def test_quantile(spark):
    rng = np.random.default_rng(1)
    v = np.round(np.r_[rng.lognormal(0, 3, 5000), np.full(3000, 2.5), -1.0], 4)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.123, 0.5, 0.9, 1.0):
        assert P.quantile(df, F.col("v"), q, held=50, bins=10) == pytest.approx(float(np.quantile(v, q)))
    assert P.quantile(df.limit(0), F.col("v")) is None


def test_nothing(rows):
    assert P.cavity_phase(rows.limit(0), K).count() == 0
    with pytest.raises(ValueError):
        P.with_cavity_phase(rows, P.cavity_phase(rows.limit(0), K), 500)
