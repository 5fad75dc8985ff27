import math

import numpy as np
import pytest

from spotlake.operators import quality as Q


def frame(spark, v):
    return spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (-3.0,)], "v double").repartition(3)


def test_valley_between_one_and_two_molecules(spark):
    rng = np.random.default_rng(0)
    got = Q.upper_valley(frame(spark, np.r_[rng.normal(100, 12, 3000), rng.normal(180, 15, 900)]), "v")
    assert got.valley and got.peak == pytest.approx(100, abs=6) and 125 < got.bound < 160
    alone = Q.upper_valley(frame(spark, rng.normal(100, 12, 3000)), "v")
    assert not alone.valley and 118 < alone.bound < 145
    none = Q.upper_valley(frame(spark, [1.0] * 5), "v")
    assert math.isnan(none.peak) and math.isnan(none.bound)


def test_smoothing_keeps_the_sum_and_mirrors_the_ends():
    c = np.r_[5.0, np.zeros(30), 7.0]
    s = Q.smooth(c, 2.0)
    assert len(s) == 32 and s.sum() == pytest.approx(12) and s[0] > s[1] and Q.smooth(np.ones(40), 2.0) == pytest.approx(np.ones(40))


def test_decay(spark):
    rng = np.random.default_rng(1)
    f = rng.exponential(300, 6000)
    got = Q.frame_decay(frame(spark, np.floor(f[f < 1000])).where("v >= 0"), "v", 0.0, 1000.0)
    assert got["decay_frames"] == pytest.approx(300, rel=0.06) and got["first_rate"] > 5 * got["last_rate"] and got["median_frame"] == np.median(np.floor(f[f < 1000]))
    flat = Q.frame_decay(frame(spark, np.arange(1000)).where("v >= 0"), "v")
    assert flat["decay_frames"] == math.inf and flat["first_rate"] == pytest.approx(1, abs=0.02)
    few = Q.frame_decay(frame(spark, [3.0, 4.0]).where("v >= 0"), "v")
    assert math.isnan(few["decay_frames"]) and few["n"] == 2
    assert Q.frame_decay(frame(spark, []).where("v >= 0"), "v")["n"] == 0
