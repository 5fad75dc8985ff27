import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import steps as S


def plain_grow(x, most):
    """The same by its definition, everything anew for each step."""
    err = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum()) if b > a else 0.0

    def best(a, b):
        edge = 1 if b - a < 4 else 2
        at = range(a + edge, b - edge + 1)
        if b - a < 2 or not at:
            return a + (b - a) // 2, 0.0
        gain = [err(a, b) - err(a, k) - err(k, b) for k in at]
        return at[int(np.argmax(gain))], max(gain)

    cuts, order, ratio = [0, len(x)], [], []
    while True:
        parts = list(zip(cuts, cuts[1:]))
        found = [best(a, b) for a, b in parts]
        marks = [0, *sorted(k for (a, b), (k, _) in zip(parts, found) if b - a >= 2), len(x)]
        fit = sum(err(a, b) for a, b in parts)
        ratio.append(sum(err(a, b) for a, b in zip(marks, marks[1:])) / fit if fit > 0 else 1.0)
        able = [(g, k) for (a, b), (k, g) in zip(parts, found) if b - a >= 4 and g > 0]
        if len(order) == most or not able:
            return order, ratio
        order.append(max(able, key=lambda x: x[0])[1])
        cuts = sorted([*cuts, order[-1]])


def plain_steps(x, threshold, part):
    left, kept = x.astype(float), []
    for _ in (1, 2):
        order, ratio = plain_grow(left, int(np.ceil(len(x) * part)))
        s = np.maximum(ratio, 1) - 1
        s = s - np.linspace(0, s[-1], len(s))
        best = int(np.argmax(s))
        kept += order[:best] if s.max() > threshold else []
        cuts = [0, *sorted(order[:best]), len(x)]
        left = left - np.concatenate([np.full(b - a, left[a:b].mean()) for a, b in zip(cuts, cuts[1:])])
    return sorted(set(kept))


@pytest.mark.parametrize("seed", range(4))
def test_growing_is_the_definition(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 5, 8), rng.integers(3, 15, 8)) + rng.normal(0, 1, 1)[0]
    x = x + rng.normal(0, 0.6, len(x))
    order, ratio = S.grow(x, len(x) // 3)
    want, curve = plain_grow(x, len(x) // 3)
    assert order == want and ratio == pytest.approx(curve, rel=1e-6)
    assert S.s_curve_steps(x) == plain_steps(x, 0.15, 0.25)


def test_known_steps_are_found(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for k in range(12):
        n = rng.integers(25, 60, 8)
        size = np.where(np.arange(8) % 3 == 2, 3.0, 10.0)  # two sizes: the second round's
        level = np.cumsum(size)
        x = np.repeat(level, n) + rng.normal(0, 0.7, n.sum())
        want[k] = np.cumsum(n)[:-1]
        rows += [(k, i * 0.5, float(v), 1) for i, v in enumerate(x)]
    rows += [(None, 1.0, 1.0, 1), (3, None, 1.0, 1), (3, 4.0, float("nan"), 1)]
    df = spark.createDataFrame(rows, "track_id long, t double, x double, level long").repartition(5)
    got = S.steps_of(df, "track_id", "t", "x").toPandas()
    for k, own in got.groupby("track_id"):
        own = own.sort_values("plateau")
        found = (own["start"].to_numpy()[1:] / 0.5).astype(int)
        # Every step is there; the second round may take a bit of noise for one more.
        assert np.abs(found[:, None] - want[k][None]).min(0).max() <= 1 and len(found) <= len(want[k]) + 1
        assert own["dwell"].sum() == pytest.approx((want[k][-1] - 0) * 0.5, abs=40) and own["n"].sum() == (df.where(F.col("track_id") == k).count() - 2 * (k == 3))
        assert np.isnan(own["step"].iloc[-1])
    again = S.steps_of(df.repartition(2), "track_id", "t", "x").toPandas()
    order = ["track_id", "plateau"]
    assert again.sort_values(order).reset_index(drop=True).equals(got.sort_values(order).reset_index(drop=True))


def test_flat_short_and_empty_traces(spark):
    rng = np.random.default_rng(3)
    assert S.s_curve_steps(np.zeros(0)) == [] and S.s_curve_steps(np.ones(1)) == [] and S.s_curve_steps(np.ones(50)) == []
    assert len(S.s_curve_steps(rng.normal(0, 1, 300), threshold=0.15)) <= 12
    x = np.repeat([0.0, 5.0], [20, 30])
    assert 20 in S.s_curve_steps(x + rng.normal(0, 0.1, 50)) and S.refined(x, [22]) == [20]
    none = spark.createDataFrame([], "track_id long, t double, x double")
    assert S.steps_of(none, "track_id", "t", "x").count() == 0
