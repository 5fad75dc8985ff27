"""Steps of traces by the curve of a fit against its counter-fit, in two rounds.

A fit grows by the split that lowers the squared error most, wherever it is. Its counter-fit has its boundaries where the
fit would split next; it is bad exactly if the steps found are real and there are no more of them. So the ratio of both errors by
number of steps has a peak where the steps of the dominant size are found; a second round on what is left finds smaller ones. Both
rounds keep their steps if the peak, above the line through the curve's ends, exceeds a threshold.

The best split of a plateau is found from running sums; plateaus wait in a heap and the counter-fit's error is kept up by its
three neighbouring parts, so a step costs its plateau's length. Limit: a trace is read by one task.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N

#: Points of a plateau below which it isn't split. A fixed value.
SHORTEST = 4


class Sums:
    """Squared errors of parts of a trace about their means."""

    def __init__(self, x: np.ndarray):
        x = x - x.mean() if len(x) else x  # for the sums' digits
        self.one, self.two = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))

    def error(self, a, b):
        s = self.one[b] - self.one[a]
        return np.maximum(self.two[b] - self.two[a] - s * s / np.maximum(b - a, 1), 0.0)

    def split(self, a: int, b: int) -> tuple[int, float]:
        """The first point after the best split of [a, b), and the error that it removes."""
        edge = 1 if b - a < SHORTEST else 2
        at = np.arange(a + edge, b - edge + 1)
        if b - a < 2 or not len(at):
            return a + (b - a) // 2, 0.0
        gain = self.error(a, b) - self.error(a, at) - self.error(at, b)
        j = int(gain.argmax())
        return int(at[j]), float(gain[j])


def grow(x: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """Boundaries in the order they are found, up to ``most``, and the ratio of the counter-fit's error to the fit's for each number of them."""
    sums, n = Sums(x), len(x)
    marks, heap, order, ratio = [], [], [], []
    fit, counter = float(sums.error(0, n)), float(sums.error(0, n))

    def put(a: int, b: int) -> None:
        nonlocal counter
        k, gain = sums.split(a, b)
        if b - a >= SHORTEST and gain > 0:
            heapq.heappush(heap, (-gain, a, b, k))
        if b - a >= 2:
            i = bisect_left(marks, k)
            lo, hi = marks[i - 1] if i else 0, marks[i] if i < len(marks) else n
            counter += float(sums.error(lo, k) + sums.error(k, hi) - sums.error(lo, hi))
            insort(marks, k)

    def drop(k: int) -> None:
        nonlocal counter
        i = bisect_left(marks, k)
        lo, hi = marks[i - 1] if i else 0, marks[i + 1] if i + 1 < len(marks) else n
        counter += float(sums.error(lo, hi) - sums.error(lo, k) - sums.error(k, hi))
        del marks[i]

    put(0, n)
    while True:
        ratio.append(counter / fit if fit > 1e-12 * max(sums.two[-1], 1e-300) else 1.0)
        if len(order) == most or not heap:
            return order, np.array(ratio)
        gain, a, b, k = heapq.heappop(heap)
        drop(k)
        fit += gain  # negative
        order.append(k)
        put(a, k)
        put(k, b)


def peak(ratio: np.ndarray) -> tuple[int, float]:
    """The number of steps at the curve's peak above the line through its ends, and how high that is."""
    over = np.maximum(ratio, 1.0) - 1.0
    over = over - np.linspace(0.0, over[-1], len(over))
    k = int(over.argmax())
    return k, float(over[k])


def levels(x: np.ndarray, cuts: list[int], statistic=np.mean) -> np.ndarray:
    """Level of each point."""
    edges = [0, *cuts, len(x)]
    return np.concatenate([np.full(b - a, statistic(x[a:b])) for a, b in zip(edges, edges[1:], strict=False) if b > a]) if len(x) else x


def s_curve_steps(x: np.ndarray, threshold: float = 0.15, part: float = 0.25, most: int = 10_000, statistic=np.mean) -> list[int]:
    """First points of the plateaus after the first; at most ``part`` of the points, and ``most``, are tried as steps in a round."""
    tries, left, kept = int(min(math.ceil(len(x) * part), most)), x.astype(float), []
    for _ in range(2 if tries else 0):
        order, ratio = grow(left, tries)
        best, height = peak(ratio)
        if height > threshold:
            kept += order[:best]
        left = left - levels(left, sorted(order[:best]), statistic)
    return sorted(set(kept))


def refined(x: np.ndarray, cuts: list[int], rounds: int = 10, statistic=np.mean) -> list[int]:
    """Boundaries moved by up to two points to where the points around lie closest to the levels beside, until none moves."""
    for _ in range(rounds):
        edges = [0, *cuts, len(x)]
        level = [statistic(x[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        new = []
        for i, k in enumerate(cuts):
            lo, hi = max(edges[i] + 1, k - 2), min(edges[i + 2] - 1, k + 2)
            first = max(lo - 1, 0)
            seen = x[first : hi + 1]
            to_left = np.concatenate([[0.0], np.cumsum((seen - level[i]) ** 2)])
            to_right = np.concatenate([[0.0], np.cumsum((seen - level[i + 1]) ** 2)])
            cost = [to_left[c - first] + to_right[-1] - to_right[c - first] for c in range(lo, hi + 1)]
            new.append(lo + int(np.argmin(np.round(cost, 12))) if cost else k)
        new = sorted(set(new))
        if new == cuts:
            break
        cuts = new
    return cuts


def steps_of(df: DataFrame, key: str, time: str, value: str, threshold: float = 0.15, part: float = 0.25, statistic: str = "mean", refine: bool = True) -> DataFrame:
    """(key, plateau, start, dwell, n, level, std, step): the plateaus of each trace and the step to the next.

    A dwell ends where the next plateau begins, the last one's with the trace. Rows without a key, a time or a finite value take no part; rows
    of one time go by value.
    """
    stat = np.median if statistic == "median" else np.mean

    def run(trace: pd.DataFrame) -> pd.DataFrame:
        trace = trace.sort_values(["t", "v"])
        x, t = trace["v"].to_numpy(), trace["t"].to_numpy()
        cuts = s_curve_steps(x, threshold, part, statistic=stat)
        cuts = refined(x, cuts, statistic=stat) if refine else cuts
        edges = [0, *cuts, len(x)]
        parts = [x[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        level = [float(stat(p)) for p in parts]
        start = t[edges[:-1]]
        return pd.DataFrame({
            "key": trace["key"].iloc[0], "plateau": range(len(parts)), "start": start, "dwell": np.append(start[1:], t[-1]) - start, "n": [len(p) for p in parts],
            "level": level, "std": [p.std(ddof=1) if len(p) > 1 else np.nan for p in parts], "step": [*np.diff(level), np.nan],
        })

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & N.finite(time) & N.finite(value)).select(F.col(key).alias("key"), N.double(time).alias("t"), N.double(value).alias("v"))
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, plateau int, start double, dwell double, n long, level double, std double, step double").withColumnRenamed("key", key)
