"""One-to-one pairing of intervals and points, greedy selection among close rows, beads and local means."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .blocks import blocks, near_means
from .graph import connected_components, cut, link_tracks
from .storage import numbered
from .joins import cell_pairs, nearest_in_time


#: Partners of an interval that are looked up at once.
PARTNERS = 64


def greedy_overlaps(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], least: float) -> list[tuple[int, int]]:
    """Intervals (ids, starts, ends) of two kinds one to one, the largest overlap of at least ``least`` first (ties: smaller ids).

    Each interval of a waits in a heap with the best partner that was free when it was looked up. What is popped with a free
    partner is the best of all, since partners only go; else its next one is taken, of those looked up or anew. Memory is linear.
    """
    (ia, sa, ea), (ib, sb, eb) = ([v[np.argsort(k[0], kind="stable")] for v in k] for k in (a, b))
    free, heap, lists, out = np.ones(len(ib), bool), [], {}, []

    def wait(i: int) -> None:
        """Put i to the heap with its next free partner, if there is one."""
        while True:
            todo = lists.get(i)
            if not todo:
                at = np.flatnonzero(free)
                over = np.minimum(ea[i], eb[at]) - np.maximum(sa[i], sb[at])
                ok = over >= least
                at, over = at[ok], over[ok]
                if len(at) > PARTNERS:  # those of the least overlap taken come whole, and the smallest ids of them stay
                    ok = over >= np.partition(over, len(over) - PARTNERS)[len(over) - PARTNERS]
                    at, over = at[ok], over[ok]
                if not len(at):
                    return
                best = np.lexsort((at, -over))[:PARTNERS][::-1]
                todo = lists[i] = list(zip(over[best].tolist(), at[best].tolist(), strict=True))
            while todo:
                v, j = todo.pop()
                if free[j]:
                    heapq.heappush(heap, (-v, i, j))
                    return

    for i in range(len(ia)):
        wait(i)
    while heap:
        _, i, j = heapq.heappop(heap)
        if free[j]:
            free[j] = False
            out.append((int(ia[i]), int(ib[j])))
            lists.pop(i, None)
        else:
            wait(i)
    return out


def pair_intervals(a: DataFrame, b: DataFrame, width: float, least: float = 0.0, keys: tuple[str, ...] = (), ident: str = "id") -> DataFrame:
    """(a, b, pair_id): intervals of two kinds one to one, the largest overlap first (ties: smaller ids); those
    that stay alone have a pair of their own. Pairs are numbered from 0 by start.

    Buckets of ``width`` that intervals reach over are chained; the intervals of a chain meet in one task, which holds them but
    never their pairs. Chains end where no interval passes from a bucket to the next.
    """
    bucket = lambda c: F.floor(N.double(c) / width).cast("long")
    side = lambda d, k: d.select(F.lit(k).alias("kind"), F.col(ident).alias("id"), N.double("start").alias("start"), N.double("end").alias("end"), *keys, bucket("start").alias("lo"), bucket("end").alias("hi"))
    spans = side(a, 0).union(side(b, 1)).where(N.finite("start") & N.finite("end") & (F.col("start") <= F.col("end")))
    spans = cut(spans.dropna(subset=list(keys)) if keys else spans)
    touched = spans.select(*keys, "hi", F.explode(F.sequence("lo", "hi")).alias("k")).groupBy(*keys, "k").agg(F.max(F.col("k") < F.col("hi")).alias("on"))
    touched = cut(touched.select(F.xxhash64(*keys, "k").alias("node"), F.xxhash64(*keys, F.col("k") + 1).alias("next"), "on"))
    chains = connected_components(touched, touched.where("on").select(F.col("node").alias("a"), F.col("next").alias("b")), "node")
    of = spans.withColumn("node", F.xxhash64(*keys, "lo")).join(chains, "node")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        both = (tuple(pdf.loc[pdf["kind"] == k, c].to_numpy() for c in ("id", "start", "end")) for k in (0, 1))
        return pd.DataFrame(greedy_overlaps(*both, max(least, 0.0)), columns=["a", "b"], dtype="int64")

    taken = cut(of.select("component", *keys, "kind", "id", "start", "end").groupBy("component", *keys).applyInPandas(greedy, "a long, b long"))
    one = a.select(F.col(ident).alias("a"), F.col("start").alias("sa")).join(taken, "a", "left")
    two = b.select(F.col(ident).alias("b"), F.col("start").alias("sb"))
    both = one.join(two, "b", "full_outer").select("a", "b", F.least("sa", "sb").alias("s"))
    both = numbered(both, "pair_id", F.col("s").asc(), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    return both.select(F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b"), "pair_id")


def pair_offsets(a: DataFrame, b: DataFrame, max_dt: float, key: str = "pair_id", time: str = "t", xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(key, dx, dy, n): median offset of rows of b to the row of a of their pair that is nearest in time."""
    m = nearest_in_time(b, a, time, list(xy), (key,), max_dt, row).where("dt is not null")
    return m.groupBy(key).agg(*[F.median(N.double(c) - N.double(f"near_{c}")).alias(f"d{c[0]}") for c in xy], F.count(F.lit(1)).alias("n"))


#: Links that are left to be judged by components; a round that settles less than a tenth of them is the last one.
LEFT = 200_000


def _beaten(e: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows that go, links still open) of links (a, b, sa, sb): a row better than all that are linked with it stays, and those go."""
    best = lambda x, s: F.struct(-F.col(s), F.col(x))
    both = e.select("a", "b", "sa", "sb").union(e.select(F.col("b"), F.col("a"), F.col("sb"), F.col("sa")))
    now, gone, before = cut(both.where("a <> b").distinct()), None, None
    n = now.count()
    while n > 2 * LEFT and (before is None or n < 0.9 * before):
        worse = now.where(best("b", "sb") < best("a", "sa")).select("a").distinct()
        out = cut(now.join(worse.hint("merge"), "a", "left_anti").select(F.col("b").alias("a")).distinct())
        gone = out if gone is None else gone.union(out)
        now = now.join(out.hint("merge"), "a", "left_anti").join(out.withColumnRenamed("a", "b").hint("merge"), "b", "left_anti")
        now = cut(now.select("a", "b", "sa", "sb"))
        before, n = n, now.count()
    return gone, now.where("a < b")


def keep_best(df: DataFrame, pairs: DataFrame, score: str, row: str = "row_id") -> DataFrame:
    """Of rows that the pairs (a, b) say are too close, the best score stays, taken in that order."""
    s = df.select(row, N.double(score).alias("__s"))
    e = pairs.where("a < b").join(s.select(F.col(row).alias("a"), F.col("__s").alias("sa")), "a").join(s.select(F.col(row).alias("b"), F.col("__s").alias("sb")), "b")
    gone, e = _beaten(e)
    parts = connected_components(df.select(row), e.select("a", "b"), row)
    e = e.join(parts.select(F.col(row).alias("a"), "component"), "a")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        best = {**dict(zip(pdf["a"], pdf["sa"], strict=True)), **dict(zip(pdf["b"], pdf["sb"], strict=True))}
        near: dict[int, set[int]] = {}
        for p, q in zip(pdf["a"], pdf["b"], strict=True):
            near.setdefault(p, set()).add(q), near.setdefault(q, set()).add(p)
        kept: set[int] = set()
        for r in sorted(best, key=lambda r: (-best[r], r)):
            if not near[r] & kept:
                kept.add(r)
        return pd.DataFrame({row: sorted(best.keys() - kept)}, dtype="int64")

    last = e.groupBy("component").applyInPandas(greedy, f"{row} long")
    return df.join(last if gone is None else last.union(gone), row, "left_anti")


def remove_double_regions(regions: DataFrame, distance: float, file: str = "filenumber", count: str = "n") -> DataFrame:
    """Of regions of one file with centres closer than ``distance`` the one with more rows stays."""
    r = regions.withColumnsRenamed({"cx": "x_nm", "cy": "y_nm", "region_id": "row_id"})
    pairs = cell_pairs(r, r, distance, keys=(file,), same=True, strict=True).select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))
    return keep_best(r, cut(pairs), count).withColumnsRenamed({"x_nm": "cx", "y_nm": "cy", "row_id": "region_id"})


#: Pairs of rows that may be near each other, at most, that are written.
MET = 4_000_000


def _crowded(now: DataFrame, reach: float) -> tuple[DataFrame | None, DataFrame]:
    """(rows that go, rows still open) of circles: while there may be more pairs than ``MET``, the best of each small cell are judged.

    One that no better row overlaps stays, and what it overlaps goes. Rows that stay overlap no other, so a row meets no more of them, nor
    of the cells' best, than there is room for; pairs are only read. What is left over has few pairs.
    """
    gone, key = None, lambda p: F.struct(-F.col(f"{p}__s"), F.col(f"{p}row_id"))
    while True:
        cells = now.groupBy(*[F.floor(F.col(c) / reach) for c in ("x_nm", "y_nm")]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        got = cells.agg(F.sum(9 * F.col("n") * F.col("n"))).first()[0]
        if got is None or got <= MET:
            return gone, now
        side = now.agg(F.avg("radius")).first()[0]
        side = side if side and math.isfinite(side) and side > 0 else reach / 4
        best = now.groupBy(*[F.floor(F.col(c) / side) for c in ("x_nm", "y_nm")]).agg(F.min_by(F.struct(*now.columns), key("")).alias("m")).select("m.*")
        met = lambda a: cell_pairs(a, now, reach).where((F.col("d") < F.col("a_radius") + F.col("b_radius")) & (F.col("a_row_id") != F.col("b_row_id")))
        best = cut(best)
        beaten = met(best).where(key("b_") < key("a_")).select(F.col("a_row_id").alias("row_id")).distinct()
        kept = cut(best.join(beaten.hint("merge"), "row_id", "left_anti"))
        out = cut(met(kept).select(F.col("b_row_id").alias("row_id")).distinct())
        gone = out if gone is None else gone.union(out)
        now = cut(now.join(out.union(kept.select("row_id")).hint("merge"), "row_id", "left_anti").select(now.columns))


def overlapping_circles(df: DataFrame, largest: float, score: str = "score") -> DataFrame:
    """Circles (x_nm, y_nm, radius) that overlap no better one."""
    placed = df.select("row_id", *[N.double(c).alias(c) for c in ("x_nm", "y_nm", "radius")], N.double(score).alias("__s"))
    gone, left = _crowded(cut(placed.where(N.finite("x_nm") & N.finite("y_nm"))), 2 * largest)
    pairs = cell_pairs(left, left.select("row_id", "x_nm", "y_nm", "radius"), 2 * largest, same=True).join(left.select(F.col("row_id").alias("a_row_id"), F.col("radius").alias("__r")), "a_row_id").where(F.col("d") < F.col("__r") + F.col("b_radius"))
    out = keep_best(df, cut(pairs.select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))), score)
    return out if gone is None else out.join(gone, "row_id", "left_anti")


def close_groups(df: DataFrame, distance: float, keys: tuple[str, ...] = ("frame",), row: str = "row_id") -> DataFrame:
    """(row, component): rows of one frame that are chained by less than ``distance``."""
    pairs = cell_pairs(df, df, distance, keys=keys, same=True, row=row, strict=True).select(F.col(f"a_{row}").alias("a"), F.col(f"b_{row}").alias("b"))
    return connected_components(df, pairs, row)


def find_beads(df: DataFrame, frames: int, bright: float, share: float, max_jump: float, memory: int = 2) -> DataFrame:
    """(bead, x_nm, y_nm, n): bright rows linked to tracks that are there in at least ``share`` of the frames."""
    t = link_tracks(df.where(F.col("photons") >= bright), max_jump, memory)
    g = t.where("track_id >= 0").groupBy(F.col("track_id").alias("bead")).agg(F.avg("x_nm").alias("x_nm"), F.avg("y_nm").alias("y_nm"), F.count_distinct("frame").alias("n"))
    return g.where(F.col("n") >= share * frames)


def mean_shift(df: DataFrame, seeds: DataFrame, radius: float, steps: int = 10, tolerance: float = 0.1) -> DataFrame:
    """(row, x_nm, y_nm, n): seeds moved to the mean of the rows within ``radius``, again and again; blocks meet, no pair is a row."""
    now, around = seeds.select("row_id", "x_nm", "y_nm"), blocks(df, radius)
    for _ in range(steps):
        new = near_means(now, around, radius)
        new = cut(new.join(now.select("row_id", F.col("x_nm").alias("x0"), F.col("y_nm").alias("y0")), "row_id"))
        moved = new.agg(F.max(F.hypot(F.col("x_nm") - F.col("x0"), F.col("y_nm") - F.col("y0"))).alias("m")).first()["m"]
        now = new.drop("x0", "y0")
        if moved is None or moved < tolerance:
            break
    return now


def equalised(df: DataFrame, column: str, knots: int = 50) -> DataFrame:
    """The column's fraction within its pixel, mapped by its own quantiles so that it becomes uniform."""
    part = N.double(column) - F.floor(N.double(column))
    q = df.agg(F.percentile(part, [i / knots for i in range(knots + 1)]).alias("q")).first()["q"]
    if q is None:
        return df
    edges = np.maximum.accumulate(np.asarray(q, float))
    edges[0], edges[-1] = 0.0, 1.0
    level = F.lit(1.0)
    for i in range(knots - 1, -1, -1):
        width = float(edges[i + 1] - edges[i])
        inside = (part - float(edges[i])) / width if width > 0 else F.lit(0.0)
        level = F.when(part < float(edges[i + 1]), (i + inside) / knots).otherwise(level)
    return df.withColumn(column, F.floor(N.double(column)) + level)


def paired_channels(a: DataFrame, b: DataFrame, transformation, distance: float, frame: str = "frame") -> DataFrame:
    """(frame, a, b, d): peaks of two channels that are each other's nearest within ``distance`` after the map."""
    p = cell_pairs(transformation.apply(a), b, distance, keys=(frame,)).select(F.col(f"a_{frame}").alias(frame), F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"), "d")
    best = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy("d", o))
    return p.withColumns({"__i": best("a", "b"), "__j": best("b", "a")}).where("__i = 1 AND __j = 1").drop("__i", "__j")
