"""Sums over all pairs within a radius where fields are dense: blocks of rows meet in tasks, and no pair is a row.

Rows are dealt to tiles as wide as the radius, and a tile's rows to parts of about ``BLOCK``. A block is one row with its places as
arrays; it is joined with the blocks of the tiles around, and what comes out of two blocks are sums. So memory is bounded
by two blocks and what is shuffled by the blocks' copies. The work itself grows with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .storage import cut

#: Rows of a block, about; rows of one that are looked around from at once.
BLOCK, CHUNK = 4096, 48


def blocks(df: DataFrame, tile: float, keys: tuple[str, ...] = (), xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(keys, tx, ty, part, block, id, x, y): rows with a finite place by tile and part, the last three as arrays."""
    rows = df.select(*keys, F.col(row).alias("id"), N.double(xy[0]).alias("x"), N.double(xy[1]).alias("y")).where(N.finite("x") & N.finite("y"))
    rows = rows.withColumns({t: F.floor(F.col(c) / tile).cast("long") for t, c in (("tx", "x"), ("ty", "y"))})
    place = [*keys, "tx", "ty"]
    parts = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = rows.join(parts.hint("merge"), place).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    got = dealt.groupBy(*place, "part").agg(F.collect_list(F.struct("id", "x", "y")).alias("r"))
    return cut(got.select(*place, "part", F.xxhash64(*place, "part").alias("block"), *[F.col(f"r.{c}").alias(c) for c in ("id", "x", "y")]))


def meeting(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), half: bool = False) -> DataFrame:
    """(keys, own, a_id, a_x, a_y, b_x, b_y): blocks of ``a`` with those of ``b`` in the tiles around.

    ``half``: both are one table, and two blocks meet once; own says that a block meets itself.
    """
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if not half or (i, j) >= (0, 0)]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    left = a.select(*keys, "tx", "ty", F.col("part").alias("a_part"), *[F.col(c).alias(f"a_{c}") for c in ("block", "id", "x", "y")], around.alias("s"))
    left = left.select("*", (F.col("tx") + F.col("s.i")).alias("__x"), (F.col("ty") + F.col("s.j")).alias("__y"))
    right = b.select(*keys, F.col("tx").alias("__x"), F.col("ty").alias("__y"), F.col("part").alias("b_part"), *[F.col(c).alias(f"b_{c}") for c in ("block", "x", "y")])
    at = (F.col("s.i") == 0) & (F.col("s.j") == 0)
    both = left.join(right.hint("merge"), [*keys, "__x", "__y"])
    if half:
        both = both.where(~at | (F.col("a_part") <= F.col("b_part")))
    # Some tiles hold most of the rows, so meetings are dealt one by one, and the number given keeps them from being put together again.
    tasks = 4 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = (at & (F.col("a_part") == F.col("b_part"))).alias("own")
    return both.repartition(tasks, "a_block", "b_block").select(*keys, own, "a_id", "a_x", "a_y", "b_x", "b_y")


def distances(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, their distances as a matrix): near rows of a in turn, with all of b that can be within ``reach``."""
    far = reach * (1 + 1e-9)
    strip = np.floor((ay - ay.min()) / max(np.ptp(ay) / max(math.sqrt(len(ay) / CHUNK), 1), 1e-300))
    order, across = np.lexsort((ax, strip)), np.argsort(bx, kind="stable")
    sx = bx[across]
    for at in range(0, len(order), CHUNK):
        i = order[at : at + CHUNK]
        x, y = ax[i], ay[i]
        j = across[np.searchsorted(sx, x.min() - far) : np.searchsorted(sx, x.max() + far, "right")]
        j = j[(by[j] >= y.min() - far) & (by[j] <= y.max() + far)]
        if len(j):
            dx, dy = x[:, None] - bx[j], y[:, None] - by[j]
            dx *= dx
            dy *= dy
            dx += dy
            yield i, j, np.sqrt(dx, out=dx)


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    columns = [batch.column(n) for n in names]
    for k in range(batch.num_rows):
        yield [c[k].values.to_numpy(zero_copy_only=False) for c in columns]


def _histogram(r_max: float, dr: float, keys: tuple[str, ...], half: bool) -> Callable:
    bins = math.ceil(r_max / dr) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((batch.num_rows, bins), np.int64)
            own = batch.column("own").to_pylist()
            for k, (ax, ay, bx, by) in enumerate(_arrays(batch, "a_x", "a_y", "b_x", "b_y")):
                for _, _, d in distances(ax, ay, bx, by, r_max):
                    d[d >= r_max] = np.inf
                    d /= dr  # the bin is its whole part
                    total[k] += np.diff([0, *[np.count_nonzero(d < i) for i in range(1, bins)], np.count_nonzero(d < np.inf)])
                if half and own[k]:
                    total[k, 0] -= len(ax)
                elif half:
                    total[k] *= 2
            r, i = np.nonzero(total)
            cols = [batch.column(c).take(pa.array(r)) for c in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(i, pa.int64()), pa.array(total[r, i], pa.int64())], [*keys, "bin", "n"])

    return run


def histogram(a: DataFrame, b: DataFrame, r_max: float, dr: float, same: bool = False, keys: tuple[str, ...] = (), xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(keys, bin, n): ordered pairs closer than ``r_max`` (of equal keys, none of them null), by distance."""
    one = blocks(a, r_max, keys, xy, row)
    met = meeting(one, one if same else blocks(b, r_max, keys, xy, row), keys, same)
    kind = "".join(f"{k} {dict(a.dtypes)[k]}, " for k in keys)
    return met.drop("a_id").mapInArrow(_histogram(r_max, dr, keys, same), f"{kind}bin long, n long").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def _sums(radius: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ax, ay, bx, by in _arrays(batch, "a_id", "a_x", "a_y", "b_x", "b_y"):
                n, sums = np.zeros(len(ids), np.int64), np.zeros((len(ids), 2))
                for i, j, d in distances(ax, ay, bx, by, radius):
                    near = d <= radius
                    n[i], near = np.count_nonzero(near, axis=1), near.astype(float)
                    # Not as a product of matrices, for which each task would start threads of its own.
                    sums[i, 0], sums[i, 1] = (np.einsum("ij,j->i", near, v[j]) for v in (bx, by))
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[k], n[k], sums[k, 0], sums[k, 1])], ["id", "n", "x", "y"])

    return run


def near_means(a: DataFrame, b: DataFrame, radius: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(row, x, y, n): number and mean place of the rows of ``b`` within ``radius`` of each row of ``a`` that has any."""
    met = meeting(blocks(a, radius, (), xy, row), b).drop("own")
    got = met.mapInArrow(_sums(radius), "id long, n long, x double, y double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])
    return got.select(F.col("id").alias(row), *[(F.col(c) / F.col("n")).alias(k) for c, k in zip("xy", xy, strict=True)], "n")
