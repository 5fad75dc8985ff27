"""Voronoi cells of points in the plane, by tiles with a border, and the clusters of dense cells.

A cell is what half-planes towards the neighbours leave of the plane around a point. A tile is read with all points
within ``reach`` of it. A cell is known if its corners lie within half the reach, for no point farther away can cut it. If not,
what it has within a square of that size is a part of it for certain; once that is larger than the largest area asked for,
the cell is known to be less dense than that, as open cells at the edge of the field are. Only cells of
which neither is known go on to the next round, with twice the reach; what is asked for so sets how far is looked, not the field.

Points at one place share a cell, named by their least row. Cells that meet in a corner only don't touch.
Limit: the points of one tile and its border are read by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .graph import connected_components
from .storage import cut
from .windows import ranked_by_size

#: Points of a tile on average; first reach in mean distances between points.
TILE, REACH = 2000, 6.0


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for way in (p, p[::-1]):
        own: list[np.ndarray] = []
        for q in way:
            while len(own) > 1 and np.cross(np.append(own[-1] - own[-2], 0), np.append(q - own[-1], 0))[2] <= 0:
                own.pop()
            own.append(q)
        sides += own[:-1]
    return np.array(sides)


def area(polygon) -> float:
    return 0.5 * abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, [*polygon[1:], *polygon[:1]], strict=True)))


def hull_area(df: DataFrame, xy: tuple[str, str] = ("x_nm", "y_nm")) -> float:
    """Area of the convex hull: hulls of the partitions, then of their corners."""

    def run(frames):
        held = np.zeros((0, 2))
        for f in frames:
            held = corners(np.concatenate([held, f.to_numpy(float)]))
        yield pd.DataFrame(held, columns=["x", "y"])

    found = df.select(N.double(xy[0]).alias("x"), N.double(xy[1]).alias("y")).where(N.finite("x") & N.finite("y")).mapInPandas(run, "x double, y double")
    hull = corners(found.toPandas().to_numpy(float))
    return area([tuple(p) for p in hull]) if len(hull) > 2 else 0.0


def clipped(polygon: list[tuple], dx: float, dy: float, half: float, name: int) -> list[tuple]:
    """The part of a polygon of (x, y, neighbour of the side that begins here) where x dx + y dy <= half."""
    values = [x * dx + y * dy - half for x, y, _ in polygon]
    if max(values) <= 0:
        return polygon
    out = []
    for i, (x, y, side) in enumerate(polygon):
        j = i + 1 if i + 1 < len(polygon) else 0
        v, w = values[i], values[j]
        if v <= 0:
            out.append((x, y, side))
        if (v <= 0) != (w <= 0):
            t = v / (v - w)
            # Where the polygon is left, the new side begins; where it is entered again, the old one goes on.
            out.append((x + t * (polygon[j][0] - x), y + t * (polygon[j][1] - y), name if v <= 0 else side))
    return out


def square(half: float) -> list[tuple]:
    return [(-half, -half, -1), (half, -half, -1), (half, half, -1), (-half, half, -1)]


class Grid:
    """Points in square cells, to look around a place."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        w, h = np.ptp(x), np.ptp(y)
        self.size = max(math.sqrt(max(w * h, 1e-12) * 3 / len(x)), max(w, h) / 3000, 1e-9)
        self.x0, self.y0 = x.min(), y.min()
        self.nx = int(w / self.size) + 1
        key = ((y - self.y0) / self.size).astype(np.int64) * self.nx + ((x - self.x0) / self.size).astype(np.int64)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def near(self, x: float, y: float, rings: int) -> np.ndarray:
        """Points of the cells up to ``rings`` away, so all within that many cells' size."""
        i, j = int((x - self.x0) / self.size), int((y - self.y0) / self.size)
        lo, hi = max(i - rings, 0), min(i + rings, self.nx - 1)
        rows = np.arange(max(j - rings, 0), j + rings + 1) * self.nx
        a, b = np.searchsorted(self.key, rows + lo), np.searchsorted(self.key, rows + hi, "right")
        return np.concatenate([self.order[s:e] for s, e in zip(a, b, strict=True)])


def cell(grid: Grid, x: float, y: float, reach: float) -> list[tuple]:
    """Corners, about the point, of what is left of a square of half-width ``reach`` by all points within the reach."""
    rings = 2
    while True:
        known = min(rings * grid.size, reach)
        at = grid.near(x, y, rings)
        dx, dy = grid.x[at] - x, grid.y[at] - y
        d2 = dx * dx + dy * dy
        some = np.flatnonzero((d2 > 0) & (d2 <= known * known))
        some = some[np.argsort(d2[some], kind="stable")]
        polygon, far = square(reach), 2 * reach * reach
        for u, v, w, k in zip(dx[some].tolist(), dy[some].tolist(), d2[some].tolist(), at[some].tolist(), strict=True):
            if w > 4 * far:
                break
            cut_ = clipped(polygon, u, v, w / 2, k)
            if cut_ is not polygon:
                polygon = cut_
                far = max(p * p + q * q for p, q, _ in polygon)
        if known >= reach or 4 * far <= known * known:
            return polygon
        rings *= 2


def _tile(tile: pd.DataFrame, reach: float, least_density: float) -> tuple[list, list]:
    """Cells (row, known, area) of a tile's own points, and the sides (row, other) of known ones."""
    rows, x, y = tile["row"].to_numpy(), tile["x"].to_numpy(float), tile["y"].to_numpy(float)
    most = tile["n"].to_numpy(float) / least_density
    grid, cells, sides = Grid(x, y), [], []
    for i in np.flatnonzero(tile["own"].to_numpy()):
        p = cell(grid, x[i], y[i], reach)
        far = math.sqrt(max(a * a + b * b for a, b, _ in p))
        if 2 * far <= reach and min(k for _, _, k in p) >= 0:
            cells.append((rows[i], True, area(p)))
            for (a, b, k), (c, d, _) in zip(p, [*p[1:], p[0]], strict=True):
                if math.hypot(c - a, d - b) > 1e-9 * far:
                    sides.append((rows[i], rows[k]))
            continue
        half = reach / math.sqrt(8)
        for u, v in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            p = clipped(p, u, v, half, -1)
        low = area(p)
        cells.append((rows[i], False if low > most[i] else None, low))
    return cells, sides


def _tiles(reach: float, least_density: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        cells, sides = _tile(tile, reach, least_density)
        out = [(0, r, -1, k, a) for r, k, a in cells] + [(1, a, b, None, 0.0) for a, b in sides]
        return pd.DataFrame(out, columns=["kind", "a", "b", "known", "area"]).astype({"known": object})

    return run


def voronoi_cells(df: DataFrame, least_density: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id", tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(row, x, y, n, density) of every place, and (a, b) of the cells of known density that touch.

    density: points per unit of area; null for open cells and those below ``least_density``, which has to be positive.
    """
    points = df.select(F.col(row).alias("row"), N.double(xy[0]).alias("x"), N.double(xy[1]).alias("y")).where(N.finite("x") & N.finite("y"))
    # -0 is 0.
    points = cut(points.groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")))
    ends = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))]).first()
    nothing = points.select("*", F.lit(None).cast("double").alias("density"))
    if ends["n"] < 4 or not least_density > 0:
        return nothing, points.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0)
    w, h = max(ends["x1"] - ends["x0"], 1e-9), max(ends["y1"] - ends["y0"], 1e-9)
    spread = math.sqrt(w * h / ends["n"]) if min(w, h) > 1e-6 * max(w, h) else max(w, h) / ends["n"]
    reach, left, known, sides = REACH * spread, points.select("row"), [], []
    while True:
        side = max(reach, spread * math.sqrt(tile))
        at = lambda c, d=0.0: F.floor((F.col(c) + d) / side).cast("long")  # noqa: E731, B023
        own = points.join(left, "row", "left_semi").select("row", "x", "y", "n", at("x").alias("tx"), at("y").alias("ty"), F.lit(True).alias("own"))
        spans = lambda c: F.explode(F.sequence(at(c, -reach), at(c, reach)))  # noqa: E731, B023
        around = points.select("row", "x", "y", "n", spans("x").alias("tx"), "*").select("row", "x", "y", "n", "tx", spans("y").alias("ty"))
        around = around.where((F.col("tx") != at("x")) | (F.col("ty") != at("y"))).unionByName(points.join(left, "row", "left_anti").select("row", "x", "y", "n", at("x").alias("tx"), at("y").alias("ty")))
        read = own.unionByName(around.withColumn("own", F.lit(False)).join(own.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi"))
        found = cut(read.groupBy("tx", "ty").applyInPandas(_tiles(reach, least_density), "kind int, a long, b long, known boolean, area double"))
        known.append(found.where("kind = 0 AND known IS NOT NULL").select(F.col("a").alias("row"), F.when(F.col("known"), F.col("area")).alias("area")))
        sides.append(found.where("kind = 1").select("a", "b"))
        left = found.where("kind = 0 AND known IS NULL").select(F.col("a").alias("row"))
        if left.isEmpty() or reach > 4 * math.hypot(w, h):
            break
        reach *= 2
    for more in known[1:]:
        known[0] = known[0].union(more)
    for more in sides[1:]:
        sides[0] = sides[0].union(more)
    density = F.col("n") / F.col("area")
    return points.join(known[0], "row", "left").select("row", "x", "y", "n", F.when((F.col("area") > 0) & (density >= least_density), density).alias("density")), sides[0]


def voronoi_density(df: DataFrame, least_density: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id", tile: int = TILE) -> DataFrame:
    """(row, density) of every row; null without a finite place, in open cells and below ``least_density``."""
    cells, _ = voronoi_cells(df, least_density, xy, row, tile)
    place = df.select(row, (N.double(xy[0]) + 0.0).alias("x"), (N.double(xy[1]) + 0.0).alias("y"))
    return place.join(cells.select("x", "y", "density"), ["x", "y"], "left").select(row, "density")


def voronoi_clusters(df: DataFrame, factor: float = 2.0, least: int = 10, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id", tile: int = TILE) -> DataFrame:
    """cluster_id (1 the largest, -1 none) and n_in_cluster: touching cells denser than ``factor`` times the field's mean.

    The mean is all points over the area of their convex hull. Fewer than four points, or points on a line, make no cluster.
    """
    df = df.drop("cluster_id", "n_in_cluster")
    rows = df.where(N.finite(xy[0]) & N.finite(xy[1])).count()
    field = hull_area(df, xy) if rows >= 4 else 0.0
    if not field > 0:
        return ranked_by_size(df.withColumn("cluster_id", F.lit(-1).cast("long")), row=row)
    bound = factor * rows / field
    cells, sides = voronoi_cells(df, bound, xy, row, tile)
    dense = cut(cells.where(F.col("density") > bound))
    is_dense = lambda c: dense.select(F.col("row").alias(c))
    edges = sides.where("a < b").join(is_dense("a"), "a", "left_semi").join(is_dense("b"), "b", "left_semi")
    found = connected_components(dense, edges, "row").join(dense.select("row", "n", "x", "y"), "row")
    large = found.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    labels = found.join(large, "component", "left_semi").select("x", "y", F.col("component").alias("cluster_id"))
    place = df.withColumns({"__px": N.double(xy[0]) + 0.0, "__py": N.double(xy[1]) + 0.0})
    both = place.join(labels.withColumnsRenamed({"x": "__px", "y": "__py"}), ["__px", "__py"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return ranked_by_size(both.drop("__px", "__py"), row=row)
