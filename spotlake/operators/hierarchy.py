"""Hierarchical density clusters: the minimum spanning tree of mutual reachability, condensed from below.

The reachability of two rows is the largest of their distance and their core distances (to the k-th other row). The
tree grows by scales: at radius r all components take their least edge to another component, again and again, until none
of at most r is left; then r grows by ``GROW``. Rows are not paired at a scale but boxes: what a component has in a cell of r / 8.
Two boxes have a least and a largest possible reachability, and only boxes that can hold a component's least edge
are opened. So a component of any size pays for its border towards its nearest other, not for its inside.

The condensed tree is built along with the scales. A component of ``least`` rows or more is a cluster; all that the next scale needs of it is
its size, the sum of 1 / distance over the rows that joined it, the best that its parts could give, and its name.
Within a component of a scale the edges of that scale are walked in order. Edges of one length count as
one merge: no large part, and a cluster begins; one, and the others join it; more, and they end and a new one begins. So the
result doesn't depend on which of several equal trees was found. A cluster is chosen if its own stability is not below
the sum of what its parts give; the one that holds everything is never chosen.

Limit: the edges that one scale adds to one component are walked in one task, as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .graph import connected_components
from .joins import nearest_neighbours
from .storage import cut
from .windows import ranked_by_size

#: Growth of a scale; boxes along the side of a cell; the least distance in 1 / distance; edges of a round that the driver may hold.
GROW, FINE, NEAR, HELD = 4, 8, 1e-9, 20_000


def core_distances(df: DataFrame, k: int, first_radius: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(row, x, y, core) of rows with a finite place; core is the distance of the k-th other row (the last, if fewer)."""
    near = nearest_neighbours(df, df, k, first_radius, same=True, row=row, xy=xy)
    core = near.groupBy(row).agg(F.max(F.when(F.col("d") < float("inf"), F.col("d"))).alias("core"))
    return df.select(row, N.double(xy[0]).alias("x"), N.double(xy[1]).alias("y")).join(core, row).select(F.col(row).alias("row"), "x", "y", F.coalesce("core", F.lit(0.0)).alias("core"))


def least_edges(points: DataFrame, r: float) -> DataFrame:
    """(comp, w, a, b): of each component the least edge, at most ``r`` long, to another; by length, then by its rows."""
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    near = points.where(F.col("core") <= r)  # others have no edge that short
    near = near.withColumns({"gx": cell("x", r), "gy": cell("y", r), "fx": cell("x", r / FINE), "fy": cell("y", r / FINE)})
    box = near.groupBy("gx", "gy", "fx", "fy", "comp").agg(F.min("core").alias("core"), *[f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("0", F.min), ("1", F.max))])
    named = lambda d, p: d.select(*[F.col(c).alias(f"{p}{c}") for c in d.columns])
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = lambda d: named(d, "a_").withColumn("i", F.explode(steps)).withColumn("gx", F.col("a_gx") + F.col("i")).withColumn("i", F.explode(steps)).withColumn("gy", F.col("a_gy") + F.col("i")).drop("i")
    right = named(box, "b_").withColumns({"gx": F.col("b_gx"), "gy": F.col("b_gy")}).hint("merge")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    span = lambda c: F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0"))
    reach = lambda f: F.greatest(F.sqrt(f("x") * f("x") + f("y") * f("y")), "a_core", "b_core")
    met = lambda d: around(d).join(right, ["gx", "gy"]).where((F.col("a_comp") != F.col("b_comp")) & (reach(gap) <= r))
    # Pairs of boxes are met twice rather than written: only bounds by component, and the few pairs that are opened, go on.
    bound = cut(met(box).groupBy("a_comp").agg(F.min(reach(span)).alias("bound")).withColumnRenamed("a_comp", "comp"))
    # A little above the bound, for its root is rounded.
    opened = met(box.join(bound.hint("merge"), "comp")).where(reach(gap) <= F.col("a_bound") * (1 + 1e-12)).select(*[f"{p}{c}" for p in ("a_", "b_") for c in ("fx", "fy", "comp")])
    rows = near.select("row", "x", "y", "core", "fx", "fy", "comp")
    both = opened.join(named(rows, "a_").hint("merge"), ["a_fx", "a_fy", "a_comp"]).join(named(rows, "b_").hint("merge"), ["b_fx", "b_fy", "b_comp"])
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    edge = F.struct(F.greatest(F.sqrt(dx * dx + dy * dy), "a_core", "b_core").alias("w"), F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))
    best = both.select(F.col("a_comp").alias("comp"), edge.alias("e")).where(F.col("e.w") <= r).groupBy("comp").agg(F.min("e").alias("e"))
    return best.select("comp", "e.w", "e.a", "e.b")


def linked(points: DataFrame, best: DataFrame, left: int) -> tuple[DataFrame, DataFrame, int]:
    """The edges (w, a, b) of a round, the points with the components they make, and how many there are then.

    Up to ``HELD`` edges are joined at the driver, more by stars; the components are the same, named by their least.
    """
    spark = points.sparkSession
    edges = best.select("w", "a", "b").distinct()
    of = lambda c: points.select(F.col("row").alias(c), F.col("comp").alias(f"c{c}"))
    pairs = edges.join(of("a"), "a").join(of("b"), "b").select("w", "a", "b", "ca", "cb")
    few = pairs.limit(HELD + 1).collect()
    if len(few) <= HELD:
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        for r in few:
            a, b = root(r["ca"]), root(r["cb"])
            up[max(a, b)] = min(a, b)
        edges = spark.createDataFrame([(r["w"], r["a"], r["b"]) for r in few], "w double, a long, b long")
        heads = F.broadcast(spark.createDataFrame([(i, root(i)) for i in up], "comp long, component long"))
        left -= len(few)
    else:
        edges = cut(edges)
        names = best.select("comp").union(pairs.select("cb")).union(pairs.select("ca")).distinct()
        heads, left = connected_components(names, pairs, "comp", "ca", "cb"), None
    points = cut(points.join(heads, "comp", "left").select("row", "x", "y", "core", F.coalesce("component", "comp").alias("comp")))
    return edges, points, points.select("comp").distinct().count() if left is None else left


def _walk(least: int):
    """Merges the components of each group along its edges; see the module's text."""

    def group(rows) -> Iterator[tuple]:
        state: dict[int, list] = {}  # root -> size, sum, best of parts, cluster, small members
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        edges = []
        for r in rows:
            if r.kind == 0:
                up[r.ca] = r.ca
                state[r.ca] = [int(r.size), r.total, r.parts, r.cluster, [] if r.cluster else [r.ca]]
            else:
                edges.append(r)
        for w, same in groupby(edges, key=lambda r: r.w):
            rate, touched, name = 1 / max(w, NEAR), {}, None
            for e in same:
                a, b = root(e.ca), root(e.cb)
                name = f"{e.a}:{e.b}"
                up[max(a, b)] = min(a, b)
                for i in (a, b):
                    touched[i] = name
            met: dict[int, list[int]] = {}
            for i in touched:
                met.setdefault(root(i), []).append(i)
            for top, members in met.items():
                parts = [state.pop(i) for i in members]
                size = sum(p[0] for p in parts)
                large = [p for p in parts if p[3]]
                small = [c for p in parts for c in p[4]]
                if len(large) == 1:
                    keep = large[0]
                    new = [size, keep[1] + (size - keep[0]) * rate, keep[2], keep[3]]
                elif large or size >= least:
                    own = touched[max(members)]
                    best = 0.0 if large else None
                    for p in large:
                        stable = p[1] - rate * p[0]
                        chosen = p[2] is None or stable >= p[2]
                        best += stable if chosen else p[2]
                        yield 1, -1, p[3], own, chosen, -1, 0.0, None
                    new = [size, size * rate, best, own]
                else:
                    state[top] = [size, 0.0, None, None, small]
                    continue
                for c in small:
                    yield 2, c, new[3], None, False, -1, 0.0, None
                state[top] = [*new, []]
        for top, s in state.items():
            yield 0, top, s[3], None, False, s[0], s[1], s[2]

    def run(frames):
        names = ["kind", "comp", "cluster", "parent", "chosen", "size", "total", "parts"]

        def rows():
            for f in frames:
                # The best of the parts is null where a cluster has none; whole numbers are never null here.
                f["parts"] = f["parts"].astype(object).where(f["parts"].notna(), None)
                yield from f.itertuples(index=False)

        out = []
        for _, g in groupby(rows(), key=lambda r: r.grp):
            out += group(g)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return run


def condensed(df: DataFrame, least: int, k: int, first_radius: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spanning tree (a, b, w), clusters (cluster, parent, chosen), and (row, cluster) where each row left the tree."""
    spark = df.sparkSession
    points = cut(core_distances(df, k, first_radius, xy, row).withColumn("comp", F.col("row")))
    ends = points.agg(F.min(F.when(F.col("core") > 0, F.col("core"))).alias("r"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far"), F.count(F.lit(1)).alias("n")).first()
    state = points.select(F.col("row").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("parts"), F.lit(None).cast("string").alias("cluster"))
    tree, entries, clusters = [], [], []
    r, left = (ends["r"] or 1.0) * 1.5, ends["n"]
    # Rows of one place with core distance 0 are a star of edges of length 0.
    start, found = points, []
    same = points.where(F.col("core") == 0).groupBy("x", "y").agg(F.min("row").alias("m"))
    zero = points.where(F.col("core") == 0).join(same, ["x", "y"]).where(F.col("row") != F.col("m")).select(F.lit(0.0).alias("w"), F.col("m").alias("a"), F.col("row").alias("b"))
    zero = cut(zero)
    if not zero.isEmpty():
        points = cut(points.join(same, ["x", "y"], "left").select("row", "x", "y", "core", F.when(F.col("core") == 0, F.coalesce("m", "row")).otherwise(F.col("row")).alias("comp")))
        found, left = [zero], points.select("comp").distinct().count()
    while left > 1 or found:
        while left > 1:
            best = cut(least_edges(points, r))
            if best.isEmpty():
                break
            edges, points, left = linked(points, best, left)
            found.append(edges)
        if found:
            edges = found[0]
            for e in found[1:]:
                edges = edges.union(e)
            tree += found
            was = start.select("row", F.col("comp").alias("was")).join(points.select("row", "comp"), "row")
            moved = was.groupBy("was").agg(F.first("comp").alias("grp"))  # all rows of a component have one
            side = lambda c, w: was.select(F.col("row").alias(c), F.col("was").alias(w), F.col("comp").alias("grp"))  # noqa: E731, B023
            put = edges.join(side("a", "ca"), "a").join(side("b", "cb").drop("grp"), "b")
            none = lambda t: F.lit(None).cast(t)
            put = put.select("grp", F.lit(1).alias("kind"), "w", "a", "b", "ca", "cb", F.lit(-1).cast("long").alias("size"), F.lit(0.0).alias("total"), none("double").alias("parts"), none("string").alias("cluster"))
            held = state.join(moved, F.col("comp") == F.col("was")).join(put.select("grp").distinct(), "grp", "left_semi")
            held = held.select("grp", F.lit(0).alias("kind"), F.lit(-1.0).alias("w"), *[F.lit(-1).cast("long").alias(c) for c in ("a", "b")], F.col("comp").alias("ca"), F.lit(-1).cast("long").alias("cb"), "size", "total", "parts", "cluster")
            walked = held.union(put).repartition("grp").sortWithinPartitions("grp", "kind", "w", "a", "b")
            out = cut(walked.mapInPandas(_walk(least), "kind int, comp long, cluster string, parent string, chosen boolean, size long, total double, parts double"))
            rest = state.join(moved, F.col("comp") == F.col("was")).join(put.select("grp").distinct(), "grp", "left_anti").select("comp", "size", "total", "parts", "cluster")
            state = cut(rest.union(out.where("kind = 0").select("comp", "size", "total", "parts", "cluster")))
            clusters.append(out.where("kind = 1").select("cluster", "parent", "chosen"))
            gone = out.where("kind = 2").select(F.col("comp").alias("was"), "cluster")
            entries.append(cut(was.select("row", "was").join(gone, "was").select("row", "cluster")))
            start, found = points, []
        r *= GROW
        if left > 1 and r > 1e6 * (abs(ends["far"]) + 1):
            raise ValueError("places that no distance links")
    union = lambda parts, kind: spark.createDataFrame([], kind) if not parts else parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:], kind))
    roots = state.where("cluster IS NOT NULL").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("chosen"))
    return union([t.select("a", "b", "w") for t in tree], "a long, b long, w double"), union([*clusters, roots], ""), union(entries, "row long, cluster string")


def hdbscan(df: DataFrame, least: int = 10, k: int | None = None, first_radius: float = 100.0, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """cluster_id (1 the largest, -1 none) and n_in_cluster of every row; ``k`` other rows make a core (``least`` if None).

    Rows without a finite place, and all of a table of fewer rows than ``least``, are in no cluster.
    """
    _, clusters, entries = condensed(df, least, k or least, first_radius, xy, row)
    now = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    while not now.where("up IS NOT NULL").isEmpty():  # doubling the way up each time
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        now = cut(now.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    label = F.col("top")
    names = now.where("top IS NOT NULL").select("top").distinct()
    # Names are numbered by the least row of each, as ids are elsewhere.
    of = entries.join(now, "cluster").where(label.isNotNull()).select(F.col("row").alias(row), "top")
    first = of.groupBy("top").agg(F.min(row).alias("cluster_id"))
    labels = of.join(names, "top", "left_semi").join(first, "top").select(row, "cluster_id")
    return ranked_by_size(df.drop("cluster_id", "n_in_cluster").join(labels, row, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))), row=row)
