"""Blinks as one row each, end to end: which rows belong together, and what their group has.

A table with a trace id is grouped by it (per file and channel), for the instrument has already said what is one molecule;
another by linking in place and time. Rows whose ``use`` is 0 are left out: they get group -1 and no row of the grouped table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate as A
from .graph import link_blinks
from .storage import cut, numbered


def by_trace(df: DataFrame, trace: str = "tid", blocks: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with group_id: 1, 2, ... in order of the blocks and traces; rows without a trace are one of their own in each block."""
    keys = [*blocks, trace]
    ids = numbered(df.select(*keys).distinct(), "group_id", *keys).withColumn("group_id", F.col("group_id") + 1)
    named = ids.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [df[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return df.drop("group_id").join(named, same).drop(*[f"__{k}" for k in keys])


def group_table(df: DataFrame, dx: float = 50.0, dt: int = 1, precision: str | None = None, blocks: tuple[str, ...] = ("filenumber", "channel"), trace: str = "tid", use: str = "use", row: str = "row_id", **rules) -> tuple[DataFrame, DataFrame]:
    """The grouped table, and ``df`` with group_id (from 1; -1 if left out) and n_in_group.

    ``precision``: the column by which rows are linked instead of a fixed box. ``rules``: as for ``combine``. A null ``use`` is 0.
    """
    df = df.drop("group_id", "n_in_group")
    blocks = tuple(b for b in blocks if b in df.columns)
    used = F.coalesce(F.col(use).cast("double"), F.lit(0.0)) != 0 if use in df.columns else F.lit(True)
    rows = df.where(used).drop(use)
    if trace in df.columns:
        linked = by_trace(rows, trace, blocks)
    else:
        linked = link_blinks(rows, dx, dt, precision, keys=blocks, row=row).drop("n_in_group").withColumn("group_id", F.col("group_id") + 1)
    linked = cut(linked)
    grouped = A.combine(linked, ["group_id"], [c for c in linked.columns if c not in ("group_id", row)], **rules)
    size = grouped.select("group_id", F.col("n_in_group").cast("long").alias("n_in_group"))
    ids = linked.select(row, "group_id").join(size, "group_id")
    return grouped, df.join(ids, row, "left").withColumns({"group_id": F.coalesce("group_id", F.lit(-1)), "n_in_group": F.coalesce("n_in_group", F.lit(0))})
