"""Tables as sets of rows: padding, unions, files, ids, order and repetition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered
from pyspark.sql import types as T

PROTECTED = ("x_nm", "y_nm", "frame", "filenumber")


def is_id(name: str) -> bool:
    """Whether a column's name says that it holds ids, of which -1 means none."""
    base = name.removesuffix("_file")
    return base == "tid" or base.endswith("_id")


def missing_value(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.FractionalType):
        return F.lit(float("nan")).cast(kind)
    if isinstance(kind, T.IntegralType):
        return F.lit(-1 if is_id(name) else 0).cast(kind)
    return F.lit(None).cast(kind)


def fill_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL to what stands for missing: NaN, -1 for ids, 0 for other whole numbers."""
    use = df.columns if columns is None else columns
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), missing_value(f.name, f.dataType)).alias(f.name) if f.name in use else F.col(f"`{f.name}`") for f in df.schema])


def concat(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name, padded by kind; whole and floating types meet as the wider one."""
    return fill_missing(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables))


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of tables with the same columns."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)


def keep_apart(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ids moved above those of ``old`` where they overlap; own numbers stay in *_file columns."""
    ids = [c for c in new.columns if is_id(c) and c in old.columns and not c.endswith("_file")]
    if not ids:
        return new
    top = old.agg(*[F.max(c).alias(c) for c in ids]).first()
    low = new.agg(*[F.min(F.when(F.col(c) >= 0, F.col(c))).alias(c) for c in ids]).first()
    out = {}
    for c in ids:
        if top[c] is not None and low[c] is not None and low[c] <= top[c]:
            out[f"{c}_file"], out[c] = F.col(c), F.when(F.col(c) >= 0, F.col(c) + F.lit(top[c] + 1)).otherwise(F.col(c))
    return new.withColumns(out) if out else new


def add_file(table: DataFrame | None, new: DataFrame, number: int) -> DataFrame:
    """Append a file to the one table: its number, ids apart, missing columns padded."""
    new = new.withColumn("filenumber", F.lit(number))
    return new if table is None else concat([table, keep_apart(table, new)])


def remove_file(df: DataFrame, number: int) -> DataFrame:
    """Without a file's rows; later file numbers close up."""
    f = F.col("filenumber")
    return df.where(f != number).withColumn("filenumber", F.when(f > number, f - 1).otherwise(f))


def combine_files(df: DataFrame, columns: tuple[str, ...] = ("frame",), gap: int = 0, file: str = "filenumber") -> DataFrame:
    """Files as one acquisition: frames, times and ids of a file go on where the files before it end."""
    steps = {c: 1 for c in columns}
    top = df.groupBy(file).agg(*[F.max(c).alias(c) for c in columns])
    w = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    before = top.select(file, *[F.coalesce(F.sum(F.greatest(F.col(c), F.lit(-1)) + steps[c] + gap).over(w), F.lit(0)).alias(f"__{c}") for c in columns])
    out = df.join(before, file)
    for c in columns:
        moved = F.col(c) + F.col(f"__{c}")
        out = out.withColumn(c, F.when(F.col(c) >= 0, moved).otherwise(F.col(c)) if is_id(c) else moved)
    return out.select(*df.columns)


def frames_apart(df: DataFrame, frame: str = "frame", file: str = "filenumber") -> DataFrame:
    """Frames moved so that no two files touch."""
    r = df.agg(F.min(frame).alias("a"), F.max(frame).alias("b")).first()
    span = 2 * ((r["b"] or 0) - (r["a"] or 0) + 1)
    return df.withColumn(frame, F.col(frame) + F.col(file) * span)


def ordered(df: DataFrame, keys: list[tuple[str, bool]], row: str = "row_id") -> DataFrame:
    """Sorted by up to several (column, descending); what is missing comes last either way; ties in row order."""
    order = []
    for c, down in keys:
        x = F.col(c)
        if isinstance(df.schema[c].dataType, T.FractionalType):
            x = F.when(~F.isnan(x), x)
        order.append(x.desc_nulls_last() if down else x.asc_nulls_last())
    return df.orderBy(*order, row)


def keyword_order(df: DataFrame, column: str, words: list[str], row: str = "row_id") -> DataFrame:
    """Sorted by a keyword's place in a list; other words last."""
    at = F.array_position(F.array(*map(F.lit, words)), F.col(column))
    return df.orderBy(F.when(at > 0, at).asc_nulls_last(), row)


def dense_ids(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Ids from 0 in ascending order onto the rows, -1 for none: ranks of the distinct ids, joined back."""
    ids = df.where(F.col(column) >= 0).select(column).distinct()
    codes = numbered(ids, out, column)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def shuffle_ids(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """A permutation of the distinct ids onto themselves, in <column>_shuffled; -1 stays."""
    ids = df.where(F.col(column) >= 0).select(column).distinct()
    by_id = numbered(ids.select(F.col(column).alias("__to")), "__r", "__to")
    mixed = numbered(ids.withColumn("__h", F.xxhash64(column, F.lit(seed))), "__r", "__h", column)
    both = mixed.join(by_id, "__r").select(column, "__to")
    return df.join(both, column, "left").withColumn(f"{column}_shuffled", F.coalesce("__to", F.col(column))).drop("__to")


def first_of(df: DataFrame, keys: list[str], row: str = "row_id") -> DataFrame:
    """The first row of each distinct value."""
    w = Window.partitionBy(*keys).orderBy(row)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def chunks(df: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    """A column chunk from 0: n parts of equal size in row order. Sizes follow from counts of row ranges."""
    out = numbered(df, "chunk", row)
    total = out.count()
    size, more = divmod(total, n)  # the first ``more`` parts have one row more
    at, edge = F.col("chunk"), more * (size + 1)
    return out.withColumn("chunk", F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(size, 1))).cast("int"))


def repeat(df: DataFrame, times: int, step: int = 0, frame: str = "frame") -> DataFrame:
    """Each row ``times`` times, its frame moved on by ``step`` each."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(frame, F.col(frame) + F.col("copy") * step)


def linearize(df: DataFrame, columns: list[str], code: str = "code") -> DataFrame:
    """Array columns (one entry a channel) to one row a channel, with its number."""
    first = df.withColumn("__z", F.arrays_zip(*columns))
    rest = [c for c in df.columns if c not in columns]
    return first.select(*rest, F.posexplode("__z").alias(code, "__v")).select(*rest, code, *[F.col("__v")[c].alias(c) for c in columns])


def time_blocks(df: DataFrame, n: int, frame: str = "frame", assignment: str = "alternate", seed: int = 0) -> DataFrame:
    """A column half (0 or 1): frames in ``n`` blocks of equal length, dealt in turn or by a seeded hash."""
    r = df.agg(F.min(frame).alias("a"), F.max(frame).alias("b")).first()
    width = max(1, -(-((r["b"] or 0) - (r["a"] or 0) + 1) // n))
    block = F.floor((F.col(frame) - (r["a"] or 0)) / width).cast("long")
    return df.withColumn("half", (block % 2 if assignment == "alternate" else F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(2))).cast("int"))


def thinned(df: DataFrame, budget: int, row: str = "row_id") -> DataFrame:
    """Every n-th row, so that at most ``budget`` are left (a sampling operator, for display)."""
    step = max(1, -(-df.count() // budget))
    return df.where(F.col(row) % step == 0)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old in PROTECTED or new in df.columns:
        raise ValueError(f"{old} can't be renamed to {new}")
    return df.withColumnRenamed(old, new)


def remove_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if bad := [c for c in names if c in PROTECTED]:
        raise ValueError(f"{', '.join(bad)} can't be removed")
    return df.drop(*names)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, those that every table needs, and no others; unknown names are ignored."""
    return df.select(*[c for c in df.columns if c in names or c in PROTECTED])
