"""Mergeable quantile summaries of very many groups (Greenwald and Khanna 2001).

A summary is a list of tuples (value, g, delta) in order of value: the rows up to a value number between the
sum of g so far and that sum plus delta. Each partition summarises what it holds of a group; summaries
of one group and batch are then merged, and a group's batches are merged into its whole from the summaries alone.

* Rows come as (keys, batch, x, n) with n rows of one x, counted before anything else, so that no frequent value or group
  weighs on a task. They are dealt by all of this, so every group is spread over the partitions.
* Merging: a value's bounds are the sums of its bounds in the parts. A part that has the value gives its own; another
  gives the rows up to the value before, and one less than the upper bound of the value after. So delta
  grows by what the other parts leave open. A part that was never compressed leaves nothing open.
* Compression joins a tuple to its right neighbour where g + g' + delta' stays within a share of the rows and the band of its
  delta is not above the neighbour's; the first and last value and at least ``LEAST`` tuples stay. The share doubles from step to step,
  from the partitions' parts over merges of at most ``FAN`` partitions to the batches and to the whole, which has 0.8 of twice
  the half error that is allowed: the error of an answer is g + delta at most.
* Parts are merged as rows sorted by group, a block of groups at a time in numpy; a group has at most ``FAN`` parts a
  batch in the last step, each of bounded length, so no group fills a task.

Exact ranks of the answers are counts as by a binary search in all rows, but nothing is broadcast, for answers grow with the
groups: each answer and each target is sent to its own cell of ``CELL`` values, found from the cells' running counts,
and only that cell's rows are counted.

Defined results: rows without a key, x or n are dropped; a group of less than ``least`` rows has no answers; an empty
table gives an empty result. Columns other than the named ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Batch number of the whole.
WHOLE = -1
#: Up to so many tuples a summary isn't compressed; fewer than LEAST it never gets by compression, and no more than MOST.
KEEP, LEAST, MOST = 100, 50, 1000
#: Partitions whose parts are merged in one step; rows that a task handles at once; bits of a cell of values.
FAN, BLOCK, BITS = 64, 300_000, 8
CELL = 1 << BITS


def compress(x: np.ndarray, g: np.ndarray, d: np.ndarray, most: float, banded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join tuples to their right neighbours while g and delta together stay within ``most``."""
    count, top = len(x), int(most)
    if count <= max(KEEP, LEAST) or top < 2:
        return x, g, d
    gs, ds = g.tolist(), d.tolist()
    band = (lambda v: 64 if v == 0 else max(0, top - v).bit_length()) if banded else (lambda v: 0)
    keep, sums = [count - 1], [gs[-1]]
    spare, own, after, high = count - LEAST, gs[-1], ds[-1], band(ds[-1])
    for i in range(count - 2, 0, -1):
        if spare and gs[i] + own + after <= top and band(ds[i]) <= high:
            own += gs[i]
            sums[-1] = own
            spare -= 1
        else:
            keep.append(i)
            own, after = gs[i], ds[i]
            high = band(after)
            sums.append(own)
    keep.append(0)
    sums.append(gs[0])
    at = np.array(keep[::-1])
    out = x[at], np.array(sums[::-1], np.int64), d[at]
    return compress(*out, most, False) if banded and len(at) > MOST // 2 else out


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One summary of several (x, g, delta, exact), not compressed."""
    xs = np.unique(np.concatenate([p[0] for p in parts]))
    low, high = np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)
    for x, g, d, exact in parts:
        least = np.cumsum(g)
        upto = np.searchsorted(x, xs, "right")  # values of the part up to each
        low += np.r_[0, least][upto]
        if exact:
            high += np.r_[0, least][upto]
        else:
            has = x[np.maximum(upto - 1, 0)] == xs
            high += np.where(has, (least + d)[np.maximum(upto - 1, 0)], np.r_[least + d - 1, least[-1]][upto])
    return xs, np.diff(low, prepend=0), high - low


class Block:
    """Tuples of many groups, in order of group, batch and value."""

    def __init__(self, group, batch, part, x, g, d, exact):
        order = np.lexsort((x, batch, group))
        self.group, self.batch, self.part, self.x, self.g, self.d, self.exact = (v[order] for v in (group, batch, part, x, g, d, exact))

    def summaries(self, share: float) -> Block:
        """One summary of each group and batch, compressed to ``share`` of its rows."""
        n = len(self.x)
        if not n:
            return self
        new = np.r_[True, (self.group[1:] != self.group[:-1]) | (self.batch[1:] != self.batch[:-1])]
        begins = np.flatnonzero(new)
        rough = np.logical_or.reduceat(~self.exact, begins)
        # Where all parts are exact, rows of one value are added up.
        first = np.flatnonzero(new | np.r_[True, self.x[1:] != self.x[:-1]])
        of = np.cumsum(new) - 1
        g, x, s = np.add.reduceat(self.g, first), self.x[first], of[first]
        rows = np.add.reduceat(self.g, begins)
        size = np.bincount(s, minlength=len(begins))
        todo = np.flatnonzero(rough | ((size > KEEP) & (share * rows >= 2)))
        plain = np.isin(s, todo, invert=True, assume_unique=False)
        out = [(begins[s[plain]], x[plain], g[plain], np.zeros(plain.sum(), np.int64), np.ones(plain.sum(), bool))]
        ends, tops = np.r_[begins[1:], n], np.r_[0, np.cumsum(size)]
        for k in todo.tolist():
            if rough[k]:
                at = slice(begins[k], ends[k])
                part = self.part[at]
                got = merge([(self.x[at][m], self.g[at][m], self.d[at][m], bool(self.exact[at][m].all())) for p in np.unique(part) for m in [part == p]])
            else:
                got = x[tops[k] : tops[k + 1]], g[tops[k] : tops[k + 1]], np.zeros(size[k], np.int64)
            done = compress(*got, share * rows[k])
            out.append((np.full(len(done[0]), begins[k]), *done, np.full(len(done[0]), not rough[k] and len(done[0]) == len(got[0]))))
        head, x, g, d, exact = (np.concatenate(v) for v in zip(*out, strict=True))
        return Block(self.group[head], self.batch[head], self.batch[head], x, g, d, exact)

    def with_whole(self, share: float) -> Block:
        """These summaries of batches, and that of each group's whole, merged from them."""
        whole = Block(self.group, np.full(len(self.x), WHOLE), self.batch, self.x, self.g, self.d, self.exact).summaries(share)
        return Block(*(np.concatenate([getattr(self, c), getattr(whole, c)]) for c in ("group", "batch", "part", "x", "g", "d", "exact")))

    def answers(self, parts: int, least: int) -> tuple[np.ndarray, ...]:
        """(group, batch, i, n, target, points, answer) of summaries of at least ``least`` rows, i from 1 to parts - 1."""
        if not len(self.x):
            return tuple(np.zeros(0, np.int64) for _ in range(7))
        new = np.r_[True, (self.group[1:] != self.group[:-1]) | (self.batch[1:] != self.batch[:-1])]
        begins = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        rows, points = np.add.reduceat(self.g, begins), np.diff(np.r_[begins, len(self.x)])
        total = np.cumsum(self.g)
        middle = 2 * (total - (total - self.g)[begins][of]) + self.d
        out = []
        for i in range(1, parts):
            target = -(-i * rows // parts)
            at = np.minimum.reduceat(np.where(middle >= 2 * target[of], np.arange(len(of)), len(of)), begins)
            out.append((self.group[begins], self.batch[begins], np.full(len(begins), i), rows, target, points, self.x[at]))
        found = tuple(np.concatenate(v) for v in zip(*out, strict=True))
        return tuple(v[found[3] >= least] for v in found)


def blocks(batches, keys: int, whole_groups: bool) -> Iterator[tuple[list, Block]]:
    """Sorted rows (keys, batch, part, x, g, delta, exact) as blocks; with ``whole_groups`` no group is cut in two."""
    held: list[pa.RecordBatch] = []

    def build(table: pa.Table):
        cols = [c.combine_chunks() for c in table.columns]
        change = np.zeros(len(table), bool)
        for c in cols[:keys]:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        group = np.cumsum(change)
        names = [c.take(pa.array(np.flatnonzero(np.r_[True, change[1:]]))) for c in cols[:keys]]
        return names, Block(group, *(c.to_numpy(zero_copy_only=False) for c in cols[keys:])), group

    waiting = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            waiting += b.num_rows
        if waiting < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        stop = len(table)
        if whole_groups:  # leave the last group to what follows
            last = np.ones(stop, bool)
            for c in range(keys):
                last &= pc.equal(table.column(c), table.column(c)[stop - 1]).to_numpy(zero_copy_only=False)
            stop = int(np.argmax(last))
        if stop:
            yield build(table.slice(0, stop))[:2]
            held = table.slice(stop).to_batches()
        waiting = sum(len(h) for h in held) if whole_groups and not stop else 0
    if held:
        yield build(pa.Table.from_batches(held))[:2]


def summarise(rows: DataFrame, keys: list[str], error: float = 0.02, answers: tuple[int, int] | None = None) -> DataFrame:
    """Summaries of (keys, batch) and of the keys' whole, of rows (keys, batch, x, n).

    (keys, batch, x, g, delta) as one row a tuple; or with ``answers`` = (parts, least) the estimates of the
    quantiles i / parts of summaries of at least ``least`` rows: (keys, batch, i, n, target, points, answer).
    """
    kinds = [(k, rows.schema[k].dataType.simpleString()) for k in keys]
    tuples = ", ".join([*(f"{k} {t}" for k, t in kinds), "batch long, part long, x long, g long, delta long, exact boolean"])
    source = rows.select(*keys, F.col("batch").cast("long").alias("batch"), F.lit(0).cast("long").alias("part"), F.col("x").cast("long").alias("x"), F.col("n").cast("long").alias("g"), F.lit(0).cast("long").alias("delta"), F.lit(True).alias("exact"))
    parts = source.rdd.getNumPartitions()  # of the plan; nothing runs
    levels = 1
    while FAN**levels < parts:
        levels += 1
    whole, batch = 0.8 * error, 0.4 * error

    def send(names: list, b: Block, part: np.ndarray):
        cols = [b.batch, part, b.x, b.g, b.d, b.exact]
        return pa.RecordBatch.from_arrays([*(n.take(pa.array(b.group)) for n in names), *(pa.array(c) for c in cols)], [*keys, "batch", "part", "x", "g", "delta", "exact"])

    def leaf(batches):
        here = TaskContext.get().partitionId()
        for i, (names, b) in enumerate(blocks(batches, len(keys), False)):
            b = b.summaries(batch / 2**levels)
            yield send(names, b, np.full(len(b.x), here * (1 << 24) + i))

    def step(level: int):
        def run(batches):
            for names, b in blocks(batches, len(keys) + 2, True):
                # The group is (keys, batch, part's number on this level), so parts that meet become one.
                b = b.summaries(batch / 2 ** (levels - level))
                yield send(names[: len(keys)], b, names[-1].take(pa.array(b.group)).to_numpy())

        return run

    def last(batches):
        for names, b in blocks(batches, len(keys), True):
            b = b.summaries(batch).with_whole(whole)
            if answers is None:
                out = [b.batch, b.x, b.g, b.d]
                group = b.group
            else:
                group, *out = b.answers(*answers)
            yield pa.RecordBatch.from_arrays([*(n.take(pa.array(group)) for n in names), *(pa.array(c) for c in out)], [*keys, *(["batch", "x", "g", "delta"] if answers is None else ["batch", "i", "n", "target", "points", "answer"])])

    now = source.mapInArrow(leaf, tuples)
    for level in range(1, levels):
        to = F.floor(F.col("part") / ((1 << 24) * FAN**level)).cast("long")
        dealt = now.withColumn("to", to).repartition(*keys, "batch", "to").sortWithinPartitions(*keys, "batch", "to")
        # The group's columns go before, batch and number once more as values of the tuples.
        cols = dealt.select(*keys, F.col("batch").alias("of"), "to", "batch", "part", "x", "g", "delta", "exact")
        now = cols.mapInArrow(step(level), tuples).withColumn("part", F.col("part") * ((1 << 24) * FAN**level))
    ends = ", ".join([*(f"{k} {t}" for k, t in kinds), "batch long, x long, g long, delta long" if answers is None else "batch long, i long, n long, target long, points long, answer long"])
    return now.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(last, ends)


def exact_ranks(rows: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """``asked`` (keys, batch, i, target, answer and others) with exact_x, n_below and n_upto, counted in all rows."""
    cell = lambda c: F.shiftright(c, BITS)
    counts = rows.groupBy(*keys, "batch", cell("x").alias("cell")).agg(F.sum("n").alias("m"))
    counts = counts.union(counts.groupBy(*keys, F.lit(WHOLE).alias("batch"), "cell").agg(F.sum("m").alias("m")))
    # As many rows a group as it has cells, whatever the number of its rows.
    counts = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*keys, "batch").orderBy("cell")) - F.col("m"))
    one = [*keys, "batch", "i"]
    met = asked.join(counts, [*keys, "batch"])
    holds = (F.col("before") < F.col("target")) & (F.col("target") <= F.col("before") + F.col("m"))
    found = met.groupBy(*asked.columns).agg(*(F.max(F.when(c, F.col(v))).alias(n) for n, c, v in (("tc", holds, "cell"), ("tb", holds, "before"), ("ab", F.col("cell") == cell("answer"), "before"))))
    found = found.withColumn("ac", cell("answer"))
    sent = found.select(*one, "answer", "target", "tb", F.explode(F.array(F.struct(F.col("ac").alias("cell"), F.lit(False).alias("t")), F.struct(F.col("tc").alias("cell"), F.lit(True).alias("t")))).alias("to")).select("*", "to.cell", "to.t")
    own = rows.select(*keys, F.col("batch").alias("rb"), "x", "n", cell("x").alias("cell"))
    near = sent.join(own, [*keys, "cell"]).where((F.col("batch") == WHOLE) | (F.col("batch") == F.col("rb")))
    near = near.groupBy(*one, "t", "x", "answer", "target", "tb").agg(F.sum("n").alias("n"))
    upto = F.col("tb") + F.sum("n").over(Window.partitionBy(*one, "t").orderBy("x"))
    near = near.withColumn("upto", upto).groupBy(*one).agg(
        F.min(F.when(F.col("t") & (F.col("upto") >= F.col("target")), F.col("x"))).alias("exact_x"),
        F.sum(F.when(~F.col("t") & (F.col("x") < F.col("answer")), F.col("n")).otherwise(0)).alias("lo"),
        F.sum(F.when(~F.col("t") & (F.col("x") <= F.col("answer")), F.col("n")).otherwise(0)).alias("hi"),
    )
    back = found.join(near, one)
    return back.select(*asked.columns, "exact_x", (F.col("ab") + F.col("lo")).alias("n_below"), (F.col("ab") + F.col("hi")).alias("n_upto"))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch, x, n) of rows (keys, batch, x, n), written once; sorted within the files."""
    some = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "batch", "x", "n"]))
    return cut(some.groupBy(*keys, "batch", "x").agg(F.sum("n").alias("n")).sortWithinPartitions(*keys, "batch", "x"))


def quantiles(rows: DataFrame, keys: list[str], parts: int = 4, least: int = 20, error: float = 0.02) -> DataFrame:
    """keys, batch, i, n, target, points, answer, exact_x, n_below, n_upto, rank_error of every summary."""
    table = counted(rows, keys)
    found = cut(summarise(table, keys, error, (parts, least)))
    out = exact_ranks(table.withColumn("batch", F.col("batch").cast("long")), keys, found)
    wrong = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", wrong)


def shop_rows(clicks: DataFrame, lines: DataFrame, items: DataFrame, batches: int = 4) -> DataFrame:
    """(stream, grp, batch, x, n) of the clicks' values and the sold items' prices.

    One row per click_id (of rows that differ the least client and value; null ids are one id); every line with its item. A row
    without item, group or finite amount is dropped; a null id is hashed as the empty text.
    """
    batch = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % batches).cast("int")
    amount = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = lambda c: (F.floor(100 * F.col(c) + 0.5) + 1000 * F.col("batch")).cast("long").alias("x")
    once = clicks.where(F.col("client_id").isNotNull() & amount("value")).groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("r"))
    value = once.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), batch("click_id").alias("batch"), F.col("r.value").alias("money"), F.lit(1).cast("long").alias("n"))
    sold = lines.where("item_id IS NOT NULL").groupBy("item_id", batch("vendor_id").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    priced = items.where(F.col("brand").isNotNull() & amount("price")).select("item_id", F.col("brand").alias("grp"), F.col("price").alias("money"))
    price = sold.join(priced, "item_id").select(F.lit("price").alias("stream"), "grp", "batch", "money", "n")
    return value.union(price).select("stream", "grp", "batch", x("money"), "n")


def shop_quantiles(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    out = quantiles(shop_rows(clicks, lines, items), ["stream", "grp"])
    return out.select(
        "stream", "grp", F.col("batch").cast("int").alias("batch"), F.col("i").cast("int").alias("i"), "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error",
        (1000 * F.col("rank_error") <= 20 * F.col("n")).alias("within"),
    )
