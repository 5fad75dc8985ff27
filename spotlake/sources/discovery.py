"""Finding datasets, a small language of path filters, and metadata of files and frames as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _glob(pattern: str) -> str:
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out += pattern[i : j + 1].replace("[!", "[^")
            i = j
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def parse_filter(text: str):
    """A predicate on (folder path, name). Shell patterns, in any case; ``,`` or ``|`` or, ``&`` and, ``!`` not.

    Not binds most, then and, then or; brackets and quotes as usual; an empty text keeps all.
    """
    tokens = re.findall(r"\s*(\"[^\"]*\"|'[^']*'|[(),|&!]|[^\s(),|&!\"'][^(),|&!\"']*)", text)
    at = 0

    def peek():
        return tokens[at].strip() if at < len(tokens) else ""

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1].strip()

    def one():
        t = take() if peek() else None
        if t == "!":
            inner = one()
            return lambda p: not inner(p)
        if t == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"a bracket is open in {text!r}")
            take()
            return inner
        if t is None or t in "),|&":
            raise ValueError(f"a pattern is missing in {text!r}")
        rx = re.compile(_glob(t.strip("\"'").lower()))
        return lambda p: bool(rx.fullmatch(p.lower()) or rx.fullmatch(p.lower().rpartition("/")[2]))

    def both():
        parts = [one()]
        while peek() == "&":
            take()
            parts.append(one())
        return lambda p: all(f(p) for f in parts)

    def either():
        parts = [both()]
        while peek() in (",", "|"):
            take()
            parts.append(both())
        return lambda p: any(f(p) for f in parts)

    if not text.strip():
        return lambda p: True
    made = either()
    if at < len(tokens):
        raise ValueError(f"{peek()!r} isn't expected in {text!r}")
    return made


def find(spark: SparkSession, paths: list[str], keep: str = "", skip: str = "", suffixes: tuple[str, ...] = (".parquet", ".csv", ".json", ".orc"), recursive: bool = True) -> list[str]:
    """Datasets below the paths, by Spark's file systems; a folder that is a dataset counts as one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted, unwanted = parse_filter(keep), parse_filter(skip) if skip.strip() else lambda p: False
    out = []

    def walk(path, inside: str):
        for s in path.getFileSystem(conf).listStatus(path):
            name = s.getPath().getName()
            rel = f"{inside}/{name}".lstrip("/")
            if name.startswith((".", "_")):
                continue
            if name.lower().endswith(suffixes):
                if wanted(rel) and not unwanted(rel):
                    out.append(str(s.getPath().toString()))
            elif s.isDirectory() and recursive:
                walk(s.getPath(), rel)

    for p in paths:
        walk(jvm.org.apache.hadoop.fs.Path(p), "")
    return sorted(out)


def file_conditions(df: DataFrame, name: Column, pattern: str, overrides: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Named groups of a pattern over file names as columns; lines {part of a name: {key: value}} come first.

    Empty means missing; numbers become numbers where every value is one.
    """
    keys = [*re.compile(pattern).groupindex]
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    index = re.compile(pattern).groupindex
    for k in keys:
        v = F.regexp_extract(name, plain, index[k])
        for part, values in (overrides or {}).items():
            if k in values:
                v = F.when(F.contains(name, F.lit(part)), F.lit(values[k])).otherwise(v)
        df = df.withColumn(k, F.when(v != "", v))
    if not keys:
        return df
    numeric = df.agg(*[F.bool_and(F.col(k).isNull() | F.expr(f"try_cast(`{k}` AS DOUBLE)").isNotNull()).alias(k) for k in keys]).first()
    return df.withColumns({k: F.coalesce(F.expr(f"try_cast(`{k}` AS DOUBLE)"), F.lit(float("nan"))) for k in keys if numeric[k]})


def codes(df: DataFrame, column: str, row: str = "row_id") -> DataFrame:
    """A text column as codes 0, 1 … by first appearance, -1 for none."""
    from ..operators.storage import numbered

    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row).alias("__f"))
    first = numbered(first, f"{column}_code", "__f").select(column, F.col(f"{column}_code").cast("int").alias(f"{column}_code"))
    return df.join(first, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))


def frame_tags(df: DataFrame, column: str = "tags", frame: str = "frame") -> DataFrame:
    """(frame, tag, value) from JSON {device: {property: value}} by frame; tags that never change are left out."""
    outer = F.from_json(column, "map<string,map<string,string>>")
    long = df.select(frame, F.explode(outer).alias("device", "m")).select(frame, "device", F.explode("m").alias("property", "value")).select(frame, F.concat_ws("-", "device", "property").alias("tag"), "value")
    changing = long.groupBy("tag").agg(F.count_distinct("value").alias("n")).where("n > 1").select("tag")
    return long.join(changing, "tag", "left_semi")


def tag_columns(tags: DataFrame, names: list[str], frame: str = "frame") -> DataFrame:
    return tags.groupBy(frame).pivot("tag", names).agg(F.first("value"))


def sequence_table(df: DataFrame, column: str = "sequence", key: str = "measurement") -> DataFrame:
    """(parameter, measurement columns…) of JSON settings, the parameters that differ first."""
    long = df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("parameter", "value"))
    names = [r[0] for r in long.select(key).distinct().orderBy(key).collect()]  # one row a measurement file; pivoted to columns
    wide = long.groupBy("parameter").pivot(key, names).agg(F.first("value"))
    differ = long.groupBy("parameter").agg((F.count_distinct("value") > 1).alias("differs"))
    return wide.join(differ, "parameter").orderBy(F.desc("differs"), "parameter")
