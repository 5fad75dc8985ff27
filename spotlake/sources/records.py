"""Structured arrays (.npy, or a .zip that holds one) as tables, whose nested fields become structs and lists.

A file is read by one task, through Spark's readers, so any store serves; files are limited to the 2 GB that Spark
puts into a value. Pickled objects are refused.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records sent to the JVM at once; bytes at the start of a file that hold its header.
BATCH, HEADER = 20_000, 1 << 16
SIGNED = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint", "f2": "float", "f4": "float", "f8": "double"}


def opened(path: str, content: bytes) -> io.IOBase:
    """The array's bytes: the file itself, or the first .npy by name inside a .zip."""
    if not path.lower().endswith(".zip"):
        return io.BytesIO(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        inside = sorted(n for n in z.namelist() if n.lower().endswith(".npy"))
        if not inside:
            raise ValueError(f"no .npy inside {path}")
        return io.BytesIO(z.read(inside[0]))


def spark_type(dtype: np.dtype) -> str:
    if dtype.subdtype:
        base, shape = dtype.subdtype
        return "array<" * len(shape) + spark_type(base) + ">" * len(shape)
    if dtype.names:
        return "struct<" + ", ".join(f"`{n}`: {spark_type(dtype[n])}" for n in dtype.names) + ">"
    if dtype.kind in "biufSU":
        return {"b": "boolean", "S": "string", "U": "string"}.get(dtype.kind) or SIGNED[dtype.str[1:]]
    raise ValueError(f"no column type for {dtype}")


def arrow_column(a: np.ndarray) -> pa.Array:
    """One Arrow value for each entry along the first axis."""
    if a.ndim > 1:
        inner = arrow_column(a.reshape(-1, *a.shape[2:]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), inner)
    if a.dtype.names:
        return pa.StructArray.from_arrays([arrow_column(a[n]) for n in a.dtype.names], names=list(a.dtype.names))
    if a.dtype.kind in "SU":
        return pa.array(np.char.decode(a, "utf-8") if a.dtype.kind == "S" else a, pa.string())
    plain = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("=")))
    if a.dtype.kind == "u":  # Spark has no unsigned integers; one that doesn't fit raises an error
        return pa.array(plain).cast({1: pa.int16(), 2: pa.int32()}.get(a.dtype.itemsize, pa.int64()))
    return pa.array(plain.astype(np.float32) if a.dtype.str[1:] == "f2" else plain)


def _layouts(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = opened(path, content)
            version = np.lib.format.read_magic(f)
            _, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if not dtype.names:
                raise ValueError(f"{path} holds no records")
            yield pa.RecordBatch.from_pydict({"layout": [", ".join(f"`{n}` {spark_type(dtype[n])}" for n in dtype.names)]})


def _records(batches):
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            a = np.load(opened(path.as_py(), content.as_py()), allow_pickle=False).reshape(-1)
            for i in range(0, len(a), BATCH):
                part = a[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([arrow_column(part[n]) for n in part.dtype.names], names=list(part.dtype.names))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file, or of a folder's or pattern's files, which must have one layout."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(npy|zip)$"))
    head = F.when(F.lower("path").endswith(".npy"), F.substring("content", 1, HEADER)).otherwise(F.col("content"))
    layouts = [r["layout"] for r in files.select("path", head.alias("content")).mapInArrow(_layouts, "layout string").distinct().limit(2).collect()]
    if len(layouts) != 1:
        raise ValueError(f"{path}: {'files of different layouts' if layouts else 'no .npy or .zip'}")
    return files.select("path", "content").mapInArrow(_records, layouts[0])
