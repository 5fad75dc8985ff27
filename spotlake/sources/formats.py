"""A registry of formats: the first reader whose suffix matches and whose sniff passes is taken."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import records

#: Headers that other programs write, and our names; a unit in brackets scales to nm.
HEADERS = {
    "x": "x_nm", "y": "y_nm", "z": "z_nm", "xnm": "x_nm", "ynm": "y_nm", "znm": "z_nm", "n": "photons", "frame": "frame", "t": "frame", "intensity": "photons", "photons": "photons", "phot": "photons",
    "sigma": "sigma_nm", "psfxnm": "sigma_nm", "sigma1": "sigma_nm", "sigma2": "sigma_y_nm", "offset": "background", "bg": "background", "bkgstd": "background_std",
    "uncertainty": "xy_err_nm", "uncertainty_xy": "xy_err_nm", "uncertainty_z": "z_err_nm", "locprecnm": "xy_err_nm", "locprecznm": "z_err_nm", "channel": "channel", "llrel": "logl_rel", "lpx": "x_err_nm", "lpy": "y_err_nm",
    "chi2": "chi2", "detections": "n_in_group", "id": "row_id", "group": "group_id", "cluster_id": "cluster_id", "photons_err": "photons_err",
}
UNITS = {"nm": 1.0, "um": 1000.0, "µm": 1000.0, "px": None, "pixel": None}


@dataclass
class Format:
    name: str
    suffixes: tuple[str, ...]
    read: Callable[..., DataFrame]
    write: Callable[..., None] | None = None
    sniff: Callable[[SparkSession, str], bool] = field(default=lambda spark, path: True)


REGISTRY: list[Format] = []


def register(f: Format) -> Format:
    REGISTRY.append(f)
    return f


def reader_for(spark: SparkSession, path: str) -> Format:
    for f in REGISTRY:
        if path.lower().rstrip("/").endswith(f.suffixes) and f.sniff(spark, path):
            return f
    raise ValueError(f"no reader for {path}; known: {', '.join(f.name for f in REGISTRY)}")


def load(spark: SparkSession, path: str, pixelsize_nm: float | None = None, **how) -> DataFrame:
    """A table from any registered format, positions in nm."""
    return with_nm(reader_for(spark, path).read(spark, path, **how), pixelsize_nm)


def save(df: DataFrame, path: str, name: str | None = None, **how) -> None:
    for f in REGISTRY:
        if f.write and (f.name == name or (name is None and path.lower().endswith(f.suffixes))):
            f.write(df, path, **how)
            return
    raise ValueError(f"no writer for {name or path}")


def with_nm(df: DataFrame, pixelsize_nm: float | None = None) -> DataFrame:
    """x_nm, y_nm from pixels, where a table has only those; 100 nm a pixel if nothing is known."""
    if "x_nm" in df.columns or "x_pix" not in df.columns:
        return df
    size = pixelsize_nm or 100.0
    return df.withColumns({c.replace("_pix", "_nm"): F.col(c) * size for c in df.columns if c.endswith("_pix")})


def in_pixels(df: DataFrame, pixelsize_nm: float | None) -> DataFrame:
    if not pixelsize_nm:
        raise ValueError("the pixel size isn't known")
    return df.withColumns({c.replace("_nm", "_pix"): F.col(c) / pixelsize_nm for c in df.columns if c.endswith("_nm")})


# CSV --------------------------------------------------------------------------------------------------------


def delimiter(line: str) -> str:
    return max(",\t;", key=lambda d: (line.count(d), d == ",")) if any(d in line for d in ",\t;") else " "


def header_mapping(header: list[str], pixelsize_nm: float = 100.0) -> dict[str, tuple[str, float]]:
    """Our name and factor of each known header."""
    out = {}
    for h in header:
        name, _, unit = h.strip().strip('"').lower().replace("[", "(").partition("(")
        unit, name = unit.strip(" )]"), name.strip().replace(" ", "_")
        if name in HEADERS:
            ours = HEADERS[name]
            factor = (UNITS.get(unit, 1.0) if unit in UNITS else 1.0) if ours.endswith("_nm") else 1.0
            out[h] = (ours, pixelsize_nm if factor is None else factor)
        elif unit in ("", "nm"):
            out[h] = (name, 1.0)
    return out


def read_csv(spark: SparkSession, path: str, pixelsize_nm: float = 100.0, first_frame: int = 0, schema: T.StructType | None = None) -> DataFrame:
    """Text with a header line: separator guessed, known headers renamed and scaled, numbers only, frames from 0."""
    head = spark.read.text(path).first()[0]
    sep = delimiter(head)
    r = spark.read.option("header", True).option("sep", sep)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    to = header_mapping(df.columns, pixelsize_nm)
    cols, used = [], set()
    for f in df.schema:
        if not isinstance(f.dataType, T.NumericType) or f.name not in to or to[f.name][0] in used:
            continue
        name, factor = to[f.name]
        used.add(name)
        c = F.col(f"`{f.name}`")
        cols.append((c.cast("long") - first_frame if name == "frame" else c * factor if factor != 1.0 else c).alias(name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, columns: dict[str, str] | None = None, first_frame: int = 0, sep: str = ",") -> None:
    """Chosen columns under other names (ours -> theirs)."""
    columns = columns or {c: c for c in df.columns}
    out = [(F.col(a) + first_frame if a == "frame" else F.col(a)).alias(b) for a, b in columns.items() if a in df.columns]
    df.select(*out).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


@dataclass
class Conversion:
    """A saved way to read a text table, found again by its headers; the one that names most of them wins."""

    name: str
    columns: dict[str, tuple[str, float]]

    def matches(self, header: list[str]) -> bool:
        return set(self.columns) <= set(header)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f"`{h}`") * k if k != 1 else F.col(f"`{h}`")).alias(n) for h, (n, k) in self.columns.items()])

    @staticmethod
    def best(all_: list[Conversion], header: list[str]) -> Conversion | None:
        return max((c for c in all_ if c.matches(header)), key=lambda c: len(c.columns), default=None)


def read_json_traces(spark: SparkSession, path: str, every: bool = False, schema: str | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return trace_rows(r.json(path), every)


def read_array_traces(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    return trace_rows(records.read_arrays(spark, path), every)


def trace_rows(df: DataFrame, every: bool = False) -> DataFrame:
    """A row of the last iteration of each valid record, or with ``every`` one for each iteration.

    Records are nested, {itr: [{loc, efo, cfr, ...}], tid, tim, vld}, or flat, a record for each iteration, where
    ``fnl`` marks the last one. Positions come in nm, and two ratios (dcr) as dcr and dcr2; cfr stays as it was written.
    """
    if isinstance(df.schema["itr"].dataType, T.StructType):
        df = df.withColumn("itr", F.array("itr"))
    if not isinstance(df.schema["itr"].dataType, T.ArrayType):
        return _flat_rows(df, every)
    df = df.where("vld") if not every and "vld" in df.columns else df
    rest = [c for c in df.columns if c != "itr"]
    if every:
        valid = F.coalesce(F.col("vld").cast("boolean"), F.lit(False)) if "vld" in df.columns else F.lit(True)
        rest.append("final")
        size = df.withColumn("__last", F.size("itr") - 1).withColumn("__valid", valid)
        out = size.select("*", F.posexplode("itr").alias("iteration", "i")).withColumn("final", (F.col("__valid") & (F.col("iteration") == F.col("__last"))).cast("int"))
    else:
        out = df.select(*rest, (F.size("itr") - 1).alias("iteration"), F.element_at("itr", -1).alias("i"))
    names = [f.name for f in df.schema["itr"].dataType.elementType if f.name not in ("loc", "itr")]
    cols = _places(F.col("i")["loc"]) + [F.col("i")[n].alias(n) for n in names]
    keep = [F.col(c).alias({"tim": "time_s"}.get(c, c)) for c in rest]
    return out.select(*keep, "iteration", *cols)


def _places(loc):
    return [(loc[k] * 1e9).alias(n) for k, n in enumerate(("x_nm", "y_nm", "z_nm"))]


def _flat_rows(df: DataFrame, every: bool) -> DataFrame:
    met = F.lit(True)
    for c in {"vld", "fnl"} & set(df.columns):
        met = met & F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    df = df.withColumn("final", met.cast("int")) if every else df.where(met)
    cols = [F.col(c).alias({"tim": "time_s", "itr": "iteration"}.get(c, c)) for c in df.columns if c not in ("loc", "dcr", "fnl", "bot", "eot")]
    if "dcr" in df.columns:
        two = isinstance(df.schema["dcr"].dataType, T.ArrayType)
        cols += [F.get("dcr", F.lit(0)).alias("dcr"), F.get("dcr", F.lit(1)).alias("dcr2")] if two else [F.col("dcr")]
    return df.select(*cols, *_places(F.col("loc")))


def pixel_table(df: DataFrame, pixelsize_nm: float, variances: bool = False) -> DataFrame:
    """Tables of other programs in pixels (x, y, lpx, lpy, sx, sy, photons, bg, group) as ours; CRLB variances by root."""
    nm = {"x": "x_nm", "y": "y_nm", "lpx": "x_err_nm", "lpy": "y_err_nm", "sx": "sigma_x_nm", "sy": "sigma_y_nm", "x_cr": "x_err_nm", "y_cr": "y_err_nm"}
    same = {"phot": "photons", "photons": "photons", "bg": "background", "frame_ix": "frame", "frame": "frame", "group": "group_id", "id": "row_id"}
    cols = []
    for c in df.columns:
        if c in nm:
            v = F.sqrt(c) if variances and c.endswith("_cr") else F.col(c)
            cols.append((v * pixelsize_nm).alias(nm[c]))
        else:
            cols.append(F.col(c).alias(same.get(c, c)))
    return df.select(*cols)


def precision_bound(pattern_nm: float, signal, background):
    """Bound of a targeted-illumination position from the pattern's size, signal and background counts."""
    ratio = F.try_divide(signal, F.greatest(background, F.lit(1e-12)))
    return pattern_nm / F.sqrt(8.0 * signal) * F.sqrt(1.0 + F.try_divide(F.lit(1.0), ratio))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = (), meta: dict | None = None) -> None:
    """Our own format; appending checks that the columns are the same. ``meta`` goes beside it as JSON."""
    spark = df.sparkSession
    if mode == "append" and exists(spark, path):
        old = spark.read.parquet(path).columns
        if set(old) != set(df.columns):
            raise ValueError(f"columns differ: {sorted(set(old) ^ set(df.columns))}")
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)
    if meta is not None:
        save_meta(spark, path, meta)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".meta")


def load_meta(spark: SparkSession, path: str) -> dict:
    p = path.rstrip("/") + ".meta"
    return json.loads(spark.read.text(p, wholetext=True).first()[0]) if exists(spark, p) else {}


register(Format("parquet", (".parquet",), lambda s, p: s.read.parquet(p), write_parquet))
register(Format("csv", (".csv", ".tsv", ".txt"), read_csv, write_csv))
register(Format("json traces", (".json", ".jsonl"), read_json_traces))
register(Format("array traces", (".npy", ".zip"), read_array_traces))
register(Format("orc", (".orc",), lambda s, p: s.read.orc(p), lambda df, p: df.write.mode("overwrite").orc(p)))
