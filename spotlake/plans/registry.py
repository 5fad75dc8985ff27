"""Operators by path with typed settings, chains of steps, named views and batches over files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Recipes, with_expression
from ..operators.filters import Filters


@dataclass
class Operator:
    path: str
    run: Callable[..., DataFrame]
    settings: type | None = None

    def __call__(self, df: DataFrame, values: dict[str, Any] | None = None) -> DataFrame:
        return self.run(df, make_settings(self.settings, values or {})) if self.settings else self.run(df, **(values or {}))


OPERATORS: dict[str, Operator] = {}


def operator(path: str, settings: type | None = None):
    """Register a table operator under "Group/Name"."""

    def add(f):
        OPERATORS[path] = Operator(path, f, settings)
        return f

    return add


def make_settings(cls: type, values: dict[str, Any]):
    """A settings dataclass from a flat map with dotted names; unknown names are left out."""
    own: dict[str, Any] = {}
    for f in dataclasses.fields(cls):
        sub = {k.removeprefix(f.name + "."): v for k, v in values.items() if k.startswith(f.name + ".")}
        if dataclasses.is_dataclass(f.default_factory if f.default_factory is not dataclasses.MISSING else None):
            own[f.name] = make_settings(f.default_factory, sub)
        elif f.name in values:
            own[f.name] = values[f.name]
    return cls(**own)


def flat_settings(s) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for f in dataclasses.fields(s):
        v = getattr(s, f.name)
        out |= {f"{f.name}.{k}": x for k, x in flat_settings(v).items()} if dataclasses.is_dataclass(v) else {f.name: v}
    return out


@dataclass
class Step:
    operator: str
    values: dict[str, Any] = field(default_factory=dict)
    label: str = ""


@dataclass
class Chain:
    """Steps one after the other as one lazy plan; its text form is JSON (YAML where it is installed)."""

    steps: list[Step]

    @classmethod
    def parse(cls, text: str) -> Chain:
        try:
            spec = json.loads(text)
        except ValueError:
            import yaml  # only for YAML texts

            spec = yaml.safe_load(text)
        return cls([Step(s["plugin"], s.get("values", {}), s.get("label", "")) for s in spec["steps"]])

    def dump(self) -> str:
        return json.dumps({"schema": 1, "steps": [{"plugin": s.operator, "label": s.label, "values": s.values} for s in self.steps]}, indent=1)

    def check(self) -> list[str]:
        """What is wrong before anything runs."""
        return [f"step {i + 1}: there is no operator {s.operator}" for i, s in enumerate(self.steps) if s.operator not in OPERATORS]

    def run(self, df: DataFrame, history: History | None = None) -> DataFrame:
        if bad := self.check():
            raise ValueError("; ".join(bad))
        for s in self.steps:
            df = OPERATORS[s.operator](df, s.values)
            if history is not None:
                history.add(s.operator, s.values)
        return df


@dataclass
class History:
    """What has been done to a table, with settings."""

    entries: list[dict] = field(default_factory=list)

    def add(self, what: str, values: dict) -> None:
        self.entries.append({"what": what, "values": values})

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.entries, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class View:
    """A named layer over the shared table: bounds and recipes."""

    filters: Filters = field(default_factory=Filters)
    recipes: Recipes = field(default_factory=Recipes)

    def of(self, df: DataFrame) -> DataFrame:
        return self.filters.apply(self.recipes.apply(df))


@dataclass
class Batch:
    """A chain over many datasets; one whose inputs and chain are unchanged is skipped."""

    chain: Chain
    done: dict[str, str] = field(default_factory=dict)

    def fingerprint(self, path: str, values: dict[str, Any]) -> str:
        return hashlib.sha256(json.dumps([path, values, self.chain.dump()], sort_keys=True, default=str).encode()).hexdigest()

    def run(self, spark: SparkSession, paths: list[str], out: str, load: Callable[[SparkSession, str], DataFrame], overrides: dict[str, dict] | None = None) -> DataFrame:
        """Writes each result under ``out``; returns (path, rows, status, error) of each."""
        report = []
        for i, p in enumerate(paths):
            over = (overrides or {}).get(p, {})
            mark = self.fingerprint(p, over)
            if self.done.get(p) == mark:
                report.append((p, None, "unchanged", None))
                continue
            try:
                chain = Chain([Step(s.operator, s.values | over.get(s.operator, {}), s.label) for s in self.chain.steps])
                target = f"{out}/{i:05d}.parquet"
                chain.run(load(spark, p)).write.mode("overwrite").parquet(target)
                report.append((p, spark.read.parquet(target).count(), "done", None))
                self.done[p] = mark
            except Exception as error:  # noqa: BLE001  one file's failure is part of the report
                report.append((p, None, "failed", f"{type(error).__name__}: {str(error)[:500]}"))
        return spark.createDataFrame(report, "path string, rows long, status string, error string")


def scalars_wide(results: DataFrame, key: str = "path", name: str = "name", value: str = "value") -> DataFrame:
    """One row a file, one column for each scalar of its results."""
    names = [r[0] for r in results.select(name).distinct().orderBy(name).collect()]  # all of them become columns
    return results.groupBy(key).pivot(name, names).agg(F.first(value))


# The built-in operators, by path ---------------------------------------------------------------------------


@dataclass
class RangeSettings:
    column: str = "photons"
    lo: float | None = None
    hi: float | None = None
    invert: bool = False


@operator("Filter/Range", RangeSettings)
def _range(df: DataFrame, s: RangeSettings) -> DataFrame:
    return Filters().set(s.column, s.lo, s.hi, s.invert).apply(df)


@dataclass
class ExpressionSettings:
    name: str = "value"
    text: str = "0"


@operator("Columns/Expression", ExpressionSettings)
def _expression(df: DataFrame, s: ExpressionSettings) -> DataFrame:
    return with_expression(df, s.name, s.text)


@dataclass
class GroupSettings:
    dx: float = 50.0
    dt: int = 1


@operator("Group/Blinks", GroupSettings)
def _group(df: DataFrame, s: GroupSettings) -> DataFrame:
    from ..operators.aggregate import combine
    from ..operators.graph import link_blinks

    linked = link_blinks(df, s.dx, s.dt)
    return combine(linked.drop("n_in_group"), ["group_id"], [c for c in df.columns if c != "row_id"]).withColumn("row_id", F.col("group_id"))


@dataclass
class ClusterSettings:
    eps: float = 20.0
    k: int = 5


@operator("Clusters/Density", ClusterSettings)
def _cluster(df: DataFrame, s: ClusterSettings) -> DataFrame:
    from ..operators.graph import dbscan

    return dbscan(df, s.eps, s.k)


@dataclass
class TrackSettings:
    max_jump: float = 500.0
    memory: int = 2
    least: int = 2
    method: str = "simple"


@operator("Tracks/Link", TrackSettings)
def _tracks(df: DataFrame, s: TrackSettings) -> DataFrame:
    from ..operators.graph import link_tracks

    return link_tracks(df, s.max_jump, s.memory, s.least, s.method)


@dataclass
class EditSettings:
    operation: str = "rename"
    column: str = ""
    new_name: str = ""
    remove: list[str] = field(default_factory=list)


@operator("Columns/Edit", EditSettings)
def _edit(df: DataFrame, s: EditSettings) -> DataFrame:
    """Renames a column or removes some, but for those that every table needs."""
    from ..operators.tables import remove_columns, rename_column

    if s.operation == "rename":
        if not s.column or not s.new_name.strip():
            raise ValueError("choose the column to rename and its new name")
        return rename_column(df, s.column, s.new_name.strip())
    if s.operation == "remove":
        if not s.remove:
            raise ValueError("choose the columns to remove")
        return remove_columns(df, s.remove)
    raise ValueError(f"no operation {s.operation!r}: rename or remove")


@dataclass
class TreeClusterSettings:
    least: int = 10
    k: int | None = None
    first_radius: float = 100.0


@operator("Clusters/Hierarchical density", TreeClusterSettings)
def _tree_clusters(df: DataFrame, s: TreeClusterSettings) -> DataFrame:
    from ..operators.hierarchy import hdbscan

    return hdbscan(df, s.least, s.k, s.first_radius)


@dataclass
class VoronoiSettings:
    factor: float = 2.0
    least: int = 10


@operator("Clusters/Voronoi", VoronoiSettings)
def _voronoi_clusters(df: DataFrame, s: VoronoiSettings) -> DataFrame:
    from ..operators.voronoi import voronoi_clusters

    return voronoi_clusters(df, s.factor, s.least)


@dataclass
class OverlapSettings:
    width: int = 500
    most: float = 300.0
    target: float = 10.0


@operator("Drift/Overlap", OverlapSettings)
def _overlap(df: DataFrame, s: OverlapSettings) -> DataFrame:
    """The table without the drift that its pairs' overlap tells."""
    from ..operators.drift import apply_drift
    from ..operators.overlap import drift_curve, overlap_drift

    return apply_drift(df, drift_curve(df, overlap_drift(df, s.width, s.most, s.target), s.width))


@dataclass
class StepSettings:
    key: str = "track_id"
    time: str = "t"
    value: str = "x_nm"
    threshold: float = 0.15
    statistic: str = "mean"


@operator("Traces/Steps", StepSettings)
def _steps(df: DataFrame, s: StepSettings) -> DataFrame:
    from ..operators.steps import steps_of

    return steps_of(df, s.key, s.time, s.value, s.threshold, statistic=s.statistic)
