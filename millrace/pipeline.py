"""Finite graphs of named stages, composed into lazy DataFrames.

>>> p = Pipeline("etl").source("in", files("lineitem.parquet")).map("calc", {"revenue": "price * (1 - discount)"})
>>> p.filter("big", "quantity > 10").sink("out", json_lines("/tmp/out"))     # doctest: +SKIP

The whole graph becomes one Catalyst plan per sink. Stages name their upstreams; without any they follow the stage before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import rowfn
from millrace.model import KEY, Stage, check_callable


def _column(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Pipeline:
    def __init__(self, name: str):
        self.name = name
        self.stages: dict[str, Stage] = {}

    # Building

    def add(self, name: str, kind: str, build, upstreams: list[str] | None = None, parallelism=None, **options) -> Pipeline:
        """Adds a stage. Upstreams exist before it, so there are no cycles."""
        if name in self.stages:
            raise ValueError(f"stage {name} is there already")
        if upstreams is None:
            upstreams = [list(self.stages)[-1]] if self.stages and kind != "source" else []
        for u in upstreams:
            if u not in self.stages:
                raise ValueError(f"stage {name} has an unknown upstream {u}")
            if self.stages[u].kind == "sink":
                raise ValueError(f"stage {name} follows the sink {u}")
        if kind == "source" and upstreams:
            raise ValueError(f"the source {name} can have no upstream")
        if kind != "source" and not upstreams:
            raise ValueError(f"stage {name} has no upstream")
        if kind not in ("join", "union", "sql", "transform") and len(upstreams) > 1:
            raise ValueError(f"stage {name} has {len(upstreams)} upstreams: join or unite them first")
        self.stages[name] = Stage(name, kind, upstreams, build, parallelism, options)
        return self

    def source(self, name: str, read: Callable[[SparkSession], DataFrame] | DataFrame, parallelism=None) -> Pipeline:
        if not isinstance(read, DataFrame):
            check_callable(read, "source")
        return self.add(name, "source", read, [], parallelism)

    def map(self, name: str, exprs: dict[str, str | Column] | None = None, fn: Callable | None = None, schema=None, on_error: str = "fail", split_col: str | None = None, sample: int = 100, **at) -> Pipeline:
        """New or replaced columns by expressions, or a Python function of a row as a dict; without a schema its result's is
        inferred from ``sample`` rows."""
        if (exprs is None) == (fn is None):
            raise ValueError("map takes either exprs or fn")
        if exprs is not None:
            return self.add(name, "map", lambda df: df.withColumns({k: _column(v) for k, v in exprs.items()}), **_at(at))
        return self.add(name, "rows", rowfn.RowSteps([("map", fn)]), schema=schema, on_error=on_error, split_col=split_col, sample=sample, **_at(at))

    def filter(self, name: str, condition: str | Column | None = None, fn: Callable | None = None, on_error: str = "fail", split_col: str | None = None, **at) -> Pipeline:
        if (condition is None) == (fn is None):
            raise ValueError("filter takes either condition or fn")
        if condition is not None:
            return self.add(name, "filter", lambda df: df.where(_column(condition)), **_at(at))
        return self.add(name, "rows", rowfn.RowSteps([("filter", fn)]), schema=None, on_error=on_error, split_col=split_col, **_at(at))

    def map_batches(self, name: str, fn: Callable, schema=None, skip_on_error: bool = False, **at) -> Pipeline:
        check_callable(fn, "map_batches")
        return self.add(name, "batches", lambda df: rowfn.map_batches(df, fn, schema, skip_on_error), **_at(at))

    def flat_map(self, name: str, fn: Callable | None = None, schema=None, skip_on_error: bool = False, explode: dict[str, str | Column] | None = None, **at) -> Pipeline:
        """Any number of rows for a batch by a Python function, or for a row by exploding an array expression."""
        if explode is not None:
            ((to, array),) = explode.items()
            return self.add(name, "flat_map", lambda df: df.withColumn(to, F.explode(_column(array))), **_at(at))
        check_callable(fn, "flat_map")
        return self.add(name, "batches", lambda df: rowfn.flat_map(df, fn, schema, skip_on_error), **_at(at))

    def key_by(self, name: str, key: str | Column, **at) -> Pipeline:
        return self.add(name, "map", lambda df: df.withColumn(KEY, F.coalesce(_column(key).cast("string"), F.lit(""))), **_at(at))

    def select(self, name: str, *columns: str | Column, **at) -> Pipeline:
        return self.add(name, "map", lambda df: df.select(*[_column(c) for c in columns]), **_at(at))

    def aggregate(self, name: str, by: list[str], how: str = "group", **aggs) -> Pipeline:
        """Groups, or a rollup or cube, with named aggregate expressions."""
        group = {"group": DataFrame.groupBy, "rollup": DataFrame.rollup, "cube": DataFrame.cube}[how]
        at = _at(aggs)
        return self.add(name, "aggregate", lambda df: group(df, *by).agg(*[_column(v).alias(k) for k, v in aggs.items()]), **at)

    def window(self, name: str, spec, **columns) -> Pipeline:
        at = _at(columns)
        return self.add(name, "window", lambda df: df.withColumns({k: _column(v).over(spec) for k, v in columns.items()}), **at)

    def sort(self, name: str, *by: str | Column, **at) -> Pipeline:
        return self.add(name, "sort", lambda df: df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in by]), **_at(at))

    def limit(self, name: str, n: int, offset: int = 0, **at) -> Pipeline:
        return self.add(name, "limit", lambda df: df.offset(offset).limit(n) if offset else df.limit(n), **_at(at))

    def join(self, name: str, left: str, right: str, on, how: str = "inner", **at) -> Pipeline:
        return self.add(name, "join", lambda a, b: a.join(b, on, how), [left, right], **_at(at))

    def union(self, name: str, *upstreams: str, **at) -> Pipeline:
        def build(first: DataFrame, *rest: DataFrame) -> DataFrame:
            for df in rest:
                first = first.unionByName(df, allowMissingColumns=True)
            return first

        return self.add(name, "union", build, list(upstreams), **_at(at))

    def sql(self, name: str, text: str, **views: str) -> Pipeline:
        """A query whose tables are stages: ``sql("q", "SELECT * FROM {a} JOIN {b} USING (id)", a="left", b="right")``."""

        def build(*dfs: DataFrame) -> DataFrame:
            return dfs[0].sparkSession.sql(text, **dict(zip(views, dfs)))

        return self.add(name, "sql", build, list(views.values()))

    def transform(self, name: str, fn: Callable[..., DataFrame], upstreams: list[str] | None = None, **at) -> Pipeline:
        check_callable(fn, "transform")
        return self.add(name, "transform", fn, upstreams, **_at(at))

    def sink(self, name: str, write: Callable[[DataFrame], object], upstream: str | None = None) -> Pipeline:
        check_callable(write, "sink")
        return self.add(name, "sink", write, [upstream] if upstream else None)

    # Running

    def consumers(self, name: str) -> list[str]:
        return [s.name for s in self.stages.values() if name in s.upstreams]

    def frames(self, spark: SparkSession, persist: bool = False) -> dict[str, DataFrame]:
        """One lazy DataFrame for each stage but the sinks. With ``persist`` those of several consumers are kept."""
        made: dict[str, DataFrame] = {}
        for s in self.stages.values():
            if s.kind == "sink":
                continue
            if s.kind == "source":
                df = s.build if isinstance(s.build, DataFrame) else s.build(spark)
            elif s.kind == "rows":
                df = self._rows(s, made)
            else:
                df = s.build(*[made[u] for u in s.upstreams])
            made[s.name] = _dealt(df, s.parallelism)
            if persist and len(self.consumers(s.name)) > 1:
                made[s.name] = made[s.name].persist(StorageLevel.MEMORY_AND_DISK)
        return made

    def _rows(self, stage: Stage, made: dict[str, DataFrame]) -> DataFrame:
        """Row functions that directly follow each other, for no other consumer, run in one pass over the rows."""
        steps, schema, at = stage.build, stage.options["schema"], stage.upstreams[0]
        policy, sample = (stage.options["on_error"], stage.options["split_col"]), stage.options.get("sample", 0)
        while True:
            up = self.stages[at]
            if up.kind != "rows" or len(self.consumers(at)) > 1 or up.parallelism or (up.options["on_error"], up.options["split_col"]) != policy:
                break
            if schema is None and not steps.maps:
                schema = up.options["schema"]
            steps, at, sample = up.build.then(steps), up.upstreams[0], max(sample, up.options.get("sample", 0))
        return rowfn.map_rows(made[at], steps, schema, *policy, sample or 100)

    def result(self, spark: SparkSession, stage: str | None = None) -> DataFrame:
        """The DataFrame of a stage, of the last one by default."""
        frames = self.frames(spark)
        return frames[stage or list(frames)[-1]]

    def run(self, spark: SparkSession) -> dict[str, object]:
        """Runs every sink, each in one action; an error in any stage fails the run. Returns what the sinks return."""
        frames = self.frames(spark, persist=True)
        try:
            return {s.name: s.build(frames[s.upstreams[0]]) for s in self.stages.values() if s.kind == "sink"}
        finally:
            for name, df in frames.items():
                if len(self.consumers(name)) > 1:
                    df.unpersist()


def _at(options: dict) -> dict:
    out = {}
    if "upstream" in options:
        out["upstreams"] = [options.pop("upstream")]
    if "parallelism" in options:
        out["parallelism"] = options.pop("parallelism")
    return out


def _dealt(df: DataFrame, parallelism: int | tuple[int, int] | None) -> DataFrame:
    """A number asks for so many partitions; a range leaves the number to adaptive execution, up to its end."""
    if parallelism is None:
        return df
    if isinstance(parallelism, tuple):
        return df.coalesce(max(1, parallelism[1]))
    return df.repartition(max(1, parallelism))
