"""Python row and batch functions over Arrow. Declarative stages are faster: a function here is opaque to Catalyst."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.model import KEY, ON_ERROR, TS, check_callable


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


class UnknownKeys(ValueError):
    """A row has keys that the inferred schema lacks."""


class RowSteps:
    """Row functions that run one after the other on each row, in one pass: ``("map" or "filter", fn)``."""

    def __init__(self, steps: list[tuple[str, Callable]]):
        for kind, fn in steps:
            check_callable(fn, kind)
        self.steps = steps

    def then(self, other: RowSteps) -> RowSteps:
        return RowSteps(self.steps + other.steps)

    @property
    def maps(self) -> bool:
        return any(kind == "map" for kind, _ in self.steps)

    def apply(self, row: dict) -> dict | None:
        """The row after all steps, or nothing if a filter drops it. A result that is no dict becomes its ``value``."""
        for kind, fn in self.steps:
            if kind == "filter":
                if not fn(row):
                    return None
            else:
                row = fn(dict(row))
                if not isinstance(row, dict):
                    row = {"value": row}
        return row


def infer_schema(df: DataFrame, steps: RowSteps, sample: int = 100) -> T.StructType:
    """A schema from a run over some rows: the union of their keys, null kinds as text. Mixed kinds are refused, and so is
    a key that only a later row has, when the rows are mapped."""
    rows = [out for r in df.drop(KEY, TS).limit(sample).collect() if (out := steps.apply(r.asDict(recursive=True))) is not None]
    if not rows:
        raise ValueError("no row is left to infer a schema from; give one")
    names = list(dict.fromkeys(k for r in rows for k in r))
    try:
        kinds = pa.Table.from_pydict({n: [r.get(n) for r in rows] for n in names}).schema
    except pa.ArrowException as e:
        raise ValueError(f"rows disagree on a column's kind: {e}") from e
    from pyspark.sql.pandas.types import from_arrow_schema

    found = from_arrow_schema(kinds)
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for f in found])


def map_rows(df: DataFrame, steps: RowSteps, schema: str | T.StructType | None = None, on_error: str = "fail", split_col: str | None = None, sample: int = 100) -> DataFrame:
    """``df`` after row steps. Filters alone keep the schema; a map without one is inferred by :func:`infer_schema` from
    ``sample`` rows, and a row with a key beyond it fails the job whatever the policy. A given schema says which keys to keep.

    Functions do not see the reserved columns: the key is kept, and a map sets the time anew. ``drop_split`` drops all
    rows of a split, told by ``split_col``, if one of them fails: the only policy whose result depends on the data alone
    and reaches beyond the row.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {', '.join(ON_ERROR)}")
    reserved = [c for c in (KEY, TS) if c in df.columns]
    plain = T.StructType([f for f in df.schema.fields if f.name not in reserved])
    body = plain if not steps.maps else as_schema(schema) if schema is not None else infer_schema(df, steps, sample)
    known = frozenset(body.names) if steps.maps and schema is None else None
    out = T.StructType(body.fields + [df.schema[c] for c in reserved])
    arrow = to_arrow_schema(out)
    sets_time = steps.maps and TS in reserved

    def convert(table: pa.Table | pa.RecordBatch) -> list[dict]:
        done = []
        for row in table.to_pylist():
            marks = {c: row.pop(c) for c in reserved}
            try:
                result = steps.apply(row)
            except Exception:
                if on_error in ("fail", "empty", "drop_split"):
                    raise
                result = None if on_error == "drop_row" else {}
            if result is not None:
                if known is not None and not known.issuperset(result):
                    raise UnknownKeys(f"a row has {sorted(set(result) - known)}, which none of the first {sample} has: give a schema")
                if sets_time:
                    marks[TS] = time.time()
                done.append({n: result.get(n) for n in body.names} | marks)
        return done

    if on_error == "drop_split":
        if split_col is None:
            raise ValueError("drop_split needs split_col")

        def whole(table: pa.Table) -> pa.Table:
            try:
                return pa.Table.from_pylist(convert(table), arrow)
            except UnknownKeys:
                raise
            except Exception:
                return arrow.empty_table()

        return df.groupBy(split_col).applyInArrow(whole, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                rows = convert(b)
            except Exception as e:
                if on_error != "empty" or isinstance(e, UnknownKeys):
                    raise
                rows = []
            yield from pa.Table.from_pylist(rows, arrow).to_batches()

    return df.mapInArrow(run, out)


def map_batches(df: DataFrame, fn: Callable, schema: str | T.StructType | None = None, skip_on_error: bool = False, same_length: bool = True) -> DataFrame:
    """``df`` with ``fn`` applied to its Arrow batches, as tables with the reserved columns. The length must not change
    unless ``same_length`` is off. A failing batch fails the job, or becomes empty with ``skip_on_error``."""
    check_callable(fn, "map_batches")
    out = as_schema(schema) if schema is not None else df.schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                got = fn(pa.Table.from_batches([b]))
                if isinstance(got, pa.RecordBatch):
                    got = pa.Table.from_batches([got])
                elif isinstance(got, list):
                    got = pa.Table.from_pylist(got, arrow)
                if same_length and len(got) != b.num_rows:
                    raise ValueError(f"the function made {len(got)} rows of {b.num_rows}")
            except Exception:
                if skip_on_error:
                    continue
                raise
            yield from got.select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(run, out)


def flat_map(df: DataFrame, fn: Callable, schema: str | T.StructType | None = None, skip_on_error: bool = False) -> DataFrame:
    """``df`` with ``fn`` applied to its batches, each to any number of rows."""
    return map_batches(df, fn, schema, skip_on_error, same_length=False)


def keyed(df: DataFrame, key=None, ts=None) -> DataFrame:
    """``df`` with the reserved columns: a key, empty where null or not given, and a time in epoch seconds."""
    k = F.coalesce((F.expr(key) if isinstance(key, str) else key).cast("string"), F.lit("")) if key is not None else F.lit("")
    t = (F.expr(ts) if isinstance(ts, str) else ts).cast("double") if ts is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return df.withColumns({KEY: k, TS: t})
