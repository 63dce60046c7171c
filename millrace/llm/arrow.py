"""Arrow plumbing that the Python-backed corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch that are worked on at once, where rows need no others.
PORTION = 2_000_000
#: Freed memory is given back when so many bytes have been worked on.
BETWEEN = 8 * PORTION
#: Spark's setting for the bytes after which it ends a batch and sends it to a worker.
SENT = "spark.sql.execution.arrow.maxBytesPerBatch"


def send_portions(spark: SparkSession) -> None:
    """Spark sends batches of some ``PORTION`` bytes from now on, unless the session has set a size. As a rule it ends them after
    10,000 rows: of whole texts these take tens of MB, which the JVM holds several times over, beyond its heap, and the worker
    once. Rows stay whole, and no result depends on where batches end. The setting is the session's: plans have none."""
    if SENT not in spark.conf.getAll:
        spark.conf.set(SENT, str(PORTION))


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory. Workers go on to other stages, and wait beside
    them, so they would hold the most that any stage took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_portions(run: Callable) -> Callable:
    """``run`` on slices of some ``PORTION`` bytes of the batches, each row whole; freed memory is given back after each large
    batch, or some small ones, and at the task's end."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            # Of equal numbers of rows: a batch that is little over a portion stays one.
            rows = max(1, -(-b.num_rows // max(1, round(b.nbytes / PORTION))))
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
            done += b.nbytes
            if done >= BETWEEN:
                give_back()
                done = 0

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        give_back()

    return lean


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable, *, portions: bool = False) -> DataFrame:
    """``df`` with new columns computed batch by batch, or in smaller ``portions`` (see ``send_portions``).

    ``make()`` runs once in each task and returns a function from the input Arrow arrays to one Arrow array per
    field. Every existing column passes through unchanged, so rows are neither joined back nor shuffled. A new
    field that has the name of an existing column replaces it.
    """
    if portions:
        send_portions(df.sparkSession)
    names = [f.name for f in fields]
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    inside = [df.columns.index(n) for n in inputs]
    # Columns go by their places: Spark hands on no name that has a dot in it.
    schema = T.StructType([T.StructField(f"c{i}", df.schema[i].dataType) for i in kept] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            new = fn(*[b.column(i) for i in inside])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + list(new), schema.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(in_portions(run) if portions else run, schema).toDF(*[df.columns[i] for i in kept], *names)


def emit_rows(df: DataFrame, inputs: list[str], schema: str | T.StructType, make: Callable, *, portions: bool = False) -> DataFrame:
    """Rows that ``make()``'s function yields for the batches of ``df``, or for smaller ``portions`` (see ``send_portions``): an
    iterator of lists of Arrow arrays.

    The function gets the input arrays, or ``None`` in place of them when the task has no more batches, so that it
    can flush what it has gathered.
    """
    if portions:
        send_portions(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for arrays in fn(*b.columns) or ():
                yield pa.RecordBatch.from_arrays(arrays, names)
        for arrays in fn(*[None for _ in inputs]) or ():
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(inputs)]).mapInArrow(in_portions(run) if portions else run, out)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column; null is empty."""
    return [x or "" for x in column.to_pylist()]
