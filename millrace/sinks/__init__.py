"""Sinks: functions of a DataFrame that write it. Files are committed by Spark, so a failed job leaves no partial result."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import KEY, TS
from millrace.sources.versioned import VersionedTable

MODES = {"append": "append", "create": "errorifexists", "overwrite": "overwrite"}


def unwrapped_base64(value: Column) -> Column:
    """Base64 without line ends, whatever the session says."""
    return F.regexp_replace(F.base64(value), "[\r\n]", "")


def with_base64(value: Column, kind: T.DataType) -> Column:
    """A value whose binary parts, at any depth, are base64 text."""
    if isinstance(kind, T.BinaryType):
        return unwrapped_base64(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: with_base64(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: with_base64(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[with_base64(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def envelope(df: DataFrame) -> DataFrame:
    """``key, timestamp, value``: the reserved columns and a struct of all others, binary as base64."""
    value = [with_base64(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (KEY, TS)]
    key = F.col(KEY) if KEY in df.columns else F.lit("")
    ts = F.col(TS) if TS in df.columns else F.unix_micros(F.current_timestamp()) / 1e6
    return df.select(key.alias("key"), ts.alias("timestamp"), F.struct(*value).alias("value"))


def _write(df: DataFrame, path: str, fmt: str, mode: str, options: dict) -> str:
    """A folder of files, or one file where the path has the format's suffix: that goes through one task."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if not path.endswith((f".{fmt}", ".jsonl")):
        df.write.mode(MODES[mode]).options(**options).format(fmt).save(path)
        return path
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    final, part = hadoop(path), f"{path}.{uuid.uuid4().hex}"
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "append":
        raise ValueError("a single file cannot be appended to")
    if fs.exists(final) and mode == "create":
        raise FileExistsError(path)
    try:
        df.coalesce(1).write.options(**options).format(fmt).save(part)
        (found,) = [s.getPath() for s in fs.listStatus(hadoop(part)) if s.getPath().getName().startswith("part-")]
        fs.delete(final, False)
        if not fs.rename(found, final):
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(hadoop(part), True)
    return path


def json_lines(path: str, mode: str = "overwrite") -> Callable[[DataFrame], str]:
    """The envelope as JSON Lines, nulls spelled out."""
    return lambda df: _write(envelope(df), path, "json", mode, {"ignoreNullFields": "false"})


def parquet(path: str, mode: str = "overwrite", enveloped: bool = False) -> Callable[[DataFrame], str]:
    return lambda df: _write(envelope(df) if enveloped else df, path, "parquet", mode, {})


def csv(path: str, mode: str = "overwrite") -> Callable[[DataFrame], str]:
    """A header, the key first, then the values; nested ones as JSON."""

    def write(df: DataFrame) -> str:
        value = envelope(df)
        flat = [F.to_json(F.col("value")[f.name]).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col("value")[f.name].alias(f.name) for f in value.schema["value"].dataType.fields]
        return _write(value.select("key", *flat), path, "csv", mode, {"header": "true"})

    return write


def table(path: str, mode: str = "append", blob_columns: list[str] | None = None) -> Callable[[DataFrame], int]:
    """A new version of a versioned table."""
    return lambda df: VersionedTable(df.sparkSession, path).write(df, mode, blob_columns)


def blocks(df: DataFrame, per_block: int | None = None) -> DataFrame:
    """``block, n_rows``: the rows as Arrow IPC streams, one a batch, or batches of ``per_block`` rows at most: what another
    engine takes over without a row being touched. No block crosses partitions, and none goes through the driver."""

    def run(batches):
        for b in batches:
            step = per_block or max(1, b.num_rows)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([part.num_rows], pa.int64())], ["block", "n_rows"])

    return df.mapInArrow(run, "block binary, n_rows long")


def from_blocks(rows: DataFrame, schema: str | T.StructType, block: str = "block") -> DataFrame:
    """The rows of Arrow IPC streams."""

    def run(batches):
        for b in batches:
            for data in b.column(block).to_pylist():
                with pa.ipc.open_stream(data) as reader:
                    yield from reader

    return rows.select(block).mapInArrow(run, schema)


def messages(df: DataFrame, key: Column | str, topic: str, partitions: int = 1) -> DataFrame:
    """``topic, partition, key, value``: each row as JSON, dealt to a partition by the MD5 of its key (null: empty), so a
    key's messages stay in one."""
    k = F.coalesce((F.expr(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    at = F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("long") % partitions
    return df.select(F.lit(topic).alias("topic"), at.cast("int").alias("partition"), k.alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def queue(servers: str, key: Column | str, topic: str, partitions: int = 1) -> Callable[[DataFrame], None]:
    """Messages to a Kafka topic, where the session has the connector; each is delivered at least once."""
    return lambda df: messages(df, key, topic, partitions).write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def log_rows(n: int = 20, logger: str = "millrace") -> Callable[[DataFrame], int]:
    """The first rows as JSON, to a log of the driver."""

    def write(df: DataFrame) -> int:
        rows = df.limit(n).toJSON().collect()
        for r in rows:
            logging.getLogger(logger).info(r)
        return len(rows)

    return write
