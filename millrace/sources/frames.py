"""Sources from functions of a session, from Arrow data, and from Python readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.model import check_callable


def dataframe(fn: Callable[[SparkSession], DataFrame] | None, parallelism: int | None = None) -> Callable[[SparkSession], DataFrame]:
    """Any DataFrame or SQL code, dealt out to ``parallelism`` partitions if it has another number."""
    if fn is None:
        raise ValueError("a function of the session is needed")
    check_callable(fn, "dataframe")

    def read(spark: SparkSession) -> DataFrame:
        df = fn(spark)
        return df.repartition(parallelism) if parallelism and df.rdd.getNumPartitions() != parallelism else df

    return read


def arrow_block(block: pa.Table | pa.RecordBatch | bytes) -> Callable[[SparkSession], DataFrame]:
    """A table, a batch, or the bytes of an IPC stream, held by the driver."""
    if isinstance(block, bytes):
        with pa.ipc.open_stream(block) as reader:
            block = reader.read_all()
    elif isinstance(block, pa.RecordBatch):
        block = pa.Table.from_batches([block])
    return lambda spark: spark.createDataFrame(block)


class SplitSource(DataSource):
    """Base of custom sources: a subclass names itself, gives a schema, plans splits and reads each as Arrow data."""

    def plan(self) -> Iterable[dict]:
        raise NotImplementedError

    def read_split(self, split: dict) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def push(self, filters: list) -> list:
        """Takes the filters that the source applies by itself and gives back the others, which Spark then applies. A source
        that has it is asked before ``plan``, and needs a session with ``spark.sql.python.filterPushdown.enabled``."""
        return filters

    def reader(self, schema) -> DataSourceReader:
        return _SplitReader(self) if type(self).push is SplitSource.push else _PushingReader(self)


class _Split(InputPartition):
    def __init__(self, value: dict):
        super().__init__(value)


class _SplitReader(DataSourceReader):
    def __init__(self, source: SplitSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [_Split(s) for s in self.source.plan()]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.source.read_split(partition.value)


class _PushingReader(_SplitReader):
    def pushFilters(self, filters: list) -> Iterable:
        return self.source.push(list(filters))
