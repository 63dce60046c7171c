"""File sources: functions of a session that give a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "parquet", "csv", "orc")


def files(paths: str | list[str], fmt: str = "json", schema: str | None = None, resume: dict | None = None) -> Callable[[SparkSession], DataFrame]:
    """JSON Lines (a malformed line fails the job, blank lines are skipped), Parquet, or CSV with a header.

    ``resume`` continues an earlier read: ``completed_files`` are skipped, and ``current_file`` is read from row
    ``row_offset`` on (Parquet only, whose rows have positions).
    """
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}, not {fmt}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    done = set((resume or {}).get("completed_files", ()))
    current, offset = (resume or {}).get("current_file"), (resume or {}).get("row_offset", 0)
    left = [p for p in paths if p not in done]
    if current and offset and fmt != "parquet":
        raise ValueError("only Parquet files can be resumed within a file")

    def one(spark: SparkSession, ps: list[str]) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        if fmt == "json":
            return reader.option("mode", "FAILFAST").json(ps)
        if fmt == "csv":
            reader = reader.option("header", True).option("mode", "FAILFAST")
            return (reader if schema else reader.option("inferSchema", True)).csv(ps)
        return getattr(reader, fmt)(*ps)

    def read(spark: SparkSession) -> DataFrame:
        if not left:
            if schema is None:
                raise ValueError("nothing is left to read, and no schema is given")
            return spark.createDataFrame([], schema)
        if not (current in left and offset):
            return one(spark, left)
        cut = one(spark, [current])
        cut = cut.where(F.col("_metadata.row_index") >= offset).select(*cut.columns)
        rest = [p for p in left if p != current]
        return cut.unionByName(one(spark, rest)) if rest else cut

    return read


def with_row_ids(df: DataFrame, split_size: int | None = None) -> DataFrame:
    """A Parquet scan with ``_rowid``, the row's place in its file, and for a split size the place of its split."""
    out = df.withColumn("_rowid", F.col("_metadata.row_index"))
    return out if split_size is None else out.withColumn("_split", F.floor(F.col("_rowid") / split_size))


def row_slice(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of a Parquet scan by their place in the file; the range reaches the scan as a filter on metadata."""
    at = F.col("_metadata.row_index")
    return df.where((at >= offset) & (at < offset + limit)).select(*df.columns)


def plan_splits(df: DataFrame, stage: str, split_size: int = 1024) -> DataFrame:
    """``split_id, file, first_row, n_rows``: one split for each ``split_size`` physical rows of each file, told by file
    and rows alone, so a plan made again is the same."""
    at = df.select(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / split_size).alias("n"))
    plan = at.groupBy("file", "n").agg(F.count("*").alias("n_rows"))
    return plan.select(F.concat(F.lit(f"{stage}_split_"), F.substring(F.md5("file"), 1, 8), F.lit("_"), F.col("n").cast("string")).alias("split_id"), "file", (F.col("n") * split_size).alias("first_row"), "n_rows")


def partition_sizes(df: DataFrame) -> DataFrame:
    """``part, n_rows``: what each Spark partition holds."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n_rows"))
