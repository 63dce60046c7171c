"""Whole files of any store that Hadoop reaches, as rows: executors read them, nothing is copied to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of files; without ``content`` selected no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)


def cache_name(url: Column) -> Column:
    """The name under which a fetched file is kept: 16 digits of the address' MD5, and the last part of its path."""
    from millrace.functions.scalar import url_name

    name = url_name(url)
    return F.concat(F.substring(F.md5(url.cast("binary")), 1, 16), F.lit("_"), F.when(name == "", F.lit("file")).otherwise(name))


def with_content(df: DataFrame, path: str, into: str = "content") -> DataFrame:
    """Rows with the bytes of the file that each names, null where there is none. The names are few enough for the driver
    to list (it hands them to the file index); the contents are joined by path on the executors."""
    spark = df.sparkSession
    names = [r[0] for r in df.select(path).where(F.col(path).isNotNull()).distinct().limit(100_001).collect()]
    if len(names) > 100_000:
        raise ValueError("read so many files by their folder, with whole_files")
    resolved = {n: _resolved(spark, n) for n in names}
    here = [u for u in resolved.values() if u]
    if not here:
        return df.withColumn(into, F.lit(None).cast("binary"))
    at = spark.createDataFrame([(n, u) for n, u in resolved.items() if u], "__name string, __uri string")
    found = whole_files(spark, here).select(F.col("path").alias("__uri"), F.col("content").alias(into)).join(at, "__uri").drop("__uri")
    return df.join(found, F.col(path) == F.col("__name"), "left").drop("__name")


def _resolved(spark: SparkSession, name: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getPath().toString() if fs.exists(at) else None
