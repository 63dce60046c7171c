"""Lineage of splits, and the history of jobs and workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import split_id
from millrace.scratch import checkpointed


def records(df: DataFrame, stage: str, parents: Column, sequence: Column, *, worker: Column, seconds: Column, inputs: Column, outputs: Column, ts: Column, data_range: Column | None = None) -> DataFrame:
    """One lineage record a row: ``split_id, stage_id, parent_ids, worker_id, processing_time, input_records,
    output_records, timestamp, data_range``. The id follows from the stage, the parents in any order, and the number."""
    none = F.lit(None).cast("map<string,string>")
    return df.select(
        split_id(stage, parents, sequence).alias("split_id"), F.lit(stage).alias("stage_id"), F.array_sort(parents).alias("parent_ids"), worker.cast("string").alias("worker_id"), seconds.cast("double").alias("processing_time"),
        inputs.cast("long").alias("input_records"), outputs.cast("long").alias("output_records"), ts.cast("double").alias("timestamp"), (none if data_range is None else data_range).alias("data_range"),
    )


def nodes(records: DataFrame) -> DataFrame:
    """One row a split: the last record of it."""
    last = F.max_by(F.struct(*[c for c in records.columns if c not in ("split_id", "parent_ids")]), F.col("timestamp"))
    return records.groupBy("split_id").agg(last.alias("x")).select("split_id", "x.*")


def edges(records: DataFrame, split: str = "split_id", parents: str = "parent_ids") -> DataFrame:
    """``parent, child`` links, each once."""
    return records.select(F.explode(parents).alias("parent"), F.col(split).alias("child")).distinct()


def depths(edge_rows: DataFrame, most: int = 1000) -> DataFrame:
    """``split, depth``: the longest way from a split without parents, a stage at a time.

    More than ``most`` stages, as a cycle that such a split leads to has, are an error and never cut. Splits of a cycle
    that none leads to have no depth. Each stage is written to the shared folder.
    """
    level = edge_rows.select(F.col("parent").alias("split")).distinct().join(edge_rows.select(F.col("child").alias("split")), "split", "left_anti").withColumn("depth", F.lit(0))
    every = level
    for d in range(1, most + 2):
        level = checkpointed(edge_rows.join(level.select(F.col("split").alias("parent")), "parent", "left_semi").select(F.col("child").alias("split")).distinct().withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        every = every.union(level)
    else:
        raise RuntimeError(f"the lineage is deeper than {most} stages, or has a cycle")
    return every.groupBy("split").agg(F.max("depth").alias("depth"))


def archived_status(any_failed: Column, any_cancelled: Column) -> Column:
    return F.when(any_failed, "FAILED").when(any_cancelled, "CANCELLED").otherwise("COMPLETED")


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor zero, else zero."""
    return F.coalesce(*[F.when(v != 0, v) for v in values], F.lit(0))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows: they are sorted first, then cut."""
    return df.orderBy(*order).offset(offset).limit(limit)


def reconcile(known: DataFrame, seen: DataFrame, key: str, gone_state: str = "DELETED") -> DataFrame:
    """``key, status``: known rows that are not seen are gone, others are new or updated."""
    a, b = known.select(F.col(key).alias("__a")), seen.select(F.col(key).alias("__b"))
    status = F.when(F.col("__b").isNull(), gone_state).when(F.col("__a").isNull(), "NEW").otherwise("UPDATED")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), status.alias("status"))


def jobs(df: DataFrame, user: str | None = None, queue: str | None = None, status: str | None = None, with_ended: bool = False, cluster: str | None = None) -> DataFrame:
    """Jobs by parts of user and queue, ignoring case, and by cluster; ended ones only on request. Empty filters pass all."""
    out = df.where(F.col("cluster") == cluster) if cluster else df
    for column, part in (("user", user), ("queue", queue)):
        if part:
            out = out.where(F.lower(column).contains(part.lower()))
    if status:
        return out.where(F.col("status") == status)
    return out if with_ended else out.where(~F.col("status").isin("SUCCEEDED", "FAILED", "STOPPED"))
