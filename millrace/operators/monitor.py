"""What a monitor shows of jobs: best snapshots, histories of lag, running jobs, kinds of errors, progress, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_snapshots(snapshots: DataFrame, key: str, ts: str, inputs: str = "input_records", outputs: str = "output_records") -> DataFrame:
    """For each key the snapshot of the most input and output records (null: 0); of equal ones the first.

    Later snapshots may say 0 after workers have stopped, so the last is not the best.
    """
    total = F.coalesce(inputs, F.lit(0)) + F.coalesce(outputs, F.lit(0))
    rest = [c for c in snapshots.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(-total, F.col(ts)))
    return snapshots.where(total >= 0).groupBy(key).agg(best.alias("best")).select(key, "best.*")


def lag_history(snapshots: DataFrame, ts: str = "timestamp", partitions: str = "partition_metrics") -> DataFrame:
    """``queue_size``, the lag of all partitions, for each snapshot of a valid time. ``partitions`` is a map to structs with
    a ``lag``; a snapshot without any has 0."""
    lags = F.transform(F.map_values(partitions), lambda p: F.coalesce(p["lag"], F.lit(0)).cast("long"))
    size = F.coalesce(F.aggregate(lags, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return snapshots.where(F.col(ts) > 0).withColumn("queue_size", size).drop(partitions)


def running_jobs(actors: DataFrame, order: str, kind: str = "class_name", name: str = "name", state: str = "state", store: str = "_RaySplitPayloadStoreActor", worker: str = "StageWorker") -> DataFrame:
    """``job_id, stage_count, worker_count`` of the jobs whose store is alive: ``payload_store_<job>``. Workers are named
    ``<stage>:<worker>`` and tell no job: they count for the first job, as the interface that users know has it.

    Jobs and stages are grouped; no list of actors is gathered.
    """
    alive = actors.where(F.col(state) == "ALIVE")
    jobs = alive.where((F.col(kind) == store) & (F.size(F.split(name, "_", 3)) == 3)).groupBy(F.split(name, "_", 3)[2].alias("job_id")).agg(F.min(order).alias("__first"))
    workers = alive.where((F.col(kind) == worker) & F.col(name).contains(":")).groupBy(F.substring_index(name, ":", 1).alias("stage")).agg(F.count("*").alias("n"))
    counts = workers.agg(F.count("*").alias("stage_count"), F.sum("n").alias("worker_count"))
    first = jobs.agg(F.min_by("job_id", F.struct("__first", "job_id")).alias("job_id"))
    of_first = first.withColumn("__one", F.lit(1)).join(counts.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each
    none = F.lit(0).cast("long")
    return jobs.drop("__first").join(of_first, "job_id", "left").select("job_id", F.coalesce("stage_count", none).alias("stage_count"), F.coalesce("worker_count", none).alias("worker_count"))


def running_stages(actors: DataFrame, kind: str = "class_name", name: str = "name", state: str = "state", worker: str = "StageWorker") -> DataFrame:
    """``stage_id, worker_count`` of the stages that have live workers."""
    rows = actors.where((F.col(state) == "ALIVE") & (F.col(kind) == worker) & F.col(name).contains(":"))
    return rows.groupBy(F.substring_index(name, ":", 1).alias("stage_id")).agg(F.count("*").alias("worker_count"))


def errors_by_type(groups: DataFrame, kind: str = "kind", n: str = "n", first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """Groups of errors (as ``telemetry.error_groups`` makes them) by type: how many groups and errors, first and last."""
    return groups.groupBy(kind).agg(F.count("*").alias("n_groups"), F.sum(n).alias("n"), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))


def selectivity(inputs: Column, outputs: Column) -> Column:
    """Output over input; null without input."""
    return F.try_divide(outputs, inputs)


def progress(done: Column, total: Column) -> Column:
    """Per cent done, 0 without a total."""
    return F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.try_divide((total - done) * elapsed, done)


def throughput(df: DataFrame, by: list[str], start: str, end: str, count: str, latency: str) -> DataFrame:
    """``messages, elapsed, throughput, avg_latency`` of runs; 0 where no time has passed or nothing was measured."""
    sums = df.groupBy(*by).agg(F.sum(count).alias("messages"), (F.max(end) - F.min(start)).alias("elapsed"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency"))
    return sums.withColumn("throughput", F.when(F.col("elapsed") > 0, F.col("messages") / F.col("elapsed")).otherwise(F.lit(0.0)))


def with_cooldown(decisions: DataFrame, key: str, ts: str, changed: Column, seconds: float) -> DataFrame:
    """Scaling decisions that change something and come ``seconds`` after the key's last such one that was let through."""
    from millrace.operators.telemetry import rate_limited

    return rate_limited(decisions.where(changed), key, ts, seconds, ts)
