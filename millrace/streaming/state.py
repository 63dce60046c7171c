"""A state machine over a stream of messages, with snapshots that a reader sees whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.telemetry import latest_state

SNAPSHOT = "snapshot="


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots that are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(SNAPSHOT)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[len(SNAPSHOT) :]) for p in names if fs.exists(done(p, "_SUCCESS")))


def read_state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The state of the newest snapshot, or of a given one."""
    have = snapshots(spark, path)
    if not have:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{SNAPSHOT}{have[-1] if number is None else number}")


def keep_state(path: str, entity: str, order: list[str], states: dict[str, str], kind: str, every: int = 1) -> Callable[[DataFrame, int], None]:
    """A batch writer that holds each entity's last status and the number of its changes, as one table.

    Batch ``n`` makes snapshot ``n`` from the newest one before it and its own messages, so a batch that comes again makes
    the same. Of older snapshots only each ``every``-th stays. State is as large as the entities, not as the messages.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = [n for n in snapshots(spark, path) if n < number]
        columns = [entity, "status", "n_changes", *[f"at_{c}" for c in order]]
        new = latest_state(batch, entity, order, states, kind, keep_order=True).select(*columns)
        if have:
            old = read_state(spark, path, have[-1])
            both = old.unionByName(new)
            at = F.struct(*[f"at_{c}" for c in order])
            new = both.groupBy(entity).agg(F.max_by("status", at).alias("status"), F.sum("n_changes").alias("n_changes"), F.max(at).alias("__at")).select(entity, "status", "n_changes", *[F.col("__at")[f"at_{c}"].alias(f"at_{c}") for c in order])
        new.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}{number}")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for n in have[:-1]:
            if n % every:
                fs.delete(hadoop(f"{path}/{SNAPSHOT}{n}"), True)

    return write
