"""Folders that every executor sees, for tables that cut lineage and for the state of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local folder is made in local mode alone: on a cluster other machines
    would not see it."""
    sc = spark.sparkContext
    to = spark.conf.get("spark.checkpoint.dir", None)
    if to is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return to or tempfile.mkdtemp(prefix="millrace-")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name beside the session's checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes the shared folder the checkpoint folder, unless the session has one. Checkpoints that nothing refers to any
    more are removed, unless the session says otherwise."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = sc._jsc.sc().conf()
        conf.setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        sc.setCheckpointDir(shared_dir(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unique_name(prefix: str) -> str:
    """A column name that no table has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
