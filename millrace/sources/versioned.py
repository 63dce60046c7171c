"""Tables as versions of Parquet files with a manifest: snapshots, append, overwrite, columns added later.

Each write adds a folder of files and a manifest that lists the folders of its version. A version is there once its
manifest is, which is written last under its final name, so a failed write leaves no trace that a reader sees.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("create", "append", "overwrite")
#: Physical row positions, which scans may add and writes leave out.
ROW_COLUMNS = ("_rowid", "_rowaddr")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, df: DataFrame, mode: str = "append", blob_columns: list[str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """A new version: ``create`` fails if there is a table, ``overwrite`` starts anew. Row positions are left out;
        blob columns become binary and are marked so.

        Files come first and are seen by none until their manifest is there. A ``batch``, the name of a stream and a number,
        is told in the manifest: one that is no larger than the stream's last is there already and not written again.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        have = self.versions()
        if mode == "create" and have:
            raise FileExistsError(self.path)
        batches = dict(self._manifest(have[-1]).get("batches", {})) if have else {}
        if batch is not None:
            if batches.get(batch[0], -1) >= batch[1]:
                return have[-1]
            batches[batch[0]] = batch[1]
        df = df.drop(*ROW_COLUMNS)
        for c in blob_columns or []:
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("binary")).withMetadata(c, {"blob": "true"})
        old = self._manifest(have[-1]) if have and mode == "append" else {"folders": [], "schema": None}
        fields = {f["name"]: f for f in (old["schema"] or {"fields": []})["fields"]}
        for f in json.loads(df.schema.json())["fields"]:
            kept = fields.setdefault(f["name"], f)
            if kept["type"] != f["type"]:
                raise ValueError(f"column {f['name']} is {kept['type']}, not {f['type']}")
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._publish((have[-1] if have else 0) + 1, {"folders": [*old["folders"], folder], "schema": {"type": "struct", "fields": list(fields.values())}, "batches": batches})

    def _publish(self, version: int, manifest: dict) -> int:
        """Writes a manifest whole under a name of its own and then claims the version by creating ``<version>.lock``, which
        the file system lets one writer alone do; the claim's owner moves the manifest into place."""
        final = self._path(f"{self.path}/_manifests/{version}.json")
        part = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._fs.create(self._path(f"{self.path}/_manifests/.{version}.lock"), False).close()
        except Exception as e:
            self._fs.delete(part, False)
            raise FileExistsError(f"version {version} was written by another") from e
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise FileExistsError(f"version {version} was written by another")
        return version

    def add_column(self, name: str, kind: str) -> int:
        """A new version with a column that is null in the rows there are."""
        have = self.versions()
        manifest = self._manifest(have[-1])
        if any(f["name"] == name for f in manifest["schema"]["fields"]):
            raise ValueError(f"column {name} is there already")
        manifest["schema"]["fields"].append({"name": name, "type": json.loads(T._parse_datatype_string(kind).json()), "nullable": True, "metadata": {}})
        return self._publish(have[-1] + 1, manifest)

    def read(self, version: int | None = None, condition: str | Column | None = None, columns: list[str] | None = None, row_ids: bool = False) -> DataFrame:
        """The newest or a given version. The condition and the columns reach the Parquet scan."""
        have = self.versions()
        if not have:
            raise FileNotFoundError(self.path)
        if version is not None and version not in have:
            raise ValueError(f"there is no version {version}")
        manifest = self._manifest(version if version is not None else have[-1])
        schema = T.StructType.fromJson(manifest["schema"])
        if not manifest["folders"]:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in manifest["folders"]])
        if condition is not None:
            df = df.where(condition)
        extra = [F.col("_metadata.row_index").alias("_rowid")] if row_ids else []
        return df.select(*(columns or schema.names), *extra)


def iceberg(spark: SparkSession, table: str, snapshot_id: int | None = None, condition: str | None = None) -> DataFrame:
    """An Iceberg table, where the session has a connector for it."""
    reader = spark.read.format("iceberg")
    if snapshot_id:
        reader = reader.option("snapshot-id", snapshot_id)
    df = reader.load(table)
    return df.where(condition) if condition else df


def lance(spark: SparkSession, uri: str, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Lance dataset, where the session has a connector for it."""
    df = spark.read.format("lance").load(uri)
    df = df.where(condition) if condition else df
    return df.select(*columns) if columns else df
