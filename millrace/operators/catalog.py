"""A light catalogue: namespaces and tables as DataFrames, with the session's catalogue behind them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import is_identifier
from millrace.sources.versioned import VersionedTable


def tables_per_namespace(namespaces: DataFrame, tables: DataFrame, key: str, other_key: str) -> DataFrame:
    """Each namespace and how many tables it has, 0 included."""
    n = tables.groupBy(F.col(other_key).alias("__k")).agg(F.count("*").alias("n_tables"))
    return namespaces.join(n, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))


def namespace_page(namespaces: DataFrame, name: str, limit: int, token: str | None = None, prefix: str = "") -> tuple[list[str], str | None]:
    """Names after a token, and the token of the next page if there is one."""
    rows = namespaces.where(F.col(name).startswith(prefix) & (F.col(name) > (token or ""))).select(name).distinct().orderBy(name).limit(limit + 1).collect()
    found = [r[0] for r in rows]
    return found[:limit], found[limit - 1] if len(found) > limit else None


def table_stats(df: DataFrame, condition: str | Column | None = None) -> DataFrame:
    """``n_rows, n_files`` of a file scan; only metadata is read."""
    df = df.where(condition) if condition is not None else df
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("_metadata.file_path").alias("n_files"))


def index_columns(df: DataFrame) -> list[str]:
    """Columns whose names speak of vectors: by a fixed rule that readers of these lists know."""
    return [c for c in df.columns if c.endswith("_vector") or "embedding" in c]


def valid_names(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("is_valid", F.coalesce(is_identifier(F.col(name)), F.lit(False)))


class Catalog:
    """Namespaces and tables of the session's catalogue. A namespace with tables is not dropped; a table's data is not
    deleted with its registration unless that is asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def create_namespace(self, name: str, properties: dict[str, str] | None = None) -> None:
        self._check(name)
        if self.spark.catalog.databaseExists(name):
            raise FileExistsError(name)
        props = ", ".join(f"{_quoted(k)}={_quoted(v)}" for k, v in (properties or {}).items())
        self.spark.sql(f"CREATE NAMESPACE {name}" + (f" WITH DBPROPERTIES ({props})" if props else ""))

    def namespaces(self, prefix: str = "") -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases() if d.name.startswith(prefix))

    def set_properties(self, name: str, **properties: str) -> None:
        self._check(name)
        self.spark.sql(f"ALTER NAMESPACE {name} SET DBPROPERTIES ({', '.join(f'{_quoted(k)}={_quoted(v)}' for k, v in properties.items())})")

    def properties(self, name: str) -> dict[str, str]:
        """The properties that were given; what is kept is asked for, not its display."""
        self._check(name)
        found = self.spark._jsparkSession.sessionState().catalog().getDatabaseMetadata(name).properties()
        pairs, each = {}, found.iterator()
        while each.hasNext():
            kv = each.next()
            pairs[kv._1()] = kv._2()
        return {k: v for k, v in pairs.items() if k not in ("owner", "location", "comment")}

    def drop_namespace(self, name: str) -> None:
        self._check(name)
        if self.spark.catalog.listTables(name):
            raise RuntimeError(f"namespace {name} has tables")
        self.spark.sql(f"DROP NAMESPACE {name}")

    def create_table(self, namespace: str, name: str, schema: str) -> None:
        self._check(namespace, name)
        T._parse_datatype_string(schema)
        self.spark.sql(f"CREATE TABLE {namespace}.{name} ({schema}) USING parquet")

    def register(self, namespace: str, name: str, path: str) -> None:
        """A table over the Parquet files of a folder, which stay where they are."""
        self._check(namespace, name)
        self.spark.sql(f"CREATE TABLE {namespace}.{name} USING parquet LOCATION {_quoted(path)}")

    def deregister(self, namespace: str, name: str) -> None:
        """Takes a registered table out of the catalogue and leaves its files. A table of the catalogue's own, whose files
        would go with it, is refused."""
        self._check(namespace, name)
        if self.spark.catalog.getTable(f"{namespace}.{name}").tableType != "EXTERNAL":
            raise ValueError(f"{namespace}.{name} was not registered: drop it")
        self.spark.sql(f"DROP TABLE {namespace}.{name}")

    def stats(self, namespace: str, name: str) -> dict[str, int]:
        """Rows and files of a table, by metadata alone."""
        row = table_stats(self.spark.table(f"{namespace}.{name}")).first()
        return {"n_rows": row["n_rows"], "n_files": row["n_files"]}

    def tag_version(self, path: str, tag: str) -> int:
        """The version that a tag means: ``latest`` the newest, ``stable`` the first, as there are no others."""
        have = self.versions(path)
        if tag not in ("latest", "stable") or not have:
            raise LookupError(f"there is no tag {tag}")
        return have[-1] if tag == "latest" else have[0]

    def add_column(self, namespace: str, name: str, column: str, kind: str) -> None:
        self._check(namespace, name, column)
        T._parse_datatype_string(kind)
        self.spark.sql(f"ALTER TABLE {namespace}.{name} ADD COLUMNS ({column} {kind})")

    def exists(self, namespace: str, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{namespace}.{name}")

    def tables(self, namespace: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(namespace))

    def describe(self, namespace: str, name: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.spark.table(f"{namespace}.{name}").schema.fields}

    def count(self, namespace: str, name: str, condition: str | None = None) -> int:
        df = self.spark.table(f"{namespace}.{name}")
        return (df.where(condition) if condition else df).count()

    def drop_table(self, namespace: str, name: str) -> None:
        self._check(namespace, name)
        self.spark.sql(f"DROP TABLE {namespace}.{name}")

    def versions(self, path: str) -> list[int]:
        return VersionedTable(self.spark, path).versions()

    def _check(self, *names: str) -> None:
        for name in names:
            if not re.fullmatch("[a-zA-Z_][a-zA-Z0-9_]*", name):
                raise ValueError(f"{name!r} is no name")


def _quoted(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"
