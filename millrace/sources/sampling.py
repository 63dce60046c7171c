"""Rows of a table on request: some columns, rows by place or id, a few, or random ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows a request may ask for: it is a look at a table, not a scan.
MOST = 100


def sample_rows(df: DataFrame, *, columns: list[str] | None = None, indices: list[int] | None = None, row_ids: list[int] | None = None, id_col: str = "_rowid", limit: int | None = 10, random: bool = False, seed: int = 0) -> DataFrame:
    """Up to ``limit`` (1 to 100) rows. ``indices`` are places in a file of a Parquet scan, ``row_ids`` values of ``id_col``
    or, without such a column, places too. Random rows are the least of a seeded hash order: a top-k, not a sort."""
    if limit is not None and not 1 <= limit <= MOST:
        raise ValueError(f"limit is 1 to {MOST}")
    out = df
    if indices is not None:
        out = out.where(F.col("_metadata.row_index").isin(indices))
    if row_ids is not None:
        out = out.where(F.col(id_col if id_col in df.columns else "_metadata.row_index").isin(row_ids))
    out = out.select(*(columns or df.columns), *([F.rand(seed).alias("__r")] if random else []))
    if random:
        out = out.orderBy("__r").drop("__r")
    return out.limit(limit) if limit is not None else out
