"""Analytics of pipeline telemetry: windows, lags, rates, groups of errors, scaling decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import checkpointed


def tumbling_latest(events: DataFrame, ts: str, source: str, group: str, seconds: int, tie: str, **sums: str) -> DataFrame:
    """``window_start, group, n_sources`` and sums, over tumbling windows of event time.

    Within a window only the last event of each source counts; of equal times that of the largest ``tie``.
    """
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)
    rows = events.withColumn("window_start", start)
    order = F.struct(F.col(ts), F.col(tie))
    last = rows.groupBy("window_start", group, source).agg(*[F.max_by(F.expr(v), order).alias(k) for k, v in sums.items()])
    return last.groupBy("window_start", group).agg(F.count("*").alias("n_sources"), *[F.sum(k).alias(k) for k in sums])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _in_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` dealt out by ranges of columns, ``__part`` the range, and written: a key's rows may lie in several ranges, so
    a key of any size is spread over tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *columns).withColumn("__part", F.spark_partition_id()))


def rate(df: DataFrame, key: str, ts: Column, value: str, order: list[str]) -> DataFrame:
    """The change of a value a second since the key's row before; null for the first and where no time has passed.

    Rows are compared within ranges of key and order; each range of a key begins with the last row of the key's range
    before, one row a key and range, so no key's rows meet in one task.
    """
    rows = _in_ranges(df.withColumn("__t", ts), [key, *order]).withColumn("__real", F.lit(1))
    last = rows.groupBy(key, "__part").agg(F.max_by(F.struct("__t", F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    before = last.withColumn("__last", F.lag("__last").over(Window.partitionBy(key).orderBy("__part"))).where("__last IS NOT NULL")
    before = before.select(key, "__part", F.col("__last.__t").alias("__t"), F.col("__last.v").alias(value), F.lit(0).alias("__real"))
    w = Window.partitionBy(key, "__part").orderBy("__real", *order)
    seconds = F.col("__t") - F.lag("__t").over(w)
    out = rows.unionByName(before, allowMissingColumns=True).withColumn("rate", F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds))
    return out.where("__real = 1").drop("__t", "__part", "__real")


def rate_limited(df: DataFrame, key: str, ts: str, interval: float, tie: str) -> DataFrame:
    """Rows at least ``interval`` seconds after the key's last row that was let through; the first always is.

    What is let through depends on all before, so a key's rows go through one task, in the order of time; only the last
    time let through is held, so memory does not grow with a key's rows, and a row that lets the next ones through is
    found by bisection, so time goes with what is let through. Rows of null time go.
    """
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__t")
    rows = df.select("*", seconds).where("__t IS NOT NULL").repartition(F.col(key)).sortWithinPartitions(key, "__t", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), 0.0
        for b in batches:
            codes = b.column(key).dictionary_encode(null_encoding="encode")
            names, ids, times = codes.dictionary.to_pylist(), codes.indices.to_numpy(), b.column("__t").to_numpy()
            keep = np.zeros(len(ids), bool)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts, cuts[1:]):
                k = names[ids[lo]]
                i = lo if k != at else lo + int(np.searchsorted(times[lo:hi] - last, interval))
                at = k
                while i < hi:
                    keep[i], last = True, times[i]
                    i += max(1, int(np.searchsorted(times[i:hi] - last, interval)))
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema).drop("__t")


def lag_by(offsets: DataFrame, by: list[str], latest: str = "latest_offset", committed: str = "committed_offset", skewed_over: float = 2.0) -> DataFrame:
    """``total_lag, max_lag, skew, is_skewed`` of partitions: latest less committed (null: 0), never below 0.

    Skew is the largest lag over the mean, 0 without lag; a group is skewed if it is over the bound.
    """
    lag = F.greatest(F.lit(0).cast("long"), F.col(latest) - F.coalesce(F.col(committed), F.lit(0))).alias("__lag")
    sums = offsets.select(*by, lag).groupBy(*by).agg(F.sum("__lag").alias("total_lag"), F.max("__lag").alias("max_lag"), F.avg("__lag").alias("__mean"))
    skew = F.coalesce(F.try_divide(F.col("max_lag"), F.col("__mean")), F.lit(0.0))
    return sums.withColumn("skew", skew).withColumn("is_skewed", F.col("skew") > skewed_over).drop("__mean")


def least_committed(offsets: DataFrame, by: list[str], committed: str = "committed_offset") -> DataFrame:
    return offsets.groupBy(*by).agg(F.min(committed).alias("min_committed"))


def truncate_before(log: DataFrame, offset: Column) -> DataFrame:
    """The log without what all consumers have committed."""
    return log.where(F.col("offset") >= offset)


def fetch(log: DataFrame, offset: int, most: int) -> DataFrame:
    return log.where(F.col("offset") >= offset).orderBy("offset").limit(most)


def assigned_worker(partition: Column, workers: int) -> Column:
    """Partitions are dealt to workers in turn."""
    return F.pmod(partition, F.lit(workers))


def error_groups(errors: DataFrame, kind: str, message: str, ts: str) -> DataFrame:
    """``group_id, kind, first message, n, first_seen, last_seen``: errors of a type whose messages begin alike."""
    head = F.concat(F.col(kind), F.lit(":"), F.substring(F.col(message), 1, 100))
    rows = errors.withColumn("group_id", F.substring(F.md5(head.cast("binary")), 1, 16))
    first = F.min(F.struct(F.col(ts), F.col(message).alias("m")))
    return rows.groupBy("group_id", F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), first["m"].alias("message"))


def exact_percentiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The element at ``floor(n p)``, from 0, of a group's sorted values; null values don't count.

    Values are counted, and ranked by running sums within ranges of group and value; each range of a group begins with
    the count of the ranges before, one row a group and range. So groups of any size are neither collected nor sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = _in_ranges(counts, [*by, value]).withColumn("__all", F.lit(None).cast("long"))
    sums = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__sum"))
    group, so_far = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__part")
    before = sums.select(*by, "__part", F.lit(None).cast(df.schema[value].dataType).alias(value), (F.sum("__sum").over(so_far) - F.col("__sum")).alias("__n"), F.sum("__sum").over(group).alias("__all"))
    at = Window.partitionBy(*by, "__part")
    upto = F.sum("__n").over(at.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.unionByName(before).withColumn("__upto", upto).withColumn("__all", F.max("__all").over(at)).where(F.col(value).isNotNull())
    place = lambda p: F.least(F.floor(F.col("__all") * p), F.col("__all") - 1)
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") > place(p), F.col(value))).alias(k) for k, p in ps.items()])


#: The bounds that readers of these histograms know.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0)


def histogram(df: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """``le, n``: how many values are at most each bound; one pass, one row a group and bound."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"__b{i}") for i, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(*by, F.explode(rows).alias("x")).select(*by, "x.le", "x.n")


def pressure(df: DataFrame, key: str, order: list[str], lag: str, size: str | None = None, high: float = 5000, high_size: float = 1000, low_share: float = 0.7) -> DataFrame:
    """``is_paused``: on when the lag or size exceeds its bound, off when the lag falls below a share of its bound, else as
    before (at first off). The last row that decides either way decides, so it is a window, not a fold."""
    on = F.col(lag) > high
    if size:
        on = on | (F.col(size) > high_size)
    decided = F.when(on, True).when(F.col(lag) < high * low_share, False)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("is_paused", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(False)))


def wanted_workers(workers: Column, lag: Column, least: Column, most: Column, override: Column | None = None, frozen: Column | None = None, up_over: int = 1000, down_under: int = 100) -> Column:
    """How many workers a stage should have: an override, or up to two more over one lag, one fewer under another."""
    out = F.when(lag > up_over, F.least(workers + 2, most)).when(lag < down_under, F.greatest(workers - 1, least)).otherwise(workers)
    if override is not None:
        out = F.coalesce(F.least(F.greatest(override, least), most), out)
    return F.when(frozen, workers).otherwise(out) if frozen is not None else out


def latest_state(messages: DataFrame, entity: str, order: list[str], states: dict[str, str], kind: str, keep_order: bool = False) -> DataFrame:
    """Each entity's status from the last of its messages that means one; with ``keep_order`` its place in ``at_`` columns."""
    status = F.lit(None).cast("string")
    for message, state in states.items():
        status = F.when(F.col(kind) == message, F.lit(state)).otherwise(status)
    at = F.struct(*order)
    rows = messages.withColumn("__s", status).where(F.col("__s").isNotNull())
    out = rows.groupBy(entity).agg(F.max_by("__s", at).alias("status"), F.count("*").alias("n_changes"), F.max(at).alias("__at"))
    return out.select(entity, "status", "n_changes", *([F.col("__at")[c].alias(f"at_{c}") for c in order] if keep_order else []))
