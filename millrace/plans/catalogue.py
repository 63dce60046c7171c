"""Registered queries over the star-schema tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import rowfn, sinks
from millrace.functions import scalar
from millrace.model import KEY
from millrace.operators import catalog, lineage, media, monitor, telemetry
from millrace.pipeline import Pipeline
from millrace.scratch import fresh_dir
from millrace.sources import remote
from millrace.sources.files import files, plan_splits, row_slice
from millrace.sources.frames import dataframe
from millrace.sources.sampling import sample_rows
from millrace.sources.versioned import VersionedTable
from millrace.streaming.incremental import commit_batches, replace_batch, run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(sf_dir: str, name: str):
    return files(f"{sf_dir}/{name}.parquet", "parquet")


# Transforms


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS quantity
FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""")
def etl_map_filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("etl").source("items", _source(sf_dir, "lineitem"))
    p.map("priced", {"revenue": "l_extendedprice * (1 - l_discount)", "processed": "true"}).filter("large", "l_quantity > 10")
    p.aggregate("sums", ["l_returnflag", "l_linestatus"], n="count(*)", revenue="round(sum(revenue), 2)", quantity="sum(l_quantity)")
    return p.result(spark)


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, true AS processed, l_quantity * 2 AS value_doubled FROM lineitem WHERE coalesce(l_quantity, 0) > 10")
def etl_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("simple").source("items", _source(sf_dir, "lineitem")).select("cut", "l_orderkey", "l_linenumber", "l_quantity AS value")
    return p.map("done", {"processed": "true", "value_doubled": "value * 2"}).filter("over", "coalesce(value, 0) > 10").result(spark)


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, true AS processed, l_quantity * 2 AS value_doubled FROM lineitem WHERE coalesce(l_quantity, 0) > 10")
def etl_map_filter_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("simple").source("items", _source(sf_dir, "lineitem")).select("cut", "l_orderkey", "l_linenumber", "l_quantity AS value")
    p.map("done", fn=lambda r: r | {"processed": True, "value_doubled": r["value"] * 2}, schema="l_orderkey long, l_linenumber int, value double, processed boolean, value_doubled double")
    return p.filter("over", fn=lambda r: (r["value"] or 0) > 10).result(spark)


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_py_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("filter").source("orders", _source(sf_dir, "orders"))
    return p.filter("big", fn=lambda r: r["o_totalprice"] > 100000 and r["o_orderstatus"] == "O").result(spark)


@query("SELECT p_partkey, p_size * 2 AS double_size, upper(p_brand) AS brand FROM part")
def map_batches_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(t: pa.Table) -> pa.Table:
        return pa.table({"p_partkey": t["p_partkey"], "double_size": pc.multiply(t["p_size"], pa.scalar(2, pa.int32())), "brand": pc.utf8_upper(t["p_brand"])})

    return Pipeline("batches").source("part", _source(sf_dir, "part")).map_batches("twice", fn, "p_partkey long, double_size int, brand string").result(spark)


@query("SELECT o_orderkey, unnest(range(o_orderkey % 3)) AS copy FROM orders")
def flat_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("copies").source("orders", _source(sf_dir, "orders")).select("keys", "o_orderkey")
    return p.flat_map("each", explode={"copy": "sequence(0L, o_orderkey % 3 - 1)"}).filter("some", "o_orderkey % 3 > 0").result(spark)


@query("SELECT o_orderkey, unnest(range(o_orderkey % 3)) AS copy FROM orders")
def flat_map_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(t: pa.Table) -> pa.Table:
        keys = [k for k in t["o_orderkey"].to_pylist() for _ in range(k % 3)]
        return pa.table({"o_orderkey": pa.array(keys, pa.int64()), "copy": pa.array([i for k in t["o_orderkey"].to_pylist() for i in range(k % 3)], pa.int64())})

    return Pipeline("copies").source("orders", _source(sf_dir, "orders")).flat_map("each", fn, "o_orderkey long, copy long").result(spark)


@query("SELECT c_custkey, c_mktsegment AS key FROM customer")
def key_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline("keys").source("c", _source(sf_dir, "customer")).key_by("k", "c_mktsegment").select("out", "c_custkey", f"{KEY} AS key").result(spark)


@query("SELECT o_orderkey, 'big' AS branch FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'")
def fanout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("fan").source("orders", _source(sf_dir, "orders"))
    p.filter("big", "o_totalprice > 200000", upstream="orders").select("a", "o_orderkey", "'big' AS branch")
    p.filter("open", "o_orderstatus = 'O'", upstream="orders").select("b", "o_orderkey", "'open' AS branch")
    return p.union("both", "a", "b").result(spark)


@query("SELECT i.generate_series AS split, least(1024, n - i.generate_series * 1024) AS n_rows FROM (SELECT count(*) AS n FROM lineitem), generate_series(0, (SELECT (count(*) - 1) // 1024 FROM lineitem)) i")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_splits(table(spark, sf_dir, "lineitem"), "items", 1024)
    return plan.select(F.floor(F.col("first_row") / 1024).alias("split"), "n_rows")


@query("SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' OR l_quantity > 45")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp '1995-01-01' OR l_quantity > 45").select("l_orderkey", "l_shipdate")


# The relational surface


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def df_fn_sql_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(s: SparkSession) -> DataFrame:
        return s.sql("SELECT c_custkey, c_name, c_acctbal FROM {c} WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", c=table(s, sf_dir, "customer"))

    return Pipeline("sql").source("rich", dataframe(fn)).result(spark)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def df_fn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("top").source("orders", _source(sf_dir, "orders")).select("cut", "o_orderkey", "o_totalprice")
    return p.sort("sorted", F.desc("o_totalprice"), "o_orderkey").limit("top", 50).result(spark)


@query("SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def df_fn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("join").source("c", _source(sf_dir, "customer")).source("o", _source(sf_dir, "orders"))
    p.join("both", "c", "o", F.expr("c_custkey = o_custkey"))
    return p.aggregate("n", ["c_mktsegment"], n_orders="count(*)", n_customers="count(DISTINCT c_custkey)").result(spark)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("semi").source("c", _source(sf_dir, "customer")).source("o", _source(sf_dir, "orders"))
    p.join("with", "c", "o", F.expr("c_custkey = o_custkey"), "left_semi").select("w", "c_custkey", "true AS has_orders")
    p.join("without", "c", "o", F.expr("c_custkey = o_custkey"), "left_anti").select("n", "c_custkey", "false AS has_orders")
    return p.union("all", "w", "n").result(spark)


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def left_outer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("history").source("o", _source(sf_dir, "orders")).source("c", _source(sf_dir, "customer")).filter("positive", "c_acctbal > 0")
    return p.join("joined", "o", "positive", F.expr("o_custkey = c_custkey"), "left").select("out", "o_orderkey", "c_name").result(spark)


@query("""
SELECT coalesce(a.c_custkey, b.o_custkey) AS custkey, CASE WHEN b.o_custkey IS NULL THEN 'DELETED' WHEN a.c_custkey IS NULL THEN 'NEW' ELSE 'UPDATED' END AS status
FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.c_custkey = b.o_custkey""")
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    seen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")).distinct()
    return lineage.reconcile(known, seen, "custkey")


@query("SELECT c_mktsegment, nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(nation) AS is_total FROM (SELECT *, c_nationkey::varchar AS nation FROM customer) GROUP BY ROLLUP (c_mktsegment, nation)")
def rollup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("rollup").source("c", _source(sf_dir, "customer")).map("named", {"nation": "cast(c_nationkey AS string)"})
    return p.aggregate("sums", ["c_mktsegment", "nation"], "rollup", n="count(*)", balance="round(sum(c_acctbal), 2)", is_total="cast(grouping(nation) as bigint)").result(spark)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline("cube").source("o", _source(sf_dir, "orders")).aggregate("n", ["o_orderstatus", "o_orderpriority"], "cube", n="count(*)").result(spark)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("sets").source("l", _source(sf_dir, "lineitem"))
    return p.sql("q", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {l} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", l="l").result(spark)


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Pipeline("rank").source("o", _source(sf_dir, "orders"))
    p.window("rn", w, rn="row_number()").window("rk", Window.partitionBy("o_custkey").orderBy("o_orderpriority"), rk="rank()")
    p.window("sum", w.rowsBetween(-2, 0), running="sum(o_totalprice)")
    return p.select("out", "o_orderkey", "rn", "rk", "round(running, 2) AS running").result(spark)


@query("""
(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, sf_dir, "customer").select("c_custkey"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey"))
    joined = joined.join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


# Telemetry


@query("""
SELECT window_start, event_type, count(*) AS n_sources, round(sum(value), 2) AS value FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL
) GROUP BY window_start, event_type""")
def telemetry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.tumbling_latest(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", 3600, "event_id", value="value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_sources", F.round("value", 2).alias("value"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return telemetry.latest_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""
SELECT event_id, round(CASE WHEN s - lag(s) OVER w > 0 THEN (value - lag(value) OVER w) / (s - lag(s) OVER w) END, 6) AS rate
FROM (SELECT *, epoch_us(ts) / 1000000.0::double AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def rate_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = telemetry.rate(e, "event_type", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value", ["ts", "event_id"])
    return out.select("event_id", F.round("rate", 6).alias("rate"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::double AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT user_id, rn, event_id, t AS last, true AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.t - f.last >= 21600 THEN o.t ELSE f.last END, o.t - f.last >= 21600 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1
)
SELECT user_id, event_id FROM f WHERE kept""")
def rate_limit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rate_limited(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 21600.0, "event_id").drop("ts")


_OFFSETS = """
SELECT event_type AS topic, user_id % 8 AS part, max(event_id) AS latest, max(event_id) FILTER (WHERE value > 20) - (CASE WHEN user_id % 8 = 3 THEN 0 ELSE 5 END) AS committed FROM events GROUP BY event_type, user_id % 8"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("user_id") % 8
    committed = F.max(F.when(F.col("value") > 20, F.col("event_id"))) - F.when(F.col("part") == 3, 0).otherwise(5)
    return table(spark, sf_dir, "events").withColumn("part", part).groupBy(F.col("event_type").alias("topic"), "part").agg(F.max("event_id").alias("latest_offset"), committed.alias("committed_offset"))


@query(f"""
SELECT topic, sum(lag)::bigint AS total_lag, max(lag) AS max_lag, round(CASE WHEN avg(lag) > 0 THEN max(lag) / avg(lag) ELSE 0 END, 6) AS skew, CASE WHEN avg(lag) > 0 THEN max(lag) / avg(lag) ELSE 0 END > 2.0 AS is_skewed
FROM (SELECT topic, greatest(0, latest - coalesce(committed, 0)) AS lag FROM ({_OFFSETS})) GROUP BY topic""")
def lag_and_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.lag_by(_offsets(spark, sf_dir), ["topic"]).withColumn("skew", F.round("skew", 6))


@query(f"SELECT topic, min(committed) AS min_committed FROM ({_OFFSETS}) GROUP BY topic")
def least_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.least_committed(_offsets(spark, sf_dir), ["topic"])


@query("SELECT event_id AS \"offset\", event_type FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events) ORDER BY 1 LIMIT 100")
def queue_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), "event_type")
    middle = (log.agg(F.max("offset")).first()[0] or 0) // 2
    return telemetry.fetch(telemetry.truncate_before(log, F.lit(middle)), middle, 100)


@query("SELECT user_id % 4 AS worker, count(*) AS n FROM events GROUP BY 1")
def partition_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(telemetry.assigned_worker(F.col("user_id"), 4).alias("worker")).agg(F.count("*").alias("n"))


@query("""
SELECT substr(md5(kind || ':' || substr(message, 1, 100)), 1, 16) AS group_id, kind, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(message, (ts, message)) AS message
FROM (SELECT 'E' || (user_id % 5) AS kind, 'failed with ' || props AS message, ts FROM events WHERE event_type = 'error') GROUP BY 1, 2""")
def exception_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    e = e.select(F.concat(F.lit("E"), (F.col("user_id") % 5).cast("string")).alias("kind"), F.concat(F.lit("failed with "), "props").alias("message"), "ts")
    return telemetry.error_groups(e, "kind", "message", "ts")


@query("SELECT event_type, list_sort(list(value))[(floor(count(*) * 0.5)::bigint + 1)] AS p50, list_sort(list(value))[(floor(count(*) * 0.99)::bigint + 1)] AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})


@query("SELECT event_type, b AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, (SELECT unnest([0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0]::double[]) AS b) GROUP BY 1, 2")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.histogram(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
SELECT event_id, coalesce(last_value(CASE WHEN value > 100 THEN true WHEN value < 70 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_paused FROM events""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return telemetry.pressure(e, "user_id", ["ts", "event_id"], "value", high=100).select("event_id", "is_paused")


@query("""
SELECT user_id, CASE WHEN user_id % 11 = 0 THEN workers ELSE coalesce(least(greatest(CASE WHEN user_id % 7 = 0 THEN 9 END, 1), 8), CASE WHEN lag > 1500 THEN least(workers + 2, 8) WHEN lag < 500 THEN greatest(workers - 1, 1) ELSE workers END) END AS wanted
FROM (SELECT user_id, 1 + user_id % 6 AS workers, floor(sum(value))::bigint AS lag FROM events GROUP BY user_id)""")
def autoscale_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.sum("value")).alias("lag")).withColumn("workers", 1 + F.col("user_id") % 6)
    u = F.col("user_id")
    wanted = telemetry.wanted_workers(F.col("workers"), F.col("lag"), F.lit(1), F.lit(8), F.when(u % 7 == 0, F.lit(9)), u % 11 == 0, 1500, 500)
    return s.select("user_id", wanted.cast("long").alias("wanted"))


@query("""
SELECT user_id, arg_max(s, (ts, event_id)) AS status, count(*) AS n_changes FROM (
  SELECT *, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS s FROM events) WHERE s IS NOT NULL GROUP BY 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"signup": "PENDING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}
    return telemetry.latest_state(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], states, "event_type")


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'FAILED' WHEN bool_or(event_type = 'signup' AND value > 150) THEN 'CANCELLED' ELSE 'COMPLETED' END AS status FROM events GROUP BY 1""")
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return e.agg(lineage.archived_status(F.bool_or(F.expr("event_type = 'error' AND value > 100")), F.bool_or(F.expr("event_type = 'signup' AND value > 150"))).alias("status"))


# Media


@query("""
WITH RECURSIVE b AS (
  SELECT user_id, least(greatest(value, 0), 100)::double AS t, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn FROM events WHERE value IS NOT NULL
), f AS (
  SELECT user_id, 0::bigint AS rn, 0.0::double AS "at", NULL::double AS lo, NULL::double AS hi FROM (SELECT DISTINCT user_id FROM b)
  UNION ALL
  SELECT b.user_id, b.rn, CASE WHEN b.t - f."at" >= 0.5 THEN b.t ELSE f."at" END, CASE WHEN b.t - f."at" >= 0.5 THEN f."at" END, CASE WHEN b.t - f."at" >= 0.5 THEN b.t END
  FROM f JOIN b ON b.user_id = f.user_id AND b.rn = f.rn + 1
), s AS (
  SELECT user_id, lo, hi FROM f WHERE lo IS NOT NULL
  UNION ALL SELECT user_id, max(f."at"), 100.0 FROM f GROUP BY user_id HAVING 100 - max(f."at") >= 0.5
)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lo) - 1 AS scene_index, round(lo, 3) AS scene_start, round(hi, 3) AS scene_end FROM s""")
def scene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("boundaries")).withColumn("duration_sec", F.lit(100.0))
    return media.scene_rows(e).select("user_id", F.col("scene_index").cast("long").alias("scene_index"), "scene_start", "scene_end")


@query("SELECT page_id, sha256(html) AS slice_sha256, octet_length(encode(html))::integer AS slice_size, printf('%s_scene_%04d.mp4', url, page_id) AS name FROM pages")
def slice_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("slice_binary", F.col("html").cast("binary"))
    return media.with_hash(p).select("page_id", "slice_sha256", "slice_size", media.slice_name(F.col("url"), F.col("page_id")).alias("name"))


# Functions, sinks, lineage, catalogue


@query("SELECT page_id::varchar AS key, base64(encode(html)) AS html, url FROM pages")
def json_envelope_b64(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rowfn.keyed(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("html")), F.col("page_id"))
    return sinks.envelope(p).select("key", "value.html", "value.url")


@query("SELECT l_orderkey, l_linenumber, 'items:' || substr(sha256(CASE WHEN l_partkey::varchar < l_suppkey::varchar THEN l_partkey || ',' || l_suppkey ELSE l_suppkey || ',' || l_partkey END || '|' || l_linenumber), 1, 12) AS split_id FROM lineitem")
def split_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.split_id("items", parents, F.col("l_linenumber")).alias("split_id"))


@query("SELECT DISTINCT 'p' || l_partkey AS parent, 'o' || l_orderkey AS child FROM lineitem UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return lineage.edges(table(spark, sf_dir, "lineitem").select(at("o", "l_orderkey").alias("split_id"), F.array(at("p", "l_partkey"), at("s", "l_suppkey")).alias("parent_ids")))


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS n_tables FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name > 'J' GROUP BY ALL")
def tables_per_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tables_per_namespace(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").where("n_name > 'J'"), "r_regionkey", "n_regionkey")


@query("SELECT n_name FROM nation ORDER BY n_name LIMIT 7 OFFSET 5")
def namespace_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.page(table(spark, sf_dir, "nation").select("n_name"), [F.col("n_name")], 7, 5)


@query("SELECT count(*) AS n_rows, 1::bigint AS n_files FROM orders WHERE o_totalprice > 1000")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_stats(table(spark, sf_dir, "orders"), "o_totalprice > 1000")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_name ILIKE '%00000001%' AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_mktsegment") == "BUILDING", "SUCCEEDED").when(F.col("c_mktsegment") == "MACHINERY", "FAILED").when(F.col("c_mktsegment") == "FURNITURE", "STOPPED").otherwise("RUNNING")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("user"), F.lit("q").alias("queue"), status.alias("status"))
    return lineage.jobs(c, user="00000001", queue="").select("c_custkey", "c_mktsegment")


@query("""SELECT t AS size, (regexp_extract(trim(upper(t)), '^([0-9]+)', 1)::double * CASE WHEN t ILIKE '%k%' THEN 1024 WHEN t ILIKE '%m%' THEN 1048576 WHEN t ILIKE '%g%' THEN 1073741824 WHEN t ILIKE '%t%' THEN 1099511627776 ELSE 1 END)::bigint AS bytes
FROM (SELECT n_nationkey || unnest(['', 'K', ' MB', 'g', ' tb']) AS t FROM nation)""")
def memory_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.explode(F.array(*[F.lit(u) for u in ("", "K", " MB", "g", " tb")]))
    n = table(spark, sf_dir, "nation").select("n_nationkey", units.alias("u")).select(F.concat(F.col("n_nationkey").cast("string"), "u").alias("size"))
    return n.select("size", scalar.memory_bytes(F.col("size")).alias("bytes"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", scalar.iso_time(text).cast("timestamp_ntz").alias("at"))


@query("SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalar.url_name(F.col("url")).alias("name"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice; the state that tells is as old as the watermark at most."""
    from millrace.streaming.incremental import once_by

    return _streamed(spark, sf_dir, lambda e: once_by(e.select("event_id", "user_id", "ts").unionByName(e.select("event_id", "user_id", "ts")), ["event_id"], "ts", "1 hour").select("event_id", "user_id"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 3 SECOND FROM events)""")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; a window is written once and its state goes."""
    from millrace.streaming.incremental import windowed

    out = _streamed(spark, sf_dir, lambda e: windowed(e, "ts", 3600, "3 seconds", ["event_type"], n="count(*)", value="round(sum(value), 2)"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
SELECT user_id, arg_max(s, (ts, event_id)) AS status, count(*) AS n_changes FROM (
  SELECT *, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS s FROM events) WHERE s IS NOT NULL GROUP BY 1""")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over a stream, with a snapshot for each batch; the newest is read."""
    from millrace.streaming import state

    at = fresh_dir(spark, "states")
    states = {"signup": "PENDING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}
    run_available(_event_stream(spark, sf_dir), f"{at}/marks", each=state.keep_state(f"{at}/out", "user_id", ["ts", "event_id"], states, "event_type"))
    return state.read_state(spark, f"{at}/out").select("user_id", "status", "n_changes")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if _is_file(spark, path) else reader.parquet(path)


def _streamed(spark: SparkSession, sf_dir: str, fn) -> DataFrame:
    """Runs a stream over all events into a fresh folder beside the session's checkpoints and reads it."""
    at = fresh_dir(spark, "stream")
    out = fn(_event_stream(spark, sf_dir))
    run_available(out, f"{at}/state", each=replace_batch(f"{at}/out"))
    return spark.read.parquet(f"{at}/out").select(*out.columns)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


# Monitoring

_SNAPSHOTS = "SELECT user_id, event_id, floor(value)::bigint AS input_records, event_id % 50 AS output_records FROM events"


@query(f"SELECT * FROM ({_SNAPSHOTS}) WHERE coalesce(input_records, 0) + output_records >= 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(input_records, 0) + output_records DESC, event_id) = 1")
def best_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("input_records"), (F.col("event_id") % 50).alias("output_records"))
    return monitor.best_snapshots(e, "user_id", "event_id")


@query("SELECT event_id, coalesce(floor(value)::bigint, 0) + event_id % 7 AS queue_size FROM events WHERE event_id > 0")
def lag_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = lambda c: F.struct(c.cast("long").alias("lag"))
    metrics = F.create_map(F.lit("0"), lag(F.floor("value")), F.lit("1"), lag(F.col("event_id") % 7))
    return monitor.lag_history(table(spark, sf_dir, "events").select("event_id", metrics.alias("partition_metrics")), ts="event_id")


def _actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = table(spark, sf_dir, "nation").select(F.lit("_RaySplitPayloadStoreActor").alias("class_name"), F.concat(F.lit("payload_store_"), "n_name").alias("name"), F.lit("ALIVE").alias("state"), F.col("n_nationkey").cast("long").alias("started"))
    workers = table(spark, sf_dir, "events").select(F.lit("StageWorker").alias("class_name"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("name"), F.when(F.col("value") > 50, "ALIVE").otherwise("DEAD").alias("state"), F.col("event_id").alias("started"))
    return stores.unionByName(workers)


@query("""
WITH w AS (SELECT count(DISTINCT event_type) AS s, count(*) AS n FROM events WHERE value > 50)
SELECT n_name AS job_id, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation) THEN w.s ELSE 0 END AS stage_count, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation) THEN w.n ELSE 0 END AS worker_count FROM nation, w""")
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.running_jobs(_actors(spark, sf_dir), "started")


@query("SELECT event_type AS stage_id, count(*) AS worker_count FROM events WHERE value > 50 GROUP BY 1")
def running_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.running_stages(_actors(spark, sf_dir))


@query("""
SELECT kind, count(*) AS n_groups, sum(n)::bigint AS n, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM (
  SELECT kind, substr(message, 1, 100) AS m, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen
  FROM (SELECT 'E' || (user_id % 5) AS kind, 'failed with ' || props AS message, ts FROM events WHERE event_type = 'error') GROUP BY 1, 2) GROUP BY kind""")
def exceptions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.errors_by_type(exception_groups(spark, sf_dir))


@query("""
SELECT l_returnflag, round(count(*) FILTER (WHERE l_quantity > 10) / count(*), 6) AS selectivity, round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0::double / count(*), 6) AS progress,
  CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') > 0 THEN round(count(*) FILTER (WHERE l_linestatus <> 'F') * 60.0::double / count(*) FILTER (WHERE l_linestatus = 'F'), 6) END AS eta
FROM lineitem GROUP BY 1""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 10).alias("out"), F.count_if(F.col("l_linestatus") == "F").alias("done"))  # noqa: E741
    n, done = F.col("n"), F.col("done")
    return l.select("l_returnflag", F.round(monitor.selectivity(n, F.col("out")), 6).alias("selectivity"), F.round(monitor.progress(done, n), 6).alias("progress"), F.round(monitor.eta_seconds(done, n, F.lit(60.0)), 6).alias("eta"))


@query("SELECT event_type, count(*) AS messages, max(event_id) - min(event_id) AS elapsed, round(avg(value), 6) AS avg_latency, round(CASE WHEN max(event_id) > min(event_id) THEN count(*) / (max(event_id) - min(event_id)) ELSE 0 END, 6) AS throughput FROM events GROUP BY 1")
def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    out = monitor.throughput(e, ["event_type"], "event_id", "event_id", "one", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_latency", "throughput")})


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def count_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline("states").source("o", _source(sf_dir, "orders")).aggregate("n", ["o_orderstatus"], n="count(*)").select("out", "o_orderstatus AS status", "n").result(spark)


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 2 DAY FROM events) ORDER BY ts, event_id LIMIT 200")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    (first,) = e.agg(F.min("ts")).first()
    return lineage.page(e.where((F.col("ts") >= F.lit(first) + F.expr("interval 1 day")) & (F.col("ts") <= F.lit(first) + F.expr("interval 2 days"))), [F.col("ts"), F.col("event_id")], 200)


@query("SELECT o_custkey AS job_id, o_orderkey AS attempt, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return telemetry.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"))


@query("SELECT s_suppkey AS worker, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 3")
def worker_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.page(table(spark, sf_dir, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 20, 3).select(F.col("s_suppkey").alias("worker"), F.col("s_name").alias("name"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' AND c_name ILIKE '%customer%'")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user"), F.lit("q").alias("queue"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").cast("string").alias("cluster"))
    return lineage.jobs(c, user="CUSTOMER", status="BUILDING", cluster="3").select("c_custkey")


@query("SELECT l_orderkey AS split_id, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS part, max(l_linenumber * 1000000 + l_partkey)::double AS timestamp FROM lineitem GROUP BY 1")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.nodes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("split_id"), F.col("l_partkey").alias("part"), F.expr("cast(l_linenumber * 1000000 + l_partkey AS double)").alias("timestamp")))


@query("""
SELECT 'load:' || substr(sha256(CASE WHEN l_partkey::varchar < l_suppkey::varchar THEN l_partkey || ',' || l_suppkey ELSE l_suppkey || ',' || l_partkey END || '|' || l_linenumber), 1, 12) AS split_id,
  'load' AS stage_id, l_orderkey::varchar AS worker_id, l_quantity AS processing_time, l_linenumber::bigint AS input_records, (l_linenumber * 2)::bigint AS output_records
FROM lineitem""")
def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, n = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), F.col("l_linenumber")
    out = lineage.records(table(spark, sf_dir, "lineitem"), "load", parents, n, worker=F.col("l_orderkey"), seconds=F.col("l_quantity"), inputs=n, outputs=n * 2, ts=F.lit(0.0))
    return out.drop("parent_ids", "timestamp", "data_range")


@query("SELECT event_id, user_id FROM events")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a versioned table, in two phases; its last batch comes again and changes nothing."""
    at = fresh_dir(spark, "commits")
    write = commit_batches(f"{at}/out", "events")
    run_available(_event_stream(spark, sf_dir).select("event_id", "user_id"), f"{at}/state", each=write)
    write(table(spark, sf_dir, "events").select("event_id", "user_id"), 0)
    return VersionedTable(spark, f"{at}/out").read()


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
d AS (SELECT DISTINCT parent AS split, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.split)
SELECT split, max(depth)::integer AS depth FROM d GROUP BY 1""")
def lineage_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf_dir, "nation").select(at("r", "n_regionkey").alias("parent"), at("n", "n_nationkey").alias("child"))
    b = table(spark, sf_dir, "customer").select(at("n", "c_nationkey").alias("parent"), at("c", "c_custkey").alias("child"))
    return lineage.depths(a.union(b).distinct())


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 3 WHEN event_id % 5 <> 0 THEN event_id % 5 ELSE 0 END AS records FROM events")
def metric_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", lineage.first_set(e % 3, F.when(e % 2 == 0, None).otherwise(e % 5), e % 5).alias("records"))


# Readable values, probes, images


@query("""
SELECT event_id,
  CASE WHEN s < 1 THEN round(s * 1000)::bigint || 'ms' WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN floor(floor(s) / 60)::bigint || 'm ' || floor(s)::bigint % 60 || 's' ELSE floor(floor(s) / 3600)::bigint || 'h ' || floor(floor(s)::bigint % 3600 / 60)::bigint || 'm' END AS duration,
  CASE WHEN b < 1024 THEN printf('%.1fB', b) WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) ELSE printf('%.1fMB', b / 1048576) END AS bytes,
  CASE WHEN n < 1000 THEN n::varchar WHEN n < 1000000 THEN printf('%.1fK', n / 1000.0::double) ELSE printf('%.1fM', n / 1000000.0::double) END AS number,
  strftime(make_timestamp(n * 1000000), '%Y-%m-%d %H:%M:%S') AS at
FROM (SELECT event_id, value * value / 3 + 0.0131 AS s, value * value * 100 + 0.0131 AS b, event_id * 140 + 3 AS n FROM events WHERE value IS NOT NULL)""")
def readable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.expr("value * value / 3 + 0.0131D").alias("s"), F.expr("value * value * 100 + 0.0131D").alias("b"), F.expr("event_id * 140 + 3").alias("n"))
    return e.select("event_id", scalar.human_duration(F.col("s")).alias("duration"), scalar.human_bytes(F.col("b")).alias("bytes"), scalar.human_number(F.col("n")).alias("number"), scalar.human_time(F.col("n")).alias("at"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey * 1001.0::double / n_regionkey END AS fps FROM nation")
def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("n_nationkey") * 1001).cast("string"), F.lit("/"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalar.fraction(text).alias("fps"))


_MESSAGES = ["Java heap MEMORY is gone", "read timeout", "Connection refused", "Access Denied to bucket", "a key is missing"]


@query(f"""
SELECT event_id, CASE WHEN user_id % 7 = 0 OR event_id % 5 = 0 THEN 'Memory exhaustion. Consider increasing worker memory or reducing batch size.'
  WHEN user_id % 7 = 1 OR event_id % 5 = 1 THEN 'Operation timeout. Check for slow data sources or network issues.'
  WHEN event_id % 5 = 2 THEN 'Network connectivity issue. Check queue backend and network configuration.' WHEN event_id % 5 = 3 THEN 'Permission issue. Check file system or S3 bucket permissions.'
  ELSE '{scalar.NO_CAUSE}' END AS cause FROM events""")
def error_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 7 == 0, "OutOfMemoryError").when(F.col("user_id") % 7 == 1, "TimeoutError").when(F.col("user_id") % 7 == 2, "ValueError")
    message = F.array(*map(F.lit, _MESSAGES))[(F.col("event_id") % 5).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", scalar.likely_cause(kind, message).alias("cause"))


@query("""
SELECT 'equals' AS op, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'not_equals', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'greater_than', count(*) FROM orders WHERE o_totalprice > 150000
UNION ALL SELECT 'less_than', count(*) FROM orders WHERE o_totalprice < 150000 UNION ALL SELECT 'contains', count(*) FROM orders WHERE contains(o_orderpriority, 'URG')""")
def catalogue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five operations in one pass over the table."""
    asked = [("equals", "o_orderstatus", "F"), ("not_equals", "o_orderstatus", "F"), ("greater_than", "o_totalprice", 150000), ("less_than", "o_totalprice", 150000), ("contains", "o_orderpriority", "URG")]
    sums = table(spark, sf_dir, "orders").agg(*[F.count_if(scalar.matches(F.col(c), op, v)).alias(op) for op, c, v in asked])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(op).alias("n")) for op, _, _ in asked])).alias("x")).select("x.op", "x.n")


@query("SELECT event_id, value AS first_cut, (value IS NOT NULL)::integer AS n_cuts, 640 AS width, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 25.0::double END AS fps FROM events")
def probe_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    frames = F.concat(F.lit('{"frames":[{"pts_time":"x"},{},{"pts_time":"'), F.coalesce(F.col("value").cast("string"), F.lit("none")), F.lit('"}]}'))
    meta = F.concat(F.lit('{"streams":[{"width":640,"height":480,"avg_frame_rate":"'), F.when(F.col("event_id") % 3 == 0, "0/0").otherwise("25/1"), F.lit('"}],"format":{"duration":"4.5"}}'))
    cuts, facts = media.boundaries_of(frames), media.metadata_of(meta)
    return e.select("event_id", F.get(cuts, 0).alias("first_cut"), F.size(cuts).alias("n_cuts"), facts["width"].alias("width"), facts["fps"].alias("fps"))


@query("""
SELECT page_id, 'PNG' AS format, w AS width, h AS height, sha256(from_hex(x)) AS sha256, CASE WHEN greatest(w, h) <= 512 THEN w ELSE greatest(1, floor(w * 512.0::double / greatest(w, h) + 0.5)::bigint) END AS fit_width, w >= 100 AND h >= 100 AND page_id % 90 >= 50 AS good
FROM (SELECT *, '89504E470D0A1A0A0000000D49484452' || printf('%08X', w) || printf('%08X', h) AS x FROM (SELECT page_id, (page_id * 37) % 3000 + 1 AS w, (page_id * 91) % 2000 + 1 AS h FROM pages))""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "pages").select("page_id", F.expr("(page_id * 37) % 3000 + 1").alias("w"), F.expr("(page_id * 91) % 2000 + 1").alias("h"))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), *[F.lpad(F.hex(c), 8, "0") for c in ("w", "h")]))
    x = media.image_facts(png)
    rows = sized.select("page_id", x["format"].alias("format"), x["width"].alias("width"), x["height"].alias("height"), x["sha256"].alias("sha256"))
    good = media.good_image(F.col("width"), F.col("height"), (F.col("page_id") % 90).cast("double"), F.lit(100.0))
    return rows.withColumns({"fit_width": media.fitted(F.col("width"), F.col("height"), 512)["width"], "good": good})


@query("SELECT page_id FROM pages WHERE page_id % 4 = 0")
def every_nth_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(media.every_nth(F.col("page_id"), 4)).select("page_id")


@query("SELECT page_id, substr(md5(url), 1, 16) || '_' || coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '([^/]*)$', 1), ''), 'file') AS name FROM pages")
def cached_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", remote.cache_name(F.col("url")).alias("name"))


# Sources and sinks, written and read back


@query("SELECT n_nationkey, n_name FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.json_lines(fresh_dir(spark, "json"))(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return files(at, "json", "key string, timestamp double, value struct<n_nationkey: int, n_name: string>")(spark).select("value.*")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.csv(fresh_dir(spark, "csv"))(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return files(at, "csv", "key string, c_custkey long, c_name string, c_acctbal double")(spark).drop("key")


@query("SELECT s_suppkey, s_name FROM supplier")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sinks.parquet(fresh_dir(spark, "parquet"))(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    return files(at, "parquet")(spark)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def resumed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier read got to row 10 of its second file."""
    first, second = f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"
    return files([first, second], "parquet", resume={"completed_files": [first], "current_file": second, "row_offset": 10})(spark).select("n_nationkey", "n_name")


@query("SELECT 1 AS version, count(*) AS n, 0 AS n_late FROM nation UNION ALL SELECT 2, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), (SELECT count(*) FROM region)")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table; the second appends rows with a later column."""
    t = VersionedTable(spark, fresh_dir(spark, "versions"))
    t.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "create")
    t.write(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(True).alias("late")))
    count = lambda v, late: t.read(v).agg(F.count("*").alias("n"), late.alias("n_late")).select(F.lit(v).alias("version"), "n", F.col("n_late").cast("int").alias("n_late"))
    return count(1, F.lit(0)).union(count(2, F.count_if("late")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return sinks.from_blocks(sinks.blocks(n, 10), n.schema)


@query("SELECT 'orders' AS topic, (('0x' || substr(md5(o_custkey::varchar), 1, 8))::bigint % 8)::integer AS partition, o_custkey::varchar AS key, json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus)::varchar AS value FROM orders")
def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.messages(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "orders", 8)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 32, 100)")
def sample_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "orders"), columns=["o_orderkey", "o_totalprice"], row_ids=[1, 2, 3, 32, 100], id_col="o_orderkey", limit=100)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_slice(table(spark, sf_dir, "nation"), 5, 5).select("n_nationkey")
