import json
import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import rowfn, sinks
from millrace.cli import options, scalar
from millrace.model import KEY, TS
from millrace.pipeline import Pipeline
from millrace.sources.files import files, plan_splits, row_slice
from millrace.sources.frames import SplitSource, arrow_block, dataframe
from millrace.sources.versioned import VersionedTable
from millrace.streaming.incremental import once_by, replace_batch, run_available, stream_files, windowed


def numbers(spark, n=10):
    return spark.range(n).withColumnRenamed("id", "value")


def values(df, c="value"):
    return sorted(r[c] for r in df.collect())


def test_graph_is_validated(spark):
    p = Pipeline("p").source("a", lambda s: numbers(s))
    with pytest.raises(ValueError, match="already"):
        p.source("a", lambda s: numbers(s))
    with pytest.raises(ValueError, match="unknown"):
        p.filter("f", "value > 1", upstream="nope")
    with pytest.raises(ValueError, match="upstreams"):
        p.source("b", lambda s: numbers(s)).add("x", "map", lambda a, b: a, ["a", "b"])
    with pytest.raises(ValueError):
        p.map("m", fn=3, schema="value long")
    with pytest.raises(ValueError):
        p.map("m")


def test_map_and_filter_rows(spark):
    p = Pipeline("p").source("a", lambda s: numbers(s))
    p.map("m", fn=lambda r: {"value": r["value"] + 1, "odd": r["value"] % 2 == 0}).filter("f", fn=lambda r: r["odd"])
    df = p.result(spark)
    assert values(df) == [1, 3, 5, 7, 9] and dict(df.dtypes) == {"value": "bigint", "odd": "boolean"}
    # Both functions run in one pass over the rows.
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_key_is_kept_and_time_set_anew(spark):
    df = rowfn.keyed(numbers(spark, 3), "value", F.lit(5.0))
    seen = rowfn.map_rows(df, rowfn.RowSteps([("map", lambda r: {"names": ",".join(sorted(r))})]), "names string")
    out = seen.collect()
    assert {r.names for r in out} == {"value"} and sorted(r[KEY] for r in out) == ["0", "1", "2"] and all(r[TS] > 1e9 for r in out)
    kept = rowfn.map_rows(df, rowfn.RowSteps([("filter", lambda r: r["value"] > 0)])).collect()
    assert len(kept) == 2 and all(r[TS] == 5.0 for r in kept)


def test_result_that_is_no_dict_is_wrapped(spark):
    assert values(rowfn.map_rows(numbers(spark, 3), rowfn.RowSteps([("map", lambda r: r["value"] * 2)]), "value long")) == [0, 2, 4]


def test_error_policies(spark):
    df = numbers(spark, 8).withColumn("split", F.floor(F.col("value") / 4)).coalesce(1)
    bad = rowfn.RowSteps([("map", lambda r: {"value": 1 // (r["value"] - 5) * 0 + r["value"], "split": r["split"]})])
    schema = "value long, split long"
    with pytest.raises(Exception, match="ZeroDivision"):
        rowfn.map_rows(df, bad, schema).collect()
    assert values(rowfn.map_rows(df, bad, schema, "drop_row")) == [0, 1, 2, 3, 4, 6, 7]
    assert rowfn.map_rows(df, bad, schema, "null_row").where("value IS NULL").count() == 1
    assert rowfn.map_rows(df, bad, schema, "empty").count() == 0
    assert values(rowfn.map_rows(df, bad, schema, "drop_split", "split")) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        rowfn.map_rows(df, bad, schema, "whatever")


def test_inferred_schema_is_the_union_of_keys(spark):
    steps = rowfn.RowSteps([("map", lambda r: {"a": 1} if r["value"] else {"b": "x"})])
    assert {f.name for f in rowfn.infer_schema(numbers(spark, 3), steps)} == {"a", "b"}
    mixed = rowfn.RowSteps([("map", lambda r: {"a": 1 if r["value"] else "x"})])
    with pytest.raises(ValueError):
        rowfn.infer_schema(numbers(spark, 3), mixed)


def test_batches(spark):
    df = numbers(spark, 4)
    with pytest.raises(Exception, match="made 0 rows"):
        rowfn.map_batches(df, lambda t: t.slice(0, 0)).collect()
    assert rowfn.map_batches(df, lambda t: t.slice(0, 0), skip_on_error=True).count() == 0
    assert values(rowfn.map_batches(df, lambda t: t.to_batches()[0])) == [0, 1, 2, 3]
    assert rowfn.flat_map(df, lambda t: pa.concat_tables([t, t])).count() == 8


def test_fan_out_and_in_and_sql(spark):
    p = Pipeline("p").source("a", lambda s: numbers(s))
    p.filter("low", "value < 5", upstream="a").filter("high", "value >= 5", upstream="a").union("u", "low", "high")
    p.sql("q", "SELECT sum(value) AS s FROM {u}", u="u")
    assert p.result(spark).first().s == 45
    p.join("j", "low", "u", "value")
    assert p.result(spark, "j").count() == 5


def test_sinks(spark, tmp_path):
    df = rowfn.keyed(spark.createDataFrame([(1, b"ab", None)], "value long, data binary, nothing string"), F.lit("k"), F.lit(2.0))
    p = Pipeline("p").source("a", df)
    p.sink("json", sinks.json_lines(f"{tmp_path}/x.json"), "a").sink("csv", sinks.csv(f"{tmp_path}/c"), "a").sink("pq", sinks.parquet(f"{tmp_path}/p", enveloped=True), "a")
    p.run(spark)
    assert json.loads(open(f"{tmp_path}/x.json").read()) == {"key": "k", "timestamp": 2.0, "value": {"value": 1, "data": "YWI=", "nothing": None}}
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().asDict() == {"key": "k", "value": "1", "data": "YWI=", "nothing": None}
    assert spark.read.parquet(f"{tmp_path}/p").first().value.value == 1
    with pytest.raises(Exception):
        sinks.parquet(f"{tmp_path}/p", "create")(df)
    assert os.listdir(tmp_path / "c")


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert values(files(f"{tmp_path}/a.json")(spark), "a") == [1, 2]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files(f"{tmp_path}/bad.json", schema="a long")(spark).collect()
    with pytest.raises(ValueError):
        files("x", "xml")
    with pytest.raises(Exception):
        files(f"{tmp_path}/none.json")(spark)
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    assert files(f"{tmp_path}/a.csv", "csv")(spark).first().asDict() == {"a": 1, "b": "x"}
    numbers(spark, 2500).coalesce(1).write.parquet(f"{tmp_path}/p")
    (part,) = [str(x) for x in (tmp_path / "p").iterdir() if x.name.endswith(".parquet")]
    df = files(part, "parquet")(spark)
    assert sorted(r.n_rows for r in plan_splits(df, "s", 1024).collect()) == [452, 1024, 1024]
    assert row_slice(df, 100, 5).count() == 5
    assert files([part], "parquet", resume={"current_file": part, "row_offset": 2400})(spark).count() == 100
    assert files([part, "x"], "parquet", schema="value long", resume={"completed_files": [part, "x"]})(spark).count() == 0


def test_frame_sources(spark):
    assert dataframe(lambda s: s.range(10), parallelism=3)(spark).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        dataframe(None)
    t = pa.table({"a": [1, 2]})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    assert [arrow_block(b)(spark).count() for b in (t, t.to_batches()[0], out.getvalue().to_pybytes())] == [2, 2, 2]

    class Blocks(SplitSource):
        @classmethod
        def name(cls):
            return "blocks"

        def schema(self):
            return "block int, id int"

        def plan(self):
            return [{"block": b} for b in range(5)]

        def read_split(self, split):
            yield pa.record_batch({"block": pa.array([split["block"]] * 20, pa.int32()), "id": pa.array(range(20), pa.int32())})

    spark.dataSource.register(Blocks)
    assert spark.read.format("blocks").load().count() == 100

    class Pushed(Blocks):
        @classmethod
        def name(cls):
            return "pushed"

        def push(self, filters):
            self.least = [f.value for f in filters if type(f).__name__ == "GreaterThanOrEqual" and f.attribute == ("block",)]
            return [f for f in filters if f.attribute != ("block",) or type(f).__name__ not in ("GreaterThanOrEqual", "IsNotNull")]

        def plan(self):
            return [{"block": b} for b in range(5) if all(b >= x for x in self.least)]

    spark.dataSource.register(Pushed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("pushed").load().where("block >= 3 AND id < 5")
        assert df.rdd.getNumPartitions() == 2 and df.count() == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.write(spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "id long, value long").withColumn("_rowid", F.lit(1)), "create")
    with pytest.raises(FileExistsError):
        t.write(numbers(spark), "create")
    t.add_column("name", "string")
    t.write(spark.createDataFrame([(6, 60, "x")], "id long, value long, name string"))
    assert t.versions() == [1, 2, 3] and t.read().count() == 6 and t.read(1).columns == ["id", "value"]
    assert t.read(1, "value > 25").count() == 3 and t.read(columns=["id"], row_ids=True).columns == ["id", "_rowid"]
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("a",)], "id string"))
    t.write(spark.createDataFrame([(9, 9)], "id long, value long"), "overwrite")
    assert t.read().count() == 1 and t.read(3).count() == 6


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, 1.0), (i, 1.0)], "id long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: run_available(once_by(stream_files(spark, f"{tmp_path}/in", "id long, v double"), ["id"]), f"{tmp_path}/cp", each=replace_batch(f"{tmp_path}/out"))
    assert run()["rows"] == 4 and run()["rows"] == 0
    spark.createDataFrame([(0, 1.0), (7, 1.0)], "id long, v double").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "id") == [0, 1, 7]


def test_window_stream_equals_batch_but_for_the_open_window(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 3).alias("g"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    agg = lambda df: windowed(df, "ts", 10, "3 seconds", ["g"], n="count(*)")
    run_available(agg(stream_files(spark, f"{tmp_path}/in", "ts timestamp, g long")), f"{tmp_path}/cp", f"{tmp_path}/out")
    got, want = spark.read.parquet(f"{tmp_path}/out").collect(), agg(rows).collect()
    assert set(got) < set(want) and max(r.window_start for r in got).timestamp() == 80.0


def test_cli():
    assert options(["--some-key", "4", "--flag", "--x=1.5", "--name", "a"]) == {"some_key": 4, "flag": True, "x": 1.5, "name": "a"}
    assert [scalar(x) for x in ("true", "3", "2.5", "abc")] == [True, 3, 2.5, "abc"]


def test_keys_beyond_the_inferred_schema_are_refused(spark):
    from millrace.rowfn import RowSteps, map_rows

    late = RowSteps([("map", lambda r: {"id": r["id"]} | ({"late": 1} if r["id"] >= 150 else {}))])
    df = spark.range(0, 300, 1, 1)
    for policy in ("fail", "drop_row", "empty"):
        with pytest.raises(Exception, match="late"):
            map_rows(df, late, on_error=policy).collect()
    assert map_rows(df, late, sample=200).where("late = 1").count() == 150
    p = Pipeline("p").source("in", lambda s: df).map("m", fn=lambda r: {"id": r["id"]} | ({"late": 1} if r["id"] >= 150 else {}), sample=200)
    assert "late" in p.result(spark).columns


def test_a_refused_version_leaves_no_files(spark, tmp_path):
    from millrace.sources.versioned import VersionedTable

    t = VersionedTable(spark, str(tmp_path))
    t.write(spark.range(3), "create")
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("x",)], "id string"))
    assert len(list((tmp_path / "data").iterdir())) == 1 and t.versions() == [1]


def test_the_entry_survives_a_missing_subpackage(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; n = sorted(e.queries()); assert 'window_rank' in n and not [x for x in n if x.startswith('op1')], n; e.oracle_sql()"
    for how in ("without", "empty", "broken"):
        here = tmp_path / how
        shutil.copytree(root, here, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
        if how != "without":
            (here / "millrace" / "llm").mkdir()
            shutil.copy(f"{here}/bench.py", f"{here}/corpus_pipeline.py")
        if how == "broken":
            (here / "millrace" / "llm" / "__init__.py").write_text("")
            (here / "millrace" / "llm" / "queries.py").write_text("import no_such_module_here")
        subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=here, check=True)
