import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import catalog, lineage, media, monitor, telemetry
from millrace.sources import remote
from millrace.sources.sampling import sample_rows
from millrace.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scenes(spark):
    f = lambda b, d, m=0.5: [(s.start, s.end) for s in one(spark, media.scenes_of(F.lit(b) if b is None else F.array(*map(F.lit, b)), F.lit(d), m))]
    assert f([1.3, 0.2, 1.0, 3.0], 3.2) == [(0.0, 1.0), (1.0, 3.0)]
    assert f(None, 4.0) == [(0.0, 4.0)] and f([9.0], 4.0) == [(0.0, 4.0)]
    assert f([0.1], 0.3) == [(0.0, 0.3)]


def test_media(spark):
    assert [one(spark, media.every_nth(F.lit(r), n)) for r, n in ((4, 2), (3, 2), (3, 0), (None, 3))] == [True, False, True, True]
    with pytest.raises(Exception, match="missing"):
        media.with_hash(spark.createDataFrame([(None,)], "slice_binary binary")).collect()
    assert len(media.with_hash(spark.createDataFrame([(b"x",)], "slice_binary binary")).first().slice_sha256) == 64
    dealt = media.deal_blocks([4, 1, 7, 2, 2, 9, 3], 3)
    assert len({sum(n for _, n in v) for v in dealt.values()}) == 1
    mixed = [media.deal_blocks([4, 1, 7, 2, 2, 9, 3], 3, True, seed) for seed in (1, 1, 2)]
    assert mixed[0] == mixed[1] != mixed[2] and len({sum(n for _, n in v) for v in mixed[2].values()}) == 1
    parts = media.random_split(spark.range(1000), [0.7, 0.3], 3, "id")
    assert sum(p.count() for p in parts) == 1000 and 600 < parts[0].count() < 800
    rows = media.scene_rows(spark.createDataFrame([(7, [1.0], 2.0)], "global_index long, boundaries array<double>, duration_sec double"), index_col="global_index").collect()
    assert [(r.scene_index, r.global_slice_rank, r.scene_count) for r in rows] == [(0, 7, 2), (1, 8, 2)]


def test_scalars(spark):
    cases = {"10": 10, "10K": 10240, "10 mb": 10 * 2**20, "2  GB": 2**31, "1T": 2**40, "x": None}
    assert [one(spark, scalar.memory_bytes(F.lit(t))) for t in cases] == list(cases.values())
    assert scalar.parse_memory("10 KB") == 10240
    with pytest.raises(ValueError):
        scalar.parse_memory("ten")
    assert [one(spark, scalar.fraction(F.lit(t))) for t in ("30000/1001", "0/0", "25", "x")] == [30000 / 1001, None, 25.0, None]
    assert [one(spark, scalar.human_duration(F.lit(s))) for s in (0.25, 12.51, 200.0, 7500.0)] == ["250ms", "12.5s", "3m 20s", "2h 5m"]
    assert [one(spark, scalar.human_bytes(F.lit(n))) for n in (10, 2048, 3 * 2**30)] == ["10.0B", "2.0KB", "3.0GB"]
    assert [one(spark, scalar.human_number(n)) for n in (F.lit(999), F.lit(1500), F.lit(2500000), F.lit(None).cast("long"))] == ["999", "1.5K", "2.5M", "0"]
    assert one(spark, scalar.human_duration(F.lit(0.0126))) == "13ms"
    assert [one(spark, scalar.human_time(F.lit(s))) for s in (0.0, None, float("nan"))] == ["1970-01-01 00:00:00", "Unknown", "Unknown"]
    assert [one(spark, scalar.is_identifier(F.lit(t))) for t in ("a_1", "1a", "a\n")] == [True, False, False]
    said = [one(spark, scalar.likely_cause(F.lit(k), F.lit(m))) for k, m in (("E", "Connection refused"), ("TimeoutError", "network"), ("E", "out of Memory on timeout"), ("E", None))]
    assert [s.split(" ")[0] for s in said] == ["Network", "Operation", "Memory", "No"]
    assert one(spark, scalar.url_name(F.lit("s3://b/x/y.mp4"))) == "y.mp4" and one(spark, scalar.is_remote(F.lit("s3://b"))) and not one(spark, scalar.is_remote(F.lit("/b")))
    assert one(spark, scalar.matches(F.lit(3), "greater_than", 2)) and one(spark, scalar.matches(F.lit("abc"), "contains", "b"))
    with pytest.raises(ValueError):
        scalar.matches(F.lit(1), "like", 1)


def test_lag_and_pressure(spark):
    df = spark.createDataFrame([("a", 10, None), ("a", 5, 9), ("b", 3, 3)], "t string, latest_offset long, committed_offset long")
    out = {r.t: (r.total_lag, r.max_lag, r.skew, r.is_skewed) for r in telemetry.lag_by(df, ["t"]).collect()}
    assert out == {"a": (10, 10, 2.0, False), "b": (0, 0, 0.0, False)}
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate([100, 6000, 4000, 3000, 4000])], "k string, i long, lag long")
    assert [r.is_paused for r in telemetry.pressure(rows, "k", ["i"], "lag").orderBy("i").collect()] == [False, True, True, False, False]


def test_lineage(spark):
    rec = spark.createDataFrame([("c", ["a", "b"], 1.0), ("d", ["c"], 2.0), ("d", ["c"], 3.0)], "split_id string, parent_ids array<string>, timestamp double")
    e = lineage.edges(rec)
    assert {(r.parent, r.child) for r in e.collect()} == {("a", "c"), ("b", "c"), ("c", "d")}
    assert {r.split: r.depth for r in lineage.depths(e).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "parent string, child string")
    assert lineage.depths(chain, 9).agg(F.max("depth")).first()[0] == 9
    with pytest.raises(RuntimeError):
        lineage.depths(chain, 4)
    with pytest.raises(RuntimeError):
        lineage.depths(chain.union(spark.createDataFrame([("9", "3")], chain.schema)), 30)
    assert {r.split_id: r.timestamp for r in lineage.nodes(rec).collect()} == {"c": 1.0, "d": 3.0}
    assert one(spark, lineage.first_set(F.lit(0), F.lit(None).cast("long"), F.lit(7))) == 7


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark)
    for t in c.tables("ns1") if "ns1" in c.namespaces() else []:
        c.drop_table("ns1", t)
    if "ns1" in c.namespaces():
        c.drop_namespace("ns1")
    c.create_namespace("ns1", {"team": "me", "odd": "it's a, b), (c", "back": "a\\b"})
    assert c.properties("ns1") == {"team": "me", "odd": "it's a, b), (c", "back": "a\\b"}
    with pytest.raises(FileExistsError):
        c.create_namespace("ns1")
    c.create_table("ns1", "t", "id int")
    c.add_column("ns1", "t", "name", "string")
    assert c.describe("ns1", "t") == {"id": "int", "name": "string"} and c.exists("ns1", "t") and c.count("ns1", "t") == 0
    with pytest.raises(RuntimeError):
        c.drop_namespace("ns1")
    with pytest.raises(ValueError):
        c.create_namespace("no good")
    with pytest.raises(ValueError):
        c.deregister("ns1", "t")
    at = str(tmp_path / "it's here")
    spark.range(7).repartition(2).write.parquet(at)
    c.register("ns1", "r", at)
    assert c.stats("ns1", "r") == {"n_rows": 7, "n_files": 2}
    c.deregister("ns1", "r")
    assert not c.exists("ns1", "r") and spark.read.parquet(at).count() == 7
    for bad in (("ns1; x", "t"), ("ns1", "t-u")):
        with pytest.raises(ValueError):
            c.create_table(*bad, "id int")
    c.drop_table("ns1", "t")
    c.drop_namespace("ns1")
    names = spark.createDataFrame([(x,) for x in "abcde"], "n string")
    page, token = catalog.namespace_page(names, "n", 2)
    assert page == ["a", "b"] and catalog.namespace_page(names, "n", 9, token) == (["c", "d", "e"], None)
    assert catalog.index_columns(spark.createDataFrame([(1, 2, 3)], "a int, b_vector int, my_embedding_x int")) == ["b_vector", "my_embedding_x"]


def test_rate_limit_across_batches(spark):
    times = [0.0, 1.0, 5.0, 9.9, 10.0, 10.0, 21.0, 29.0, 31.0]
    rows = spark.createDataFrame([(k, F_ts, i) for k in ("a", None, "b") for i, F_ts in enumerate(times)], "k string, s double, i int").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = telemetry.rate_limited(rows, "k", "ts", 10.0, "i").collect()
        assert sorted((r.k or "", r.s) for r in got) == [(k, s) for k in ("", "a", "b") for s in (0.0, 10.0, 21.0, 31.0)]


def test_monitor(spark):
    snaps = spark.createDataFrame([("s", 1.0, 5, 5), ("s", 2.0, 10, 0), ("s", 3.0, 0, None), ("t", 1.0, None, None)], "stage string, ts double, input_records long, output_records long")
    assert {r.stage: r.ts for r in monitor.best_snapshots(snaps, "stage", "ts").collect()} == {"s": 1.0, "t": 1.0}
    lag = spark.createDataFrame([(1.0, {"0": (3,), "1": (4,)}), (0.0, {"0": (9,)}), (2.0, {}), (3.0, None)], "timestamp double, partition_metrics map<string,struct<lag:long>>")
    assert {r.timestamp: r.queue_size for r in monitor.lag_history(lag).collect()} == {1.0: 7, 2.0: 0, 3.0: 0}
    actors = [("_RaySplitPayloadStoreActor", "payload_store_j_1", "ALIVE", 1), ("_RaySplitPayloadStoreActor", "payload_store_k", "ALIVE", 2), ("StageWorker", "a:1", "ALIVE", 3), ("StageWorker", "a:2", "ALIVE", 4), ("StageWorker", "b:1", "DEAD", 5), ("StageWorker", "x", "ALIVE", 6)]
    df = spark.createDataFrame(actors, "class_name string, name string, state string, n int")
    assert {tuple(r) for r in monitor.running_jobs(df, "n").collect()} == {("j_1", 1, 2), ("k", 0, 0)} and monitor.running_jobs(df.limit(0), "n").count() == 0
    decisions = spark.createDataFrame([("s", i * 25, i != 2) for i in range(6)], "stage string, at long, changed boolean").withColumn("ts", F.timestamp_seconds("at"))
    assert [r["at"] for r in monitor.with_cooldown(decisions, "stage", "ts", F.col("changed"), 60.0).orderBy("at").collect()] == [0, 75]


def test_probes_and_images(spark):
    assert one(spark, media.boundaries_of(F.lit('{"frames":[{"pts_time":"2.5"},{"pts_time":"x"},{},{"pts_time":"1"}]}'))) == [1.0, 2.5] and one(spark, media.boundaries_of(F.lit("no json"))) == []
    facts = lambda t: tuple(one(spark, media.metadata_of(F.lit(t))))
    assert facts('{"streams":[{"width":4,"height":3,"avg_frame_rate":"30000/1001"}],"format":{"duration":"9.5"}}') == (4, 3, 30000 / 1001, 9.5)
    assert facts('{"streams":[],"format":{"duration":"N/A"}}') == (None, None, None, None)
    df = spark.createDataFrame([("a",), (None,), ("a",)], "path string")
    assert [r.j for r in media.probed(df, "path", lambda p: p * 2, "j").collect()] == ["aa", None, "aa"]
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little")
    x = [one(spark, media.image_facts(F.lit(b))) for b in (gif, b"\xff\xd8\xff\xe0", b"RIFF0000WEBP", b"")]
    assert [(i.format, i.width, i.height) for i in x] == [("GIF", 300, 7), ("JPEG", None, None), ("WEBP", None, None), (None, None, None)]
    assert tuple(one(spark, media.fitted(F.lit(4000), F.lit(3), 512))) == (512, 1) and tuple(one(spark, media.fitted(F.lit(5), F.lit(3), 512))) == (5, 3)


def test_samples_and_whole_files(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert [r.id for r in sample_rows(df, indices=[3, 7]).collect()] == [3, 7] and sample_rows(df, random=True, limit=9).distinct().count() == 9
    assert [r.id for r in sample_rows(df, row_ids=[1]).collect()] == [1]
    with pytest.raises(ValueError):
        sample_rows(df, limit=101)
    (tmp_path / "a.bin").write_bytes(b"xyz")
    rows = spark.createDataFrame([(f"{tmp_path}/a.bin",), (f"{tmp_path}/none",), (None,)], "path string")
    assert {(r.path or "")[-5:]: bytes(r.content) if r.content else None for r in remote.with_content(rows, "path").collect()} == {"a.bin": b"xyz", "/none": None, "": None}


def test_states_by_batches(spark, tmp_path):
    states = {"start": "RUNNING", "stop": "DONE"}
    write = state.keep_state(str(tmp_path), "job", ["t"], states, "kind")
    batch = lambda *rows: spark.createDataFrame(rows, "job string, t int, kind string")
    first, second = batch(("a", 1, "start"), ("b", 5, "stop"), ("c", 1, "other")), batch(("a", 2, "stop"), ("b", 3, "start"))
    for _ in range(2):  # a batch that comes again changes nothing
        write(first, 0)
    assert state.snapshots(spark, str(tmp_path)) == [0]
    for _ in range(2):
        write(second, 1)
    assert {(r.job, r.status, r.n_changes) for r in state.read_state(spark, str(tmp_path)).collect()} == {("a", "DONE", 2), ("b", "DONE", 2)}


def test_rates_and_percentiles_across_ranges(spark):
    """A hot key, a null one, ties, and more ranges than keys."""
    rows = [(k, i, float((i * 37) % 101) if i % 9 else None) for k, n in (("hot", 400), (None, 30), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): r.rate for r in telemetry.rate(df, "k", (F.col("i") * 2).cast("double"), "v", ["i"]).collect()}
    at = {(k, i): v for k, i, v in rows}
    for (k, i), v in at.items():
        before = at.get((k, i - 1))
        assert got[k, i] == (None if v is None or before is None else (v - before) / 2)
    ps = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in telemetry.exact_percentiles(df, ["k"], "v", ps).collect():
        values = sorted(v for k, _, v in rows if k == r.k and v is not None)
        assert [r[p] for p in ps] == [values[min(int(len(values) * p), len(values) - 1)] for p in ps.values()]
