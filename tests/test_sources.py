"""Sources and sinks."""

import json
from pathlib import Path

import pytest
from pyspark.sql import types as T

from refweave.sources import files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    assert files.read_jsonl(spark, path, SCHEMA).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\n\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3, "name": "z"}\n')
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "*.jsonl"), SCHEMA).collect())) == [(1, "x"), (2, None), (3, "z")]
    ordered = files.read_jsonl_ordered(spark, str(tmp_path / "*.jsonl"), SCHEMA).orderBy("_file", "_position").collect()
    assert [r["id"] for r in ordered] == [1, 2, 3]
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, SCHEMA).collect()
    good, bad = files.read_jsonl_lenient(spark, path, SCHEMA)
    assert good.count() == 1 and [r["line"] for r in bad.collect()] == ["not json"]
    out = str(tmp_path / "out")
    for _ in range(2):
        files.append_jsonl(good, out)
    assert files.read_jsonl(spark, out, SCHEMA).count() == 2


def test_report_isolates_failures(spark, tmp_path):
    nested = spark.createDataFrame([(1, [1, 2])], "id int, v array<int>")

    def broken():
        raise RuntimeError("no such input")

    log = files.Report({"good": lambda: nested, "bad": broken}).export(spark, str(tmp_path))
    assert {(r["artifact"], r["status"]) for r in log.collect()} == {("good", "written"), ("bad", "failed")}
    assert spark.read.option("header", True).csv(str(tmp_path / "good.csv")).first()["v"] == "[1,2]"
    assert "no such input" in spark.read.option("header", True).csv(str(tmp_path / "export_failures.csv")).first()["message"]


def test_typed_csv_and_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,d,b,s\n3.7,1.5,Yes,a\n,oops,,\n")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("s", T.StringType()), T.StructField("gone", T.LongType())])
    rows = [tuple(r) for r in files.read_csv_typed(spark, str(tmp_path / "x.csv"), schema).collect()]
    assert rows in ([(3, 1.5, True, "a", 0), (0, 0.0, False, "", 0)], [(4, 1.5, True, "a", 0), (0, 0.0, False, "", 0)])
    df = spark.createDataFrame([("a_b", 1)], "k string, v int")
    assert files.markdown(df) == "| k | v |\n| --- | --- |\n| a_b | 1 |" and "a\\_b & 1" in files.latex(df)


def test_state_and_settings(spark, tmp_path):
    store = files.KeyValueStore(spark, str(tmp_path / "kv"))
    assert store.latest().count() == 0
    store.save(spark.createDataFrame([("n", "k", "1")], "namespace string, key string, value string"))
    store.save(spark.createDataFrame([("n", "k", "2")], "namespace string, key string, value string"))
    assert [r["value"] for r in store.latest().collect()] == ["2"]
    assert files.Settings.from_env({"REFWEAVE_MAX_DEPTH": "3"}).max_depth == 3 and files.Settings.from_env({}).seed == 42
    (tmp_path / "there").write_text("x")
    assert files.missing_inputs(spark, str(tmp_path), ["there", "not"]) == ["not"]
    assert {r["check"] for r in files.preflight(spark, str(tmp_path), ["there"]).collect()} == {"inputs", "yaml"}
    obs = spark.createDataFrame([("a", "v1", "tag", "x", 1), ("a", "v1", "tag", "y", 2), ("a", "v1", "tag", None, 3)], "action_id string, ref_name string, ref_type string, sha string, ingest_seq long")
    assert [r["sha"] for r in files.ref_states(obs).collect()] == ["y"]


def test_range_search(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("".join(json.dumps({"stars": i % 97, "n": i}) + "\n" for i in range(1000)))
    assert files.bisect_ranges(lambda a, b: b - a + 1, 0, 99, 30) == [(0, 24), (25, 49), (50, 74), (75, 99)]
    spark.dataSource.register(files.RangeSearch)
    df = spark.read.format("range_search").options(path=str(path), column="stars", low="0", high="200", most="150").load()
    assert df.count() == 1000 and df.rdd.getNumPartitions() >= 7
    assert df.where("value >= 90").count() == sum(i % 97 >= 90 for i in range(1000))
    assert {json.loads(r["record"])["n"] for r in df.collect()} == set(range(1000))


def test_resumption_and_reference_state(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "unit string")
    states = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "failed")], "unit string, status string")
    left = files.pending(units, states, spark.createDataFrame([("a",), ("c",)], "unit string"))
    assert {tuple(r) for r in left.collect()} == {("b", "completed"), ("c", "failed"), ("d", "new")}
    wanted = spark.createDataFrame([("x", "v1", "tag"), ("x", "v2", "tag"), ("x", "main", "branch"), ("y", "v1", "tag")], "action_id string, ref_name string, ref_type string")
    own = spark.createDataFrame([("x", "v1", "tag", "new")], "action_id string, ref_name string, ref_type string, sha string")
    old = spark.createDataFrame([("x", "v1", "old"), ("x", "v2", "old"), ("x", "main", "old")], "action_id string, tag_name string, sha string")
    got = {(r["action_id"], r["ref_name"]): r["sha"] for r in files.load_ref_state(wanted, own, old).collect()}
    assert got == {("x", "v1"): "new", ("x", "v2"): "old", ("x", "main"): None, ("y", "v1"): None}


def test_csv_keeps_blanks_quotes_and_lines(spark, tmp_path):
    rows = [(" a ", 1), ('say "x", y', 2), ("two\nlines", 3), ("", 4)]
    files.write_csv(spark.createDataFrame(rows, "s string, n long"), str(tmp_path / "x.csv"))
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])
    assert sorted(map(tuple, files.read_csv_typed(spark, str(tmp_path / "x.csv"), schema).collect()), key=lambda r: r[1]) == rows


def test_intermediates_follow_the_tables(spark, tmp_path):
    """A table written anew within a session is read anew."""
    from refweave.plans import domain

    def write(n):
        spark.range(n).selectExpr("id as repo_id").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))

    make = lambda: spark.read.parquet(str(tmp_path / "t.parquet"))
    write(3)
    assert domain.once(spark, str(tmp_path), "t", make).count() == 3 and domain.once(spark, str(tmp_path), "t", make).count() == 3
    import time

    time.sleep(1.1)
    write(5)
    assert domain.once(spark, str(tmp_path), "t", make).count() == 5


def test_bars(spark):
    from xml.etree import ElementTree

    df = spark.createDataFrame([("a<b", 4.0), (None, 2.0), ("none", None), ("less", -1.0)], "l string, v double")
    root = ElementTree.fromstring(files.svg_bars(df, "l", "v"))
    widths = [float(r.get("width")) for r in root.iter("{http://www.w3.org/2000/svg}rect")]
    assert widths == [340.0, 170.0, 0.0, 0.0] and ElementTree.fromstring(files.svg_bars(df.limit(0), "l", "v")) is not None


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs of one scheduled stream: the second one writes only what came since."""
    from refweave.streaming import streams

    source = str(tmp_path / "in")
    for first, n in ((0, 3), (3, 5)):
        spark.range(first, n).write.mode("append").parquet(source)
        q = streams.start(spark.readStream.schema("id long").parquet(source), str(tmp_path / "run"), "1 second")
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()) == [0, 1, 2, 3, 4]


def test_what_was_shuffled_for_intermediates_is_deleted(spark):
    """Of five shuffles none but the last one's files stay."""
    import gc
    import time

    from refweave.session import materialize

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: str(disk.getAllFiles().mkString(" ")).count("/shuffle_")
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(3)
    before, kept = held(), []
    for i in range(5):
        kept.append(materialize(spark.range(200_000).selectExpr(f"id % 5000 + {i} as k").groupBy("k").count()))
        if not i:
            one = held() - before
    until = time.time() + 10
    while held() > before + one and time.time() < until:
        time.sleep(0.2)
    assert held() <= before + one and [k.count() for k in kept] == [5000] * 5


def test_kept_edges_are_not_shuffled_again(spark):
    from refweave.plans import domain as D
    from refweave.plans import graph_metrics as G

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no data")
    D.forget()
    fresh = sorted(map(str, D.scoped(spark, folder).collect()))
    G.ref_risk_by_workflow(spark, folder)
    again = D.scoped(spark, folder)
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString() and sorted(map(str, again.collect())) == fresh
