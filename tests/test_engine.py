"""One run writes every artifact; one that breaks leaves the others alone."""

import os

import pytest
from pyspark.sql import types as T

from refweave import engine
from refweave.sources import files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no data")


def test_one_broken_artifact_of_many(spark, tmp_path):
    def broken(s, d):
        raise RuntimeError("no such input")

    names = engine.artifacts()
    assert len(names) == 52 and len(engine.SUMMARIES) >= 12
    log = engine.run(spark, DATA, str(tmp_path), ("json",), names | {"blast_radius": broken}).collect()
    assert {r["artifact"] for r in log if r["status"] == "failed"} == {"blast_radius"}
    assert sum(r["status"] == "written" for r in log) == 51
    schema = T.StructType([T.StructField("action_id", T.StringType()), T.StructField("usage_count", T.LongType())])
    again = files.read_artifact(spark, str(tmp_path), "ref_risk_by_action", schema)
    assert again.count() == spark.read.parquet(f"{DATA}/actions.parquet").select("action_id").distinct().count()
    assert files.read_artifact(spark, str(tmp_path), "blast_radius", schema).count() == 0
    report = spark.read.json(str(tmp_path / "report.json"))
    assert {r["artifact"] for r in report.collect()} == set(engine.SUMMARIES)


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="repositories.parquet"):
        engine.run(spark, str(tmp_path), str(tmp_path / "out"))
