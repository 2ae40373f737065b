"""Readers, the store, the dataset's checks, and streams against their batch forms."""

import pytest

from ocularis import dataset, schema
from ocularis.errors import SchemaError
from ocularis.sources import importers, store
from ocularis.streaming import live


def test_schema(spark):
    assert len(schema.table_names()) == 16
    df = schema.standardize(spark.createDataFrame([("r", 1)], "recording_id string, extra int"), "recordings")
    assert df.columns[:2] == ["recording_id", "participant_id"] and df.columns[-1] == "extra"
    with pytest.raises(SchemaError):
        schema.schema_of("nothing")


def test_dataset_issues(spark):
    recordings = spark.createDataFrame([("r1",), ("r1",)], "recording_id string")
    samples = spark.createDataFrame([("r1", "s1", 0.0), ("r2", "s2", float("nan"))], "recording_id string, sample_id string, timestamp_seconds double")
    data = dataset.new_dataset(spark, recordings=recordings, gaze_samples=samples)
    found = {(r["code"], r["table"]) for r in dataset.validation_issues(data).collect()}
    assert {("duplicate_key", "recordings"), ("orphan_reference", "gaze_samples"), ("missing_time", "gaze_samples")} <= found


def test_delimited_and_detection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIME,FPOGX,FPOGY,USER\n0.0,0.5,0.5,p1\n0.1,bad,0.6,p1\n")
    assert importers.detect_format(["TIME", "FPOGX", "FPOGY"]) == "gazepoint"
    got = importers.read_export(spark, str(tmp_path / "a.csv")).orderBy("timestamp_native").collect()
    assert [r["gaze_x"] for r in got] == [0.5, None] and got[0]["participant_id"] == "p1"


def test_asc(spark, tmp_path):
    (tmp_path / "a.asc").write_text("** x\n1000 10.5 20.5 900.0 ...\nMSG 1001 TRIAL_START 1\nEFIX R 1000 1010 10 15.0 20.0 900\n")
    got = importers.read_eyelink_asc(spark, str(tmp_path / "a.asc"))
    assert got["gaze_samples"].first()["timestamp_seconds"] == 1.0
    assert got["events"].first()["event_name"] == "TRIAL_START 1" and got["episodes"].first()["episode_type"] == "fixation"


def test_store_reads_only_what_it_needs(spark, tmp_path):
    samples = spark.createDataFrame([(f"r{k % 3}", f"s{k}", float(k)) for k in range(9)], "recording_id string, sample_id string, timestamp_seconds double")
    store.write_store(dataset.Dataset({"gaze_samples": samples}), str(tmp_path))
    got = store.query_store(spark, str(tmp_path), "gaze_samples", {"recording_id": ["r1"]}, ["sample_id"])
    assert {r[0] for r in got.collect()} == {"s1", "s4", "s7"}


def test_sliding_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 AS g, cast(id AS double) AS v FROM range(600)")
    rows.write.parquet(f"{tmp_path}/in")
    make = lambda df: live.sliding_windows(df, "ts", ["g"], "v", "2 minutes", "1 minute", "10 minutes")
    q = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("slides").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("slides").collect())) == sorted(map(tuple, make(spark.read.parquet(f"{tmp_path}/in")).collect()))
