"""Folders, fingerprints, round trips and redaction of datasets, vendor readers, and streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from ocularis import dataset
from ocularis.errors import SchemaError
from ocularis.operators import irt
from ocularis.sources import canonical, importers
from ocularis.streaming import live


@pytest.fixture(scope="module")
def data(spark):
    recordings = spark.createDataFrame([("r1", "anna"), ("r2", "anna"), ("r3", None)], "recording_id string, participant_id string")
    samples = spark.createDataFrame([(f"r{k % 3 + 1}", f"s{k}", k / 7, None if k == 4 else k * 1.5) for k in range(20)], "recording_id string, sample_id string, timestamp_seconds double, gaze_x double")
    return dataset.new_dataset(spark, recordings=recordings, gaze_samples=samples)


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_roundtrip(data, tmp_path, format):
    some = dataset.Dataset({n: data[n] for n in ("recordings", "gaze_samples")})
    got = {r["table"]: (r["n_left"], r["n_right"], r["status"]) for r in canonical.roundtrip_dataset(some, f"{tmp_path}/d", format).collect()}
    assert got["recordings"] == (3, 3, "equal") and got["gaze_samples"] == (20, 20, "equal")


def test_fingerprints_ignore_order_and_see_values(data):
    moved = data.with_table("gaze_samples", data["gaze_samples"].repartition(5).orderBy(F.desc("sample_id")))
    changed = data.with_table("gaze_samples", data["gaze_samples"].withColumn("gaze_x", F.when(F.col("sample_id") == "s3", 0.0).otherwise(F.col("gaze_x"))))
    shorter = data.with_table("recordings", data["recordings"].limit(2))
    status = lambda other: {r["table"]: r["status"] for r in canonical.compare_datasets(data, other).collect() if r["status"] != "equal"}
    assert status(moved) == {} and status(changed) == {"gaze_samples": "values_differ"} and status(shorter) == {"recordings": "rows_differ"}


def test_anonymized_ids_are_equal_where_they_were(data):
    ids = [r["participant_id"] for r in canonical.anonymize_dataset(data, "salt")["recordings"].orderBy("recording_id").collect()]
    other = canonical.anonymize_dataset(data, "pepper")["recordings"].orderBy("recording_id").first()["participant_id"]
    assert ids[0] == ids[1] and ids[2] is None and "anna" not in ids and ids[0] != other


def test_coverage(data):
    got = {(r["table"], r["field"]): r["filled_fraction"] for r in canonical.schema_coverage(data).collect()}
    assert got["gaze_samples", "gaze_x"] == 0.95 and got["recordings", "participant_id"] == pytest.approx(2 / 3) and got["streams", "stream_id"] is None
    summary = {r["table"]: r["n_filled"] for r in canonical.schema_coverage_summary(canonical.schema_coverage(data)).collect()}
    assert summary["recordings"] == 2 and summary["streams"] == 0


def test_remapped_recordings(data, spark):
    renamed = canonical.remap_recording_ids(data, spark.createDataFrame([("r1", "first")], "recording_id string, new_id string"))
    assert {r["recording_id"] for r in renamed["gaze_samples"].collect()} == {"first", "r2", "r3"} and renamed["gaze_samples"].columns == data["gaze_samples"].columns


def test_only_asked_tables_are_read(data, spark, tmp_path):
    canonical.write_dataset(data, f"{tmp_path}/d")
    some = canonical.read_dataset(spark, f"{tmp_path}/d", ["recordings"])
    assert some["recordings"].count() == 3 and some["gaze_samples"].count() == 0
    with pytest.raises(SchemaError):
        canonical.read_dataset(spark, f"{tmp_path}/d", ["nothing"])


def test_vendor_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Recording timestamp\tGaze point X\tGaze point Y\n2000000\t10\t20\n")
    (tmp_path / "n.csv").write_text("timestamp [ns],gaze x [px],gaze y [px]\n3000000000,1,2\n")
    (tmp_path / "g.csv").write_text("TIME,FPOGX,FPOGY,MEDIA_ID\n0.5,0.1,0.2,m\n")
    assert importers.read_tobii(spark, str(tmp_path / "t.tsv")).first()["timestamp_seconds"] == pytest.approx(2.0)
    assert importers.read_export(spark, str(tmp_path / "n.csv")).first()["timestamp_seconds"] == pytest.approx(3.0)
    assert importers.read_gazepoint(spark, str(tmp_path / "g.csv")).first()["stimulus_id"] == "m"
    assert importers.detect_format(["Recording timestamp", "Gaze point X"]) == "tobii"
    got = importers.read_folder(spark, str(tmp_path), "generic", "g*.csv").first()
    assert got["source_file"].endswith("g.csv") and got["gaze_y"] == 0.2
    assert importers.validate_mapping(["t"], {"timestamp_native": "t", "gaze_x": "x", "odd": "t"}) == [("odd", "unknown field"), ("gaze_x", "no column x"), ("gaze_y", "missing")]


def test_gazepoint_fixations(spark, tmp_path):
    (tmp_path / "f.csv").write_text("MEDIA_ID,FPOGS,FPOGD,FPOGX,FPOGY,FPOGID,FPOGV\nm,1.0,0.1,0.5,0.5,7,1\nm,1.0,0.3,0.6,0.4,7,1\nm,1.5,0.2,0.1,0.1,8,0\nk,1.0,0.2,0.9,0.9,7,1\n")
    got = {(r["media_id"], r["fixation_id"]): (r["centroid_x"], round(r["end_time"], 6), round(r["duration_ms"], 6)) for r in importers.read_gazepoint_fixations(spark, str(tmp_path / "f.csv")).collect()}
    assert got == {("m", 7.0): (0.6, 1.3, 300.0), ("k", 7.0): (0.9, 1.2, 200.0)}


def test_session_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 7 + CASE WHEN id % 10 = 0 THEN 400 ELSE 0 END) AS ts, id % 2 AS g, CASE WHEN id % 5 < 4 THEN 'a' END AS aoi FROM range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    make = lambda df: live.session_visits(df, "ts", ["g"], "aoi", "30 seconds", "10 minutes")
    q = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("visits").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, make(spark.read.parquet(f"{tmp_path}/in")).collect()))
    assert sorted(map(tuple, spark.table("visits").collect())) == want and len(want) > 4


def test_streamed_scores_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(p, i, 0.8 + 0.1 * i, 0.4 * i - 1, (p * i) % 3 % 2) for p in range(4) for i in range(6)], "person int, item_id int, a double, b double, response int")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.streaming_eap(stream, "person").writeStream.format("memory").queryName("scores").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    final = {r["person"]: r for r in spark.table("scores").orderBy("n_items").collect()}
    items = rows.select("item_id", "a", "b").distinct()
    for r in irt.eap_scores(rows.select("person", "item_id", "response"), items, "person").collect():
        assert final[r["person"]]["n_items"] == 6 and final[r["person"]]["theta"] == pytest.approx(r["theta"]) and final[r["person"]]["se"] == pytest.approx(r["se"])
