"""Exports of several vendors, written small and read back."""

import pytest

from ocularis.errors import SchemaError
from ocularis.sources import importers, vendors


def test_smi(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        "## [BeGaze]\n## Version:\t3.7\n## Sample Rate:\t250\nTime\tType\tTrial\tL POR X [px]\tL POR Y [px]\tL Pupil Diameter [mm]\tR POR X [px]\n"
        "1000000\tSMP\t1\t10.5\t20.5\t3.1\t11\n1002000\tMSG\t1\t# Message: face one.jpg\n1004000\tSMP\t1\t\tbad\t3.2\t12\nlate\tSMP\t1\t1\t1\t1\t1\n\tSMP\t1\t1\t1\t1\t1\n"
    )
    got = vendors.read_smi(spark, str(tmp_path / "a.txt"))
    rows = got["gaze_samples"].orderBy("timestamp_native").collect()
    assert [(r["timestamp_seconds"], r["gaze_x"], r["gaze_y"], r["pupil_left"], r["right_x"], r["trial_id"]) for r in rows] == [(1.0, 10.5, 20.5, 3.1, 11.0, "1"), (pytest.approx(1.004), None, None, 3.2, 12.0, "1")]
    assert [(r["timestamp_seconds"], r["event_name"]) for r in got["events"].collect()] == [(pytest.approx(1.002), "face one.jpg")]
    assert sorted(r["reason"] for r in got["rejected"].collect()) == ["no time", "time is not a number"]
    (tmp_path / "b.txt").write_text("Time\tx\n1\t2\n")
    with pytest.raises(SchemaError, match="gaze_y"):
        vendors.read_smi(spark, str(tmp_path / "b.txt"))
    with pytest.raises(SchemaError, match="IDF"):
        vendors.read_smi(spark, "x.idf")


def test_eyelink_report(spark, tmp_path):
    (tmp_path / "r.xls").write_text("RECORDING_SESSION_LABEL\tTRIAL_INDEX\tTIMESTAMP\tRIGHT_GAZE_X\tRIGHT_GAZE_Y\tRIGHT_PUPIL_SIZE\tSAMPLE_MESSAGE\ns1\t1\t1000\t10\t20\t900\t.\ns1\t1\t1002\t.\t.\t.\tTARGET_ON\ns1\t1\t.\t1\t1\t1\t.\n")
    got = vendors.read_eyelink_report(spark, str(tmp_path / "r.xls"))
    assert [(r["recording_id"], r["trial_id"], r["timestamp_seconds"], r["gaze_x"], r["pupil_diameter"]) for r in got["gaze_samples"].orderBy("timestamp_native").collect()] == [("s1", "1", 1.0, 10.0, 900.0), ("s1", "1", 1.002, None, None)]
    assert [(r["timestamp_seconds"], r["event_name"]) for r in got["events"].collect()] == [(1.002, "TARGET_ON")]
    assert got["rejected"].count() == 1


def test_pupil_core(spark, tmp_path):
    with pytest.raises(SchemaError, match="gaze_positions"):
        vendors.read_pupil_core(spark, str(tmp_path))
    (tmp_path / "gaze_positions.csv").write_text("gaze_timestamp,world_index,confidence,norm_pos_x,norm_pos_y\n5.0,0,0.9,0.5,0.25\nx,0,0.9,0.5,0.25\n")
    assert set(vendors.read_pupil_core(spark, str(tmp_path))) == {"gaze_samples", "rejected"}
    (tmp_path / "pupil_positions.csv").write_text("pupil_timestamp,eye_id,confidence,diameter,diameter_3d\n5.0,0,0.9,40,3.5\n5.1,1,0.9,41,\n")
    (tmp_path / "fixations.csv").write_text("id,start_timestamp,duration,norm_pos_x,norm_pos_y,confidence\n7,5.0,250,0.5,0.5,1\n")
    got = vendors.read_pupil_core(spark, str(tmp_path))
    assert [(r["gaze_x"], r["gaze_y"], r["timestamp_seconds"]) for r in got["gaze_samples"].collect()] == [(0.5, 0.25, 5.0)]
    assert sorted((r["eye"], r["pupil_diameter"]) for r in got["pupil_samples"].collect()) == [("left", None), ("right", 3.5)]
    assert [(r["fixation_id"], r["start_time"], r["end_time"]) for r in got["episodes"].collect()] == [("7", 5.0, 5.25)]
    assert got["rejected"].count() == 1


def test_pairs_of_a_folder(spark, tmp_path):
    for name in ("User 1_all_gaze.csv", "User 1_fixations.csv", "User 2_all_gaze.CSV", "sub/User 3_fixations.csv", "User 4_all_gaze.csv", "sub/User 4_all_gaze.csv", "data_summary.csv", "notes.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a,b\n")
    pairs = vendors.pair_exports(spark, str(tmp_path))
    assert pairs.count() == 7 and pairs.filter("export_type = 'summary'").first()["pair"] == "summary"
    got = {r["pair"]: r["status"] for r in vendors.audit_pairs(pairs).collect()}
    names = {k.replace("%20", " "): v for k, v in got.items()}
    assert names == {"User 1": "complete", "User 2": "no_fixations", "User 3": "no_gaze", "User 4": "duplicate"}


def test_readers_by_mapping(spark, tmp_path):
    (tmp_path / "n.csv").write_text("timestamp [ns],gaze x [px],gaze y [px]\n1500000000,3,4\n")
    got = importers.read_pupil_neon(spark, str(tmp_path / "n.csv")).first()
    assert (got["timestamp_seconds"], got["gaze_x"], got["gaze_y"]) == (1.5, 3.0, 4.0)
    importers.register_adapter(importers.Adapter("mine", lambda c: 0.0, importers.read_delimited, 5))
    with pytest.raises(ValueError, match="exists"):
        importers.register_adapter(importers.Adapter("mine", lambda c: 0.0, importers.read_delimited, 5))
    assert "mine" in {r["name"] for r in importers.supported_formats(spark).collect()}
    importers.unregister_adapter("mine")
    assert "mine" not in {r["name"] for r in importers.supported_formats(spark).collect()}
    assert importers.infer_mapping(["Time", "X", "Y", "Pupil"]) == {"timestamp_native": "Time", "gaze_x": "X", "gaze_y": "Y", "pupil_diameter": "Pupil"}
