"""Reading and writing round trips."""

import json

import pytest
from pyspark.sql import functions as F

from cadencia.sources import files as S
from cadencia.sources import rules as R
from cadencia.sources import sinks as K


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "walk.Trial.enf").write_text("[Node]\nTYPE=TRIAL\n\nSUBJECTS=Anna, bob\nFP2=Left\nFP1=Right\nDESCRIPTION=walk=fast\nDESCRIPTION=second\n")
    (tmp_path / "a" / "REC.C3D").write_bytes(b"x")
    (tmp_path / "s.mp").write_text("$Bodymass=67.2\n$Height=1730\n!x=1\n")
    (tmp_path / "ik.mot").write_text("Coordinates\nnRows=2\nendheader\ntime  hip_R   knee\n0.0 1.5\t2\n0.01  1.6 nan\n")
    (tmp_path / "m.trc").write_text("PathFileType\t4\nDataRate\n100\nFrame#\tTime\tLHEE\t\t\tRHEE\t\t\n\t\tX1\tY1\tZ1\tX2\tY2\tZ2\n\n1\t0.0\t1\t2\t3\t4\t5\t6\n2\t0.01\t7\t8\t9\t10\t\t12\n")
    return str(tmp_path)


def test_scan(spark, folder):
    got = S.scan_files(spark, folder, ".c3d").collect()
    assert [(r.basename, r.stem, r.ext, r.length) for r in got] == [("REC.C3D", "REC", ".c3d", 1)]


def test_sidecar(spark, folder):
    r = S.sidecar_facts(S.read_key_values(spark, folder, glob="*.enf")).first()
    assert r.description == "walk=fast" and r.subjects == ["anna", "bob"]
    assert [(p.plate, p.side) for p in r.plates] == [("FP1", "Right"), ("FP2", "Left")]


def test_params(spark, folder):
    got = {r.key: r.value for r in S.read_dollar_params(spark, folder, glob="*.mp").collect()}
    assert got == {"Bodymass": "67.2", "Height": "1730"}


def test_sim_table(spark, folder):
    got = S.read_sim_tables(spark, folder, ["HIP_r"], glob="*.mot").orderBy("t").collect()
    assert [(r.t, r.column, r.v) for r in got] == [(0.0, "hip_R", 1.5), (0.01, "hip_R", 1.6)]
    assert S.sim_headers(spark, folder, glob="*.mot").first().columns == ["time", "hip_R", "knee"]


def test_sim_rows_of_another_width(spark, tmp_path):
    (tmp_path / "x.sto").write_text("h\nendheader\ntime\ta\tb\n0.0\t1\t2\n0.1\t3\n0.2\t5\t6\n")
    got = S.read_sim_tables(spark, str(tmp_path), ["a"], with_status=True).orderBy("t").collect()
    assert [(r.t, r.column, r.v, r.status) for r in got] == [(0.0, "a", 1.0, "ok"), (0.1, None, None, "field_count"), (0.2, "a", 5.0, "ok")]
    assert S.read_sim_tables(spark, str(tmp_path)).count() == 4


def test_marker_table(spark, folder):
    got = S.read_marker_tables(spark, folder, glob="*.trc").where("frame = 2").collect()
    assert sorted((r.marker, r.comp, r.v) for r in got) == [("LHEE", "x", 7), ("LHEE", "y", 8), ("LHEE", "z", 9), ("RHEE", "x", 10), ("RHEE", "z", 12)]


def test_document(spark):
    doc = {"trial_id": "t", "events": {"event_times": [1.0], "event_labels": [" L "], "kinetic": [1]}, "analog": {"time": [0.0, 0.1], "channels": {"E": [1.0, 2.0]}}}
    schema = "trial_id string, events struct<event_times: array<double>, event_labels: array<string>, kinetic: array<int>>, analog struct<time: array<double>, channels: map<string, array<double>>>"
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", schema).alias("d")).select("d.*")
    assert tuple(S.flatten_events(df).first()) == ("t", 0, 1.0, "L", True)
    assert [(r.channel, r.t, r.v) for r in S.flatten_channels(df, "analog").orderBy("t").collect()] == [("E", 0.0, 1.0), ("E", 0.1, 2.0)]
    assert ("analog.channels{}[]", "double") in K.schema_tree(df)


def test_rules(spark, tmp_path):
    good = {"ik": {"marker_error_RMS_max": 0.02, "marker_error_max_max": 0.04}, "so": {"force_rms_max_pcGRF": 6, "force_max_max_pcGRF": 20, "moment_rms_max": 50, "moment_max_max": 75, "so_ms_tol": 100}}
    p = tmp_path / "r.json"
    p.write_text(json.dumps(good))
    assert R.qc_rules(R.load_rules(spark, str(p))).force_rms == ("pcGRF", 6.0)
    two = {**good, "so": {**good["so"], "force_rms_max": 10}}
    with pytest.raises(ValueError):
        R.qc_rules(two)
    w = R.whitelist_rules({"point": ["LHEE"], "analog": "x", "extra": 1})
    assert w["analog"] == [] and w["meta"] == [] and w["extra"] == 1
    assert [tuple(r) for r in R.label_lists(spark, w).collect()] == [("point", "LHEE")]


def test_dataset_and_trial_writes(spark, tmp_path):
    root = str(tmp_path / "d")
    w = spark.createDataFrame([(1, [1.0])], "sample_id long, wave array<double>")
    K.write_dataset(w, root, "20240101_000000")
    K.write_dataset(w.withColumn("sample_id", F.lit(2).cast("long")), root, "20240102_000000")
    assert [r.sample_id for r in K.read_newest(spark, root).collect()] == [2]
    out = str(tmp_path / "t")
    t = spark.createDataFrame([("p", "t1", 1), ("p", "t2", 2)], "pid string, trial_id string, v int")
    K.write_trial_outputs(t, out)
    K.write_trial_outputs(t.where("trial_id = 't2'").withColumn("v", F.lit(9)), out, salt="v", salts=4)
    assert {r.trial_id: r.v for r in spark.read.parquet(out).collect()} == {"t1": 1, "t2": 9}
    K.write_report_tables({"a": t}, str(tmp_path / "r"), "csv")
    assert S.read_result_csv(spark, str(tmp_path / "r" / "a"), "pid string, trial_id string, v int").count() == 2


def test_audit_only_on_change(spark, tmp_path):
    cols = "pid string, trial_type string, side string, mode string, selected int, unselected int, changed int"
    c = spark.createDataFrame([("p", "W", "left", "kinetic", 3, 1, 2), ("q", "W", "left", "kinetic", 3, 1, 0)], cols)
    rows = K.audit_rows(c, c, "me", "2025-01-01T00:00:00")
    assert rows.columns == K.AUDIT_COLUMNS
    K.append_audit(rows, str(tmp_path / "a"))
    K.append_audit(rows.limit(0), str(tmp_path / "a"))
    got = spark.read.parquet(str(tmp_path / "a")).collect()
    assert len(got) == 1 and got[0].left_kinetic_changed == 2 and got[0].right_kinetic_sel == 0


def test_names(spark):
    df = spark.createDataFrame([("x_splitCycles.mat",), ("x_CHECK.mat",)], "n string")
    assert [r[0] for r in df.select(K.check_name("n")).collect()] == ["x_splitCycles_check.mat", "x_CHECK.mat"]
    assert df.select(K.stage_name("n", "osim")).first()[0] == "x_splitCycles_osim.mat"


def test_status(spark):
    df = S.with_status(spark.range(3), {"not zero": F.col("id") > 0})
    good, bad = S.split_status(df)
    assert good.count() == 2 and bad.first().message == "not zero"
