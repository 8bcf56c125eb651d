"""Readers and writers on small files with the awkward cases in them."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from trialspark import schema as SC
from trialspark.operators.fleet import stale_documents
from trialspark.sources import records as R, sinks as K


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(text, bytes):
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def test_trials_from_nested_folders(spark, tmp_path):
    write(tmp_path / "w/vidA/segment_03/trials.jsonl", '\n{"crf": "31", "s_f": 0.5, "encode_ok": "True"}\nnot json\n[{"crf": 1}]\n"text"\n{"crf": 28.0, "video_stem": "own", "segment_index": 7}\n{"crf": 30\n')
    rows = R.read_trials(spark, str(tmp_path / "w")).orderBy("crf").collect()
    assert [(r.video_stem, r.segment_index, r.crf, r.s_f, r.encode_ok) for r in rows] == [("own", 7, 28, None, None), ("vidA", 3, 31, 0.5, True)]


def test_flat_file_is_preferred(spark, tmp_path):
    write(tmp_path / "w/vidA/all_trials.jsonl", '{"crf": 20, "segment_index": 1}\n')
    write(tmp_path / "w/vidA/segment_03/trials.jsonl", '{"crf": 31}\n')
    rows = R.read_trials(spark, str(tmp_path / "w")).collect()
    assert [(r.video_stem, r.crf) for r in rows] == [("vidA", 20)]


def test_documents_skip_unreadable_files(spark, tmp_path):
    write(tmp_path / "d/a.json", '{\n "job_id": "v1",\n "best": {"crf": 30}\n}')
    write(tmp_path / "d/b.json", '{"job_id": ')
    assert [(r.job_id, r.best.crf) for r in R.read_documents(spark, str(tmp_path / "d"), SC.RESULT_DOC).collect()] == [("v1", 30.0)]


def test_sweep_falls_back_to_csv(spark, tmp_path):
    csv = write(tmp_path / "results.csv", "crf,aq_strength,s_f,compression_ratio,vmaf_neg,gates_ok,encode_ok\n30,1.00004,0.5,5,90,True,True\n31,1,x,5,90,True,True\n32,1,0.5,5,90,False,False\n33,1,0.5,5,90,False,\n")
    got = R.read_sweep(spark, str(tmp_path / "trials.jsonl"), csv).orderBy("crf").collect()
    assert [(r.crf, r.aq_strength, r.gates_ok) for r in got] == [(30, 1.0, True), (33, 1.0, False)]
    js = write(tmp_path / "trials.jsonl", '{"crf": 40, "aq_strength": "1.2", "s_f": 1, "compression_ratio": 2, "vmaf_neg": 3}\n')
    assert [r.crf for r in R.read_sweep(spark, js, csv).collect()] == [40]
    with pytest.raises(FileNotFoundError):
        R.read_sweep(spark, str(tmp_path / "no"), str(tmp_path / "none"))


def test_log_lines_stay_when_parallelism_changes(spark, tmp_path):
    big = write(tmp_path / "c.log", "\n".join(f"line {i} " + "y" * (i % 70) for i in range(50_000)) + "\n")
    key = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(key, "4")
        df = R.read_log(spark, [big])
        spark.conf.set(key, "6")
        assert df.count() == 50_000
        assert df.filter("value not like concat('line ', line - 1, ' %')").count() == 0
    finally:
        spark.conf.unset(key)


def test_log_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    big = write(tmp_path / "a.log", "\n".join(lines) + "\n")
    other = write(tmp_path / "b.log", b"one\r\nbad \xff byte\n\nlast")
    keys = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = R.read_log(spark, [big, other])
        assert spark.read.text(big).rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in rows}
    assert len(got) == len(rows) == 3004
    assert all(got["a.log", i + 1] == v for i, v in enumerate(lines))
    assert [got["b.log", i] for i in (1, 2, 3, 4)] == ["one", "bad � byte", "", "last"]


def test_job_manifest(spark):
    doc = {"work_dir": "work", "vmaf_threshold": 85, "jobs": [
        {"id": "a b", "input_path": "/x.mp4", "output_path": "./o/85/y.mp4"}, {"input_path": "/z.mp4", "crf": 30}, {"id": "r", "input_url": "u", "upload_url": "p"}]}
    req = spark.createDataFrame([(json.dumps(doc),)], "d string").select(F.from_json("d", SC.REQUEST).alias("r")).select("r.*")
    rows = R.job_manifest(req).orderBy("job_pos").collect()
    assert [(r.job_id, r.job_dir, r.input_path, r.output_path) for r in rows] == [
        ("a b", "work/85/a_b", "/x.mp4", "o/85/y.mp4"), ("video-2", "work/85/video-2", "/z.mp4", "output/fleet/85/video-2.mp4"),
        ("r", "work/85/r", "work/85/r/input.mp4", "work/85/r/output.mp4")]


def test_clip_listing(spark, tmp_path):
    for n in ("seg01_f30-90.mp4", "seg00_f0-30.mp4", "seg02_f90-90.mp4", "other.mp4"):
        write(tmp_path / "c/vidA" / n, "data")
    got = [(r.video_stem, r.clip_index, r.start_frame, r.end_frame, r.frame_count, r.length) for r in R.list_clips(spark, str(tmp_path / "c")).collect()]
    assert got == [("vidA", 0, 0, 30, 30, 4), ("vidA", 1, 30, 90, 60, 4)]


def test_stale_documents(spark):
    def doc(i, detector="content", samples=16, **seg):
        return (i, json.dumps({"meta": {"samples_per_segment": samples, "scene_detect": {"detector": detector}}, "segments": [{"si": 1, "ti": 1, "luma_mean": 1, "sat_mean": 1, **seg}]}))
    rows = [doc(1), doc(2, "adaptive"), doc(3, samples=8), doc(4, ti=None), (5, "{}")]
    d = spark.createDataFrame(rows, "id int, d string").select("id", F.from_json("d", SC.FEATURE_DOC).alias("x")).select("id", "x.*")
    assert sorted(r.id for r in stale_documents(d).collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in stale_documents(d, "adapt").collect()) == [1, 3, 4, 5]


SCHEMA = "run_id string, job_id string, created_at double, crf double"


def table(spark, path):
    return K.UpsertTable(spark, str(path), ["created_at", "crf"], buckets=4)


def test_upsert(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert t.read(schema).count() == 0
    t.upsert(spark.createDataFrame([("r", "a", 1.0, 30.0), ("r", "b", 5.0, 31.0), (None, "a", 1.0, 9.0)], SCHEMA))
    t.upsert(spark.createDataFrame([("r", "a", 2.0, 28.0), ("r", "b", 4.0, 99.0), (None, "a", 1.0, 9.0), ("q", "a", 1.0, 7.0)], SCHEMA))
    got = sorted(map(tuple, t.read(schema).collect()), key=str)
    assert got == sorted([("r", "a", 2.0, 28.0), ("r", "b", 5.0, 31.0), ("q", "a", 1.0, 7.0), (None, "a", 1.0, 9.0), (None, "a", 1.0, 9.0)], key=str)


def test_repeated_batch_is_skipped(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    rows = spark.createDataFrame([(None, "a", 1.0, 30.0)], SCHEMA)
    assert t.upsert(rows, 0) and not t.upsert(rows, 0) and t.upsert(rows, 1)
    assert t.read(rows.schema).count() == 2


def test_upsert_survives_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    rows = spark.createDataFrame([("r", "a", 1.0, 30.0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(K.files, "create_small", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            t.upsert(rows, 0)
    assert t.read(rows.schema).count() == 0
    assert t.upsert(rows, 0) and t.read(rows.schema).count() == 1


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    a, b = (spark.createDataFrame([("r", k, 1.0, 30.0)], SCHEMA) for k in "ab")
    create = K.files.create_small

    def second_first(*args):
        monkeypatch.setattr(K.files, "create_small", create)
        two.upsert(b)
        return create(*args)

    monkeypatch.setattr(K.files, "create_small", second_first)
    one.upsert(a)
    assert sorted(r.job_id for r in one.read(a.schema).collect()) == ["a", "b"]


def test_a_large_first_batch_gets_its_buckets(spark, tmp_path):
    t = K.UpsertTable(spark, str(tmp_path / "t"), ["created_at", "crf"], buckets=1, bucket_rows=10)
    rows = spark.range(100).selectExpr("'r' AS run_id", "cast(id AS string) AS job_id", "'1' AS created_at", "cast(id AS double) AS crf")
    assert t.upsert(rows, 0) and len(t.parts()) > 4
    assert t.read(rows.schema).count() == 100


def test_buckets_follow_the_size(spark, tmp_path):
    t = K.UpsertTable(spark, str(tmp_path / "t"), ["created_at", "crf"], buckets=1, bucket_rows=10)
    rows = spark.range(100).selectExpr("'r' AS run_id", "CAST(id AS STRING) AS job_id", "1D AS created_at", "CAST(id AS DOUBLE) AS crf")
    t.upsert(rows)
    t.upsert(rows.withColumn("created_at", F.lit(2.0)))
    got = t.read(rows.schema)
    assert len(t.parts()) > 8 and got.count() == 100 and got.filter("created_at = 2").count() == 100


def test_readers_survive_odd_numbers(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps({"crf": 1e12, "aq_strength": "x"}),), (json.dumps({"crf": "27"}),)], "value string")
    assert [r.crf for r in R.parse_objects(lines, {"crf": T.IntegerType(), "aq_strength": T.DoubleType()}).collect()] == [None, 27]
    seg = tmp_path / "w" / "v" / "segment_01"
    seg.mkdir(parents=True)
    (tmp_path / "w" / "all_trials.jsonl").write_text("", encoding="utf-8")
    (seg / "trials.jsonl").write_text(json.dumps({"crf": 30}) + "\n", encoding="utf-8")
    (seg / "train_rows.jsonl").write_text(json.dumps({"crf": 99}) + "\n", encoding="utf-8")
    assert [(r.video_stem, r.segment_index, r.crf) for r in R.read_trials(spark, str(tmp_path / "w")).collect()] == [("v", 1, 30)]


def test_flatten_result(spark):
    doc = {"run_id": "r", "job_id": "v1", "uploaded": True, "best": {"crf": 30.0, "recipe": "p", "s_f": 0.5}, "features": {"motion": 0.5}}
    d = spark.createDataFrame([(json.dumps(doc),), ('{"run_id": "r"}',)], "d string").select(F.from_json("d", SC.RESULT_DOC).alias("r")).select("r.*")
    r = K.flatten_result(d).collect()
    assert len(r) == 1 and (r[0].uploaded, r[0].error, r[0].crf, r[0].recipe) == (1, "", 30.0, "p")
    assert json.loads(r[0].features_json) == {"motion": 0.5} and r[0].stage_timings_json == "{}" and json.loads(r[0].best_json)["s_f"] == 0.5


def test_import_uses_the_batch_only_for_roots_without_files(spark):
    a = spark.createDataFrame([("w1", "v1"), ("w1", "v1"), ("w1", "")], "work_root string, job_id string")
    b = spark.createDataFrame([("w1", "v9"), ("w2", "v1"), ("w2", "v1")], "work_root string, job_id string")
    rows, runs = K.import_results(a, b)
    assert sorted(map(tuple, rows.collect())) == [("w1", "v1"), ("w1", "v1"), ("w2", "v1"), ("w2", "v1")]
    assert sorted(map(tuple, runs.collect())) == [("w1", 1, 1), ("w2", 2, 2)]


def test_column_order():
    assert K.ordered_columns(["z", "b", "a", "id"], ["id", "b", "missing"]) == ["id", "b", "a", "z"]


def test_documents_share_folders(spark, tmp_path, monkeypatch):
    """One file for each document, but not one folder: a commit moves folders one by one."""
    from trialspark.plans import load_all, storage
    monkeypatch.setattr(storage, "scratch_path", lambda s, label: f"file:{tmp_path}/{label}")
    supplier = spark.range(250).select(F.col("id").alias("s_suppkey"), F.col("id").cast("double").alias("s_acctbal"), F.lit(3).alias("s_nationkey"), F.lit("x").alias("s_name"))
    supplier.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = load_all()["a02_document_source"].frame(spark, str(tmp_path)).collect()
    assert sorted((int(r.job_id), r.elapsed_sec) for r in rows) == [(i, float(i)) for i in range(250)]
    folders = [d for d in (tmp_path / "documents").iterdir() if d.is_dir()]
    assert len(list((tmp_path / "documents").rglob("part-*.txt"))) == 250 and len(folders) <= 3
