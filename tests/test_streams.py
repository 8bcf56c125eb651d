"""Streams: restart from the checkpoint, late rows, repeated files."""

import json

from pyspark.sql import functions as F

from trialspark.sources.sinks import UpsertTable
from trialspark.streaming import jobs as J

SCHEMA = ("run_id string, job_id string, created_at double, crf double, error string, vmaf_threshold int, has_best boolean, has_result boolean, mtime double")


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def row(job, at, crf=30.0, error=None):
    return {"run_id": "r", "job_id": job, "created_at": at, "crf": crf, "error": error, "vmaf_threshold": 85, "has_best": True, "has_result": True, "mtime": at}


def test_watch_restarts_and_reports_changes_only(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    expected = spark.createDataFrame([(85, 2)], "vmaf_threshold int, expected_jobs int")
    table = UpsertTable(spark, str(tmp_path / "t"), ["created_at"], buckets=2)

    def run():
        s = J.json_stream(spark, str(tmp_path / "in"), schema, 1)
        J.watch_results(s, table, expected, str(tmp_path / "status"), str(tmp_path / "cp"), once=True).awaitTermination()

    put(tmp_path / "in", "1.json", [row("a", 1.0)])
    run()
    put(tmp_path / "in", "2.json", [row("a", 0.5, 99.0)])  # older than what is there: no change
    run()
    put(tmp_path / "in", "3.json", [row("b", 3.0)])
    run()
    log = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "status")).orderBy("batch").collect()
    assert [(r.batch, r.ok_best, r.done) for r in log] == [(0, 1, False), (2, 2, True)]
    assert {r.job_id: r.crf for r in table.read(schema).collect()} == {"a": 30.0, "b": 30.0}


def test_live_progress(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    table = UpsertTable(spark, str(tmp_path / "t"), ["ts", "elapsed_sec"], key=["job_id"], buckets=2)

    def run():
        s = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
        J.live_progress(s, table, str(tmp_path / "cp"), once=True).awaitTermination()

    (src / "a.log").write_text("[2026-07-17 16:51:39]   [v1] probe CRF30 … 15s size=0.3MiB rate=0.0019 ratio=538.39x\nnoise\n", encoding="utf-8")
    run()
    (src / "b.log").write_text("[2026-07-17 16:54:53]   [v1] probe CRF30 encode done 209.3s size=12.1MiB rate=0.0900 ratio=11.11x\n", encoding="utf-8")
    run()
    schema = J.progress_state(J.parse_progress(spark.createDataFrame([], "value string"))).schema
    got = table.read(schema).collect()
    assert [(r.job_id, r.elapsed_sec, r.done, r.ratio, r.label) for r in got] == [("v1", 209.3, True, 11.11, "probe CRF30")]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    def line(t):
        return {"event_time": t, "codec": "hevc", "mode": "CRF", "vmaf_threshold": 85.0, "uid": 1, "final": 0.5, "vmaf_neg": 90.0, "compression_rate": 0.1, "status": "success"}

    schema = spark.createDataFrame([], "event_time timestamp, codec string, mode string, vmaf_threshold double, uid int, final double, vmaf_neg double, compression_rate double, status string").schema
    src = tmp_path / "in"
    out = []

    def run():
        df = J.windowed_scores(J.json_stream(spark, str(src), schema, 1), "10 minutes", late="10 minutes")
        (df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
         .foreachBatch(lambda d, _: out.extend((r.window_start.strftime("%H:%M"), r.n) for r in d.collect())).start().awaitTermination())

    put(src, "1.json", [line("2024-01-01T00:01:00Z"), line("2024-01-01T00:05:00Z")])
    run()
    put(src, "2.json", [line("2024-01-01T01:00:00Z")])
    run()
    put(src, "3.json", [line("2024-01-01T00:02:00Z"), line("2024-01-01T02:00:00Z")])
    run()
    put(src, "4.json", [line("2024-01-01T03:00:00Z")])
    run()
    assert out[0] == ("00:00", 2) and ("01:00", 1) in out and sum(n for w, n in out if w == "00:00") == 2


def test_windows_batch_twin(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", 0.4), ("2024-01-01 00:09:00", 0.6), ("2024-01-01 00:11:00", 1.0)], "t string, final double").select(
        F.col("t").cast("timestamp").alias("event_time"), "final", F.lit("hevc").alias("codec"), F.lit("CRF").alias("mode"), F.lit(85.0).alias("vmaf_threshold"), F.lit(1).alias("uid"),
        F.lit(90.0).alias("vmaf_neg"), F.lit(0.1).alias("compression_rate"), F.lit("success").alias("status"))
    assert [(r.n, r.mean_final) for r in J.windowed_scores(df, "10 minutes").orderBy("window_start").collect()] == [(2, 0.5), (1, 1.0)]
    assert sum(r.n for r in J.windowed_scores(df, "10 minutes", "5 minutes").collect()) == 6
