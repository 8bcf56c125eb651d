"""Structured Streaming jobs over result files, encode progress and score rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from trialspark.operators.fleet import status_against, status_counts
from trialspark.sources import files
from trialspark.sources.sinks import UpsertTable

# An encode progress line.
PROGRESS = (r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*?)\s+(…|encode done)\s+([\d.]+)s\s+"
            r"size=([\d.]+)MiB\s+rate=([\d.]+)\s+ratio=([\d.]+)x")


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", True).json(path))


def _start(df: DataFrame, checkpoint: str, each, mode: str, once: bool) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w).start()


def ingest_results(rows: DataFrame, table: UpsertTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Idempotent ingest: newest row per key wins, a repeated batch is skipped."""
    return _start(rows, checkpoint, lambda df, batch: table.upsert(df, batch), "append", once)


def watch_results(rows: DataFrame, table: UpsertTable, expected: DataFrame, status_path: str, checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    """Ingest results and append a status row for every threshold whose counts changed.

    The counts of each table bucket are kept beside the status: a batch counts only the buckets
    that it has rewritten, and adds up one small row per bucket and threshold.
    """
    def counts(spark):
        parts = table.parts()
        kept = []
        for folder in sorted({p.rpartition("/")[0] for p in parts.values()}):
            path = f"{status_path.rstrip('/')}-counts/{folder.rpartition('/')[2]}"
            if not files.exists(spark, f"{path}/_SUCCESS"):
                status_counts(spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(folder), "_bucket").withColumn(
                    "_folder", F.lit(folder)).coalesce(1).write.mode("overwrite").parquet(path)
            kept.append(path)
        # at most one row per bucket
        current = spark.createDataFrame([(int(b), p.rpartition("/")[0]) for b, p in parts.items()], "_bucket int, _folder string")
        return spark.read.parquet(*kept).join(current, ["_bucket", "_folder"]) if kept else None

    def each(df, batch):
        table.upsert(df, batch)
        spark = df.sparkSession
        found = counts(spark)
        if found is None:
            return
        now = status_against(found, expected).withColumn("batch", F.lit(batch).cast("bigint"))
        if files.exists(spark, status_path):
            # one row per threshold and change: a small table
            log = spark.read.schema(now.schema).parquet(status_path).filter(F.col("batch") < batch)
            last = log.groupBy("vmaf_threshold").agg(F.max_by(F.struct("ok_best", "newest"), "batch").alias("_l"))
            now = (now.join(last, "vmaf_threshold", "left")
                   .filter(F.col("_l").isNull() | ~(F.col("_l.ok_best").eqNullSafe(F.col("ok_best"))
                                                    & F.col("_l.newest").eqNullSafe(F.col("newest")))).drop("_l"))
        # one folder per batch: a repeated batch replaces its own rows
        now.coalesce(1).write.mode("overwrite").parquet(f"{status_path}/batch={batch}")

    return _start(rows, checkpoint, each, "append", once)


def latest_status(spark: SparkSession, status_path: str, schema: T.StructType) -> DataFrame:
    log = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(status_path)
    fields = [c for c in log.columns if c not in ("vmaf_threshold",)]
    return log.groupBy("vmaf_threshold").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("vmaf_threshold", "s.*")


def parse_progress(lines: DataFrame) -> DataFrame:
    # the separator cannot stand in a line: it is replaced first
    line = F.translate("value", "\u0001", "\uFFFD")
    g = F.split(F.regexp_replace(line, PROGRESS + ".*$", "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7\u0001$8"), "\u0001", -1)
    x = lines.withColumn("_g", g).filter(F.size("_g") == 8)
    c = F.col("_g")
    return x.select(c[0].alias("ts"), c[1].alias("job_id"), c[2].alias("label"), (c[3] == "encode done").alias("done"),
                    *[c[i].try_cast("double").alias(n) for i, n in enumerate(("elapsed_sec", "size_mib", "rate", "ratio"), start=4)])


def progress_state(progress: DataFrame) -> DataFrame:
    """Latest figures per job; text order of the time stamps is time order."""
    row = F.struct("elapsed_sec", "size_mib", "rate", "ratio", "label", "done")
    return progress.groupBy("job_id").agg(F.max(F.struct("ts", row.alias("r"))).alias("m")).select("job_id", F.col("m.ts").alias("ts"), "m.r.*")


def live_progress(lines: DataFrame, table: UpsertTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the latest progress of every job in a table (update mode)."""
    state = progress_state(parse_progress(lines))
    return _start(state, checkpoint, lambda df, batch: table.upsert(df, batch), "update", once)


def windowed_scores(scores: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes",
                    time: str = "event_time") -> DataFrame:
    """Uid statistics per event-time window, tumbling or sliding; batch and stream alike."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    s = F.col("status")
    return (scores.withWatermark(time, late).groupBy(w.alias("w"), "codec", "mode", "vmaf_threshold", "uid")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("final").alias("mean_final"), F.max("final").alias("max_final"),
                 F.avg("vmaf_neg").alias("mean_neg"), F.min("vmaf_neg").alias("min_neg"), F.avg("compression_rate").alias("mean_rate"),
                 F.count_if(s == "success").alias("ok"), F.count_if(s == "vmaf_soft").alias("soft"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "codec", "mode", "vmaf_threshold", "uid",
                    "n", "mean_final", "max_final", "mean_neg", "min_neg", "mean_rate", "ok", "soft"))
