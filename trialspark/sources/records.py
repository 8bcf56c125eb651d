"""Readers: trial lines, documents, sweeps, logs, job manifests, clip listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from trialspark import schema as S
from trialspark.operators.trials import truthy
from trialspark.session import materialize
from trialspark.sources import files

# Name of a segment clip.
CLIP_NAME = r"(?i)^seg(\d+)_f(\d+)-(\d+)\.mp4$"


def parse_objects(lines: DataFrame, fields: dict[str, T.DataType], column: str = "value") -> DataFrame:
    """JSON object lines to typed columns. Blank, malformed and non-object lines are
    skipped; numbers may arrive as text."""
    text = F.trim(column)
    loose = T.StructType([T.StructField(n, T.StringType()) for n in fields] + [T.StructField("_bad", T.StringType())])
    j = F.from_json(text, loose, {"columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in lines.columns if c != column]
    df = lines.filter(F.startswith(text, F.lit("{"))).select(*rest, j.alias("_j")).filter(F.col("_j._bad").isNull())

    def typed(name, t) -> Column:
        raw = F.col(f"_j.{name}")
        if isinstance(t, (T.IntegerType, T.LongType)):
            return raw.try_cast("double").try_cast(t)
        if isinstance(t, T.BooleanType):
            return F.when(raw.isNotNull(), truthy(raw, False))
        return raw if isinstance(t, T.StringType) else raw.try_cast(t)

    return df.select(*rest, *[typed(n, t).alias(n) for n, t in fields.items()])


def read_trials(spark: SparkSession, folder: str, pattern: str = "trials.jsonl") -> DataFrame:
    """All trials of a work folder. Rows of flat all_trials.jsonl files are preferred to the per-segment files,
    which are read when those have none; video and segment come from the path where the row lacks them."""
    for flat in (f"{folder}/all_trials.jsonl", f"{folder}/*/all_trials.jsonl"):
        if files.glob(spark, flat):
            rows = _trial_rows(spark.read.text(flat))
            if not rows.isEmpty():
                return rows
    return _trial_rows(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder))


def _trial_rows(lines: DataFrame) -> DataFrame:
    lines = lines.select("value", F.col("_metadata.file_path").alias("_path"))
    rows = parse_objects(lines, S.TRIAL)
    parts = F.split("_path", "/")
    parent = F.element_at(parts, -2)
    stem = F.when(F.regexp_like(parent, F.lit(r"segment_\d+")), F.element_at(parts, -3)).otherwise(parent)
    seg = F.nullif(F.regexp_extract("_path", r"segment_(\d+)", 1), F.lit("")).try_cast("int")
    return rows.withColumns({"video_stem": F.coalesce("video_stem", F.element_at(F.split(stem, "="), -1)),
                             "segment_index": F.coalesce("segment_index", seg)}).drop("_path")


def read_documents(spark: SparkSession, path, schema: T.StructType, recursive: bool = False) -> DataFrame:
    """One JSON object per file; files that do not parse are skipped."""
    full = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    r = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad")
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.json(path).select("*", F.col("_metadata.file_path").alias("doc_path"),
                             F.col("_metadata.file_modification_time").alias("doc_mtime"))
    return df.filter(F.col("_bad").isNull()).drop("_bad")


# Columns of a sweep plot.
SWEEP = ("crf", "aq_strength", "s_f", "compression_ratio", "vmaf_neg", "gates_ok")


def read_sweep(spark: SparkSession, jsonl: str | None = None, csv: str | None = None, gates_only: bool = False) -> DataFrame:
    """Sweep points from JSON lines, or from CSV where those are missing. Failed rows
    and rows with unreadable numbers are dropped."""
    if jsonl and files.exists(spark, jsonl):
        raw = parse_objects(spark.read.text(jsonl), {n: T.StringType() for n in [*SWEEP, "encode_ok"]})
    elif csv and files.exists(spark, csv):
        raw = spark.read.option("header", True).csv(csv)
    else:
        raise FileNotFoundError("no sweep file found")
    have = set(raw.columns)

    def col(n):
        return F.col(n) if n in have else F.lit(None).cast("string")

    ok = raw.filter(truthy(col("encode_ok"), True))
    if gates_only:
        ok = ok.filter(truthy(col("gates_ok"), False))
    num = {n: col(n).try_cast("double") for n in SWEEP if n != "gates_ok"}
    out = ok.select(num["crf"].try_cast("int").alias("crf"), (F.rint(num["aq_strength"] * 10000.0) / 10000.0).alias("aq_strength"),
                    *[num[n].alias(n) for n in ("s_f", "compression_ratio", "vmaf_neg")], truthy(col("gates_ok"), False).alias("gates_ok"))
    return out.dropna(subset=[n for n in SWEEP if n != "gates_ok"])


#: Up to this many splits (128 MB of text each by default) the line counts are broadcast.
MAX_BROADCAST_SPLITS = 100_000


def read_log(spark: SparkSession, paths) -> DataFrame:
    """Log lines with their 1-based number per file; undecodable bytes are replaced.

    The text is read once: each line is written with its file, split and place in the split, and the line counts
    of the splits come from that copy. How the files were split does not matter afterwards, so executors
    may come and go. Files stay splittable; the counts, one row for each split, are broadcast while they are few.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.make_valid_utf8("value").alias("value"), F.monotonically_increasing_id().alias("_id"))
    raw = materialize(raw, "log-lines")
    per = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    per = materialize(per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))), "log-splits")
    return raw.join(F.broadcast(per) if per.count() <= MAX_BROADCAST_SPLITS else per, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def job_manifest(requests: DataFrame) -> DataFrame:
    """Jobs of request documents: default ids, safe ids, paths nested by threshold,
    request values where the job has none."""
    x = requests.select("*", F.posexplode("jobs").alias("job_pos", "job"))
    jid = F.coalesce(F.nullif("job.id", F.lit("")), F.concat(F.lit("video-"), (F.col("job_pos") + 1).cast("string")))
    safe = F.regexp_replace(jid, r"[^\p{L}\p{N}_-]", "_")
    thr = F.col("vmaf_threshold").cast("string")
    x = x.withColumns({"job_id": jid, "safe_id": safe, "_thr": thr})
    x = x.withColumn("job_dir", F.concat_ws("/", "work_dir", "_thr", "safe_id"))
    local = F.coalesce(F.col("job.input_path"), F.lit("")) != ""
    out = F.coalesce(F.nullif("job.output_path", F.lit("")), F.concat(F.lit("output/fleet/"), F.col("safe_id"), F.lit(".mp4")))
    out = F.regexp_replace(out, r"^(\./)+", "")
    parts = F.split(out, "/")
    name, dir_ = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    nested = F.when(F.try_element_at(dir_, F.lit(-1)) == F.col("_thr"), out).otherwise(
        F.array_join(F.concat(dir_, F.array("_thr", name)), "/"))
    return x.select(
        *[c for c in requests.columns if c not in ("jobs", "target_bitrate", "target_compression_rate")], "job_pos", "job_id", "safe_id", "job_dir",
        F.when(local, F.col("job.input_path")).otherwise(F.concat(F.col("job_dir"), F.lit("/input.mp4"))).alias("input_path"),
        F.when(local, nested).otherwise(F.concat(F.col("job_dir"), F.lit("/output.mp4"))).alias("output_path"),
        F.col("job.crf").alias("crf"), F.col("job.libx265_params").alias("libx265_params"),
        F.coalesce(F.col("job.target_bitrate"), F.col("target_bitrate")).alias("target_bitrate"),
        F.coalesce(F.col("job.target_compression_rate"), F.col("target_compression_rate")).alias("target_compression_rate"))


def parse_clip_names(df: DataFrame, name: str) -> DataFrame:
    """seg<index>_f<start>-<end>.mp4 names to columns; others and empty ranges are dropped."""
    x = df.filter(F.regexp_like(name, F.lit(CLIP_NAME)))
    x = x.withColumns({c: F.regexp_extract(name, CLIP_NAME, i).try_cast("int") for i, c in
                       enumerate(("clip_index", "start_frame", "end_frame"), start=1)})
    return x.filter(F.col("end_frame") > F.col("start_frame")).withColumn("frame_count", F.col("end_frame") - F.col("start_frame"))


def list_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Segment clips below a folder (names and sizes only), by index and start."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(folder)
    parts = F.split("path", "/")
    f = f.select("path", "length", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("video_stem"))
    return parse_clip_names(f, "file").orderBy("video_stem", "clip_index", "start_frame")
