"""Fleet jobs, results, catalogues and pair validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions.text import bitrate_for_rate
from trialspark.operators.scan import bitmap_semi, top_one
from trialspark.operators.trials import SEGMENT, best_trial, dedupe_last_wins, usable_results

# Tolerances of the pair check.
FPS_TOLERANCE = 0.3
FRAME_TOLERANCE = 5
BITRATE_TOLERANCE = 1.10


def split_jobs(jobs: DataFrame, work: DataFrame, published: DataFrame) -> DataFrame:
    """pending / skipped per job; a usable working result names the source before a published one."""
    w = usable_results(work).select("job_id").distinct().withColumn("_w", F.lit(True))
    p = usable_results(published).select("job_id").distinct().withColumn("_p", F.lit(True))
    j = jobs.join(w, "job_id", "left").join(p, "job_id", "left")
    src = F.when(F.col("_w"), "work").when(F.col("_p"), "published")
    return j.withColumns({"state": F.when(src.isNull(), "pending").otherwise("skipped"), "source": src}).drop("_w", "_p")


def pending_jobs(jobs: DataFrame, work: DataFrame, published: DataFrame) -> DataFrame:
    """Jobs without any usable result (two anti joins). Of many results only those that may match are shuffled."""
    left = jobs
    for res in (work, published):
        left = left.join(bitmap_semi(usable_results(res).select("job_id"), jobs, ["job_id"]).distinct(), "job_id", "left_anti")
    return left


def job_keys(jobs: DataFrame) -> DataFrame:
    """Names under which a job's video may be found; the later job wins a name."""
    jid = F.trim(F.coalesce("job_id", F.lit("")))
    file = F.element_at(F.split(F.coalesce("input_path", F.lit("")), "/"), -1)
    alias = F.when(F.regexp_like(jid, F.lit(r"^v\d+$")), F.concat(jid.substr(F.lit(2), F.length(jid)), F.lit(".mp4")))
    names = F.filter(F.array(file, jid, alias), lambda n: n.isNotNull() & (n != ""))
    x = jobs.select("job_id", "job_pos", F.posexplode(names).alias("_i", "name"))
    return top_one(x, ["name"], F.col("job_pos").desc(), F.col("_i").desc()).select("name", "job_id")


def preferred_results(results: DataFrame, threshold: int | None) -> DataFrame:
    """One result per job: the last of the preferred threshold, else the first seen.
    Without a preference the last one."""
    if threshold is None:
        return top_one(results, ["job_id"], F.col("pos").desc())
    pref = F.coalesce(F.col("vmaf_threshold") == threshold, F.lit(False))
    return top_one(results, ["job_id"], pref.desc(), F.when(pref, F.col("pos")).desc(), F.col("pos").asc())


def catalogue(videos: DataFrame, jobs: DataFrame, results: DataFrame, threshold: int | None) -> DataFrame:
    """Videos with their job and its preferred result."""
    r = preferred_results(results, threshold).drop("pos")
    return videos.join(job_keys(jobs), "name", "left").join(r, "job_id", "left")


def order_catalogue(df: DataFrame) -> DataFrame:
    """Dated entries first, newest first, then by name."""
    return df.orderBy(F.col("result_mtime").desc_nulls_last(), F.lower("name"))


def _number_key(digits: Column) -> Column:
    """Sorts digit runs of any length by value: by length without leading zeros, then by digits."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.struct(F.length(short).alias("length"), short.alias("digits"))


def natural_key(x: Column) -> Column:
    """Sort key that reads digit runs as numbers: array of (is_text, number, text)."""
    parts = F.regexp_extract_all(x, F.lit(r"[0-9]+|[^0-9]+"), 0)
    return F.transform(parts, lambda p: F.struct(
        (~p.rlike("^[0-9]")).alias("is_text"), F.when(p.rlike("^[0-9]"), _number_key(p)).alias("number"), F.lower(p).alias("text")))


def order_names(df: DataFrame, name: str) -> DataFrame:
    """Whole-number names by value, then the others as text."""
    num = F.regexp_like(name, F.lit("^[0-9]+$"))
    return df.orderBy(num.desc(), F.when(num, _number_key(F.col(name))), name)


def segments_with_best(segs: DataFrame, rich: DataFrame, trials: DataFrame, features: list[str], root_names: list[str],
                       keys=SEGMENT) -> DataFrame:
    """Segments with features (own value first, then the rich document) and the best
    merged trial (gated if any), with the roots it was merged from."""
    keys = list(keys)
    r = rich.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in features])
    names = F.array(*[F.lit(n) for n in root_names])
    src = trials.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.element_at(names, F.col("root_rank") + 1))), "+").alias("encode_source"))
    best = best_trial(dedupe_last_wins(trials, keys), keys, gated="prefer")
    best = best.select(*keys, "crf", "aq_strength", "vmaf_neg", *[c for c in ("vmaf_base",) if c in best.columns],
                       "compression_rate", "compression_ratio", F.col("s_f").alias("final_score"))
    best = best.join(src, keys)
    out = segs.join(r, keys, "left").join(best, keys, "left")
    own = set(segs.columns)
    out = out.withColumns({f: F.coalesce(F.col(f), F.col(f"_r_{f}")) if f in own else F.col(f"_r_{f}") for f in features})
    vmaf = F.coalesce("vmaf_neg", "vmaf_base") if "vmaf_base" in out.columns else F.col("vmaf_neg")
    return out.withColumn("vmaf", vmaf).drop(*[f"_r_{f}" for f in features])


def source_bitrate(size_bytes: Column, duration: Column) -> Column:
    return F.when((size_bytes > 0) & (duration > 0), size_bytes * 8.0 / duration)


def validate_pairs(reference: DataFrame, output: DataFrame, abr: bool = False, key: str = "clip_id") -> DataFrame:
    """Violated gates per (reference, output) probe pair.

    Probe columns: codec, width, height, fps, frames, container, profile, sar, pix_fmt,
    color_space, color_primaries, color_transfer, bit_rate_mbps; jobs may carry target_bitrate_mbps.
    """
    r, d = reference.alias("r"), output.alias("d")
    j = r.join(d, F.col(f"r.{key}") == F.col(f"d.{key}"))

    def R(c):
        return F.col(f"r.{c}")

    def D(c):
        return F.col(f"d.{c}")

    box = F.lower(D("container"))
    rules = [
        (~D("codec").isin("hevc", "h265"), "codec"),
        ((D("width") != R("width")) | (D("height") != R("height")), "resolution"),
        (F.abs(D("fps") - R("fps")) > FPS_TOLERANCE, "fps"), (F.abs(D("frames") - R("frames")) > FRAME_TOLERANCE, "frames"),
        (F.contains(box, F.lit("ivf")) | ~(F.contains(box, F.lit("mp4")) | F.contains(box, F.lit("mov"))), "container"),
        (~D("profile").isin("Main", "Main 10"), "profile"), (~D("sar").isin("1:1", "1/1"), "sar"), (D("pix_fmt") != "yuv420p", "pix_fmt")]
    for c in ("color_space", "color_primaries", "color_transfer"):
        rules.append(((R(c) != "") & (D(c) != "") & (R(c) != D(c)), c))
    if abr:
        rate, want = D("bit_rate_mbps"), R("target_bitrate_mbps")
        rules += [(rate.isNull(), "bitrate_missing"), (rate > want * BITRATE_TOLERANCE, "bitrate")]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules]))
    return j.select(R(key).alias(key), bad.alias("violations"), (F.size(bad) == 0).alias("ok"))


def job_bitrates(jobs: DataFrame, features: DataFrame) -> DataFrame:
    """Target bitrate per job: the explicit one, else derived from rate, size and duration."""
    j = jobs.join(features.select("job_id", "duration", "source_bytes"), "job_id", "left")
    explicit = F.nullif(F.trim(F.coalesce("target_bitrate", F.lit(""))), F.lit(""))
    made = bitrate_for_rate(F.col("source_bytes").cast("double"), F.col("duration"), F.col("target_compression_rate"))
    err = F.when(explicit.isNotNull(), None).when(F.col("target_compression_rate").isNull(), "no target").otherwise(made["error"])
    return j.withColumns({"bitrate": F.coalesce(explicit, F.when(err.isNull(), made["bitrate"])), "error": err})


def status_counts(results: DataFrame, *more: str) -> DataFrame:
    """Counts and newest change per threshold (and `more` keys); counts of disjoint results add up."""
    ok = (F.coalesce("error", F.lit("")) == "") & F.col("crf").isNotNull()
    return results.groupBy("vmaf_threshold", *more).agg(
        F.count_if("has_best").alias("best_json"), F.count_if("has_result").alias("result_json"), F.count_if(ok & F.col("has_best")).alias("ok_best"),
        F.max(F.when(F.col("has_best"), F.col("mtime"))).alias("newest"))


def status_against(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Added-up counts per threshold against the expected jobs, with a change fingerprint."""
    numbers = ("best_json", "result_json", "ok_best")
    g = counts.groupBy("vmaf_threshold").agg(*[F.sum(c).alias(c) for c in numbers], F.max("newest").alias("newest"))
    out = expected.join(g, "vmaf_threshold", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return out.withColumn("done", (F.col("ok_best") >= F.col("expected_jobs")) & (F.col("expected_jobs") > 0))


def fleet_status(results: DataFrame, expected: DataFrame) -> DataFrame:
    return status_against(status_counts(results), expected)


def latest_results(results: DataFrame, limit: int = 50) -> DataFrame:
    return results.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


# What a current feature document must hold.
NEEDED_SEGMENT_KEYS = ("si", "ti", "luma_mean", "sat_mean")
MIN_SAMPLES = 16
# Detectors by the start of their name, the last for all others; what else counts as one.
DETECTORS = (("builtin", "builtin"), ("adapt", "adaptive"), ("", "content"))
ACCEPTED_WITH = {"builtin": ("",)}


def stale_documents(docs: DataFrame, detector: str = "content") -> DataFrame:
    """Feature documents that must be extracted again (missing keys, other detector,
    too few samples)."""
    want = next((kind for start, kind in DETECTORS if detector.lower().startswith(start)), DETECTORS[-1][1])
    first = F.get("segments", F.lit(0))
    missing = F.coalesce(F.size("segments"), F.lit(0)) <= 0
    for k in NEEDED_SEGMENT_KEYS:
        missing = missing | first[k].isNull()
    have = F.coalesce(F.col("meta.scene_detect.detector"), F.lit(""))
    accepted = [want, *ACCEPTED_WITH.get(want, ())]
    few = F.coalesce(F.col("meta.samples_per_segment"), F.lit(0)) < MIN_SAMPLES
    return docs.filter(F.coalesce(missing, F.lit(True)) | ~have.isin(accepted) | few)
