"""Segments, frames, packets and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialspark.functions.features import (EDGE_MID, HARD_DIFFICULTY, HF_MID, MOTION_MID, NOISE_MID, TEXTURE_MID,
                                           FEATURE_KEYS)
from trialspark.functions.numbers import half_even, round_even, soft_level
from trialspark.operators.scan import (asof, exact_quantiles, exact_sum, group_max, group_min, group_sum,
                                       moments_and_quantiles, ordered_scan, nearest, previous, range_join, running_sum)
from trialspark.session import materialize

FRAME_BUCKET = 64
FRAME_CHUNK = 4096
SEG = ["video_id", "seg_index"]


def _seg_chunk() -> Column:
    return F.floor(F.col("seg_index") / FRAME_CHUNK).cast("bigint")


def _per_video(segs: DataFrame, key: str = "video_id", **ops) -> DataFrame:
    """Group values on every segment, joined by (video, chunk) so that a video with
    very many segments is still spread over tasks."""
    return ordered_scan(segs, [key], ["seg_index"], _seg_chunk(), **ops)


# Cut thresholds on the histogram distance and the mean difference.
CUT_HIST = 0.45
CUT_DIFF = 0.18
# Borders of the difficulty histogram.
HISTOGRAM_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
HIGH_COMPLEXITY, LOW_COMPLEXITY = 0.45, 0.20
# Seconds by which a sum over chunks may miss a budget; far above its rounding errors.
NEAR_BUDGET = 1e-6


# ---------------------------------------------------------------- frame ranges

def segment_frames(segs: DataFrame, key: str = "video_id") -> DataFrame:
    """Seconds to frame ranges: half-even rounding, clamped to the clip, at least one
    frame; the last segment is stretched to the end of the clip.

    Input: seg_index, start_sec, end_sec, fps and clip_frames (0 when unknown).
    """
    j = _per_video(segs, key, _last=group_max(F.col("seg_index")))
    fps, n = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0)), F.col("clip_frames")
    s, e = half_even(F.col("start_sec") * fps), half_even(F.col("end_sec") * fps)
    start = F.greatest(F.lit(0), F.when(n > 0, F.least(s, n)).otherwise(s))
    j = j.withColumn("start_frame", start)
    end = F.greatest(F.col("start_frame") + 1, F.when(n > 0, F.least(e, n)).otherwise(e))
    end = F.when((F.col("seg_index") == F.col("_last")) & (n > 0), F.greatest(end, n)).otherwise(end)
    return (j.withColumn("end_frame", end)
            .withColumn("frame_count", F.col("end_frame") - F.col("start_frame")).drop("_last"))


def cuts_to_segments(cuts: DataFrame, clips: DataFrame, min_segment_sec: float, key: str = "video_id") -> DataFrame:
    """Cut frames to segments, runs shorter than the minimum merged into a neighbour.

    The merge has a closed form: a run opens a segment when it is long enough
    itself and starts no earlier than the minimum length (before that, all runs
    belong to the first segment). `clips` holds (key, clip_frames, fps).
    """
    # the cut list keeps borders inside the clip; 0 is always one
    inner = (cuts.join(clips, key).filter((F.col("cut_frame") > 0) & (F.col("cut_frame") < F.col("clip_frames")))
             .select(key, "cut_frame"))
    starts = inner.unionByName(clips.select(key, F.lit(0).cast(inner.schema["cut_frame"].dataType).alias("cut_frame"))).distinct()
    chunk = F.floor(F.col("cut_frame") / FRAME_CHUNK).cast("bigint")
    runs = ordered_scan(starts, [key], ["cut_frame"], chunk, reverse=True, _next=previous(F.col("cut_frame")))
    runs = runs.join(clips, key)
    least_frames = F.greatest(F.lit(1), half_even(F.lit(float(min_segment_sec)) * F.col("fps")))
    length = F.coalesce("_next", "clip_frames") - F.col("cut_frame")
    opens = (F.col("cut_frame") == 0) | ((length >= least_frames) & (F.col("cut_frame") >= least_frames))
    heads = runs.filter(opens).select(key, F.col("cut_frame").alias("start_frame"), "clip_frames")
    chunk = F.floor(F.col("start_frame") / FRAME_CHUNK).cast("bigint")
    out = ordered_scan(heads, [key], ["start_frame"], chunk, reverse=True, _next=previous(F.col("start_frame")))
    return out.select(key, "start_frame", F.coalesce("_next", "clip_frames").alias("end_frame"))


def limit_segments(segs: DataFrame, max_segments: int, key: str = "video_id") -> DataFrame:
    """Group every ceil(n / max) neighbours where a video has too many segments."""
    size = F.when(F.col("_n") <= max_segments, 1).otherwise(F.ceil(F.col("_n") / max_segments))
    g = _per_video(segs, key, _n=group_sum(F.lit(1))).withColumn("group_index", F.floor(F.col("seg_index") / size).cast("int"))
    return g.groupBy(key, "group_index").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


# ---------------------------------------------------------------- packets and frames

def packet_bytes(segs: DataFrame, packets: DataFrame, keys=("video_id",), out: str = "packet_bytes") -> DataFrame:
    """Bytes per segment over packets with start <= frame < end; 0 when there are none."""
    keys = list(keys)
    seg_keys = [*keys, "seg_index"]
    # packets of one frame are added up before they travel
    per = packets.groupBy(*keys, "frame").agg(F.sum("size").alias("_size"))
    hit = range_join(per, segs.select(*seg_keys, "start_frame", "end_frame"), keys, "frame", "start_frame", "end_frame", FRAME_BUCKET)
    sums = hit.groupBy(*seg_keys).agg(F.sum("_size").alias(out))
    return segs.join(sums, seg_keys, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def zone_compression(segs: DataFrame, reference: DataFrame, output: DataFrame) -> DataFrame:
    """Reference and output bytes per zone; rate and ratio are 0 when undefined."""
    a = packet_bytes(segs, reference, out="size_in_bytes")
    both = packet_bytes(a, output, out="size_out_bytes")
    i, o = F.col("size_in_bytes"), F.col("size_out_bytes")
    return both.withColumns({"compression_rate": F.when(i > 0, o / i).otherwise(0.0),
                             "compression_ratio": F.when(o > 0, i / o).otherwise(0.0)})


def frames_in_segments(segs: DataFrame, frames: DataFrame, payload: list[str]) -> DataFrame:
    """Frames of each segment; a segment without any takes the frame nearest its middle.

    A segment of a video without frames keeps one row with null frame columns.
    """
    s = segs.select(*SEG, "start_frame", "end_frame")
    f = frames.select("video_id", "frame", *payload)
    hit = range_join(f, s, ["video_id"], "frame", "start_frame", "end_frame", FRAME_BUCKET)
    bare = s.join(hit.select(*SEG).distinct(), SEG, "left_anti")
    bare = bare.withColumn("_mid", F.floor((F.col("start_frame") + F.col("end_frame") - 1) / 2).cast("bigint"))
    f = f.withColumn("frame", F.col("frame").cast("bigint"))
    # few segments are bare; written once, they need no second range join
    near = nearest(materialize(bare, "bare-segments"), f, ["video_id"], "_mid", "frame", payload, "_pick", FRAME_CHUNK)
    cols = [*SEG, "start_frame", "end_frame"]
    return hit.select(*cols, F.col("frame").cast("bigint").alias("frame"), *payload, F.lit(False).alias("is_nearest")).unionByName(
        near.select(*cols, F.col("_pick.frame").alias("frame"), *[F.col(f"_pick.{c}").alias(c) for c in payload],
                    F.col("_pick").isNotNull().alias("is_nearest")))


def even_samples(in_segment: DataFrame, count: int) -> DataFrame:
    """At most `count` frames per segment at evenly spaced (truncated) positions."""
    one = F.lit(1).cast("bigint")
    pos = ordered_scan(in_segment, SEG, ["frame"], F.floor(F.col("frame") / FRAME_CHUNK).cast("bigint"),
                       _p=running_sum(one), _n=group_sum(one))
    p = F.col("_p") - 1
    if count == 1:
        keep = p == 0
    else:
        step = (F.col("_n") - 1) / F.lit(float(count - 1))
        picks = F.transform(F.sequence(F.lit(0), F.lit(count - 2)), lambda i: F.floor(i * step).cast("bigint"))
        keep = (F.col("_n") <= count) | (p == F.col("_n") - 1) | F.array_contains(picks, p)
    return pos.filter(keep).drop("_p", "_n")


def aggregate_samples(samples: DataFrame, motion: str, means: list[str]) -> DataFrame:
    """Motion statistics and plain means per segment. Samples per segment are few by
    construction (see even_samples), so the exact percentile stays small."""
    return samples.groupBy(*SEG).agg(
        F.count("frame").alias("samples"), F.avg(motion).alias("motion_mean"), F.stddev_pop(motion).alias("motion_std"),
        F.percentile(motion, F.lit(0.9)).alias("motion_p90"), F.max(motion).alias("motion_max"),
        *[F.avg(c).alias(f"{c}_mean") for c in means])


def detect_cuts(frames: DataFrame) -> DataFrame:
    """Sampled frames that differ enough from the sample before."""
    chunk = F.floor(F.col("frame") / FRAME_CHUNK).cast("bigint")
    w = ordered_scan(frames, ["video_id"], ["frame"], chunk, _prev=previous(F.col("hist")))
    dist = F.aggregate(F.zip_with("hist", "_prev", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2.0
    w = w.withColumn("hist_distance", dist)
    cut = F.col("_prev").isNotNull() & ((F.col("hist_distance") >= CUT_HIST) | (F.col("diff") >= CUT_DIFF))
    return w.withColumn("is_cut", cut).drop("_prev")


def motion_between_samples(frames: DataFrame, step: int) -> DataFrame:
    """Largest frame-to-frame motion since the previous sample, per sampled frame."""
    b = F.ceil(F.col("frame") / F.lit(step)).cast("bigint")
    g = frames.groupBy("video_id", b.alias("sample")).agg(
        F.max("motion_inst").alias("motion"), F.max("frame").alias("_end"))
    return g.filter(F.col("_end") == F.col("sample") * step).select(
        "video_id", F.col("_end").alias("frame"), F.coalesce("motion", F.lit(0.0)).alias("motion"))


# ---------------------------------------------------------------- zones

def attach_zones(segs: DataFrame, zones: DataFrame, width: int = FRAME_CHUNK) -> DataFrame:
    """Give every segment its zone settings.

    With as many zones as segments they pair by position, and the zone start is the
    segment's. Otherwise the latest zone at or before the segment start applies, or
    the earliest zone when none is. Segments of a video without zones have no settings
    and the mode `fallback`. Zones: video_id, zone_pos, zone_start, crf, qp, bitrate.
    """
    opts = ["crf", "qp", "bitrate"]
    per = zones.groupBy("video_id").agg(F.count(F.lit(1)).alias("_nz"), F.min("zone_start").alias("_z0"))
    s = _per_video(segs, _ns=group_sum(F.lit(1))).join(per, "video_id", "left")
    none = s.filter(F.col("_nz").isNull()).select(*segs.columns, F.lit(None).cast("bigint").alias("zone_start_frame"),
                                                  *[F.lit(None).cast(zones.schema[c].dataType).alias(c) for c in opts],
                                                  F.lit("none").alias("zone_match"))
    pair = s.filter(F.col("_ns") == F.col("_nz")).join(
        zones.select("video_id", F.col("zone_pos").alias("seg_index"), "zone_start", *opts), SEG)
    pair = pair.select(*segs.columns, F.col("start_frame").cast("bigint").alias("zone_start_frame"), *opts,
                       F.lit("by_position").alias("zone_match"))
    rest = s.filter(F.col("_ns") != F.col("_nz"))
    rest = rest.withColumn("_at", F.greatest("start_frame", F.col("_z0").cast("bigint")))
    z = zones.select("video_id", F.col("zone_start").cast("bigint").alias("zone_start"), "zone_pos", *opts)
    hit = asof(rest.select(*segs.columns, "_at"), z, ["video_id"], "_at", "zone_start", opts, "_z", width, tie=["zone_pos"])
    hit = hit.select(*segs.columns, F.col("_z.zone_start").alias("zone_start_frame"),
                     *[F.col(f"_z.{c}").alias(c) for c in opts], F.lit("by_start").alias("zone_match"))
    both = pair.unionByName(hit).unionByName(none)
    mode = (F.when(F.col("qp").isNotNull(), "qp").when(F.col("crf").isNotNull(), "crf")
            .when(F.col("bitrate").isNotNull(), "bitrate").otherwise("fallback"))
    return both.withColumns({
        "rc_mode": mode,
        "applied_q": F.when(mode == "qp", half_even(F.col("qp"))).when(mode == "crf", half_even(F.col("crf"))),
        "applied_crf": F.when(mode == "crf", F.col("crf"))})


def majority_options(options: DataFrame, keys=("video_id",)) -> DataFrame:
    """Most frequent value per option key (first seen on ties) and whether zones differ.

    Input: keys, zone_pos, option, value.
    """
    per = options.groupBy(*keys, "option", "value").agg(F.count(F.lit(1)).alias("n"), F.min("zone_pos").alias("p"))
    return per.groupBy(*keys, "option").agg(
        F.max(F.struct("n", (-F.col("p")).alias("p"), "value"))["value"].alias("chosen"),
        (F.count(F.lit(1)) > 1).alias("differs"))


def zone_means(rows: DataFrame) -> DataFrame:
    """Plain and frame-weighted means of quality and rate per video."""
    w = F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame"))
    has = F.col("vmaf_neg").isNotNull()
    return rows.groupBy("video_id").agg(
        F.min("vmaf_neg").alias("vmaf_min"), F.max("vmaf_neg").alias("vmaf_max"), (exact_sum(F.col("vmaf_neg")) / F.count("vmaf_neg")).alias("vmaf_mean"),
        (exact_sum(F.when(has, F.col("vmaf_neg") * w)) / F.sum(F.when(has, w))).alias("vmaf_wmean"),
        F.min("compression_rate").alias("rate_min"), F.max("compression_rate").alias("rate_max"),
        (exact_sum(F.col("compression_rate") * w) / F.sum(w)).alias("rate_wmean"))


def zones_text(segs: DataFrame, qp: str = "qp") -> DataFrame:
    """`zones=start,end,q=N/...`, one text per video in segment order.

    A video has few segments (see limit_segments), so its text stays small.
    """
    ok = segs.filter(F.col("end_frame") > F.col("start_frame"))
    item = F.concat_ws(",", F.col("start_frame").cast("string"), F.col("end_frame").cast("string"),
                       F.concat(F.lit("q="), F.col(qp).cast("string")))
    g = ok.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_index", item.alias("t")))).alias("z"))
    return g.select("video_id", F.concat(F.lit("zones="), F.array_join(F.transform("z", lambda x: x["t"]), "/")).alias("zones"))


def _difficulty_scale(segs: DataFrame) -> DataFrame:
    j = _per_video(segs, _lo=group_min(F.col("difficulty")), _hi=group_max(F.col("difficulty")))
    flat = F.col("_hi") <= F.col("_lo") + 1e-9
    return j.withColumn("_t", F.when(~flat, (F.col("difficulty") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))


def difficulty_settings(segs: DataFrame, base_qp: int = 28, qp_span: float = 6.0, b_span: float = 0.6,
                        b_min: float = 0.5, b_max: float = 1.5) -> DataFrame:
    """QP (harder gets lower) and bitrate factor (harder gets higher) by per-video scaling."""
    j = _difficulty_scale(segs)
    qp = F.coalesce(F.lit(float(base_qp)) + F.lit(max(0.0, qp_span)) * (F.lit(0.5) - F.col("_t")), F.lit(float(base_qp)))
    b = F.coalesce(F.lit(1.0) + F.lit(max(0.0, b_span)) * (F.col("_t") - 0.5), F.lit(1.0))
    return j.withColumns({"qp": half_even(qp), "bitrate_factor": round_even(F.greatest(F.lit(b_min), F.least(F.lit(b_max), b)), 3)}
                         ).drop("_lo", "_hi", "_t")


# ---------------------------------------------------------------- sampling

def spread_scenes(segs: DataFrame, max_scenes: int) -> DataFrame:
    """At most `max_scenes` segments per video, spread over the timeline."""
    j = _per_video(segs, _n=group_sum(F.lit(1)))
    if max_scenes <= 0:
        return j.filter(F.lit(False)).drop("_n")
    if max_scenes == 1:
        picks = F.array(F.floor(F.col("_n") / 2).cast("int"))
    else:
        step = (F.col("_n") - 1) / F.lit(float(max_scenes - 1))
        picks = F.transform(F.sequence(F.lit(0), F.lit(max_scenes - 1)), lambda i: half_even(i * step))
    return j.filter((F.col("_n") <= max_scenes) | F.array_contains(picks, F.col("seg_index"))).drop("_n")


def sample_windows(scenes: DataFrame, sample_seconds: float, floor_to_sec: bool = False) -> DataFrame:
    """A centred sample window per scene, kept inside the scene."""
    fps = F.greatest(F.lit(1.0), F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0)))
    want = F.greatest(F.lit(1.0) / fps, F.lit(float(sample_seconds)))
    dur = F.col("end_sec") - F.col("start_sec")
    take = F.least(want, F.greatest(dur, F.lit(1.0) / fps))
    start = F.greatest(F.col("start_sec"), F.col("start_sec") + dur / 2.0 - take / 2.0)
    start = F.least(start, F.greatest(F.col("start_sec"), F.col("end_sec") - take))
    if floor_to_sec:
        start = F.when(want >= 2.0, F.floor(start).cast("double")).otherwise(start)
    return scenes.withColumns({"take_sec": take, "take_frames": F.greatest(F.lit(1), half_even(take * fps)), "sample_start": start})


def budget_windows(segs: DataFrame, seconds_per_segment: float = 2.5, max_seconds: float = 15.0,
                   min_window: float = 0.5) -> DataFrame:
    """Mid-segment windows; over budget the hardest come first and the last one shrinks.

    Reading windows in falling difficulty, a window gets what the budget has left
    after the full windows before it, so one running sum decides. A sum over chunks
    only drops what is clearly over budget; the few windows that can be left of a
    video (at most one for each millisecond) are added one after the other, since
    a total on the edge of the budget is told by its last bit.
    """
    dur = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    small = dur < min_window
    win = F.when(small, dur).otherwise(F.least(F.lit(float(seconds_per_segment)), dur))
    raw = segs.withColumns({"_w": win, "_s": F.when(small, F.col("start_sec")).otherwise(
        F.col("start_sec") + F.greatest(F.lit(0.0), (dur - win) / 2.0))}).filter(F.col("_w") > 1e-3)
    raw = raw.withColumn("_hard", -F.col("difficulty"))
    run = ordered_scan(raw, ["video_id"], ["_hard", "seg_index"], F.floor(F.col("_hard") * 256).cast("bigint"),
                       _cum=running_sum(F.col("_w")), _total=group_sum(F.col("_w")))
    whole = F.col("_total") <= max_seconds + NEAR_BUDGET
    near = run.filter(whole | (F.col("_cum") - F.col("_w") <= max_seconds - min_window + NEAR_BUDGET))
    hardest = W.partitionBy("video_id").orderBy("_hard", "seg_index")
    near = near.withColumns({
        "_before": F.sum("_w").over(hardest.rowsBetween(W.unboundedPreceding, -1)),
        "_all": F.sum("_w").over(hardest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    fits = whole & (F.col("_all") <= max_seconds)
    left = F.lit(float(max_seconds)) - F.coalesce("_before", F.lit(0.0))
    take = F.when(fits, F.col("_w")).otherwise(F.least(F.col("_w"), left))
    keep = near.filter(fits | (F.round(left, 9) >= min_window))
    return keep.select(*SEG, (F.col("_s") + (F.col("_w") - take) / 2.0).alias("window_start"), take.alias("window_sec"), "difficulty")


# ---------------------------------------------------------------- distributions

def clip_summary(segs: DataFrame, width: int = 3840, height: int = 2160, fps: float = 30.0,
                 names: dict[str, str] | None = None) -> DataFrame:
    """One row of clip features per video from its segments (duration-weighted means,
    spreads, difficulty statistics, cut and volatility measures, soft levels)."""
    c = {k: k for k in ("motion_mean", "motion_p90", "texture", "entropy", "edge", "noise", "hf_energy", "flatness",
                        "luma_mean", "luma_std", "sat_mean", "chroma_std", "difficulty", "duration")}
    c.update(names or {})
    have = set(segs.columns)
    d = F.col(c["duration"])

    total = F.when(F.sum(d) > 0, F.sum(d)).otherwise(1.0)

    def wmean(name):
        return (F.sum(F.col(c[name]) * d) / total) if c[name] in have else F.lit(None).cast("double")

    diff = F.col(c["difficulty"])
    agg = segs.groupBy("video_id").agg(
        F.count(F.lit(1)).cast("double").alias("segment_count"), F.sum(d).alias("duration"),
        (F.coalesce(F.sum(F.when(diff >= HARD_DIFFICULTY, d)), F.lit(0.0)) / total).alias("hard_fraction"),
        F.max(diff).alias("worst_difficulty"), F.avg(diff).alias("difficulty_mean"), wmean("difficulty").alias("duration_weighted_difficulty"),
        wmean("motion_mean").alias("motion_mean"), F.stddev_pop(c["motion_mean"]).alias("motion_std"), F.max(c["motion_p90"]).alias("motion_p90"),
        wmean("texture").alias("texture"), F.stddev_pop(c["texture"]).alias("texture_std"), wmean("entropy").alias("entropy"),
        wmean("edge").alias("edge_density"), wmean("noise").alias("noise_level"), wmean("hf_energy").alias("high_freq_energy"),
        wmean("flatness").alias("flatness"), wmean("luma_mean").alias("luma_mean"), wmean("luma_std").alias("luma_std"),
        wmean("sat_mean").alias("sat_mean"), wmean("chroma_std").alias("chroma_std"))
    p90 = exact_quantiles(segs, ["video_id"], c["difficulty"], {"difficulty_p90": 0.9})
    out = agg.join(p90, "video_id")
    out = out.withColumn("cut_count", F.greatest(F.lit(0.0), F.col("segment_count") - 1))
    out = out.withColumn("cut_rate", F.col("cut_count") / F.greatest(F.col("duration"), F.lit(1e-6)))
    out = out.withColumn("cut_density", F.least(F.col("cut_rate") / 0.5, F.lit(1.0)))
    one = F.lit(1.0)
    out = out.withColumns({
        "texture_lbp": F.col("texture"),
        "volatility": F.least(one, F.lit(0.35) * F.least(F.col("motion_std") / 0.08, one) + F.lit(0.25) * F.least(F.col("texture_std") / 0.5, one)
                              + F.lit(0.25) * F.least(F.col("cut_density"), one) + F.lit(0.15) * F.col("worst_difficulty")),
        "fps": F.lit(float(fps)), "width": F.lit(float(width)), "height": F.lit(float(height)),
        "short_side": F.lit(float(min(width, height))), "pixels": F.lit(float(max(width * height, 1))),
        "motion_level": soft_level(F.col("motion_p90"), MOTION_MID), "texture_level": soft_level(F.col("texture"), TEXTURE_MID),
        "noise_level_norm": soft_level(F.col("noise_level"), NOISE_MID), "edge_level": soft_level(F.col("edge_density"), EDGE_MID),
        "cut_level": F.col("cut_density")})
    return out.select("video_id", *FEATURE_KEYS)


def to_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form (keys, metric, value)."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return df.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))


def metric_distribution(segs: DataFrame, metrics: list[str], key: str = "video_id") -> DataFrame:
    """mean/max/min/p95/variance/std of several metrics per video."""
    long = to_metrics(segs, [key], metrics)
    return moments_and_quantiles(long, [key, "metric"], "value", {"p95": 0.95}).drop("n")


def difficulty_histogram(segs: DataFrame, key: str = "video_id") -> DataFrame:
    """Counts and fractions per bin (the last bin includes 1.0); empty bins are kept."""
    e = HISTOGRAM_EDGES
    d = F.col("difficulty")
    bins = [F.count_if((d >= lo) & ((d <= hi) if hi == e[-1] else (d < hi))) for lo, hi in zip(e, e[1:])]
    g = segs.groupBy(key).agg(*[b.alias(f"c{i}") for i, b in enumerate(bins)])
    total = sum((F.col(f"c{i}") for i in range(1, len(bins))), F.col("c0"))
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(e[i]).alias("lo"), F.lit(e[i + 1]).alias("hi"), F.col(f"c{i}").alias("n"))
                     for i in range(len(bins))])
    x = g.select(key, total.alias("_t"), F.explode(rows).alias("r"))
    return x.select(key, "r.*", (F.col("r.n") / F.greatest(F.col("_t"), F.lit(1))).alias("fraction"))


def complexity_ratios(segs: DataFrame, key: str = "video_id") -> DataFrame:
    d, dur = F.coalesce("difficulty", F.lit(0.0)), F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))
    hi, lo = d >= HIGH_COMPLEXITY, d <= LOW_COMPLEXITY
    total = F.coalesce(F.nullif(F.sum(dur), F.lit(0.0)), F.lit(1.0))
    n = F.count(F.lit(1))
    return segs.groupBy(key).agg(
        (F.sum(F.when(hi, dur).otherwise(0.0)) / total).alias("high_complexity_ratio"),
        (F.sum(F.when(lo, dur).otherwise(0.0)) / total).alias("low_complexity_ratio"),
        (F.count_if(hi) / n).alias("high_complexity_segment_ratio"), (F.count_if(lo) / n).alias("low_complexity_segment_ratio"),
        F.max_by("seg_index", F.struct(d.alias("d"), (-F.col("seg_index")).alias("i"))).alias("worst_segment_index"))


PERCENTS = (0, 10, 25, 50, 75, 90, 95, 100)


def calibration(df: DataFrame, metrics: list[str], suggest: float = 50.0) -> DataFrame:
    """Percentile report per metric over all finite values, with a midpoint suggestion."""
    long = to_metrics(df, [], metrics).filter(F.col("value").isNotNull() & ~F.isnan("value")
                                              & (F.abs("value") != float("inf")))
    qs = {f"p{p}": p / 100.0 for p in PERCENTS} | {"suggested_mid": suggest / 100.0}
    return moments_and_quantiles(long, ["metric"], "value", qs).drop("min", "max", "variance")


#: Parts of a CRF and of a second that weighted sums are counted in.
CRF_PARTS, TIME_PARTS = 10_000, 1_000_000


def whole_file_setting(segs: DataFrame, weight: str = "duration") -> DataFrame:
    """Weighted CRF and the parameters of the longest segment (last on ties).

    Weights are whole frames where `weight` is an integer column, else seconds in millionths. Sums are
    of integers and the half is rounded to even on integers, so the order of rows never shows. CRF has four places;
    segments without a weight or CRF add nothing, and a video without any weight gets 0.
    """
    w = F.col(weight)
    if segs.schema[weight].dataType.typeName() in ("double", "float", "decimal"):
        w = F.round(w * TIME_PARTS)
    w = w.cast("bigint")
    crf = F.round(F.col("crf") * CRF_PARTS).cast("bigint")
    sums = segs.groupBy("video_id").agg(
        F.coalesce(F.sum((crf * w).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("_sum"),
        (F.coalesce(F.sum(w.cast("decimal(28,0)")), F.lit(0)) * CRF_PARTS).cast("decimal(38,0)").alias("_all"),
        F.max_by("params", F.struct(F.col(weight).alias("d"), F.col("seg_index").alias("i"))).alias("params"))
    sums = sums.withColumn("_whole", F.expr("if(_all > 0, _sum div _all, 0)"))
    up = F.expr("CASE WHEN _all <= 0 THEN 0 WHEN 2 * (_sum - _whole * _all) > _all THEN 1 WHEN 2 * (_sum - _whole * _all) = _all THEN _whole % 2 ELSE 0 END")
    return sums.select("video_id", (F.col("_whole") + up).cast("int").alias("crf"), "params")


def harmonic_pool(frames: DataFrame, score: str, keys: list[str], pooled: str | None = None) -> DataFrame:
    """Harmonic mean of frame quality; a pooled value wins where one is given."""
    h = F.count(score) / F.sum(F.lit(1.0) / F.greatest(F.col(score).cast("double"), F.lit(1e-6)))
    return frames.groupBy(*keys).agg((F.coalesce(F.max(pooled), h) if pooled else h).alias("vmaf"))
