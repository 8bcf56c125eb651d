"""Plan jobs: one table of clips or segments in, one table of settings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions import rules as R
from trialspark.functions.features import rule_inputs
from trialspark.functions.numbers import clamp, half_even, ladder, short_text
from trialspark.functions.text import merge_options
from trialspark.operators.curve import linspace_cqs, next_probes, with_anchor

# Default packs for clips without features.
DEFAULT_PARAMS = "aq-mode=3:rd=5:ref=4:bframes=6:rc-lookahead=40:keyint=48:min-keyint=1:scenecut=40"
DEFAULT_QUALITY_PARAMS = "aq-mode=3:rd=6:ref=5:bframes=8:rc-lookahead=60:me=umh:subme=7:keyint=48:min-keyint=1:scenecut=40"


def segment_rule_table(segs: DataFrame, fps: str | None = None) -> DataFrame:
    """Segments with the columns the setting rules read."""
    x = rule_inputs(segs, fps=fps)
    drop = [c for c in ("flatness", "entropy", "luma_mean", "duration") if c in x.columns]
    x = x.drop(*drop)
    for c in ("flatness", "entropy", "luma", "duration"):
        x = x.withColumnRenamed(f"rule_{c}", "luma_mean" if c == "luma" else c)
    return x.withColumns({"cut_rate": F.lit(0.0), "cut_density": F.lit(0.0)})


def segment_plan(segs: DataFrame, threshold: int) -> DataFrame:
    """CRF seed, AQ strength and full parameter text per segment."""
    x = R.software_settings(segment_rule_table(segs))
    return x.withColumn("crf", R.volatile_crf(R.crf_seed(threshold)))


def plan_params(segs: DataFrame, features: DataFrame, fixed: str, keys=("video_id", "seg_index")) -> DataFrame:
    """Per segment: parameters from its features, or the fixed ones, with the source
    named; one GOP per segment. AQ strength is left to the sweep."""
    feat = R.software_settings(segment_rule_table(features)).select(*keys, F.col("params").alias("_fp"))
    j = segs.select(*keys, "frame_count").join(feat, list(keys), "left")
    n = F.greatest(F.lit(1), F.col("frame_count")).cast("string")
    gop = F.concat(F.lit("keyint="), n, F.lit(":min-keyint="), n, F.lit(":scenecut=0"))
    own = F.regexp_replace("_fp", r"(^|:)aq-strength=[^:]*", "")
    return j.withColumns({"params": merge_options(F.coalesce(own, F.lit(fixed)), gop),
                          "param_source": F.when(F.col("_fp").isNull(), "fixed_fallback").otherwise("features")}).drop("_fp")


def probe_band(clips: DataFrame, count: int, crf_min: int, crf_max: int, threshold: float, spread: int = 2) -> DataFrame:
    """First-round CQs per clip: a content-leaning band round the seed; clips without
    features get an even spread."""
    seed = R.cq_seed(threshold, crf_min, crf_max)["cq_seed"]
    off = R.probe_offsets(count, spread)
    blind = F.col("motion_level").isNull() & F.col("texture_level").isNull()
    x = clips.withColumns({"cq_seed": seed, "_off": off["offsets"], "band": off["band"]})
    center = clamp(F.col("cq_seed"), crf_min, crf_max)
    even = linspace_cqs(crf_min, crf_max, F.lit(count))
    return x.withColumns({
        "cqs": F.when(blind, even).otherwise(R.filled_band(center, F.col("_off"), count, crf_min, crf_max)),
        "cq_seed": F.when(blind, F.get(even, F.floor(F.size(even) / 2).cast("int"))).otherwise(center),
        "band": F.when(blind, "linspace_fallback").otherwise(F.col("band"))}).drop("_off")


def recipes(clips: DataFrame, threshold: int, override: str = "", preset: str = "medium") -> DataFrame:
    """Default and quality pack per clip with the CRF seed."""
    x = R.software_settings(R.software_settings(clips, False, "p_"), True, "q_")
    blind = F.col("motion_level").isNull() & F.col("texture_level").isNull()
    seed = R.volatile_crf(R.crf_seed(threshold))

    def row(name, pre, params, default):
        p = F.when(blind, default).otherwise(F.col(params))
        return F.struct(F.lit(name).alias("recipe"), F.lit(pre).alias("preset"), merge_options(p, F.lit(override)).alias("params"), seed.alias("crf_start"))

    both = F.array(row(f"default_{preset}", preset, "p_params", DEFAULT_PARAMS), row("default_quality", "slow", "q_params", DEFAULT_QUALITY_PARAMS))
    return x.select("video_id", F.explode(both).alias("r")).select("video_id", "r.*")


def fine_box(best: DataFrame, crf_min: int, crf_max: int, radius: int, aq_radius: float, aq_step: float) -> DataFrame:
    """Fine (crf, aq) grid round the best coarse point of every video."""
    c, a = F.col("crf"), F.col("aq_strength")
    crfs = F.sequence(F.greatest(F.lit(crf_min), c - radius), F.least(F.lit(crf_max), c + radius))
    aqs = R.float_grid(F.greatest(F.lit(0.1), a - aq_radius), F.least(F.lit(2.0), a + aq_radius), aq_step)
    x = best.select("video_id", F.explode(crfs).alias("fine_crf"), F.coalesce(aqs, F.array(a)).alias("_a"))
    return x.select("video_id", "fine_crf", F.explode("_a").alias("fine_aq"))


def hardware_variants(clips: DataFrame) -> DataFrame:
    """Ranked knob changes per clip. Every firing rule gives (priority, change, reason);
    the highest priority comes first, equal changes are kept once.

    Reads the features and the clip's current `nvenc_*` columns.
    """
    lv = R.levels()
    mot, tex, noise, edge, cuts, fps = (lv[k] for k in ("motion", "texture", "noise", "edge", "cuts", "fps"))
    aq = F.coalesce("nvenc_aq_strength", F.lit(8))
    saq, taq = F.coalesce("nvenc_spatial_aq", F.lit(True)), F.coalesce("nvenc_temporal_aq", F.lit(True))
    look, bf = F.coalesce("nvenc_rc_lookahead", F.lit(0)), F.coalesce("nvenc_bf", F.lit(0))
    gop, bref = F.col("nvenc_gop"), F.coalesce(F.nullif("nvenc_b_ref_mode", F.lit("")), F.lit("disabled"))
    multipass = F.coalesce(F.col("nvenc_multipass"), F.lit("qres")) if "nvenc_multipass" in clips.columns else F.lit("qres")
    down, up = F.greatest(F.lit(1), aq - 4), F.least(F.lit(15), aq + 4)
    bf_t = F.when(mot >= 0.7, 4).otherwise(3)
    la_t = F.when(fps >= 50, 32).otherwise(20)
    gop_t, gop_alt = F.greatest(F.lit(24), half_even(fps)), R.segment_gop()
    la_cut = F.greatest(F.lit(20), look)

    def s(x):
        return x.cast("string") if isinstance(x, Column) else F.lit(x)

    def change(cond, pri, knob, value, reason, also=""):
        val = s(value)
        return F.when(cond, F.struct((-pri).alias("neg"), reason.alias("reason"), F.concat(F.lit(f"{knob}="), val, F.lit(also)).alias("change"),
                                     pri.alias("priority")))

    def p(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    def tag(name, value=None):
        return F.lit(name) if value is None else F.concat(F.lit(name), s(value))

    noisy, rich, moving = noise >= 0.4, ((tex >= 0.4) | (edge >= 0.4)) & (noise < 0.55), mot >= 0.4
    rules = [
        change(multipass != "fullres", p(0.55), "nvenc_multipass", "fullres", tag("feat_multipass_fullres")),
        change(noisy & (down != aq), p(0.95) + 0.05 * noise, "nvenc_aq_strength", down, tag("feat_noise_aq_", down)),
        change(noisy & taq, p(0.85) + 0.1 * noise, "nvenc_temporal_aq", "false", tag("feat_noise_taq_off")),
        change(rich & (up != aq), p(0.8) + 0.15 * F.greatest(tex, edge), "nvenc_aq_strength", up, tag("feat_texture_aq_", up), ";nvenc_spatial_aq=true"),
        change(rich & ~saq, p(0.7), "nvenc_spatial_aq", "true", tag("feat_texture_saq_on")),
        change(moving & ~taq & (noise < 0.4), p(0.88), "nvenc_temporal_aq", "true", tag("feat_motion_taq_on")),
        change(moving & (bf < bf_t), p(0.75) + 0.1 * mot, "nvenc_bf", bf_t, tag("feat_motion_bf_", bf_t)),
        change(moving & (look < la_t), p(0.7) + 0.1 * mot, "nvenc_rc_lookahead", la_t, tag("feat_motion_la_", la_t)),
        change(moving & (bref == "disabled"), p(0.6), "nvenc_b_ref_mode", "middle", tag("feat_motion_bref_middle")),
        change(moving & (bref == "middle"), p(0.25), "nvenc_b_ref_mode", "each", tag("feat_bref_each")),
        change((cuts >= 0.35) & (gop.isNull() | (gop > gop_t)), p(0.78) + 0.1 * cuts, "nvenc_gop", gop_t, tag("feat_cuts_gop_", gop_t)),
        change((cuts >= 0.35) & (look < la_cut), p(0.65), "nvenc_rc_lookahead", la_cut, tag("feat_cuts_la_", la_cut)),
        change((cuts < 0.35) & F.coalesce(gop < gop_alt, F.lit(False)), p(0.35), "nvenc_gop", gop_alt, tag("feat_gop_alt_", gop_alt)),
        change(taq & (noise < 0.4), p(0.3), "nvenc_temporal_aq", "false", tag("feat_taq_off")),
        change(saq & (tex < 0.35) & (noise < 0.4), p(0.25), "nvenc_spatial_aq", "false", tag("feat_saq_off"))]
    x = clips.withColumn("_v", F.array_sort(F.array_compact(F.array(*rules))))
    x = x.withColumn("_c", F.transform("_v", lambda v: v["change"]))
    x = x.withColumn("_u", F.filter("_v", lambda v, i: F.array_position(F.col("_c"), v["change"]) == i + 1))
    return x.select("video_id", F.posexplode("_u").alias("pos", "v")).select(
        "video_id", (F.col("pos") + 1).alias("rank"), "v.change", "v.reason", "v.priority")


def next_round(curve_rows: DataFrame, variants: DataFrame, preprocess: DataFrame | None, param_trials: int, cq_trials: int,
               crf_min: int, crf_max: int, threshold: float) -> DataFrame:
    """Mixed next round per video: the preprocess trial, knob changes at the anchor CQ,
    then fresh CQs. `curve_rows` has one curve per video_id."""
    a = with_anchor(curve_rows.filter(F.size("pts") > 0), threshold).select(
        "video_id", F.col("anchor.cq").alias("cq"), F.col("anchor.s_f").alias("predicted_s_f"))
    none = F.lit(None).cast("string")
    knobs = variants.filter(F.col("rank") <= max(0, param_trials)).join(a, "video_id").select(
        "video_id", F.lit(2).alias("part"), F.col("rank"), "cq", "change", "reason", "predicted_s_f")
    fresh = next_probes(curve_rows.filter(F.size("pts") > 0), max(0, cq_trials), crf_min, crf_max, threshold, ["video_id"]).select(
        "video_id", F.lit(3).alias("part"), F.col("cq").alias("rank"), "cq", none.alias("change"),
        F.concat(F.lit("refine_cq:"), "probe_reason").alias("reason"), "predicted_s_f")
    out = knobs.unionByName(fresh)
    if preprocess is not None:
        pre = preprocess.join(a, "video_id").select(
            "video_id", F.lit(1).alias("part"), F.lit(1).alias("rank"), "cq", F.concat(F.lit("preprocess="), "preprocess").alias("change"),
            F.concat(F.lit("preprocess_experiment:"), "preprocess").alias("reason"), "predicted_s_f")
        out = pre.unionByName(out)
    return out
