"""Setting plan queries over clips and segments."""

from pyspark.sql import functions as F

from trialspark.functions import rules as R
from trialspark.functions.features import rule_inputs
from trialspark.operators import curve as C, plan as P, trials as T
from trialspark.plans.registry import query, view
from trialspark.plans.segments import clips
from trialspark.session import materialize

MASH = "(0.5::DOUBLE * worst_difficulty + 0.3::DOUBLE * volatility + 0.2::DOUBLE * hard_fraction)"
BIAS = """(CASE WHEN worst_difficulty >= 0.7 OR hard_fraction >= 0.45 OR cut_rate >= 0.35 OR volatility >= 0.55 THEN -3 WHEN worst_difficulty >= 0.55 OR hard_fraction >= 0.3 OR cut_rate >= 0.2 OR volatility >= 0.35 THEN -2
 WHEN worst_difficulty >= 0.4 OR cut_density >= 0.15 OR volatility >= 0.2 THEN -1 ELSE 0 END - CASE WHEN texture >= 1.2 OR hard_fraction >= 0.5 THEN 1 ELSE 0 END)"""
MODE = f"""CASE WHEN noise_level_norm >= 0.5 OR texture_level >= 0.87 OR edge_level >= 0.62 OR {MASH} >= 0.52 THEN 1 WHEN texture_level < 0.86 AND edge_level < 0.55 THEN 2 WHEN motion_level >= 0.68 AND texture_level >= 0.84 THEN 1 ELSE 2 END"""
GOP = "CASE WHEN duration > 0 THEN greatest(30, least(60, CAST(round_even(duration / greatest(1, segment_count) * 30.0::DOUBLE, 0) AS INT))) END"


def strength_sql(src):
    return f"""(SELECT *, round_even(greatest(0.8, least(1.4, CASE WHEN lum < 90 AND noise_level_norm >= 0.45 THEN least(s4, 1.0) WHEN lum < 90 AND noise_level_norm < 0.4 THEN greatest(s4, 1.15) ELSE s4 END)), 2)::DOUBLE AS aq_strength FROM
(SELECT *, CASE WHEN flatness >= 0.55 AND motion_level < 0.4 AND edge_level < 0.35 THEN least(s3, 1.0) ELSE s3 END AS s4 FROM (SELECT *, CASE WHEN flatness >= 0.6 AND motion_level < 0.45 AND texture_level < 0.55 THEN least(s2, 1.0) ELSE s2 END AS s3 FROM
(SELECT *, CASE WHEN texture_level >= 0.87 AND edge_level >= 0.6 THEN greatest(s1, 1.3) ELSE s1 END AS s2 FROM (SELECT *, CASE WHEN motion_level >= 0.52 AND texture_level >= 0.55 THEN greatest(s0, 1.2) ELSE s0 END AS s1 FROM
(SELECT *, (1.0 + CASE WHEN texture_level >= 0.75 THEN 0.35 WHEN texture_level >= 0.55 THEN 0.2 WHEN texture_level < 0.3 THEN -0.2 WHEN texture_level < 0.4 THEN -0.1 ELSE 0 END + CASE WHEN texture_level < 0.75 AND edge_level >= 0.62 THEN 0.05 ELSE 0 END
 + CASE WHEN entropy >= 0.65 AND texture_level < 0.75 THEN 0.05 ELSE 0 END + CASE WHEN noise_level_norm >= 0.55 THEN -0.3 WHEN noise_level_norm >= 0.5 THEN -0.2 WHEN noise_level_norm >= 0.4 THEN -0.1 WHEN noise_level_norm < 0.25 THEN 0.1 ELSE 0 END
 + CASE WHEN motion_level >= 0.68 THEN 0.1 WHEN motion_level >= 0.52 THEN 0.05 ELSE 0 END + CASE WHEN flatness >= 0.7 THEN -0.2 WHEN flatness >= 0.55 THEN -0.1 ELSE 0 END
 + CASE WHEN noise_level_norm >= 0.5 THEN 0 WHEN lum < 60 THEN 0.2 WHEN lum < 90 THEN 0.1 ELSE 0 END)::DOUBLE AS s0 FROM (SELECT *, coalesce(nullif(luma_mean, 0), 128) AS lum FROM {src}) AS q0) AS q1) AS q2) AS q3) AS q4) AS q5)"""


def short_sql(x):
    return f"regexp_replace(fixed_text({x}, 2), '\\.?0+$', '')"


def software_sql(src):
    return f"""(SELECT *, 'aq-mode=' || aq_mode || ':aq-strength=' || {short_sql('aq_strength')} || ':rd=' || CASE WHEN mash >= 0.6 THEN 6 ELSE 5 END || ':ref=' || CASE WHEN motion_level >= 0.52 OR mash >= 0.6 THEN 5 ELSE 4 END
 || ':bframes=' || CASE WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 4 ELSE 8 END || ':rc-lookahead=' || greatest(CASE WHEN motion_level >= 0.52 THEN 50 WHEN motion_level >= 0.48 THEN 40 WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 20 ELSE 40 END, CASE WHEN cut_level >= 0.35 THEN 40 ELSE 0 END)
 || ':keyint=' || coalesce(gop, 48) || ':min-keyint=1:scenecut=' || CASE WHEN cut_level >= 0.35 THEN 60 WHEN cut_level >= 0.2 THEN 50 ELSE 40 END AS params
FROM (SELECT *, {MODE} AS aq_mode, {MASH} AS mash, {GOP} AS gop FROM {strength_sql(src)} AS a0) AS a1)"""


view("v_seg_rules", """SELECT video_id, seg_key, seg_index, frame_count, motion_p90 / (motion_p90 + 0.145::DOUBLE) AS motion_level, texture / (texture + 4.22::DOUBLE) AS texture_level, noise / (noise + 0.048::DOUBLE) AS noise_level_norm,
edge / (edge + 0.0475::DOUBLE) AS edge_level, 0.0::DOUBLE AS cut_level, flatness, coalesce(nullif(entropy, 0), 0.5::DOUBLE) AS entropy, coalesce(nullif(luma_mean, 0), 0.5::DOUBLE) * 255.0::DOUBLE AS luma_mean, difficulty AS worst_difficulty,
CASE WHEN difficulty >= 0.45 THEN 1.0::DOUBLE ELSE 0.0 END AS hard_fraction, 0.0::DOUBLE AS volatility, 1.0::DOUBLE AS segment_count, greatest(duration, 0.1::DOUBLE) AS duration, 0.0::DOUBLE AS cut_rate, 0.0::DOUBLE AS cut_density, texture FROM v_segments_d""")


@query("i01_crf_seed", f"SELECT video_id, greatest(8, 18 + {BIAS}) AS crf_85, greatest(8, 16 + {BIAS}) AS crf_89, greatest(8, 14 + {BIAS}) AS crf_93 FROM v_clips")
def _(t):
    return clips(t).select("video_id", *[R.volatile_crf(R.crf_seed(x)).alias(f"crf_{x}") for x in (85, 89, 93)])


@query("i02_cq_seed", f"""WITH d AS (SELECT *, {MASH} AS m, greatest(0.0, least(1.0, 0.35 * texture_level + 0.25 * motion_level + 0.15 * edge_level + 0.15 * {MASH} + 0.1 * cut_level)) AS df FROM v_clips),
b AS (SELECT *, (0.4 - df) * 18 * 0.7 - CASE WHEN texture_level >= 0.85 THEN 5 WHEN texture_level >= 0.7 THEN 3 WHEN texture_level >= 0.55 THEN 1.5 ELSE 0 END - CASE WHEN motion_level >= 0.65 THEN 3 WHEN motion_level >= 0.5 THEN 1.5 ELSE 0 END
 - CASE WHEN m >= 0.6 THEN 3 WHEN m >= 0.45 THEN 1.5 ELSE 0 END - CASE WHEN edge_level >= 0.65 AND texture_level >= 0.55 THEN 1 ELSE 0 END - CASE WHEN noise_level_norm >= 0.55 THEN 1.5 WHEN noise_level_norm >= 0.45 THEN 0.5 ELSE 0 END
 + CASE WHEN df <= 0.35 AND m < 0.35 THEN 2 ELSE 0 END AS bias FROM d)
SELECT video_id, CAST(greatest(25, least(34, round_even(22 + 18 * 0.45 + bias, 0))) AS INT) AS cq_seed, df::DOUBLE AS seed_difficulty, bias::DOUBLE AS seed_bias FROM b""", "seed_difficulty seed_bias")
def _(t):
    return clips(t).select("video_id", *[v.alias(k) for k, v in R.cq_seed(89, 22, 40).items()])


CQ_SEED = """(SELECT *, CAST(greatest(25, least(34, round_even(22 + 18 * 0.45 + bias, 0))) AS INT) AS cq_seed FROM (SELECT *, (0.4 - df) * 18 * 0.7 - CASE WHEN texture_level >= 0.85 THEN 5 WHEN texture_level >= 0.7 THEN 3 WHEN texture_level >= 0.55 THEN 1.5 ELSE 0 END - CASE WHEN motion_level >= 0.65 THEN 3 WHEN motion_level >= 0.5 THEN 1.5 ELSE 0 END
 - CASE WHEN m >= 0.6 THEN 3 WHEN m >= 0.45 THEN 1.5 ELSE 0 END - CASE WHEN edge_level >= 0.65 AND texture_level >= 0.55 THEN 1 ELSE 0 END - CASE WHEN noise_level_norm >= 0.55 THEN 1.5 WHEN noise_level_norm >= 0.45 THEN 0.5 ELSE 0 END + CASE WHEN df <= 0.35 AND m < 0.35 THEN 2 ELSE 0 END AS bias
 FROM (SELECT *, greatest(0.0, least(1.0, 0.35 * texture_level + 0.25 * motion_level + 0.15 * edge_level + 0.15 * m + 0.1 * cut_level)) AS df FROM (SELECT *, """ + MASH + """ AS m FROM v_clips) AS x0) AS x1) AS x2)"""


@query("i03_probe_band", f"""SELECT video_id, cq_seed, band, CASE band WHEN 'hard_down_band' THEN (cq_seed - 2) || ',' || cq_seed WHEN 'noise_down_band' THEN (cq_seed - 1) || ',' || cq_seed WHEN 'default_bracket' THEN (cq_seed - 1) || ',' || (cq_seed + 2) ELSE cq_seed || ',' || (cq_seed + 2) END AS cqs,
greatest(22, cq_seed - 4) || ',' || (cq_seed - 2) || ',' || cq_seed AS quality_cqs FROM (SELECT *, CASE WHEN m >= 0.55 THEN 'hard_down_band' WHEN motion_level >= 0.52 THEN 'hard_up_band' WHEN noise_level_norm >= 0.5 THEN 'noise_down_band'
 WHEN 0.3 * motion_level + 0.25 * texture_level + 0.2 * edge_level + 0.15 * cut_level + 0.1 * noise_level_norm < 0.45 THEN 'easy_up_band' ELSE 'default_bracket' END AS band FROM {CQ_SEED} AS y) AS z""")
def _(t):
    two = P.probe_band(clips(t), 2, 22, 40, 89.0)
    return two.select("video_id", "cq_seed", "band", F.array_join(F.col("cqs").cast("array<string>"), ",").alias("cqs"),
                      F.array_join(R.quality_band(F.col("cq_seed"), 22, 40).cast("array<string>"), ",").alias("quality_cqs"))


@query("i04_aq_mode", f"""SELECT video_id, {MODE} AS aq_mode, CASE WHEN texture_level > 0.8 AND noise_level_norm < 0.15 AND cut_count < 3 THEN 1 ELSE 2 END AS aq_mode_fixed FROM v_clips""")
def _(t):
    return clips(t).select("video_id", R.aq_mode().alias("aq_mode"), R.aq_mode_fixed_pack().alias("aq_mode_fixed"))


@query("i05_aq_strength", f"SELECT seg_key, aq_strength FROM {strength_sql('v_seg_rules')} AS x")
def _(t):
    s, _ = R.aq_strength()
    return P.segment_rule_table(t.segments_d).select("seg_key", s.alias("aq_strength"))


REASONS = f"""list_filter(['aq-strength=' || {short_sql('aq_strength')} || ' (base 1.0)',
 CASE WHEN texture_level >= 0.75 THEN 'very_high_texture=' || fixed_text(texture_level, 2) || ' +0.35' WHEN texture_level >= 0.55 THEN 'high_texture=' || fixed_text(texture_level, 2) || ' +0.20' WHEN texture_level < 0.3 THEN 'very_low_texture=' || fixed_text(texture_level, 2) || ' -0.20' WHEN texture_level < 0.4 THEN 'low_texture=' || fixed_text(texture_level, 2) || ' -0.10' END,
 CASE WHEN texture_level < 0.75 AND edge_level >= 0.62 THEN 'high_edge=' || fixed_text(edge_level, 2) || ' +0.05' END, CASE WHEN entropy >= 0.65 AND texture_level < 0.75 THEN 'high_entropy=' || fixed_text(entropy, 2) || ' +0.05' END,
 CASE WHEN noise_level_norm >= 0.55 THEN 'very_high_noise=' || fixed_text(noise_level_norm, 2) || ' -0.30' WHEN noise_level_norm >= 0.5 THEN 'high_noise=' || fixed_text(noise_level_norm, 2) || ' -0.20' WHEN noise_level_norm >= 0.4 THEN 'medium_noise=' || fixed_text(noise_level_norm, 2) || ' -0.10' WHEN noise_level_norm < 0.25 THEN 'very_low_noise=' || fixed_text(noise_level_norm, 2) || ' +0.10' END,
 CASE WHEN motion_level >= 0.68 THEN 'very_high_motion=' || fixed_text(motion_level, 2) || ' +0.10' WHEN motion_level >= 0.52 THEN 'high_motion=' || fixed_text(motion_level, 2) || ' +0.05' END,
 CASE WHEN flatness >= 0.7 THEN 'extremely_flat=' || fixed_text(flatness, 2) || ' -0.20' WHEN flatness >= 0.55 THEN 'large_flat=' || fixed_text(flatness, 2) || ' -0.10' END,
 CASE WHEN noise_level_norm >= 0.5 THEN NULL WHEN lum < 60 THEN 'very_dark_luma=' || fixed_text(lum, 0) || ' +0.20' WHEN lum < 90 THEN 'dark_luma=' || fixed_text(lum, 0) || ' +0.10' END,
 CASE WHEN s1 > s0 THEN 'sports_like → floor 1.2' END, CASE WHEN s2 > s1 THEN 'forest_like → floor 1.3' END, CASE WHEN flatness >= 0.6 AND motion_level < 0.45 AND texture_level < 0.55 THEN 'anime_flat → cap 1.0' END,
 CASE WHEN flatness >= 0.55 AND motion_level < 0.4 AND edge_level < 0.35 THEN 'screen_like → cap 1.0' END,
 CASE WHEN lum < 90 AND noise_level_norm >= 0.45 THEN 'dark_noisy → cap 1.0' WHEN lum < 90 AND noise_level_norm < 0.4 AND s4 < 1.15 THEN 'dark_clean → floor 1.15' END], lambda x: x IS NOT NULL)"""


@query("i05_aq_strength_reasons", f"SELECT video_id, CAST(generate_subscripts(why, 1) - 1 AS INT) AS pos, unnest(why) AS reason FROM (SELECT video_id, {REASONS} AS why FROM {strength_sql('v_clips')} AS x) AS y")
def _(t):
    _, why = R.aq_strength()
    return clips(t).select("video_id", F.posexplode(why).alias("pos", "reason"))


@query("i06_full_param_set", f"SELECT video_id, params FROM {software_sql('v_clips')} AS x")
def _(t):
    return R.software_settings(clips(t)).select("video_id", "params")


@query("i07_hardware_param_set", f"""SELECT video_id, CASE WHEN noise_level_norm >= 0.55 THEN 4 WHEN noise_level_norm >= 0.5 THEN 5 WHEN texture_level >= 0.5 OR edge_level >= 0.5 THEN CASE WHEN greatest(texture_level, edge_level) >= 0.55 THEN 12 ELSE 10 END ELSE 8 END AS nvenc_aq_strength,
CASE WHEN noise_level_norm >= 0.5 THEN FALSE WHEN texture_level >= 0.5 OR edge_level >= 0.5 THEN CASE WHEN motion_level >= 0.48 THEN TRUE END ELSE TRUE END AS nvenc_temporal_aq,
CASE WHEN noise_level_norm >= 0.55 THEN TRUE WHEN noise_level_norm >= 0.5 THEN NULL ELSE TRUE END AS nvenc_spatial_aq, CASE WHEN motion_level >= 0.52 THEN 4 WHEN motion_level >= 0.48 THEN 3 WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 2 END AS nvenc_bf,
CASE WHEN cut_level >= 0.35 THEN 20 WHEN motion_level >= 0.48 THEN 20 WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 8 END AS nvenc_rc_lookahead,
CASE WHEN motion_level >= 0.48 THEN 'middle' WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 'disabled' END AS nvenc_b_ref_mode, {GOP} AS nvenc_gop FROM v_clips""")
def _(t):
    return clips(t).select("video_id", *[v.alias(k) for k, v in R.hardware_settings().items()])


@query("i08_preprocess_choice", """SELECT seg_key, CASE WHEN noise_level_norm >= 0.55 THEN CASE WHEN motion_level >= 0.55 AND coalesce(nullif(texture_level, 0), 0.5) < 0.45 THEN 'atadenoise_light' WHEN coalesce(nullif(texture_level, 0), 0.5) >= 0.55 THEN 'bilateral_light' ELSE 'hqdn3d_med' END
WHEN noise_level_norm >= 0.52 THEN 'hqdn3d_light' WHEN noise_level_norm < 0.48 AND edge_level >= 0.6 THEN 'unsharp_mild' WHEN noise_level_norm < 0.48 AND flatness >= 0.55 THEN 'contrast_mild' ELSE 'none' END AS preprocess FROM v_seg_rules""")
def _(t):
    return P.segment_rule_table(t.segments_d).select("seg_key", R.preprocess_choice().alias("preprocess"))


@query("i09_segment_plan", f"SELECT video_id, seg_index, greatest(8, 18 + {BIAS}) AS crf, aq_strength, params FROM {software_sql('v_seg_rules')} AS x")
def _(t):
    return P.segment_plan(t.segments_d, 85).select("video_id", "seg_index", "crf", "aq_strength", "params")


@query("i10_clip_report", f"""SELECT video_id, greatest(8, 18 + {BIAS}) AS crf_85, greatest(8, 16 + {BIAS}) AS crf_89, greatest(8, 14 + {BIAS}) AS crf_93,
cut_rate >= 0.15 OR hard_fraction >= 0.25 OR volatility >= 0.35 OR segment_count >= 4 AS mashup_like, segment_count, worst_difficulty FROM v_clips""")
def _(t):
    return clips(t).select("video_id", *[R.volatile_crf(R.crf_seed(x)).alias(f"crf_{x}") for x in (85, 89, 93)],
                           R.mashup_like().alias("mashup_like"), "segment_count", "worst_difficulty")


@query("i11_fine_grid_box", """SELECT video_id, fine_crf::INT AS fine_crf, round_even(lo + i * 0.05::DOUBLE, 4) AS fine_aq FROM (SELECT *, unnest(range(greatest(22, c - 2), least(42, c + 2) + 1)) AS fine_crf FROM (SELECT *, unnest(range(0, CAST(floor((hi - lo) / 0.05::DOUBLE + 1e-6) AS INT) + 1)) AS i FROM
(SELECT video_id, oracle_crf AS c, greatest(0.1::DOUBLE, oracle_aq_strength - 0.1::DOUBLE) AS lo, least(2.0::DOUBLE, oracle_aq_strength + 0.1::DOUBLE) AS hi FROM v_labels) AS a WHERE hi - lo > -1e-6) AS b) AS c
UNION ALL SELECT video_id, unnest(range(greatest(22, oracle_crf - 2), least(42, oracle_crf + 2) + 1))::INT, oracle_aq_strength FROM v_labels WHERE least(2.0::DOUBLE, oracle_aq_strength + 0.1::DOUBLE) < greatest(0.1::DOUBLE, oracle_aq_strength - 0.1::DOUBLE) - 1e-6""", "fine_aq")
def _(t):
    return P.fine_box(T.oracle_best(t.scored, ["video_id"]), 22, 42, 2, 0.1, 0.05)


@query("i11_bitrate_grid", """SELECT DISTINCT o_orderkey, round_even(a + (b - a) * i / 4.0::DOUBLE, 3) AS mbps FROM (SELECT o_orderkey, least(o_totalprice / 100000, 3.0::DOUBLE) AS a, greatest(o_totalprice / 100000, 3.0::DOUBLE) AS b, unnest(range(0, 5)) AS i FROM orders) AS x""", "mbps")
def _(t):
    return t.orders.select("o_orderkey", F.explode(R.bitrate_grid(F.col("o_totalprice") / 100000.0, F.lit(3.0), 5)).alias("mbps"))


UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("i12_knob_candidates", f"""WITH b AS (SELECT *, motion_level >= 0.55 AS fast, CASE WHEN motion_level >= 0.52 OR mash >= 0.6 THEN 5 ELSE 4 END AS ref, CASE WHEN mash >= 0.6 THEN 6 ELSE 5 END AS rd, CASE WHEN motion_level < 0.45 AND noise_level_norm < 0.48 THEN 4 ELSE 8 END AS bf,
 CAST(regexp_extract(params, 'rc-lookahead=([0-9]+)', 1) AS INT) AS la FROM {software_sql('v_clips')} AS x),
l AS (SELECT *, list_transform(CASE WHEN texture_level >= 0.7 THEN [0, 0.1, 0.2, -0.1] WHEN noise_level_norm >= 0.45 THEN [0, -0.1, -0.2, 0.1] ELSE [0, -0.1, 0.1, -0.2, 0.2] END, lambda d: round_even(greatest(0.8::DOUBLE, least(1.4::DOUBLE, aq_strength + d::DOUBLE)), 2)) AS ls,
 list_transform(CASE WHEN fast THEN [la, la + 10, la + 20, la - 10] ELSE [la, la + 10, la - 10, la + 20] END, lambda v: (greatest(20, least(80, v)))::DOUBLE) AS ll FROM b),
k AS (SELECT video_id, 'aq-mode' AS knob, CASE WHEN texture_level >= 0.75 OR noise_level_norm >= 0.45 OR aq_mode = 1 THEN [1.0::DOUBLE, 2, 3] ELSE [2.0::DOUBLE, 1, 3] END AS v FROM l
UNION ALL SELECT video_id, 'aq-strength', ({UNIQ.format('ls')})[1:4] FROM l UNION ALL SELECT video_id, 'rd', CASE rd WHEN 6 THEN [6.0::DOUBLE, 5] ELSE [5.0::DOUBLE, 6, 4] END FROM l
UNION ALL SELECT video_id, 'ref', CASE WHEN ref = 5 THEN [5.0::DOUBLE, 6, 4] WHEN fast THEN [4.0::DOUBLE, 5, 6, 3] ELSE [4.0::DOUBLE, 5, 3] END FROM l UNION ALL SELECT video_id, 'bframes', CASE WHEN bf = 8 AND fast THEN [8.0::DOUBLE] WHEN bf = 8 THEN [8.0::DOUBLE, 6] WHEN fast THEN [4.0::DOUBLE, 6, 8] ELSE [4.0::DOUBLE, 6, 2] END FROM l
UNION ALL SELECT video_id, 'rc-lookahead', ({UNIQ.format('ll')})[1:4] FROM l)
SELECT video_id, knob, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, unnest(v) AS value FROM k""")
def _(t):
    x = R.software_settings(clips(t))
    names = {"aq-mode": "aq_mode", "aq-strength": "aq_strength", "rd": "rd", "ref": "ref", "bframes": "bframes", "rc-lookahead": "rc_lookahead"}
    c = R.knob_candidates({k: F.col(v) for k, v in names.items()})
    rows = F.array(*[F.struct(F.lit(k).alias("knob"), v.alias("vals")) for k, v in c.items()])
    return x.select("video_id", F.explode(rows).alias("r")).select("video_id", "r.knob", F.posexplode("r.vals").alias("pos", "value"))


@query("i13_bump_and_budget", """SELECT k1, k2, k3, k4, vmaf_neg - 85 >= 2 AS try_bump, greatest(1, least(greatest(1, crf % 7), (segment_index + 1) * greatest(1, CAST(floor(size_in / 100.0::DOUBLE / 90.0) AS INT)))) AS affordable FROM v_trials""")
def _(t):
    return t.trials.select("k1", "k2", "k3", "k4", R.try_crf_bump(F.col("vmaf_neg"), 85.0).alias("try_bump"),
                           R.affordable(F.col("size_in") / 100.0, F.col("crf") % 7, F.col("segment_index") + 1, F.lit(90.0)).alias("affordable"))


@query("i14_hardware_variants")
def _(t):
    x = clips(t)
    return P.hardware_variants(x.select("*", *[v.alias(k) for k, v in R.hardware_settings().items()]))


@query("i15_mixed_next_round")
def _(t):
    x = materialize(clips(t), "clips")  # read by two branches
    var = P.hardware_variants(x.select("*", *[v.alias(k) for k, v in R.hardware_settings().items()]))
    pre = x.select("video_id", R.preprocess_choice().alias("preprocess")).filter("preprocess <> 'none'")
    c = materialize(C.curves(C.observations(t.scored, ["video_id"]), ["video_id"]), "curves")  # read by three branches
    return P.next_round(c, var, pre, 2, 2, 16, 46, 93.0)


@query("i16_sample_plan", """WITH p AS (SELECT video_id, duration * 40 AS d, greatest(2, CAST(ceil(duration * 40 / 300.0::DOUBLE) AS INT), 1) AS want, CAST(segment_count AS INT) AS sc FROM v_clips),
c AS (SELECT *, least(12, want, greatest(1, sc)) AS n0 FROM p), n AS (SELECT *, CASE WHEN n0 * 3.0 >= d * 0.85 THEN 1 ELSE n0 END AS n FROM c)
SELECT video_id, n AS sample_count, i::INT AS sample_idx, greatest(0, d - n * 3.0::DOUBLE) / (n + 1.0::DOUBLE) * (i + 1) + i * 3.0::DOUBLE AS start_sec FROM (SELECT *, unnest(range(0, n)) AS i FROM n) AS x""", "start_sec")
def _(t):
    d = F.col("duration") * 40.0
    x = clips(t).select("video_id", d.alias("d"), *[v.alias(k) for k, v in R.sample_plan(d, F.col("segment_count").cast("int"), F.lit(None).cast("int"), every=300.0, least=2).items()])
    return x.select("video_id", "sample_count", F.posexplode(R.sample_starts(F.col("d"), F.col("sample_count"), 3.0)).alias("sample_idx", "start_sec"))


CLIP_PRE = """CASE WHEN noise_level_norm >= 0.55 THEN CASE WHEN motion_level >= 0.55 AND coalesce(nullif(texture_level, 0), 0.5) < 0.45 THEN 'atadenoise_light' WHEN coalesce(nullif(texture_level, 0), 0.5) >= 0.55 THEN 'bilateral_light' ELSE 'hqdn3d_med' END
WHEN noise_level_norm >= 0.52 THEN 'hqdn3d_light' WHEN noise_level_norm < 0.48 AND edge_level >= 0.6 THEN 'unsharp_mild' WHEN noise_level_norm < 0.48 AND flatness >= 0.55 THEN 'contrast_mild' ELSE 'none' END"""


@query("i17_preprocess_candidates", f"""WITH c AS (SELECT video_id, {CLIP_PRE} AS pick FROM v_clips), l AS (SELECT *, CASE video_id % 5 WHEN 0 THEN {list(R.SURVEY_SET)} WHEN 1 THEN {list(R.BRAVE_SET)} WHEN 2 THEN ['hqdn3d_med'] ELSE ['none'] END AS base FROM c),
v AS (SELECT video_id, CASE WHEN video_id % 5 = 2 OR pick = 'none' OR list_contains(base, pick) THEN base ELSE list_append(base, pick) END AS v FROM l)
SELECT video_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, unnest(v) AS preprocess FROM v""")
def _(t):
    explicit = F.when(F.col("video_id") % 5 == 0, "sweep").when(F.col("video_id") % 5 == 1, "Brave").when(F.col("video_id") % 5 == 2, "hqdn3d_med")
    return clips(t).select("video_id", F.posexplode(R.preprocess_candidates(explicit)).alias("pos", "preprocess"))


@query("i18_recipe_table", f"""WITH s AS (SELECT *, greatest(8, 16 + {BIAS}) AS seed FROM {software_sql('v_clips')} AS x), m AS (SELECT *, CASE WHEN texture_level > 0.8 AND noise_level_norm < 0.15 AND cut_count < 3 THEN 1 ELSE 2 END AS fm FROM s)
SELECT video_id, 'default_medium' AS recipe, 'medium' AS preset, regexp_replace(params, ':rd=[0-9]+', ':rd=4') AS params, seed AS crf_start FROM m
UNION ALL SELECT video_id, 'default_quality', 'slow', regexp_replace(regexp_replace(params, ':rd=[0-9]+', ':rd=4'), ':ref=[0-9]+', ':ref=5') || ':me=umh:subme=7', seed FROM m
UNION ALL SELECT video_id, 'crf_pack', 'slow', 'aq-mode=' || fm || ':aq-strength=1:rd=6:ref=6:bframes=12:rc-lookahead=50:keyint=60:min-keyint=1:scenecut=50', NULL FROM m
UNION ALL SELECT video_id, 'vbr_pack', 'slow', 'aq-mode=' || fm || ':aq-strength=1.2:rd=6:ref=6:bframes=8:rc-lookahead=50:keyint=60:min-keyint=1:scenecut=50', NULL FROM m""")
def _(t):
    x = clips(t)
    a = P.recipes(x, 89, override="rd=4")
    b = x.select("video_id", F.explode(F.array(
        F.struct(F.lit("crf_pack").alias("recipe"), F.lit("slow").alias("preset"), R.pack_params(R.CRF_PACK).alias("params")),
        F.struct(F.lit("vbr_pack").alias("recipe"), F.lit("slow").alias("preset"), R.pack_params(R.VBR_PACK, 1.2).alias("params")))).alias("r"))
    return a.unionByName(b.select("video_id", "r.*"), allowMissingColumns=True)


@query("d14_segment_params", f"""WITH p AS (SELECT seg_key, params FROM {software_sql('v_seg_rules')} AS x WHERE seg_key % 4 > 0)
SELECT video_id, seg_index, CASE WHEN p.params IS NULL THEN 'aq-mode=2:rd=5' || ':keyint=' || frame_count || ':min-keyint=' || frame_count || ':scenecut=0'
 ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(p.params, ':aq-strength=[^:]*', ''), ':keyint=[0-9]+', ':keyint=' || frame_count), ':min-keyint=[0-9]+', ':min-keyint=' || frame_count), ':scenecut=[0-9]+', ':scenecut=0') END AS params,
CASE WHEN p.params IS NULL THEN 'fixed_fallback' ELSE 'features' END AS param_source FROM v_segments s LEFT JOIN p USING (seg_key)""")
def _(t):
    return P.plan_params(t.segments, t.segments_d.filter(F.col("seg_key") % 4 > 0), "aq-mode=2:rd=5").select("video_id", "seg_index", "params", "param_source")
