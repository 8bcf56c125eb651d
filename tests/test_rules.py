"""Known answers of the setting rules."""

import pytest
from pyspark.sql import functions as F

from trialspark.functions import rules as R
from trialspark.functions.features import MOTION_MID, NOISE_MID
from trialspark.functions.numbers import soft_level
from trialspark.operators import plan as P

BASE = dict(motion_level=0.5, texture_level=0.5, noise_level_norm=0.3, edge_level=0.4, cut_level=0.1, fps=30.0, flatness=0.2, entropy=0.5, luma_mean=128.0,
            worst_difficulty=0.5, hard_fraction=0.0, volatility=0.0, segment_count=6.0, duration=30.0, cut_rate=0.0, cut_density=0.0, cut_count=5.0, texture=0.5, noise_level=0.3)


def clip(spark, **kw):
    d = {"video_id": 1, **BASE, **kw}
    return spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} {'int' if k == 'video_id' else 'double'}" for k in d))


def value(df, col):
    return df.select(col.alias("v")).first()["v"]


def test_soft_level_midpoints(spark):
    for mid in (MOTION_MID, NOISE_MID):
        assert value(spark.range(1), soft_level(F.lit(mid), mid)) == pytest.approx(0.5)
    assert value(spark.range(1), soft_level(F.lit(-1.0), 0.1)) == 0.0 and value(spark.range(1), soft_level(F.lit(1.0), 0.0)) == 0.0


@pytest.mark.parametrize("kw, mode", [
    (dict(motion_level=.73, texture_level=.89, edge_level=.68, worst_difficulty=.6, hard_fraction=1., volatility=.2), 1),
    (dict(motion_level=.69, texture_level=.85, edge_level=.50, worst_difficulty=.53, hard_fraction=1., volatility=.07), 2), (dict(noise_level_norm=.6), 1)])
def test_aq_mode(spark, kw, mode):
    assert value(clip(spark, **kw), R.aq_mode()) == mode


def test_aq_strength_limits(spark):
    high = clip(spark, motion_level=.73, texture_level=.89, edge_level=.68, noise_level_norm=.23, worst_difficulty=.6)
    low = clip(spark, noise_level_norm=.7, texture_level=.2, flatness=.8)
    s, why = R.aq_strength()
    assert value(high, s) == 1.4 and value(low, s) == 0.8
    assert "very_high_texture=0.89 +0.35" in value(high, why)


@pytest.mark.parametrize("kw, want", [
    (dict(noise_level_norm=.50), "none"), (dict(noise_level_norm=.53), "hqdn3d_light"), (dict(noise_level_norm=.60, motion_level=.3, texture_level=.6), "bilateral_light"),
    (dict(noise_level_norm=.60, motion_level=.7, texture_level=.3), "atadenoise_light"), (dict(noise_level_norm=.35, edge_level=.7), "unsharp_mild"), (dict(noise_level_norm=.35, edge_level=.2, flatness=.6), "contrast_mild")])
def test_preprocess(spark, kw, want):
    assert value(clip(spark, **kw), R.preprocess_choice()) == want


def test_preprocess_candidates(spark):
    c, none = clip(spark, noise_level_norm=.53), F.lit(None).cast("string")
    assert value(c, R.preprocess_candidates(none)) == ["none", "hqdn3d_light"]
    assert value(c, R.preprocess_candidates(none, auto=False)) == ["none"]
    assert value(c, R.preprocess_candidates(F.lit("X "))) == ["x"]
    assert value(c, R.preprocess_candidates(F.lit("sweep"))) == list(R.SURVEY_SET)
    assert value(c, R.preprocess_candidates(none, brave=True)) == ["none", "hqdn3d_light", *R.BRAVE_SET[1:]]


def test_hardware_noise_rules(spark):
    h = clip(spark, noise_level_norm=.60).select(*[v.alias(k) for k, v in R.hardware_settings().items()]).first()
    assert (h.nvenc_aq_strength, h.nvenc_temporal_aq, h.nvenc_spatial_aq) == (4, False, True)
    assert clip(spark, noise_level_norm=.4).select(R.hardware_settings()["nvenc_aq_strength"].alias("a")).first().a != 4


def test_fixed_packs(spark):
    clean = clip(spark, texture_level=.85, noise_level_norm=.10, cut_count=2.0)
    assert value(clean, R.aq_mode_fixed_pack()) == 1
    assert value(clip(spark), R.pack_params(R.CRF_PACK)) == "aq-mode=2:aq-strength=1:rd=6:ref=6:bframes=12:rc-lookahead=50:keyint=60:min-keyint=1:scenecut=50"
    assert value(clip(spark), R.pack_params(R.VBR_PACK, 1.2, rd=5, bframes=12, lookahead=40)).startswith("aq-mode=2:aq-strength=1.2:rd=5:ref=6:bframes=12:rc-lookahead=40")


def test_grids(spark):
    w = R.walk_from(1.0, 0.2, 2.4, 0.2)
    assert w[0] == 1.2 and w[-1] == 0.2 and 1.0 not in w and 2.4 in w
    g = value(spark.range(1), R.float_grid(F.lit(0.2), F.lit(2.6), 0.2))
    assert g[0] == 0.2 and g[-1] == 2.6 and 1.0 in g and len(g) == 13
    assert value(spark.range(1), R.int_grid(22, 42, 6)) == [22, 28, 34, 40, 42]
    assert value(spark.range(1), R.bitrate_grid(F.lit(3.0), F.lit(1.0), 3)) == [1.0, 2.0, 3.0]


def test_knobs_and_flags(spark):
    base = {k: F.lit(v) for k, v in {"aq-mode": "2", "aq-strength": "x", "rd": "6", "ref": "4", "bframes": "8", "rc-lookahead": "43"}.items()}
    base = {k: v.try_cast("double") for k, v in base.items()}
    k = clip(spark, texture_level=.9, noise_level_norm=.2).select(*[v.alias(n) for n, v in R.knob_candidates(base).items()]).first()
    assert k["aq-mode"] == [1.0, 2.0, 3.0] and k["aq-strength"] == [1.0, 1.1, 1.2, 0.9] and k["rd"] == [6.0, 5.0]
    assert k["bframes"] == [8.0, 6.0] and k["rc-lookahead"] == [45.0, 55.0, 35.0, 65.0]
    assert value(spark.range(1), R.try_crf_bump(F.lit(88.0), 85.0)) and not value(spark.range(1), R.try_crf_bump(F.lit(86.5), 85.0))
    a = [value(spark.range(1), R.affordable(*(F.lit(x) for x in t))) for t in ((600.0, 3, 3, 90.0), (100.0, 3, 1, 90.0), (1.0, 3, 1, 90.0))]
    assert a == [3, 1, 1]


def test_sample_plan(spark):
    def plan(d, n, **kw):
        r = spark.range(1).select(*[v.alias(k) for k, v in R.sample_plan(F.lit(float(d)), F.lit(n), F.lit(None).cast("int"), **kw).items()]).first()
        return tuple(r)
    assert plan(600, 4, most=8) == (1, 3.0, 90) and plan(30, 6, least=5, most=8) == (5, 3.0, 90) and plan(10, 6, least=5, most=8)[0] == 1
    assert value(spark.range(1), R.sample_count(F.lit(3600.0), F.lit(None).cast("int"))) == 5
    assert value(spark.range(1), R.sample_count(F.lit(300.0), F.lit(3))) == 3
    assert value(spark.range(1), R.sample_starts(F.lit(10.0), F.lit(1), 4.0)) == [3.0]


def test_probe_band(spark):
    easy = P.probe_band(clip(spark, motion_level=.4, texture_level=.4, worst_difficulty=.3), 2, 22, 40, 89.0).first()
    assert easy.band == "easy_up_band" and list(easy.cqs) == [easy.cq_seed, easy.cq_seed + 2]
    hard = P.probe_band(clip(spark, worst_difficulty=.9, volatility=.6, hard_fraction=1.), 2, 22, 40, 89.0).first()
    assert hard.band == "hard_down_band" and list(hard.cqs) == [hard.cq_seed - 2, hard.cq_seed]
    blind = P.probe_band(clip(spark, motion_level=None, texture_level=None), 3, 22, 40, 89.0).first()
    assert list(blind.cqs) == [22, 31, 40] and blind.cq_seed == 31
    assert value(spark.range(1), R.quality_band(F.lit(30), 22, 40)) == [26, 28, 30]
    assert value(spark.range(1), R.quality_band(F.lit(22), 22, 40)) == [22, 23, 24]


def test_variants_are_ranked_and_unique(spark):
    c = clip(spark, noise_level_norm=.6, motion_level=.6, cut_level=.4)
    v = P.hardware_variants(c.select("*", *[x.alias(k) for k, x in R.hardware_settings().items()])).orderBy("rank").collect()
    assert [r["rank"] for r in v] == list(range(1, len(v) + 1)) and len({r.change for r in v}) == len(v)
    assert [r.priority for r in v] == sorted((r.priority for r in v), reverse=True)
    assert any(r.change == "nvenc_multipass=fullres" for r in v)


def test_recipes_without_features_use_the_packs(spark):
    r = P.recipes(clip(spark, motion_level=None, texture_level=None), 89, override="rd=4").orderBy("recipe").collect()
    assert [x.recipe for x in r] == ["default_medium", "default_quality"]
    assert r[0].params == "aq-mode=3:rd=4:ref=4:bframes=6:rc-lookahead=40:keyint=48:min-keyint=1:scenecut=40" and r[1].preset == "slow"
