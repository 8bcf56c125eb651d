"""Setting rules: feature columns to encoder settings, as CASE expressions.

All rules read the clip feature columns by name (motion_level, texture_level,
noise_level_norm, edge_level, cut_level, flatness, entropy, luma_mean, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trialspark.functions.numbers import clamp, fixed_text, half_even, ladder, nz, round_even, short_text

# CRF seed by quality threshold.
CRF_SEEDS = ((93, 14), (89, 16), (None, 18))
CRF_FLOOR = 8
# Fixed values: (threshold, base share, soft low share, soft high share) of the CQ range.
CQ_SHARES = ((93, 0.38, 0.12, 0.58), (89, 0.45, 0.15, 0.65), (None, 0.50, 0.18, 0.72))
# Limits of the AQ strength.
AQ_MIN, AQ_MAX = 0.8, 1.4
# Preprocess sets.
SURVEY_SET = ("none", "hqdn3d_light", "bilateral_light", "unsharp_mild", "contrast_mild")
BRAVE_SET = ("none", "unsharp_micro", "unsharp_nano", "contrast_micro", "contrast_nano", "cas_micro", "cas_nano",
             "smartblur_restore", "denoise_unsharp", "bilateral_unsharp", "hqdn3d_temporal", "temporal_cas")
# Constant-quality and average-bitrate packs.
CRF_PACK = dict(rd=6, ref=6, bframes=12, lookahead=50, keyint=60, min_keyint=1, scenecut=50)
VBR_PACK = dict(rd=6, ref=6, bframes=8, lookahead=50, keyint=60, min_keyint=1, scenecut=50)


def _v(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def levels() -> dict[str, Column]:
    return dict(motion=_v("motion_level"), texture=_v("texture_level"), noise=_v("noise_level_norm"),
                edge=_v("edge_level"), cuts=_v("cut_level"), fps=nz(F.col("fps"), 30.0))


def mashup() -> Column:
    return F.lit(0.50) * _v("worst_difficulty") + F.lit(0.30) * _v("volatility") + F.lit(0.20) * _v("hard_fraction")


# ---------------------------------------------------------------- seeds

def crf_seed(threshold: Column | int) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return ladder(*[(t >= lim, s) for lim, s in CRF_SEEDS if lim], otherwise=CRF_SEEDS[-1][1])


def volatile_crf(seed: Column) -> Column:
    """Seed lowered on jumpy or hard clips, floor 8."""
    worst, hard, rate, vol = _v("worst_difficulty"), _v("hard_fraction"), _v("cut_rate"), _v("volatility")
    bias = ladder(
        ((worst >= 0.7) | (hard >= 0.45) | (rate >= 0.35) | (vol >= 0.55), -3),
        ((worst >= 0.55) | (hard >= 0.30) | (rate >= 0.20) | (vol >= 0.35), -2),
        ((worst >= 0.40) | (_v("cut_density") >= 0.15) | (vol >= 0.20), -1), otherwise=0)
    extra = F.when((_v("texture") >= 1.2) | (hard >= 0.5), -1).otherwise(0)
    return F.greatest(F.lit(CRF_FLOOR), seed + bias + extra)


def cq_seed(threshold: float, crf_min: int, crf_max: int) -> dict[str, Column]:
    """CQ seed inside soft bounds, with the difficulty and bias that led to it."""
    lo, hi = min(crf_min, crf_max), max(crf_min, crf_max)
    span = max(1, hi - lo)
    share = next(s for s in CQ_SHARES if s[0] is None or threshold >= s[0])
    base = lo + span * share[1]
    soft_lo = min(max(round(lo + span * share[2]), lo), hi)
    soft_hi = min(max(round(lo + span * share[3]), soft_lo), hi)
    lv, m = levels(), mashup()
    tex, mot, edge, noise = lv["texture"], lv["motion"], lv["edge"], lv["noise"]
    diff = clamp(F.lit(0.35) * tex + F.lit(0.25) * mot + F.lit(0.15) * edge + F.lit(0.15) * m + F.lit(0.10) * lv["cuts"], 0.0, 1.0)
    bias = (F.lit(0.40) - diff) * float(span) * 0.70
    bias = bias - ladder((tex >= 0.85, 5.0), (tex >= 0.70, 3.0), (tex >= 0.55, 1.5), otherwise=0.0)
    bias = bias - ladder((mot >= 0.65, 3.0), (mot >= 0.50, 1.5), otherwise=0.0)
    bias = bias - ladder((m >= 0.60, 3.0), (m >= 0.45, 1.5), otherwise=0.0)
    bias = bias - F.when((edge >= 0.65) & (tex >= 0.55), 1.0).otherwise(0.0)
    bias = bias - ladder((noise >= 0.55, 1.5), (noise >= 0.45, 0.5), otherwise=0.0)
    bias = bias + F.when((diff <= 0.35) & (m < 0.35), 2.0).otherwise(0.0)
    seed = clamp(clamp(half_even(F.lit(base) + bias), soft_lo, soft_hi), lo, hi)
    return {"cq_seed": seed, "seed_difficulty": diff, "seed_bias": bias}


def _int_array(*xs) -> Column:
    return F.array(*[F.lit(int(x)) for x in xs])


def probe_offsets(count: int, spread: int) -> dict[str, Column]:
    """Offsets around the seed, leaning by content when two probes are asked for."""
    spread = max(1, int(spread))
    if count <= 1:
        return {"offsets": _int_array(0), "band": F.lit("center")}
    if count != 2:
        return {"offsets": _int_array(*[(i - 1) * spread for i in range(count)]), "band": F.lit("upward_band")}
    lv, m = levels(), mashup()
    mix = F.lit(0.30) * lv["motion"] + F.lit(0.25) * lv["texture"] + F.lit(0.20) * lv["edge"] + F.lit(0.15) * lv["cuts"] + F.lit(0.10) * lv["noise"]
    rules = [(m >= 0.55, (-spread, 0), "hard_down_band"), (lv["motion"] >= 0.52, (0, spread), "hard_up_band"),
             (lv["noise"] >= 0.50, (-1, 0), "noise_down_band"), (mix < 0.45, (0, spread), "easy_up_band")]
    return {"offsets": ladder(*[(c, _int_array(*o)) for c, o, _ in rules], otherwise=_int_array(-1, spread)),
            "band": ladder(*[(c, t) for c, _, t in rules], otherwise="default_bracket")}


def filled_band(center: Column, offsets: Column, count: int, crf_min: int, crf_max: int, up_first: bool = True) -> Column:
    """Clamped, distinct probes; gaps from clamping are filled with the nearest free CQs."""
    span = crf_max - crf_min + 1
    own = F.transform(offsets, lambda o: clamp(center + o, crf_min, crf_max))
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(span)), lambda s: (
        F.array(center + s, center - s) if up_first else F.array(center - s, center + s))))
    near = F.filter(near, lambda c: c.between(crf_min, crf_max))
    return F.array_sort(F.slice(F.array_distinct(F.concat(own, near)), 1, count))


def quality_band(seed: Column, crf_min: int, crf_max: int, count: int = 3, spread: int = 2) -> Column:
    """Probes that end at the seed and step towards quality."""
    if count < 1 or crf_min > crf_max:
        raise ValueError("bad probe range")
    center = clamp(seed, crf_min, crf_max)
    return filled_band(center, _int_array(*[-(count - 1 - i) * max(1, spread) for i in range(count)]), count, crf_min, crf_max, up_first=False)


# ---------------------------------------------------------------- adaptive quantisation

def aq_mode() -> Column:
    lv = levels()
    tex, edge = lv["texture"], lv["edge"]
    return ladder((lv["noise"] >= 0.50, 1), ((tex >= 0.87) | (edge >= 0.62) | (mashup() >= 0.52), 1),
                  ((tex < 0.86) & (edge < 0.55), 2), ((lv["motion"] >= 0.68) & (tex >= 0.84), 1), otherwise=2)


def aq_mode_fixed_pack() -> Column:
    """The fixed packs' rule: mode 1 only on clean, textured clips with few cuts."""
    tex = nz(F.coalesce("texture_level", "texture"), 0.0)
    noise = nz(F.coalesce("noise_level_norm", "noise_level"), 0.0)
    return F.when((tex > 0.80) & (noise < 0.15) & (_v("cut_count").cast("int") < 3), 1).otherwise(2)


def aq_strength() -> tuple[Column, Column]:
    """(strength, reasons): steps added up, then floors and caps in order, then the limits."""
    lv = levels()
    tex, edge, mot, noise = lv["texture"], lv["edge"], lv["motion"], lv["noise"]
    flat, ent = clamp(_v("flatness"), 0.0, 1.0), clamp(_v("entropy"), 0.0, 1.0)
    luma = nz(F.col("luma_mean"), 128.0)
    quiet = noise < 0.50
    # (value shown, digits, [(condition, step, name), ...]); the first match of a group counts
    groups = [
        (tex, 2, [(tex >= 0.75, 0.35, "very_high_texture"), (tex >= 0.55, 0.20, "high_texture"),
                  (tex < 0.30, -0.20, "very_low_texture"), (tex < 0.40, -0.10, "low_texture")]),
        (edge, 2, [((tex < 0.75) & (edge >= 0.62), 0.05, "high_edge")]),
        (ent, 2, [((ent >= 0.65) & (tex < 0.75), 0.05, "high_entropy")]),
        (noise, 2, [(noise >= 0.55, -0.30, "very_high_noise"), (noise >= 0.50, -0.20, "high_noise"),
                    (noise >= 0.40, -0.10, "medium_noise"), (noise < 0.25, 0.10, "very_low_noise")]),
        (mot, 2, [(mot >= 0.68, 0.10, "very_high_motion"), (mot >= 0.52, 0.05, "high_motion")]),
        (flat, 2, [(flat >= 0.70, -0.20, "extremely_flat"), (flat >= 0.55, -0.10, "large_flat")]),
        (luma, 0, [(quiet & (luma < 60), 0.20, "very_dark_luma"), (quiet & (luma < 90), 0.10, "dark_luma")])]
    s, why = F.lit(1.0), []
    for shown, digits, rules in groups:
        s = s + ladder(*[(c, step) for c, step, _ in rules], otherwise=0.0)
        why.append(ladder(*[(c, F.concat(F.lit(f"{n}="), fixed_text(shown, digits), F.lit(f" {step:+.2f}"))) for c, step, n in rules]))
    dark_noisy, dark_clean = (luma < 90) & (noise >= 0.45), (luma < 90) & (noise < 0.40)
    bounds = [((mot >= 0.52) & (tex >= 0.55), "floor", 1.2, "sports_like"), ((tex >= 0.87) & (edge >= 0.60), "floor", 1.3, "forest_like"),
              ((flat >= 0.60) & (mot < 0.45) & (tex < 0.55), "cap", 1.0, "anime_flat"), ((flat >= 0.55) & (mot < 0.40) & (edge < 0.35), "cap", 1.0, "screen_like"),
              (dark_noisy, "cap", 1.0, "dark_noisy"), (dark_clean, "floor", 1.15, "dark_clean")]
    for cond, kind, limit, name in bounds:
        hit = (cond & (s < limit)) if kind == "floor" else cond
        why.append(F.when(hit, F.lit(f"{name} → {kind} {limit}")))
        # null limits are skipped, so an unmet condition changes nothing
        s = (F.greatest if kind == "floor" else F.least)(s, F.when(cond, F.lit(limit)))
    s = round_even(clamp(s, AQ_MIN, AQ_MAX), 2)
    head = F.concat(F.lit("aq-strength="), short_text(s), F.lit(" (base 1.0)"))
    return s, F.array_compact(F.array(head, *why))


def segment_gop() -> Column:
    """Mean segment length in frames within one to two seconds (at least 24); null without a duration."""
    fps = nz(F.col("fps"), 30.0)
    low = F.greatest(F.lit(24), half_even(fps))
    high = F.greatest(low, half_even(2.0 * fps))
    raw = half_even(_v("duration") / F.greatest(F.lit(1.0), _v("segment_count")) * fps)
    return F.when(_v("duration") > 0, F.greatest(F.least(raw, high), low))


# ---------------------------------------------------------------- parameter sets

def software_settings(df, quality_pack: bool = False, prefix: str = "", reasons: bool = False):
    """All software-encoder knobs as columns, plus `<prefix>params` as option text
    (and the AQ reasons on request)."""
    lv, m = levels(), mashup()
    mot, noise, cuts, fast = lv["motion"], lv["noise"], lv["cuts"], lv["fps"] >= 50
    strength, why = aq_strength()
    hard = (m >= 0.60) | F.lit(quality_pack)
    ref = F.greatest(F.lit(5 if quality_pack else 4), F.when(mot >= 0.52, 5).otherwise(0), F.when(hard, 5).otherwise(0))
    rd = F.greatest(F.lit(6 if quality_pack else 5), F.when(hard, 6).otherwise(0))
    calm = (mot < 0.45) & (noise < 0.48)
    look = ladder((mot >= 0.52, F.when(fast, 60).otherwise(50)), (mot >= 0.48, F.when(fast, 50).otherwise(40)), (calm, 20), otherwise=40)
    look = F.when(cuts >= 0.35, F.greatest(look, F.lit(40))).otherwise(look)
    new = {"aq_mode": aq_mode(), "aq_strength": strength, "rd": rd, "ref": ref,
           "bframes": F.when((mot < 0.48) & calm, 4).otherwise(8), "rc_lookahead": look,
           "keyint": F.coalesce(segment_gop(), F.lit(48)), "min_keyint": F.lit(1),
           "scenecut": ladder((cuts >= 0.35, 60), (cuts >= 0.20, 50), otherwise=40)}
    df = df.withColumns({prefix + k: v for k, v in new.items()} | ({prefix + "reasons": why} if reasons else {}))
    parts = []
    for k in new:
        c = F.col(prefix + k)
        parts.append(F.concat(F.lit(k.replace("_", "-") + "="), short_text(c) if k == "aq_strength" else c.cast("string")))
    if quality_pack:
        parts += [F.lit("me=umh"), F.lit("subme=7")]
    return df.withColumn(prefix + "params", F.concat_ws(":", *parts))


def hardware_settings() -> dict[str, Column]:
    """Hardware-encoder knobs; null where the rules leave the request's value."""
    lv = levels()
    mot, tex, noise, edge, cuts = (lv[k] for k in ("motion", "texture", "noise", "edge", "cuts"))
    rich = (tex >= 0.50) | (edge >= 0.50)
    no, yes = F.lit(False), F.lit(True)
    busy, calm = mot >= 0.48, (mot < 0.45) & (noise < 0.48)
    taq = ladder((noise >= 0.50, no), (rich, F.when(busy, yes)), otherwise=yes)
    look = ladder((busy, F.when(lv["fps"] >= 50, 32).otherwise(20)), (calm, 8))
    gop = segment_gop()
    return {"nvenc_aq_strength": ladder((noise >= 0.55, 4), (noise >= 0.50, 5), (rich, F.when(F.greatest(tex, edge) >= 0.55, 12).otherwise(10)), otherwise=8),
            "nvenc_temporal_aq": taq, "nvenc_spatial_aq": F.when((noise >= 0.55) | (noise < 0.50), yes),
            "nvenc_bf": ladder((mot >= 0.52, 4), (busy, 3), (calm, 2)),
            "nvenc_rc_lookahead": F.when(gop.isNotNull() & (cuts >= 0.35), F.greatest(F.coalesce(look, F.lit(0)), F.lit(20))).otherwise(look),
            "nvenc_b_ref_mode": ladder((busy, "middle"), (calm, "disabled")), "nvenc_gop": gop}


def preprocess_choice() -> Column:
    noise, mot, edge = levels()["noise"], levels()["motion"], levels()["edge"]
    tex, flat = nz(F.col("texture_level"), 0.5), _v("flatness")
    return ladder((noise >= 0.55, ladder(((mot >= 0.55) & (tex < 0.45), "atadenoise_light"), (tex >= 0.55, "bilateral_light"), otherwise="hqdn3d_med")),
                  (noise >= 0.52, "hqdn3d_light"), ((noise < 0.48) & (edge >= 0.60), "unsharp_mild"),
                  ((noise < 0.48) & (flat >= 0.55), "contrast_mild"), otherwise="none")


def preprocess_candidates(explicit: Column, *, auto: bool = True, sweep: bool = False, brave: bool = False) -> Column:
    """Ordered names to try ('none' = no filter): explicit wins, then a sweep set, then
    none plus the feature pick."""
    pick = preprocess_choice()
    pick_list = F.when(pick == "none", F.array().cast("array<string>")).otherwise(F.array(pick))

    def sweep_set(names, reorder):
        base = F.array(*[F.lit(n) for n in names])
        if not reorder:
            return F.array_distinct(F.concat(base, pick_list))
        return F.array_distinct(F.concat(F.array(F.lit("none")), pick_list, base))

    if brave or sweep:
        rest = sweep_set(BRAVE_SET if brave else SURVEY_SET, True)
    elif not auto:
        rest = F.array(F.lit("none"))
    else:
        rest = F.concat(F.array(F.lit("none")), pick_list)
    key = F.lower(F.trim(explicit))
    return (F.when(key.isNull(), rest).when(key == "sweep", sweep_set(SURVEY_SET, False)).when(key == "brave", sweep_set(BRAVE_SET, False))
            .otherwise(F.array(F.when(key == "", "none").otherwise(key))))


def pack_params(pack: dict, strength: float = 1.0, **changes) -> Column:
    p = {**pack, **changes}
    return F.concat(F.lit("aq-mode="), aq_mode_fixed_pack().cast("string"), F.lit(
        f":aq-strength={round(strength, 2):g}:rd={p['rd']}:ref={p['ref']}:bframes={p['bframes']}:rc-lookahead={p['lookahead']}"
        f":keyint={p['keyint']}:min-keyint={p['min_keyint']}:scenecut={p['scenecut']}"))


def mashup_like() -> Column:
    return (_v("cut_rate") >= 0.15) | (_v("hard_fraction") >= 0.25) | (_v("volatility") >= 0.35) | (_v("segment_count") >= 4)


# ---------------------------------------------------------------- grids and plans

def int_grid(lo: Column | int, hi: Column | int, step: int = 1) -> Column:
    """Inclusive coarse grid; the upper end is always in it."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.array_distinct(F.concat(F.sequence(lo, hi, F.lit(max(1, step))), F.array(hi)))


def float_grid(lo: Column, hi: Column, step: float, digits: int = 4) -> Column:
    """Inclusive grid from lo in fixed steps."""
    n = F.floor((hi - lo) / step + 1e-6).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: round_even(lo + i * step, digits)))


def walk_from(base: float, lo: float, hi: float, step: float) -> list[float]:
    """Stronger values in rising order, then weaker ones in falling order."""
    k = [round(base + i * step, 2) for i in range(1, int((hi - base) / step + 1e-6) + 1)]
    return k + [round(base - i * step, 2) for i in range(1, int((base - lo) / step + 1e-6) + 1)]


def bitrate_grid(lo: Column, hi: Column, count: int) -> Column:
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    if count <= 1:
        return F.array(round_even((a + b) / 2.0, 3))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: round_even(a + (b - a) * i / float(count - 1), 3)))


def sample_count(duration: Column, samples: Column, every: float = 720.0, least: int = 1) -> Column:
    n = F.when(F.coalesce(samples, F.lit(0)) > 0, samples).otherwise(F.ceil(duration / max(1.0, every)).cast("int"))
    return F.greatest(F.lit(int(least)), n, F.lit(1))


def sample_plan(duration: Column, scenes: Column, samples: Column, *, seconds: float = 3.0, fps: float = 30.0,
                every: float = 720.0, least: int = 1, most: int = 12) -> dict[str, Column]:
    fps = max(1.0, fps)
    sec = max(1.0 / fps, seconds)
    n = F.least(F.lit(int(most)), sample_count(duration, samples, every, least), F.greatest(F.lit(1), scenes))
    n = F.when(n * sec >= duration * 0.85, 1).otherwise(n)
    return {"sample_count": n, "sample_seconds": F.lit(sec), "sample_frames": F.lit(max(1, round(sec * fps)))}


def sample_starts(duration: Column, count: Column, seconds: float) -> Column:
    """Evenly gapped start times of `count` samples."""
    gap = F.greatest(F.lit(0.0), duration - count * seconds)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: gap / (count + 1.0) * (i + 1) + i * seconds)


def try_crf_bump(vmaf: Column, threshold: float, headroom: float = 2.0) -> Column:
    return vmaf - threshold >= headroom


def affordable(budget: Column, requested: Column, workers: Column, seconds_each: Column) -> Column:
    batches = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.lit(1e-6), seconds_each)).cast("int"))
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), requested), F.greatest(F.lit(1), workers) * batches))


def knob_candidates(base: dict[str, Column]) -> dict[str, Column]:
    """Discrete values to try around the baseline of each knob (double arrays).

    A baseline that is no number falls back to the knob's default.
    """
    mot, tex, noise = nz(F.col("motion_level"), 0.4), nz(F.col("texture_level"), 0.5), nz(F.col("noise_level_norm"), 0.3)
    fast = mot >= 0.55

    def start(key, default):
        number = base[key].try_cast("double")
        whole = number if key == "aq-strength" else F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
        return F.coalesce(whole, F.lit(float(default)))

    def steps(b, *ds):
        return F.array(*[b + float(d) for d in ds])

    def within(arr, lo, hi, n):
        return F.slice(F.array_distinct(F.filter(arr, lambda c: c.between(lo, hi))), 1, n)

    mode, s, rd, ref, bf, la = (start(*x) for x in (("aq-mode", 2), ("aq-strength", 1), ("rd", 5), ("ref", 4), ("bframes", 4), ("rc-lookahead", 40)))
    modes = F.array_distinct(F.concat(F.when((tex >= 0.75) | (noise >= 0.45), F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")),
                                      F.array(F.floor(mode).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    sd = ladder((tex >= 0.7, steps(s, 0, 0.1, 0.2, -0.1)), (noise >= 0.45, steps(s, 0, -0.1, -0.2, 0.1)), otherwise=steps(s, 0, -0.1, 0.1, -0.2, 0.2))
    look = F.when(fast, steps(la, 0, 10, 20, -10)).otherwise(steps(la, 0, 10, -10, 20))
    return {
        "aq-mode": F.slice(modes, 1, 3),
        "aq-strength": F.slice(F.array_distinct(F.transform(sd, lambda v: round_even(clamp(v, AQ_MIN, AQ_MAX), 2))), 1, 4),
        "rd": within(steps(rd, 0, 1, -1), 3, 6, 3),
        "ref": within(F.when(fast, steps(ref, 0, 1, 2, -1)).otherwise(steps(ref, 0, 1, -1)), 2, 6, 4),
        "bframes": within(F.when(fast, steps(bf, 0, 2, 4)).otherwise(steps(bf, 0, 2, -2)), 2, 8, 4),
        "rc-lookahead": F.slice(F.array_distinct(F.transform(look, lambda v: F.rint(clamp(v, 20.0, 80.0) / 5.0) * 5.0)), 1, 4)}
