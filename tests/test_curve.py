"""Known answers on small curves."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import curve as C


def curve(spark, points, used=None):
    """points: (cq, vmaf, rate, s_f)"""
    rows = [(1, 0, cq, float(v), float(r), 1 / r if r else 0.0, float(s), True) for cq, v, r, s in points]
    df = spark.createDataFrame(rows, "video_id int, segment_index int, cq int, vmaf double, compression_rate double, compression_ratio double, s_f double, encode_ok boolean")
    return C.curves(df)


FIVE = [(25, 96.15, 0.3, 0.283), (27, 95.68, 0.3, 0.292), (29, 95.01, 0.3, 0.304), (31, 93.09, 0.3, 0.323), (33, 90.63, 0.3, 0.351)]


@pytest.mark.parametrize("points, target, want", [
    ([(32, 92, .2, .5), (34, 86, .15, .55)], 89.0, 33.0), ([(30, 90, .2, .5)], 85.0, 30.0),
    ([(30, 90, .2, .5), (32, 88, .2, .5)], 85.0, 35.0), ([(30, 90, .2, .5), (32, 90, .2, .5)], 85.0, 30.0)])
def test_crossing(spark, points, target, want):
    assert C.with_crossing(curve(spark, points), target).first()["cq_star"] == pytest.approx(want)


def test_interpolated_crf(spark):
    r = C.interpolated_crf(curve(spark, [(32, 92, .2, .5), (34, 86, .15, .55)]), 89, 16, 40).first()
    assert (r.crf, r.crf_reason) == (33, "interp_vmaf=89 crf*=33.00")
    r = C.interpolated_crf(curve(spark, [(40, 92, .2, .5)]), 89, 16, 40).first()
    assert (r.crf, r.crf_reason) == (40, "single_probe_vmaf=92.0>=89")
    assert C.interpolated_crf(curve(spark, [(30, 80, .2, .5)]), 89, 16, 40).first().crf == 29


def test_quality_anchored(spark):
    got = sorted(r.crf for r in C.vmaf_anchored_crfs(curve(spark, FIVE), 3, (22, 40), (16, 40), 85.0).collect())
    assert 31 in got and 27 not in got and min(got) >= 29 and len(set(got)) == len(got)


def test_anchor_prefers_positive_scores_then_quality(spark):
    r = C.with_anchor(curve(spark, FIVE), 85.0).first()
    assert (r.anchor.cq, r.band_lo, r.band_hi) == (33, 32, 33)
    r = C.with_anchor(curve(spark, [(30, 70, .2, 0), (32, 75, .2, 0), (34, 75, .2, 0)]), 85.0).first()
    assert r.anchor.cq == 32


def test_prediction_uses_end_points(spark):
    c = curve(spark, [(30, 90, .2, .5), (34, 86, .1, .6)])
    p = {r.candidate: r.predicted_s_f for r in C.predict_candidates(c, 28, 36, 85.0).collect()}
    assert p[28] == p[30] and p[36] == p[34] and p[30] < p[32] < p[34]


def test_next_probes_are_new_and_near_the_best(spark):
    got = [r.cq for r in C.next_probes(curve(spark, FIVE), 2, 22, 40, 85.0).orderBy("cq").collect()]
    assert len(got) == 2 and not set(got) & {25, 27, 29, 31, 33} and min(got) >= 32


def test_next_probes_without_points_spread_evenly(spark):
    df = spark.createDataFrame([(1, 0, 30, 0.0, 1.0, 1.0, 0.0, False)], "video_id int, segment_index int, cq int, vmaf double, compression_rate double, compression_ratio double, s_f double, encode_ok boolean")
    got = C.next_probes(C.curves(df), 3, 20, 40, 85.0).orderBy("cq").collect()
    assert [r.cq for r in got] == [20, 27, 33] and {r.probe_reason for r in got} == {"fallback_linspace"}


def test_handoff_starts_with_the_anchor(spark):
    h = C.handoff(curve(spark, FIVE), 3, 22, 40, 85.0).orderBy("rank").collect()
    assert (h[0].cq, h[0].reason) == (33, "measured_best") and len(h) <= 3
    m = C.map_offset(spark.createDataFrame([(1, 0, 36, 0), (1, 0, 22, 1), (1, 0, 18, 2)], "video_id int, segment_index int, cq int, rank int"), -6, 16, 40)
    assert sorted((r.crf, r.cq) for r in m.collect()) == [(16, 22), (30, 36)]


@pytest.mark.parametrize("points, mashup, crf, why", [
    ([(30, 92, .2, .5)], 0.2, 31, "single_pass_margin+1"), ([(30, 92, .2, .5)], 0.6, 30, "single_pass_keep"), ([(30, 80, .2, .5)], 0.2, 29, "single_fail_nudge-1"),
    ([(30, 92, .2, .5), (32, 89, .2, .6)], 0.2, 33, "all_pass_margin+1"), ([(30, 92, .2, .7), (32, 89, .2, .6)], 0.6, 30, "all_pass_best_s_f"),
    ([(30, 80, .2, .5), (32, 79, .2, .6)], 0.2, 29, "all_fail_nudge-1"), ([(30, 87, .2, .5), (32, 84.5, .2, .4)], 0.2, 32, "bracket_lean_up"),
    ([(30, 86, .2, .5), (32, 80, .2, .4)], 0.2, 30, "bracket")])
def test_rule_anchored(spark, points, mashup, crf, why):
    c = curve(spark, points).withColumns({"plan": F.array(F.lit(30), F.lit(32)), "mashup": F.lit(mashup)})
    r = C.rule_anchored_crf(c, "plan", "mashup", 22, 40, 85.0).first()
    assert (r.crf, r.crf_reason) == (crf, why)


TRIAL = ("video_id int, segment_index int, crf double, s_f double, vmaf_neg double, compression_rate double, compression_ratio double, "
         "encode_ok boolean, k1 int, k2 int, k3 int, k4 int")


def test_rejected_observations_name_the_reason(spark):
    rows = [(1, 0, c, s, 90.0, .2, 4.0, True, i, 0, 0, 0) for i, (c, s) in enumerate([(23.0, .5), (23.5, .6), (24.0, .5), (70.0, .5), (None, .5)])]
    df = spark.createDataFrame(rows, TRIAL)
    assert {(r.crf, r.reject_reason) for r in C.rejected_observations(df).collect()} == {(70.0, "cq_out_of_range"), (None, "no_cq")}
    assert sorted((r.cq, r.place) for r in C.observations(df).collect()) == [(23, 0), (23, 1), (24, 0)]


def test_fractional_settings_are_observations_of_their_whole_cq(spark):
    rows = [(1, 0, c, .5, v, .2, 5.0, True, i, 0, 0, 0) for i, (c, v) in enumerate([(23.0, 95.0), (23.5, 91.0), (25.0, 90.0)])]
    r = C.with_crossing(C.curves(C.observations(spark.createDataFrame(rows, TRIAL))), 93.0).first()
    assert r.cq_star == 23.0 and [p.vmaf for p in r.pts] == [95.0, 91.0, 90.0]


def trace(trials, target, at):
    """(crossing, prediction inputs at `at`) over every trial of one curve, straight from the rules."""
    ok = sorted((t for t in trials if t[7]), key=lambda t: (int(t[2]), t[8]))
    pts = [(int(t[2]), t[4], t[5]) for t in ok if t[4] > 0]
    star = None if not pts else float(pts[0][0])
    if len(pts) > 1:
        hits = [(l, r) for l, r in zip(pts, pts[1:]) if (l[1] - target) * (r[1] - target) <= 0 and l[1] != r[1]]
        l, r = hits[0] if hits else sorted(sorted(pts, key=lambda p: abs(p[1] - target))[:2], key=lambda p: p[0])
        star = float(l[0]) if l[1] == r[1] else l[0] + (target - l[1]) / (r[1] - l[1]) * (r[0] - l[0])
    pts = [(int(t[2]), t[4], t[5]) for t in ok if t[5] > 0]
    if not pts:
        return star, None
    if at <= pts[0][0] or at >= pts[-1][0]:
        return star, (pts[0] if at <= pts[0][0] else pts[-1])[1:]
    l, r = next((l, r) for l, r in zip(pts, pts[1:]) if l[0] <= at <= r[0])
    w = 0 if l[0] == r[0] else (at - l[0]) / (r[0] - l[0])
    return star, (l[1] + w * (r[1] - l[1]), l[2] + w * (r[2] - l[2]))


def test_kept_observations_answer_as_all_trials_do(spark):
    import random
    from trialspark.functions.score import predicted_score

    draw, rows = random.Random(7), []
    for video in range(150):
        for i in range(draw.choice([1, 2, 3, 8, 40])):
            v = draw.choice([0.0, 88.0, 93.0, round(draw.uniform(85, 99), 1)]) if video % 3 else round(draw.uniform(80, 92), 0)
            rows.append((video, 0, draw.choice([30, 30.5, 31, 32.25, 35]) * 1.0, draw.choice([0.0, .2, .3]), v, draw.choice([0.0, .1, .2, .3]), 4.0, draw.random() < .8, i, 0, 0, 0))
    c = C.curves(C.observations(spark.createDataFrame(rows, TRIAL)))
    got = C.predict_candidates(C.with_crossing(c, 93.0), 29, 36, 93.0).collect()
    want = {(v, at): trace([r for r in rows if r[0] == v], 93.0, at) for v in range(150) for at in range(29, 37)}
    inputs = [(v, at, *w[1]) for (v, at), w in want.items() if w[1]]
    scores = spark.createDataFrame(inputs, "v int, at int, vmaf double, rate double").select("v", "at", predicted_score(F.col("vmaf"), F.col("rate"), 93.0).alias("s"))
    scores = {(r.v, r["at"]): r.s for r in scores.collect()}
    assert len(got) == len(want)
    for r in got:
        key = (r.video_id, r.candidate)
        assert r.cq_star == pytest.approx(want[key][0]) and r.predicted_s_f == pytest.approx(scores.get(key))


def test_observations_take_one_shuffle_and_groups_span_batches(spark):
    """One shuffle of the trials, each task cut first; a hot CQ spread over batches of three rows gives what whole groups give."""
    rows = [(1, 0, 23 if i % 9 else 24, float(80 + i * 7 % 13), 0.1 + i % 5 / 10, 2.0, i % 4 / 4, i % 6 != 5, i, 0, 0, 0) for i in range(300)]
    names = "video_id segment_index crf vmaf_neg compression_rate compression_ratio s_f encode_ok k1 k2 k3 k4".split()
    df = spark.createDataFrame(rows, names).repartition(3, "k1")

    def run():
        obs = C.observations(df, gates=(85.0,))
        return obs._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, obs.collect()))

    plan, whole = run()
    assert plan.count("hashpartitioning(video_id") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run()[1] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 4 <= len([r for r in whole if r[2] == 23]) <= 13 and [r[3] for r in whole if r[2] == 23] == list(range(len([r for r in whole if r[2] == 23])))
