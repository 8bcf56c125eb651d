"""Curve queries: all trials of one (video, segment) form a curve, by whole CQ and trial order."""

from pyspark.sql import functions as F

from trialspark.operators import curve as C
from trialspark.plans.registry import query, view

THR = 93.0
LO, HI = 22, 42
K = "video_id, segment_index"

view("v_obs", """SELECT video_id, segment_index, crf AS cq, vmaf_neg AS vmaf, compression_rate AS rate, s_f, encode_ok,
 crf::BIGINT * 1000000000 + row_number() OVER (PARTITION BY video_id, segment_index, crf ORDER BY k1, k2, k3, k4) AS pos FROM v_scored""")
view("v_pts", "SELECT * FROM v_obs WHERE encode_ok")
view("v_cross", f"""WITH p AS (SELECT *, lead(cq) OVER w AS c2, lead(vmaf) OVER w AS v2, row_number() OVER (PARTITION BY {K} ORDER BY abs(vmaf - 93), pos) AS nr, count(*) OVER (PARTITION BY {K}) AS n
 FROM v_pts WHERE vmaf > 0 WINDOW w AS (PARTITION BY {K} ORDER BY pos)),
h AS (SELECT {K}, first(cq + (93 - vmaf) / (v2 - vmaf) * (c2 - cq) ORDER BY pos) AS x FROM p WHERE (vmaf - 93) * (v2 - 93) <= 0 AND vmaf <> v2 GROUP BY 1, 2),
t AS (SELECT {K}, any_value(n) AS n, min(cq) FILTER (nr <= 2) AS ca, max(cq) FILTER (nr <= 2) AS cb, first(vmaf ORDER BY pos) FILTER (nr <= 2) AS va, first(vmaf ORDER BY pos DESC) FILTER (nr <= 2) AS vb FROM p GROUP BY 1, 2)
SELECT t.video_id, t.segment_index, n, CASE WHEN n = 1 THEN ca WHEN x IS NOT NULL THEN x WHEN va = vb THEN ca ELSE ca + (93 - va) / (vb - va) * (cb - ca) END::DOUBLE AS cq_star, va FROM t LEFT JOIN h USING (video_id, segment_index)""")
view("v_pred", f"""WITH c AS (SELECT DISTINCT {K} FROM v_pts), g AS (SELECT *, unnest(range({LO}, {HI + 1}))::INT AS candidate FROM c),
a AS (SELECT g.*, arg_max(p.cq, p.cq) FILTER (p.cq < candidate) AS lc, arg_max(p.vmaf, p.pos) FILTER (p.cq < candidate) AS lv, arg_max(p.rate, p.pos) FILTER (p.cq < candidate) AS lr,
  min(p.cq) FILTER (p.cq >= candidate) AS rc, arg_min(p.vmaf, p.pos) FILTER (p.cq >= candidate) AS rv, arg_min(p.rate, p.pos) FILTER (p.cq >= candidate) AS rr,
  candidate >= max(p.cq) AND candidate > min(p.cq) AS past, arg_max(p.vmaf, p.pos) AS zv, arg_max(p.rate, p.pos) AS zr, max(p.vmaf) FILTER (p.cq >= candidate) AS beyond
  FROM g JOIN v_pts p USING (video_id, segment_index) WHERE p.rate > 0 GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN past THEN zv WHEN lc IS NULL THEN rv WHEN rc IS NULL THEN lv ELSE lv + (candidate - lc)::DOUBLE / (rc - lc) * (rv - lv) END AS v, CASE WHEN past THEN zr WHEN lc IS NULL THEN rr WHEN rc IS NULL THEN lr ELSE lr + (candidate - lc)::DOUBLE / (rc - lc) * (rr - lr) END AS r FROM a)
SELECT {K}, candidate, beyond, CASE WHEN r >= 0.8 OR v < 88 THEN 0
 WHEN v < 93 THEN least(1.0, (CASE WHEN 1 / r <= 20 THEN pow((1 / r - 1) / 19, 1.5) ELSE 1.0 + 0.3 * ln(1 / r / 20) END) * (0.7 * pow((v - 88) / 5, 2)) / 1.12)
 ELSE least(1.0, (0.7 * (CASE WHEN 1 / r <= 20 THEN pow((1 / r - 1.25) / 18.75, 0.9) ELSE 1.0 + 0.1 * ln(1 / r / 20) END) + 0.3 * (0.7 + 0.3 * least(1.0, (v - 93) / 7))) / 1.12) END::DOUBLE AS predicted_s_f FROM m""")
view("v_anchor", f"""WITH a AS (SELECT {K}, cq AS a, s_f AS asf, vmaf AS av FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY s_f > 0 DESC, CASE WHEN s_f > 0 THEN round(s_f, 12) END DESC NULLS LAST, vmaf DESC, cq) AS rn FROM v_pts) AS x WHERE rn = 1),
e AS (SELECT {K}, a, asf, av, min(cq) FILTER (cq > a AND vmaf < 88) AS hard, min(cq) FILTER (cq > a AND vmaf < 93) AS soft, min(cq) AS mn, max(cq) AS mx FROM v_pts JOIN a USING (video_id, segment_index) GROUP BY 1, 2, 3, 4, 5)
SELECT {K}, a AS anchor_cq, asf, av, least(greatest(a - 1, mn), coalesce(hard, soft, mx)) AS band_lo, greatest(greatest(a - 1, mn), coalesce(hard, soft, mx)) AS band_hi FROM e""")


def curves(t, **settings):
    """The curves of the trials; every second setting has a half, which counts as its whole CQ."""
    halves = t.scored.withColumn("crf", F.col("crf") + F.when(F.col("k2") % 2 == 0, 0.5).otherwise(0.0))
    return C.curves(C.observations(halves, **settings))


ALL = f"(SELECT DISTINCT {K} FROM v_obs)"  # curves without a working point too


@query("f11_threshold_crossing", f"SELECT {K}, cq_star FROM {ALL} LEFT JOIN v_cross USING (video_id, segment_index)", "cq_star")
def _(t):
    return C.with_crossing(curves(t), THR).select("video_id", "segment_index", "cq_star")


@query("f12_crossing_to_crf", f"""SELECT {K}, CAST(CASE WHEN n IS NULL THEN NULL WHEN n = 1 AND va >= 93 THEN least({HI}, cq_star + 1) WHEN n = 1 THEN greatest({LO}, cq_star - 1) ELSE greatest({LO}, least({HI}, round_even(cq_star, 0))) END AS INT) AS crf,
CASE WHEN n IS NULL THEN 'no_observations' WHEN n = 1 THEN 'single_probe_vmaf=' || fixed_text(va, 1) || CASE WHEN va >= 93 THEN '>=93' ELSE '<93' END ELSE 'interp_vmaf=93 crf*=' || fixed_text(cq_star, 2) END AS crf_reason FROM {ALL} LEFT JOIN v_cross USING (video_id, segment_index)""")
def _(t):
    return C.interpolated_crf(curves(t), THR, LO, HI).select("video_id", "segment_index", "crf", "crf_reason")


@query("d13_predict_unseen_crf", f"SELECT {K}, candidate, predicted_s_f FROM (SELECT *, unnest(range({LO}, {HI + 1}))::INT AS candidate FROM {ALL}) LEFT JOIN v_pred USING (video_id, segment_index, candidate)", "predicted_s_f")
def _(t):
    return C.predict_candidates(curves(t), LO, HI, THR).select("video_id", "segment_index", "candidate", "predicted_s_f")


@query("f13_anchor_and_band", f"SELECT {K}, anchor_cq, band_lo, band_hi FROM {ALL} LEFT JOIN v_anchor USING (video_id, segment_index)")
def _(t):
    return C.with_anchor(curves(t), THR).select("video_id", "segment_index", F.col("anchor.cq").alias("anchor_cq"), "band_lo", "band_hi")


def probes_sql(used: str, count: int) -> str:
    """Next probes per curve; `used` is a condition on (p, a) that marks taken CQs."""
    return f"""WITH j AS (SELECT p.*, a.* EXCLUDE (video_id, segment_index), CAST(round_even(cq_star, 0) AS INT) AS cv, greatest({LO}, band_lo) AS bl, least({HI}, band_hi) AS bh FROM v_pred p JOIN v_anchor a USING (video_id, segment_index)
 LEFT JOIN v_cross USING (video_id, segment_index) WHERE NOT ({used})),
s AS (SELECT *, candidate BETWEEN bl AND bh AS r1, abs(candidate - cv) <= 1 AS r2, candidate = anchor_cq + 1 AND predicted_s_f >= 0.5 * greatest(asf, 1e-9) AS r3, candidate < anchor_cq - 1 AS r4, coalesce(beyond < 88, FALSE) AND candidate > anchor_cq + 1 AS r5,
  candidate >= anchor_cq - 1 AND (predicted_s_f >= CASE WHEN asf > 0 THEN asf * 0.95 ELSE 0 END OR candidate = anchor_cq + 1 OR candidate = cv) AS keep,
  CASE WHEN candidate = anchor_cq - 1 THEN 0 WHEN candidate = anchor_cq + 1 THEN 1 WHEN candidate = cv THEN 2 END AS tag FROM j),
k AS (SELECT *, predicted_s_f + CASE WHEN r1 THEN 0.02 ELSE 0 END + CASE WHEN r2 THEN 0.015 ELSE 0 END + CASE WHEN r3 THEN 0.02 ELSE 0 END - CASE WHEN r4 THEN 0.1 * (anchor_cq - candidate) ELSE 0 END - CASE WHEN r5 THEN 0.25 ELSE 0 END AS score, bool_or(keep) OVER (PARTITION BY {K}) AS anyk FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN NOT anyk THEN tag END NULLS FIRST, round(score, 9) DESC, round(predicted_s_f, 9) DESC, candidate) AS rn FROM k WHERE keep OR (NOT anyk AND tag IS NOT NULL))
SELECT {K}, candidate AS cq, predicted_s_f, CASE WHEN anyk THEN concat_ws('+', 'pred_s_f', CASE WHEN r1 THEN 'sweet_band' END, CASE WHEN r2 THEN 'near_cq_vmaf*' END, CASE WHEN r3 THEN 'best+1' END, CASE WHEN r4 THEN 'overshoot_penalty' END, CASE WHEN r5 THEN 'known_fail_region' END)
 ELSE ['fallback_best-1', 'fallback_best+1', 'fallback_cq_vmaf*'][tag + 1] END AS probe_reason FROM r WHERE rn <= {count}"""


BARE_SQL = f"""SELECT {K}, unnest(list_filter(list_sort(list_distinct(list_transform(range(0, len(used) + 3), lambda i: CAST(round_even({LO} + {HI - LO} * i / greatest(len(used) + 2, 1)::DOUBLE, 0) AS INT)))), lambda c: NOT list_contains(used, c))[1:3]) AS cq,
 0.0::DOUBLE AS predicted_s_f, 'fallback_linspace' AS probe_reason FROM (SELECT {K}, list(DISTINCT cq) AS used FROM v_obs GROUP BY ALL HAVING count(*) FILTER (encode_ok) = 0) AS b"""


@query("f14_next_probes", "SELECT * FROM (" + probes_sql("EXISTS (SELECT 1 FROM v_obs o WHERE o.video_id = p.video_id AND o.segment_index = p.segment_index AND o.cq = p.candidate)", 3) + ") AS q UNION ALL " + BARE_SQL, "predicted_s_f")
def _(t):
    return C.next_probes(curves(t), 3, LO, HI, THR)


view("v_targets", """SELECT video_id, segment_index, 1 AS ti, av AS target, 'vmaf_anchor match CQ' || anchor_cq || ' V=' || fixed_text(av, 1) AS reason FROM v_anchor
UNION ALL SELECT video_id, segment_index, 2, greatest(86.0::DOUBLE, av - 2), 'vmaf_anchor push_compression V=' || fixed_text(pv, 1) FROM (SELECT *, greatest(86.0::DOUBLE, av - 2) AS pv FROM v_anchor) AS x WHERE av - 85 > 2 AND abs(greatest(86.0::DOUBLE, av - 2) - av) >= 0.75
UNION ALL SELECT video_id, segment_index, 3, 87.0::DOUBLE, 'vmaf_anchor near_gate V=87.0' FROM v_anchor WHERE 87 < av - 0.5""")


@query("f15_vmaf_anchored_crfs", f"""WITH p AS (SELECT q.*, ti, target, lead(cq) OVER w AS c2, lead(vmaf) OVER w AS v2, row_number() OVER (PARTITION BY {K}, ti ORDER BY abs(vmaf - target), pos) AS nr FROM v_pts q JOIN v_targets USING (video_id, segment_index) WHERE vmaf > 0 WINDOW w AS (PARTITION BY {K}, ti ORDER BY pos)),
h AS (SELECT {K}, ti, first(cq + (target - vmaf) / (v2 - vmaf) * (c2 - cq) ORDER BY pos) AS x FROM p WHERE (vmaf - target) * (v2 - target) <= 0 AND vmaf <> v2 GROUP BY 1, 2, 3),
n AS (SELECT {K}, ti, any_value(target) AS target, count(*) AS n, min(cq) FILTER (nr <= 2) AS ca, max(cq) FILTER (nr <= 2) AS cb, first(vmaf ORDER BY pos) FILTER (nr <= 2) AS va, first(vmaf ORDER BY pos DESC) FILTER (nr <= 2) AS vb FROM p GROUP BY 1, 2, 3),
c AS (SELECT n.video_id, n.segment_index, n.ti, n.target, CASE WHEN n = 1 THEN ca WHEN x IS NOT NULL THEN x WHEN va = vb THEN ca ELSE ca + (target - va) / (vb - va) * (cb - ca) END AS cqs FROM n LEFT JOIN h USING (video_id, segment_index, ti)),
m AS (SELECT c.*, t.reason, CAST(round_even(16 + greatest(0, least(1, (cqs - {LO}) / {HI - LO}.0::DOUBLE)) * 24, 0) AS INT) AS crf FROM c JOIN v_targets t USING (video_id, segment_index, ti)),
f AS (SELECT {K}, crf AS c0 FROM m WHERE ti = 1),
b AS (SELECT f.video_id, f.segment_index, 3 + i AS ti, greatest(16, least(40, c0 + o)) AS crf, 'band_around CRF' || c0 || printf('%+d', o) AS reason, a.av AS target FROM f JOIN v_anchor a USING (video_id, segment_index), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i, unnest([2, -2, 4, -4, 6, -6]) AS o) AS s),
u AS (SELECT {K}, ti, crf, reason, target FROM m UNION ALL SELECT {K}, ti, crf, reason, target FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY {K}, crf ORDER BY ti) AS own FROM u), e AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ti) AS pos FROM d WHERE own = 1)
SELECT {K}, CAST(crf AS INT) AS crf, reason, target AS target_vmaf FROM e WHERE pos <= 3""", "target_vmaf")
def _(t):
    return C.vmaf_anchored_crfs(curves(t), 3, (LO, HI), (16, 40), 85.0)


PLAN = "30, 32, 34"


@query("f16_rule_anchored_crf", f"""WITH c AS (SELECT DISTINCT {K}, (video_id % 10) / 10.0::DOUBLE < 0.55 AS push FROM v_obs),
p AS (SELECT *, vmaf >= 93 AS pass, lead(cq) OVER w AS c2, lead(vmaf) OVER w AS v2 FROM v_pts WHERE cq IN ({PLAN}) AND vmaf > 0 WINDOW w AS (PARTITION BY {K} ORDER BY pos)),
g AS (SELECT {K}, count(*) AS n, count(*) FILTER (pass) AS np, min(cq) AS lowc, max(cq) AS highc, first(vmaf ORDER BY pos) AS lowv, first(vmaf ORDER BY cq DESC, pos) AS highv,
 min(vmaf) FILTER (pass) AS minv, max(cq) FILTER (pass) AS topc, max(round(s_f, 12)) FILTER (pass) AS bests, first(cq ORDER BY round(s_f, 12) DESC, cq DESC) FILTER (pass) AS bestc,
 least(34, greatest(30, round_even(first(cq + (93 - vmaf) / (v2 - vmaf) * (c2 - cq) ORDER BY pos) FILTER ((vmaf - 93) * (v2 - 93) <= 0 AND vmaf <> v2), 0))) AS star FROM p GROUP BY 1, 2),
o AS (SELECT {K}, cq AS star, round(first(s_f ORDER BY pos), 12) AS ons FROM p WHERE pass GROUP BY 1, 2, 3),
x AS (SELECT c.video_id, c.segment_index, push, n, np, lowc, highc, lowv, highv, minv, topc, CASE WHEN ons >= bests THEN star ELSE bestc END AS pick, bestc,
 push AND lowv >= 94.5 AND highv < 93 AND highv >= 92 AS lean FROM c LEFT JOIN g USING (video_id, segment_index) LEFT JOIN o USING (video_id, segment_index, star))
SELECT {K}, CAST(CASE WHEN n IS NULL THEN NULL WHEN n = 1 AND np = 1 AND push AND lowv >= 95 THEN lowc + 1 WHEN n = 1 AND np = 1 THEN lowc WHEN n = 1 THEN lowc - 1
 WHEN np = n AND push AND minv >= 96 THEN topc + 1 WHEN np = n AND push AND minv >= 95 THEN topc WHEN np = n THEN bestc WHEN np = 0 THEN lowc - 1 WHEN lean THEN highc ELSE pick END AS INT) AS crf,
CASE WHEN n IS NULL THEN 'no_observations' WHEN n = 1 AND np = 1 AND push AND lowv >= 96 THEN 'single_pass_margin+1' WHEN n = 1 AND np = 1 AND push AND lowv >= 95 THEN 'single_pass_nudge'
 WHEN n = 1 AND np = 1 THEN 'single_pass_keep' WHEN n = 1 THEN 'single_fail_nudge-1' WHEN np = n AND push AND minv >= 96 THEN 'all_pass_margin+1' WHEN np = n AND push AND minv >= 95 THEN 'all_pass_high_crf'
 WHEN np = n THEN 'all_pass_best_s_f' WHEN np = 0 THEN 'all_fail_nudge-1' WHEN lean THEN 'bracket_lean_up' ELSE 'bracket' END AS crf_reason FROM x""")
def _(t):
    c = curves(t, gates=(THR,)).withColumns({"plan": F.expr(f"array({PLAN})"), "mashup": (F.col("video_id") % 10) / 10.0})
    # the probe plan: only its points count
    c = c.withColumn("pts", F.filter("pts", lambda x: F.array_contains(F.col("plan"), x["cq"])))
    return C.rule_anchored_crf(c, "plan", "mashup", LO, HI, THR).select("video_id", "segment_index", "crf", "crf_reason")


@query("f27_handoff_set", f"""WITH q AS ({probes_sql('p.candidate = a.anchor_cq', 3)}),
h AS (SELECT {K}, anchor_cq AS cq, 'measured_best' AS reason, asf AS predicted_s_f, 0 AS rk FROM v_anchor UNION ALL SELECT {K}, cq, 'interp_' || probe_reason, predicted_s_f, row_number() OVER (PARTITION BY {K} ORDER BY cq) FROM q),
m AS (SELECT *, greatest(16, least(40, cq - 6)) AS crf FROM h)
SELECT {K}, crf, cq, reason, predicted_s_f FROM (SELECT *, row_number() OVER (PARTITION BY {K}, crf ORDER BY rk) AS rn FROM m) AS x WHERE rn = 1""", "predicted_s_f")
def _(t):
    h = C.handoff(curves(t), 4, LO, HI, THR)
    return C.map_offset(h, -6, 16, 40).select("video_id", "segment_index", "crf", "cq", "reason", "predicted_s_f")
