"""Trial queries."""

from pyspark.sql import functions as F

from trialspark.functions.numbers import round_even
from trialspark.functions.score import with_compression, with_score
from trialspark.operators import trials as T
from trialspark.plans.registry import query, view

SEQ = ", ".join(T.SEQ)
SEQD = ", ".join(f"{c} DESC" for c in T.SEQ)
OUT = "video_id, segment_index, crf, aq_strength, s_f, vmaf_neg, k1"
OUTC = OUT.split(", ")


def _top(src, keys, order, where="TRUE", cols=OUT):
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
FROM {src} WHERE {where}) AS t WHERE rn = 1"""


GROUP = "video_id, segment_index"

view("v_merged", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index, crf, round_even(aq_strength, 4)
ORDER BY root_rank DESC, {SEQD}) AS rn FROM v_scored) AS t WHERE rn = 1""")
view("v_labels", f"""SELECT b.video_id, b.crf AS oracle_crf, b.aq_strength AS oracle_aq_strength, b.s_f AS oracle_s_f, b.vmaf_neg AS oracle_vmaf_neg,
a.crf AS crf_at_threshold, a.aq_strength AS aq_at_threshold, a.s_f AS s_f_at_threshold
FROM ({_top('v_scored', 'video_id', f'gates_ok DESC, s_f DESC, vmaf_neg DESC, {SEQ}')}) AS b
LEFT JOIN ({_top('v_scored', 'video_id', f'crf, s_f DESC, vmaf_neg DESC, {SEQ}', 'gates_ok AND vmaf_neg >= 85')}) AS a USING (video_id)""")


def labels(t):
    """One label row per video, made from the trials."""
    best = T.oracle_best(t.scored, ["video_id"]).select(
        "video_id", F.col("crf").alias("oracle_crf"), F.col("aq_strength").alias("oracle_aq_strength"),
        F.col("s_f").alias("oracle_s_f"), F.col("vmaf_neg").alias("oracle_vmaf_neg"))
    at = T.crf_at_threshold(t.scored, ["video_id"], 85.0).select(
        "video_id", F.col("crf").alias("crf_at_threshold"), F.col("aq_strength").alias("aq_at_threshold"),
        F.col("s_f").alias("s_f_at_threshold"))
    return best.join(at, "video_id", "left")


@query("b11_compression_measure", "SELECT k1, k2, k3, k4, compression_rate, compression_ratio FROM v_measured")
def _(t):
    return with_compression(t.trials).select("k1", "k2", "k3", "k4", "compression_rate", "compression_ratio")


@query("b14_trial_scoring", "SELECT k1, k2, k3, k4, s_f, reason FROM v_scored", "s_f")
def _(t):
    return t.scored.select("k1", "k2", "k3", "k4", "s_f", "reason")


view("v_logged", """SELECT *, CAST(floor(size_out) AS BIGINT) AS size_out_bytes FROM v_scored""")


@query("b15_rescore_job", """
WITH seg AS (SELECT video_id, segment_index, CAST(max(floor(size_in)) AS BIGINT) AS src FROM v_trials GROUP BY 1, 2),
j AS (SELECT l.*, src, CASE WHEN size_out_bytes < src THEN size_out_bytes::DOUBLE / src ELSE 1.0 END AS r
      FROM v_logged l JOIN seg USING (video_id, segment_index)),
n AS (SELECT *, 1.0::DOUBLE / r AS q, encode_ok AND src > 0 AND size_out_bytes > 0 AS live FROM j),
s AS (SELECT *, CASE WHEN r >= 0.8 OR vmaf_neg < 80 THEN 0
       WHEN vmaf_neg < 85 THEN least(1.0, (CASE WHEN q <= 20 THEN pow((q - 1) / 19, 1.5) ELSE 1.0 + 0.3 * ln(q / 20) END) * (0.7 * pow((vmaf_neg - 80) / 5, 2)) / 1.12)
       ELSE least(1.0, (0.7 * (CASE WHEN q <= 20 THEN pow((q - 1.25) / 18.75, 0.9) ELSE 1.0 + 0.1 * ln(q / 20) END) + 0.3 * (0.7 + 0.3 * least(1.0, (vmaf_neg - 85) / 15))) / 1.12) END AS nsf
  FROM n)
SELECT k1, k2, k3, k4, CASE WHEN live THEN r ELSE compression_rate END AS compression_rate,
  CASE WHEN live THEN nsf ELSE s_f END AS s_f,
  live AND (abs(compression_rate - r) > 1e-9 OR abs(s_f - nsf) > 1e-9) AS changed FROM s""", "compression_rate s_f")
def _(t):
    seg = t.trials.groupBy(*T.SEGMENT).agg(F.max(F.floor("size_in")).cast("bigint").alias("source_bytes"))
    logged = t.scored.withColumn("size_out_bytes", F.floor("size_out").cast("bigint"))
    return T.rescore(logged, seg, 85.0).select("k1", "k2", "k3", "k4", "compression_rate", "s_f", "changed")


@query("c03_trial_selection", "SELECT k1, k2, k3, k4, crf FROM v_trials WHERE encode_ok AND gates_ok")
def _(t):
    return T.select_trials(t.trials, gates_only=True, include_failed=False).select("k1", "k2", "k3", "k4", "crf")


@query("c04_truthy_coercion", """
WITH x AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_shipdate AS k3, l_extendedprice AS k4,
 CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'True' ELSE 'YES' END ELSE CASE l_linestatus WHEN 'F' THEN '0' ELSE '1' END END AS f FROM lineitem)
SELECT k1, k2, k3, k4, coalesce(lower(f) IN ('1', 'true', 'yes'), TRUE) AS ok_report, coalesce(lower(f) IN ('1', 'true', 'yes'), FALSE) AS ok_search FROM x""")
def _(t):
    st = F.col("l_linestatus") == "F"
    flag = (F.when(F.col("l_returnflag") == "R", None)
            .when(F.col("l_returnflag") == "A", F.when(st, "True").otherwise("YES"))
            .otherwise(F.when(st, "0").otherwise("1")))
    return t.lineitem.select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
                             F.col("l_shipdate").alias("k3"), F.col("l_extendedprice").alias("k4"),
                             T.truthy(flag, True).alias("ok_report"), T.truthy(flag, False).alias("ok_search"))


@query("c06_complete_label", """
SELECT o_orderkey AS video_id FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN 89 ELSE 85 END = 85
AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_custkey % 50 > 0""")
def _(t):
    c = F.col
    lab = t.orders.select(
        c("o_orderkey").alias("video_id"), F.when(c("o_orderkey") % 3 == 0, 89).otherwise(85).alias("threshold"),
        (c("o_custkey") % 50).cast("int").alias("trial_count"),
        F.struct(F.when(c("o_orderpriority") == "5-LOW", "").otherwise("aq-mode=2").alias("params"),
                 F.when(c("o_orderstatus") == "P", "x").otherwise("30").alias("crf")).alias("oracle_best_sf"))
    return T.complete_labels(lab, 85).select("video_id")


@query("c07_interval_validity", """SELECT k1, k2, k3, k4, encode_ok AND vmaf_neg > 85 AND compression_ratio > 2.5 AS valid,
nullif(CASE WHEN NOT encode_ok THEN 'encode_failed' ELSE concat_ws(',', CASE WHEN vmaf_neg <= 85 THEN 'vmaf<=85' END, CASE WHEN compression_ratio <= 2.5 THEN 'ratio<=2.5' END) END, '') AS invalid_reason
FROM v_measured""")
def _(t):
    return T.interval_state(with_compression(t.trials), 85.0, 2.5).select("k1", "k2", "k3", "k4", "valid", "invalid_reason")


@query("c08_mode_feasibility", """SELECT k1, k2, k3, k4, encode_ok AND vmaf_neg > 85 AS crf_ok,
encode_ok AND vmaf_neg > 85 AND compression_rate < 0.3 AS crf_small_ok, encode_ok AND vmaf_neg > 85 AND s_f > 0 AS vbr_ok FROM v_scored""")
def _(t):
    ok, v = F.col("encode_ok"), F.col("vmaf_neg")
    return t.scored.select("k1", "k2", "k3", "k4", T.feasible_crf(ok, v, F.col("compression_rate"), 85.0).alias("crf_ok"),
                           T.feasible_crf(ok, v, F.col("compression_rate"), 85.0, 0.3).alias("crf_small_ok"),
                           T.feasible_vbr(ok, v, F.col("s_f"), 85.0).alias("vbr_ok"))


@query("d01_trials_with_labels", """SELECT s.video_id, k1, k2, k3, k4,
coalesce(crf = oracle_crf AND abs(aq_strength - oracle_aq_strength) < 1e-6, FALSE) AS is_oracle_best_sf,
coalesce(crf = crf_at_threshold AND abs(aq_strength - aq_at_threshold) < 1e-6, FALSE) AS is_oracle_crf_at_threshold
FROM v_scored s LEFT JOIN v_labels l USING (video_id)""")
def _(t):
    none = F.lit(None).cast("string")
    lab = labels(t).withColumns({"oracle_params": none, "params_at_threshold": none})
    return T.flag_trials(t.scored.withColumn("params", none), lab).select(
        "video_id", "k1", "k2", "k3", "k4", "is_oracle_best_sf", "is_oracle_crf_at_threshold")


@query("d02_feature_fallback", """
WITH a AS (SELECT s_suppkey AS video_id, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END AS texture, CASE WHEN s_nationkey % 4 = 0 THEN s_nationkey::DOUBLE END AS entropy FROM supplier),
b AS (SELECT p_partkey AS video_id, p_retailprice AS texture, p_size::DOUBLE AS entropy FROM part)
SELECT k1, k2, k3, k4, CASE WHEN coalesce(a.texture, a.entropy) IS NOT NULL THEN a.texture ELSE b.texture END AS feat_texture,
CASE WHEN coalesce(a.texture, a.entropy) IS NOT NULL THEN a.entropy ELSE b.entropy END AS feat_entropy, 85 AS threshold
FROM v_trials t LEFT JOIN a USING (video_id) LEFT JOIN b USING (video_id)""")
def _(t):
    c = F.col
    a = t.supplier.select(c("s_suppkey").alias("video_id"), F.when(c("s_nationkey") % 2 == 0, c("s_acctbal")).alias("texture"),
                          F.when(c("s_nationkey") % 4 == 0, c("s_nationkey").cast("double")).alias("entropy"))
    b = t.part.select(c("p_partkey").alias("video_id"), c("p_retailprice").alias("texture"), c("p_size").cast("double").alias("entropy"))
    tr = t.trials.withColumn("threshold", F.lit(None).cast("int"))
    return T.feature_fallback(tr, a, b, ["texture", "entropy"], default_threshold=85).select(
        "k1", "k2", "k3", "k4", "feat_texture", "feat_entropy", "threshold")


@query("d03_todo_grid", """
WITH seg AS (SELECT DISTINCT video_id, segment_index FROM v_trials),
g AS (SELECT c::INT AS crf, a AS aq_key FROM (SELECT unnest([24, 30, 36, 42]) AS c) AS x, (SELECT unnest([0.2::DOUBLE, 1.0, 1.8, 2.6]) AS a) AS y)
SELECT seg.video_id, seg.segment_index, g.crf, g.aq_key FROM seg, g WHERE NOT EXISTS (SELECT 1 FROM v_trials t WHERE t.encode_ok AND t.video_id = seg.video_id
 AND t.segment_index = seg.segment_index AND t.crf = g.crf AND round_even(t.aq_strength, 4) = g.aq_key)""")
def _(t):
    return T.todo_grid(t.trials, t.trials, [24, 30, 36, 42], [0.2, 1.0, 1.8, 2.6])


@query("f03_best_trial", _top("v_scored", GROUP, f"s_f DESC, {SEQ}", "encode_ok"), "s_f")
def _(t):
    return T.best_trial(t.scored).select(*OUTC)


@query("f03_best_trial_gated", _top("v_scored", GROUP, f"s_f DESC, {SEQ}", "encode_ok AND gates_ok"), "s_f")
def _(t):
    return T.best_trial(t.scored, gated="only").select(*OUTC)


@query("f03_best_trial_prefer_gated", _top("v_scored", GROUP, f"gates_ok DESC, s_f DESC, {SEQ}", "encode_ok"), "s_f")
def _(t):
    return T.best_trial(t.scored, gated="prefer").select(*OUTC)


@query("f04_last_wins_dedupe", f"SELECT {OUT}, root_rank FROM v_merged", "s_f")
def _(t):
    return T.dedupe_last_wins(t.scored).select(*OUTC, "root_rank")


@query("f05_oracle_best", _top("v_scored", "video_id", f"gates_ok DESC, s_f DESC, vmaf_neg DESC, {SEQ}"), "s_f")
def _(t):
    return T.oracle_best(t.scored, ["video_id"]).select(*OUTC)


@query("f06_crf_at_threshold", _top("v_scored", "video_id", f"crf, s_f DESC, vmaf_neg DESC, {SEQ}", "gates_ok AND vmaf_neg >= 85"), "s_f")
def _(t):
    return T.crf_at_threshold(t.scored, ["video_id"], 85.0).select(*OUTC)


@query("f07_search_best", _top("v_scored", "video_id", f"s_f DESC, vmaf_neg DESC, crf ASC NULLS LAST, {SEQ}", "encode_ok"), "s_f")
def _(t):
    return T.search_best(t.scored, ["video_id"]).select(*OUTC)


PRE = "CASE crf % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'hqdn3d_light' WHEN 2 THEN 'bilateral_light' ELSE 'unsharp_mild' END"


@query("f08_preprocess_winner", f"""SELECT video_id, aq_strength, CASE WHEN gates_ok THEN nullif(preprocess, 'none') END AS winner, gates_ok AS any_passed, k1
FROM (SELECT *, {PRE} AS preprocess, row_number() OVER (PARTITION BY video_id, aq_strength ORDER BY gates_ok DESC, s_f DESC, vmaf_neg DESC, {SEQ}) AS rn FROM v_scored) AS t WHERE rn = 1""")
def _(t):
    m = F.col("crf") % 4
    df = t.scored.withColumn("preprocess", F.when(m == 0, "none").when(m == 1, "hqdn3d_light")
                             .when(m == 2, "bilateral_light").otherwise("unsharp_mild"))
    return T.preprocess_winner(df, ["video_id", "aq_strength"]).select("video_id", "aq_strength", "winner", "any_passed", "k1")


@query("f09_incumbent_trace", f"""
WITH r AS (SELECT *, encode_ok AND s_f > 0 AS c, vmaf_neg > 85 AS cl FROM v_scored),
k AS (SELECT *, CASE WHEN c THEN dense_rank() OVER (PARTITION BY video_id ORDER BY c, cl, s_f, CASE WHEN cl THEN 0 ELSE vmaf_neg END) END AS rk FROM r),
m AS (SELECT *, max(rk) OVER w AS best, max(rk) OVER (PARTITION BY video_id ORDER BY {SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM k WINDOW w AS (PARTITION BY video_id ORDER BY {SEQ} ROWS UNBOUNDED PRECEDING))
SELECT video_id, k1, k2, k3, k4, rk IS NOT NULL AND (prev IS NULL OR rk > prev) AS accepted,
  last_value(CASE WHEN rk IS NOT NULL AND (prev IS NULL OR rk > prev) THEN s_f END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY {SEQ} ROWS UNBOUNDED PRECEDING) AS best_s_f FROM m""", "best_s_f")
def _(t):
    out = T.incumbent_trace(t.scored, ["video_id"], 85.0, F.floor(F.col("k1") / 4096).cast("bigint"))
    return out.select("video_id", "k1", "k2", "k3", "k4", "accepted", "best_s_f")


@query("f10_attempt_pick", f"""SELECT {OUT}, passed FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index ORDER BY passed DESC, CASE WHEN passed THEN crf END DESC NULLS LAST,
CASE WHEN NOT passed THEN vmaf_neg END DESC NULLS LAST, {SEQ}) AS rn FROM (SELECT *, encode_ok AND vmaf_neg >= 95 AND size_out * 100.0 / size_in <= 30 AS passed FROM v_scored) AS a) AS t WHERE rn = 1""", "s_f")
def _(t):
    df = t.scored.withColumn("encode_percent", T.encoded_percent(F.col("size_in"), F.col("size_out")))
    return T.best_attempt(df, T.SEGMENT, 95.0, 30.0).select(*OUTC, "passed")


@query("h01_union_of_roots", """SELECT video_id, k1, k2, k3, k4, CASE WHEN NOT rr = 1 THEN size_in END AS size_in, CASE WHEN rr = 1 THEN vmaf_neg END AS vmaf_neg, rr AS root_rank
FROM (SELECT *, root_rank AS rr FROM v_trials) AS t""")
def _(t):
    base = t.trials
    a = base.filter(F.col("root_rank") == 0).select("video_id", "k1", "k2", "k3", "k4", "size_in")
    b = base.filter(F.col("root_rank") == 1).select("video_id", "k1", "k2", "k3", "k4", "vmaf_neg")
    return T.merge_roots([a, b])


@query("h02_ordered_distinct", """SELECT url_key, min(page_id) AS page_id FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url_key FROM pages) AS p GROUP BY 1""")
def _(t):
    key = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return T.ordered_distinct(t.pages.select(key.alias("url_key"), "page_id"), ["url_key"], ["page_id"])


@query("h04_not_logged", """SELECT DISTINCT video_id, segment_index, crf, aq_strength FROM v_trials WHERE root_rank = 1
EXCEPT SELECT video_id, segment_index, crf, aq_strength FROM v_trials WHERE root_rank = 0""")
def _(t):
    keys = ["video_id", "segment_index", "crf", "aq_strength"]
    return T.not_logged(t.trials.filter("root_rank = 1").select(*keys).distinct(), t.trials.filter("root_rank = 0"), keys)


BEST = f"first(%s ORDER BY s_f DESC, {SEQ}) FILTER (%s)"


@query("e09_sweep_summary", f"""
WITH b AS ({_top('v_scored', GROUP, f's_f DESC, {SEQ}', 'encode_ok')}), g AS ({_top('v_scored', GROUP, f's_f DESC, {SEQ}', 'encode_ok AND gates_ok')})
SELECT t.*, b.crf AS best_crf, b.aq_strength AS best_aq, b.s_f AS best_s_f, g.crf AS gated_crf, g.aq_strength AS gated_aq, g.s_f AS gated_s_f
FROM (SELECT video_id, segment_index, count(*) AS n_trials, count(*) FILTER (encode_ok) AS n_ok FROM v_scored GROUP BY 1, 2) AS t
LEFT JOIN b USING (video_id, segment_index) LEFT JOIN g USING (video_id, segment_index)""", "best_s_f gated_s_f")
def _(t):
    return T.sweep_summary(t.scored)


@query("e09_sweep_summary_video", f"""
WITH b AS ({_top('v_scored', 'video_id', f's_f DESC, {SEQ}', 'encode_ok')}), g AS ({_top('v_scored', 'video_id', f's_f DESC, {SEQ}', 'encode_ok AND gates_ok')})
SELECT t.*, b.crf AS best_crf, b.aq_strength AS best_aq, b.s_f AS best_s_f, g.crf AS gated_crf, g.aq_strength AS gated_aq, g.s_f AS gated_s_f
FROM (SELECT video_id, count(*) AS n_trials, count(*) FILTER (encode_ok) AS n_ok FROM v_scored GROUP BY 1) AS t
LEFT JOIN b USING (video_id) LEFT JOIN g USING (video_id)""", "best_s_f gated_s_f")
def _(t):
    return T.sweep_summary(t.scored, ["video_id"])


@query("e10_merged_catalogue", """
WITH m AS (SELECT video_id, segment_index, count(*) AS n, count(*) FILTER (encode_ok) AS ok FROM v_merged GROUP BY 1, 2),
v AS (SELECT video_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_trials, CAST(sum(ok) AS BIGINT) AS n_ok FROM m GROUP BY 1),
r AS (SELECT video_id, count(*) FILTER (root_rank = 0) AS raw_grid, count(*) FILTER (root_rank = 1) AS raw_adaptive FROM v_trials GROUP BY 1)
SELECT v.*, raw_grid, raw_adaptive, s_nationkey % 3 + 7 AS expected_n_segments,
 CASE WHEN raw_grid > 0 AND raw_adaptive > 0 THEN 'adaptive+grid' WHEN raw_grid > 0 THEN 'grid' ELSE 'adaptive' END AS method_label,
 coalesce(n_segments < s_nationkey % 3 + 7, FALSE) AS incomplete
FROM v JOIN r USING (video_id) LEFT JOIN supplier ON s_suppkey = video_id""")
def _(t):
    exp = t.supplier.select(F.col("s_suppkey").alias("video_id"), (F.col("s_nationkey") % 3 + 7).alias("expected_n_segments"))
    return T.merged_catalogue(t.scored, exp, ["grid", "adaptive"])


CRFS = list(range(22, 43))


@query("e11_surface_pivot", f"""
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index, crf, aq_strength ORDER BY root_rank DESC, {SEQD}) AS rn FROM v_scored WHERE encode_ok) AS x WHERE rn = 1)
SELECT video_id, segment_index, aq_strength AS aq, {', '.join(f'max(CASE WHEN crf = {c} THEN s_f END) AS crf_{c}' for c in CRFS)} FROM c GROUP BY 1, 2, 3""",
       " ".join(f"crf_{c}" for c in CRFS))
def _(t):
    return T.surface_pivot(T.surface_cells(t.scored, ["s_f"]), "s_f", CRFS)


@query("e11_surface_summary", """SELECT *, n_ok < greatest(1, n_crf * n_aq) * 0.85 AS sparse FROM (SELECT video_id, segment_index, count(*) AS n_trials, count(*) FILTER (encode_ok AND gates_ok) AS n_ok,
count(DISTINCT crf) FILTER (encode_ok AND gates_ok) AS n_crf, count(DISTINCT aq_strength) FILTER (encode_ok AND gates_ok) AS n_aq FROM v_scored GROUP BY 1, 2) AS t""")
def _(t):
    return T.surface_summary(t.scored, gates_only=True)


@query("e14_pass_interval", f"""
WITH d AS (SELECT *, encode_ok AND vmaf_neg > 85 AND compression_ratio > 2.0 AS valid, round_even(aq_strength, 1) AS aq FROM
 (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index, crf, round_even(aq_strength, 1) ORDER BY root_rank DESC, {SEQD}) AS rn FROM v_scored) AS x WHERE rn = 1),
b AS (SELECT video_id, segment_index, crf, aq AS best_aq, s_f AS best_s_f FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index, crf ORDER BY s_f DESC, aq) AS r2 FROM d WHERE valid) AS y WHERE r2 = 1)
SELECT t.*, n_valid = 0 AS is_empty, best_aq, best_s_f FROM (SELECT video_id, segment_index, crf, min(aq) FILTER (valid) AS aq_lo, max(aq) FILTER (valid) AS aq_hi, count(*) AS n_probes, count(*) FILTER (valid) AS n_valid
 FROM d GROUP BY 1, 2, 3) AS t LEFT JOIN b USING (video_id, segment_index, crf)""", "best_s_f")
def _(t):
    return T.pass_intervals(t.scored, 85.0, 2.0)


@query("e16_param_impact", f"""
WITH p AS (SELECT *, ['aq-mode', 'rd', 'ref', 'bframes', 'rc-lookahead'][CAST(crf % 5 AS INT) + 1] AS param, CAST(crf AS VARCHAR) AS value, vmaf_neg - 88.5 AS d FROM v_trials WHERE encode_ok),
h AS (SELECT param, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY vmaf_neg DESC, {SEQ}) AS rn FROM p) AS x WHERE rn = 1),
l AS (SELECT param, value AS worst_value FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY vmaf_neg, {SEQ}) AS rn FROM p) AS x WHERE rn = 1)
SELECT t.param, max_abs_delta_vmaf, best_value, best_vmaf_neg, worst_value, worst_vmaf_neg, trials FROM
(SELECT param, max(abs(d)) AS max_abs_delta_vmaf, max(vmaf_neg) AS best_vmaf_neg, min(vmaf_neg) AS worst_vmaf_neg, count(*) AS trials FROM p GROUP BY 1) AS t JOIN h USING (param) JOIN l USING (param)""",
       "max_abs_delta_vmaf")
def _(t):
    names = F.array(*[F.lit(x) for x in ("aq-mode", "rd", "ref", "bframes", "rc-lookahead")])
    df = t.trials.select("k1", "k2", "k3", "k4", "vmaf_neg", F.col("encode_ok").alias("ok"), F.col("crf").cast("string").alias("value"),
                         F.element_at(names, F.col("crf") % 5 + 1).alias("param"), (F.col("vmaf_neg") - 88.5).alias("delta_vmaf_vs_baseline"))
    return T.param_impact(df)


@query("e20_dashboard_summary", f"""
WITH b AS ({_top('v_scored', GROUP, f's_f DESC, {SEQ}', 'encode_ok', '*')}), g AS ({_top('v_scored', GROUP, f's_f DESC, {SEQ}', 'encode_ok AND gates_ok', '*')})
SELECT t.*, b.crf AS best_crf, b.aq_strength AS best_aq, round_even(b.s_f, 4) AS best_s_f, round_even(b.vmaf_neg, 2) AS best_vmaf, round_even(b.compression_ratio, 2) AS best_ratio,
 g.crf AS gated_crf, g.aq_strength AS gated_aq, round_even(g.s_f, 4) AS gated_s_f
FROM (SELECT video_id, segment_index, count(*) AS n FROM v_scored WHERE encode_ok GROUP BY 1, 2) AS t JOIN b USING (video_id, segment_index) LEFT JOIN g USING (video_id, segment_index)""",
       "best_s_f best_vmaf best_ratio gated_s_f")
def _(t):
    return T.dashboard_summary(t.scored)


@query("g07_grid_order", "SELECT video_id, segment_index, crf, aq_strength, s_f FROM v_merged ORDER BY crf, aq_strength", "s_f")
def _(t):
    return T.dedupe_last_wins(t.scored).select("video_id", "segment_index", "crf", "aq_strength", "s_f").orderBy("crf", "aq_strength")
