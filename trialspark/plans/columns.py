"""Column function queries."""

from pyspark.sql import functions as F

from trialspark.functions import features as FE, numbers as N, text as X
from trialspark.functions.documents import with_json_fields
from trialspark.plans.registry import query

PARAMS = "concat('aq-mode=', CAST(l_linenumber AS STRING), ':aq-strength=', CAST(l_discount AS STRING), ':rd= ', CAST(l_quantity AS STRING), ' :ref=', l_returnflag, ':scenecut::rd=6')"


@query("b06_feature_canonicalisation", """WITH r AS (SELECT *, CASE WHEN seg_key % 3 = 0 THEN NULL ELSE motion_p90 END AS mm, CASE WHEN seg_key % 5 = 0 THEN NULL ELSE noise END AS cr FROM v_segments)
SELECT seg_key, coalesce(mm, edge) AS motion_mean, texture, least(3840, 2160)::DOUBLE AS short_side, (3840 * 2160)::DOUBLE AS pixels, cr AS cut_density, least(cr / 0.5::DOUBLE, 1.0::DOUBLE) AS cut_level FROM r""")
def _(t):
    raw = t.segments.select("seg_key", F.when(F.col("seg_key") % 3 != 0, F.col("motion_p90")).alias("motion_mean"), F.col("edge").alias("mean_motion"),
                            F.col("texture").alias("mean_texture"), F.when(F.col("seg_key") % 5 != 0, F.col("noise")).alias("cut_rate"),
                            F.lit(3840).alias("width"), F.lit(2160).alias("height"))
    return FE.canonical_features(raw).select("seg_key", "motion_mean", "texture", "short_side", "pixels", "cut_density", "cut_level")


@query("b07_feature_column_contract", "SELECT seg_key, " + ", ".join(
    ({"texture": "texture", "entropy": "entropy", "flatness": "flatness", "luma_mean": "luma_mean", "motion_p90": "motion_p90", "duration": "duration"}.get(k, "CAST(NULL AS DOUBLE)")) + f" AS feat_{k}"
    for k in FE.FEATURE_KEYS) + " FROM v_segments")
def _(t):
    return FE.feature_columns(t.segments.select("seg_key", "texture", "entropy", "flatness", "luma_mean", "motion_p90", "duration"), ["seg_key"])


@query("b08_param_expansion", f"""SELECT l_orderkey AS k1, l_linenumber AS k2, l_shipdate AS k3, l_extendedprice AS k4, l_linenumber AS aq_mode, l_discount AS aq_strength, 6 AS rd, CAST(NULL AS INT) AS ref, l_returnflag AS ref_raw,
1 AS scenecut, CAST(NULL AS INT) AS keyint FROM lineitem""")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_shipdate").alias("k3"),
                           F.col("l_extendedprice").alias("k4"), F.expr(PARAMS).alias("params"))
    return X.expand_options(df, "params").select("k1", "k2", "k3", "k4", "aq_mode", "aq_strength", "rd", "ref", "ref_raw", "scenecut", "keyint")


@query("b09_param_override_merge", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'aq-mode=3:rd=5:ref=4' WHEN o_orderkey % 7 = 0 THEN 'rd=' || o_custkey || ':me'
ELSE 'aq-mode=3:rd=' || o_custkey || ':ref=4:me=1' END AS params FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    base = F.when(k % 5 == 0, "aq-mode=3:rd=5:ref=4").when(k % 7 == 0, "").otherwise("aq-mode=3:rd=5:ref=4")
    over = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("rd="), F.col("o_custkey").cast("string"), F.lit(":me")))
    return t.orders.select("o_orderkey", X.merge_options(base, over).alias("params"))


@query("b10_cell_sanitiser", r"""SELECT doc_id, CASE WHEN length(o) > 240 THEN substr(o, 1, 237) || '...' ELSE o END AS cell
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS o FROM documents) AS d""")
def _(t):
    return t.documents.select("doc_id", X.sanitize_cell(F.col("text")).alias("cell"))


@query("b12_target_bitrate", """WITH j AS (SELECT o_orderkey, floor(o_totalprice * 1000) AS b, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey % 60 + 1 END::DOUBLE AS d, (o_orderkey % 13)::DOUBLE / 12 AS r FROM orders),
m AS (SELECT *, r * b * 8.0 / d / 1000000.0 AS mbps FROM j), g AS (SELECT *, greatest(1.0, mbps * 1000.0) AS kb FROM m)
SELECT o_orderkey, CASE WHEN d > 0 AND r > 0 AND r < 1 THEN CASE WHEN mbps >= 1 THEN fixed_text(mbps, 3) || 'M' ELSE fixed_text(kb, 0) || 'k' END END AS bitrate,
CASE WHEN d <= 0 THEN 'bad duration' WHEN NOT (r > 0 AND r < 1) THEN 'bad rate' END AS error FROM g""")
def _(t):
    k = F.col("o_orderkey")
    d = F.when(k % 11 == 0, 0).otherwise(F.col("o_custkey") % 60 + 1).cast("double")
    out = X.bitrate_for_rate(F.floor(F.col("o_totalprice") * 1000).cast("double"), d, (k % 13).cast("double") / 12.0)
    return t.orders.select("o_orderkey", out.alias("o")).select("o_orderkey", "o.*")


@query("b12_bitrate_text_parse", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey * (1 / 1000.0)::DOUBLE WHEN 1 THEN o_custkey::DOUBLE WHEN 2 THEN o_custkey * 1000.0 WHEN 3 THEN NULL ELSE o_custkey::DOUBLE END::DOUBLE AS mbps FROM orders""")
def _(t):
    c = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 5
    txt = (F.when(m == 0, F.concat(c, F.lit("k"))).when(m == 1, F.concat(F.lit(" "), c, F.lit("M "))).when(m == 2, F.concat(c, F.lit("g")))
           .when(m == 3, F.concat(c, F.lit("x"))).otherwise(c))
    return t.orders.select("o_orderkey", X.parse_bitrate(txt).alias("mbps"))


MODES = ["rc", " Crf ", "CQ", "abr", "vbr", "Bitrate", "avg_bitrate", "", "hq"]


@query("b13_mode_normalisation", """SELECT o_orderkey, ['RC', 'RC', 'RC', 'ABR', 'ABR', 'ABR', 'ABR', 'RC', NULL][CAST(o_orderkey % 9 AS INT) + 1] AS codec_mode FROM orders""")
def _(t):
    m = F.element_at(F.array(*[F.lit(x) for x in MODES]), (F.col("o_orderkey") % 9).cast("int") + 1)
    return t.orders.select("o_orderkey", X.codec_mode(m).alias("codec_mode"))


@query("b16_soft_levels", """SELECT seg_key, motion_p90 / (motion_p90 + 0.145::DOUBLE) AS motion_level, texture / (texture + 4.22::DOUBLE) AS texture_level, noise / (noise + 0.048::DOUBLE) AS noise_level_norm,
edge / (edge + 0.0475::DOUBLE) AS edge_level, hf_energy / (hf_energy + 4.99::DOUBLE) AS hf_level FROM v_segments""")
def _(t):
    return t.segments.select("seg_key", *[v.alias(k) for k, v in FE.soft_levels().items()])


@query("b17_segment_difficulty", "SELECT seg_key, difficulty FROM v_segments_d", "difficulty")
def _(t):
    return t.segments_d.select("seg_key", "difficulty")


@query("b19_segment_rule_inputs", """SELECT seg_key, motion_p90 / (motion_p90 + 0.145::DOUBLE) AS motion_level, coalesce(nullif(flatness, 0), 0) AS rule_flatness, coalesce(nullif(entropy, 0), 0.5::DOUBLE) AS rule_entropy,
coalesce(nullif(luma_mean, 0), 0.4::DOUBLE) * 255.0::DOUBLE AS rule_luma, CASE WHEN difficulty >= 0.45 THEN 1.0::DOUBLE ELSE 0.0 END AS hard_fraction, greatest(duration, 0.1::DOUBLE) AS rule_duration FROM v_segments_d""",
       "motion_level rule_luma rule_duration")
def _(t):
    df = t.segments_d.withColumn("clip_luma", F.lit(0.4))
    return FE.rule_inputs(df).select("seg_key", "motion_level", "rule_flatness", "rule_entropy", "rule_luma", "hard_fraction", "rule_duration")


@query("b22_result_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.x.y') AS missing FROM events")
def _(t):
    return with_json_fields(t.events, "props", {"k": ("$.k", "int"), "missing": ("$.x.y", "string")}).select("event_id", "k", "missing")


@query("b22_result_documents", """SELECT o_orderkey, CAST(CASE WHEN ok THEN 16 + o_orderkey % 25 END AS INT) AS crf, CASE WHEN ok THEN CASE o_orderkey % 2 WHEN 0 THEN 'CRF' ELSE 'VBR' END END AS mode,
CASE WHEN ok AND o_orderkey % 3 > 0 THEN 80 + o_orderkey % 64 / 4.0::DOUBLE END AS vmaf, CASE WHEN ok THEN o_custkey % 1000 / 8.0::DOUBLE END AS encode_sec, CAST(CASE WHEN ok THEN o_orderkey % 9 END AS INT) AS second_zone_crf,
CAST(NULL AS INT) AS mode_as_number FROM (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders) AS o""")
def _(t):
    k = F.col("o_orderkey")
    best = F.struct((16 + k % 25).alias("crf"), F.when(k % 2 == 0, "CRF").otherwise("VBR").alias("mode"), F.when(k % 3 > 0, 80 + k % 64 / 4.0).alias("vmaf"))
    zones = F.array(F.struct(F.lit(1).alias("crf")), F.struct((k % 9).alias("crf")))
    doc = F.to_json(F.struct(best.alias("best"), F.struct((F.col("o_custkey") % 1000 / 8.0).alias("encode")).alias("stage_timings"), zones.alias("zones")))
    # every seventh document is cut off
    docs = t.orders.select("o_orderkey", F.when(k % 7 == 0, doc.substr(F.lit(1), F.length(doc) - 1)).otherwise(doc).alias("doc"))
    return with_json_fields(docs, "doc", {
        "crf": ("$.best.crf", "int"), "mode": ("$.best.mode", "string"), "vmaf": ("$.best.vmaf", "double"), "encode_sec": ("$.stage_timings.encode", "double"),
        "second_zone_crf": ("$.zones[1].crf", "int"), "mode_as_number": ("$.best.mode", "int")}).drop("doc")


@query("b23_human_bytes", """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * pow(1024.0, o_orderkey % 5)) AS BIGINT) AS b FROM orders), v AS (SELECT *, b::DOUBLE AS x, b / 1024.0::DOUBLE AS k, b / 1048576.0::DOUBLE AS m, b / 1073741824.0::DOUBLE AS g, b / 1099511627776.0::DOUBLE AS t FROM n)
SELECT o_orderkey, CASE WHEN x < 1024 THEN b || ' B' WHEN k < 1024 THEN fixed_text(k, 1) || ' KB' WHEN m < 1024 THEN fixed_text(m, 1) || ' MB' WHEN g < 1024 THEN fixed_text(g, 1) || ' GB' ELSE fixed_text(t, 1) || ' TB' END AS size_human FROM v""")
def _(t):
    b = F.floor(F.col("o_totalprice") * F.pow(F.lit(1024.0), (F.col("o_orderkey") % 5).cast("double"))).cast("bigint")
    return t.orders.select("o_orderkey", X.human_bytes(b).alias("size_human"))
