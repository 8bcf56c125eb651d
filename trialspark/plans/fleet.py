"""Fleet job, result and catalogue queries. Jobs and results are read from orders and lineitem."""

from pyspark.sql import functions as F

from trialspark.functions.features import segment_difficulty
from trialspark.operators import fleet as X
from trialspark.plans.registry import query

SEQ = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


def results_like(t):
    """Result payloads, one per order line."""
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").alias("job_id"), F.when(c("l_returnflag") == "R", "encode failed").alias("error"),
        F.when(c("l_linenumber") != 3, c("l_quantity")).alias("crf"), F.when(c("l_tax") > 0.04, "2M").alias("bitrate"),
        F.when(c("l_linenumber") == 5, "n/a").when(c("l_linenumber") != 6, (c("l_discount") * 10).cast("string")).alias("s_f"), *SEQ, "l_linestatus")


USABLE = """l_returnflag <> 'R' AND (l_linenumber <> 3 OR l_tax > 0.04) AND l_linenumber <> 5 AND (l_linenumber = 6 OR l_discount * 10 > 0)"""


@query("c05_usable_results", f"SELECT l_orderkey AS k1, l_linenumber AS k2, l_shipdate AS k3, l_extendedprice AS k4 FROM lineitem WHERE {USABLE}")
def _(t):
    from trialspark.operators.trials import usable_results
    return usable_results(results_like(t)).select(*[F.col(s).alias(f"k{i}") for i, s in enumerate(SEQ, 1)])


@query("d04_pending_jobs", f"""WITH w AS (SELECT DISTINCT l_orderkey AS j FROM lineitem WHERE {USABLE} AND l_linestatus = 'O'), p AS (SELECT DISTINCT l_orderkey AS j FROM lineitem WHERE {USABLE} AND l_linestatus = 'F')
SELECT o_orderkey AS job_id, CASE WHEN w.j IS NOT NULL OR p.j IS NOT NULL THEN 'skipped' ELSE 'pending' END AS state, CASE WHEN w.j IS NOT NULL THEN 'work' WHEN p.j IS NOT NULL THEN 'published' END AS source
FROM orders LEFT JOIN w ON w.j = o_orderkey LEFT JOIN p ON p.j = o_orderkey""")
def _(t):
    r = results_like(t)
    return X.split_jobs(t.orders.select(F.col("o_orderkey").alias("job_id")), r.filter("l_linestatus = 'O'"), r.filter("l_linestatus = 'F'"))


@query("d04_pending_jobs_anti", f"SELECT o_orderkey AS job_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {USABLE})")
def _(t):
    r = results_like(t)
    return X.pending_jobs(t.orders.select(F.col("o_orderkey").alias("job_id")), r.filter("l_linestatus = 'O'"), r.filter("l_linestatus = 'F'"))


CATALOGUE_SQL = """WITH j AS (SELECT s_suppkey AS pos, CASE WHEN s_nationkey % 2 = 0 THEN 'v' || s_suppkey ELSE 'job' || s_suppkey END AS job_id, s_name || '.mp4' AS file FROM supplier),
k AS (SELECT pos, 1 AS i, file AS name, job_id FROM j UNION ALL SELECT pos, 2, job_id, job_id FROM j UNION ALL SELECT pos, 3, substr(job_id, 2) || '.mp4', job_id FROM j WHERE job_id LIKE 'v%'),
n AS (SELECT name, arg_max(job_id, pos * 4 + i) AS job_id FROM k GROUP BY 1),
v AS (SELECT s_name || '.mp4' AS name FROM supplier UNION ALL SELECT c_custkey || '.mp4' FROM customer),
r AS (SELECT job_id, vmaf_threshold, s_f, mtime FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY vmaf_threshold = 89 DESC, CASE WHEN vmaf_threshold = 89 THEN l_orderkey END DESC NULLS LAST, CASE WHEN vmaf_threshold = 89 THEN l_linenumber END DESC NULLS LAST,
 CASE WHEN vmaf_threshold = 89 THEN l_shipdate END DESC NULLS LAST, CASE WHEN vmaf_threshold = 89 THEN l_extendedprice END DESC NULLS LAST, l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS rn
 FROM (SELECT *, 'v' || l_suppkey AS job_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE 85 + l_linenumber % 3 * 4 END AS vmaf_threshold, l_discount AS s_f, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS mtime FROM lineitem) AS a) AS b WHERE rn = 1)
SELECT v.name, n.job_id, r.vmaf_threshold, r.s_f, r.mtime AS result_mtime FROM v LEFT JOIN n USING (name) LEFT JOIN r USING (job_id)"""


def catalogue(t):
    c = F.col
    jobs = t.supplier.select(F.when(c("s_nationkey") % 2 == 0, F.concat(F.lit("v"), c("s_suppkey"))).otherwise(F.concat(F.lit("job"), c("s_suppkey"))).alias("job_id"),
                             F.concat(F.lit("/data/in/"), c("s_name"), F.lit(".mp4")).alias("input_path"), c("s_suppkey").alias("job_pos"))
    videos = t.supplier.select(F.concat("s_name", F.lit(".mp4")).alias("name")).unionByName(t.customer.select(F.concat(c("c_custkey").cast("string"), F.lit(".mp4")).alias("name")))
    res = t.lineitem.select(F.concat(F.lit("v"), c("l_suppkey")).alias("job_id"), F.when(c("l_linenumber") != 1, F.lit(85) + c("l_linenumber") % 3 * 4).alias("vmaf_threshold"),
                            c("l_discount").alias("s_f"), F.when(c("l_tax") > 0.02, c("l_extendedprice")).alias("result_mtime"), F.struct(*SEQ).alias("pos"))
    return X.catalogue(videos, jobs, res, 89)


@query("d09_job_result_catalogue", CATALOGUE_SQL)
def _(t):
    return catalogue(t).select("name", "job_id", "vmaf_threshold", "s_f", "result_mtime")


@query("g05_catalogue_order", f"SELECT name, result_mtime FROM ({CATALOGUE_SQL}) AS c ORDER BY result_mtime DESC NULLS LAST, lower(name)")
def _(t):
    return X.order_catalogue(catalogue(t).select("name", "result_mtime"))


BEST_SQL = """b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_index ORDER BY gates_ok DESC, s_f DESC, k1, k2, k3, k4) AS rn FROM v_merged WHERE encode_ok) AS x WHERE rn = 1),
r AS (SELECT video_id, segment_index, CASE WHEN min(root_rank) = 1 THEN 'adaptive' WHEN max(root_rank) = 0 THEN 'grid' ELSE 'adaptive+grid' END AS encode_source FROM v_trials GROUP BY 1, 2)"""


def seg_catalogue(t):
    s = t.segment_table.withColumn("difficulty", segment_difficulty()).withColumnRenamed("seg_index", "segment_index")
    own = s.select("video_id", "segment_index", "start_frame", "end_frame", "duration", F.when(F.col("seg_key") % 2 == 0, F.col("texture")).alias("texture"))
    return X.segments_with_best(own, s, t.scored, ["texture", "difficulty"], ["grid", "adaptive"])


@query("d10_segments_features_best", f"""WITH {BEST_SQL}
SELECT s.video_id, s.seg_index AS segment_index, s.texture, s.difficulty, b.crf, b.aq_strength, b.s_f AS final_score, r.encode_source FROM v_segments_d s LEFT JOIN b ON b.video_id = s.video_id AND b.segment_index = s.seg_index LEFT JOIN r ON r.video_id = s.video_id AND r.segment_index = s.seg_index""",
       "difficulty final_score")
def _(t):
    return seg_catalogue(t).select("video_id", "segment_index", "texture", "difficulty", "crf", "aq_strength", "final_score", "encode_source")


@query("b21_video_segment_catalogue", f"""WITH {BEST_SQL},
d AS (SELECT video_id, sum(duration) AS dur FROM v_segments GROUP BY 1)
SELECT s.video_id, s.seg_index AS segment_index, s.start_frame, s.end_frame, CASE WHEN c_acctbal * 1000 > 0 THEN c_acctbal * 1000 * 8.0 / dur END AS bitrate_bps, b.crf, coalesce(b.vmaf_neg, CAST(NULL AS DOUBLE)) AS vmaf, b.compression_ratio
FROM v_frames s JOIN d USING (video_id) LEFT JOIN customer ON c_custkey = s.video_id LEFT JOIN b ON b.video_id = s.video_id AND b.segment_index = s.seg_index""", "bitrate_bps vmaf compression_ratio")
def _(t):
    size = t.customer.select(F.col("c_custkey").alias("video_id"), (F.col("c_acctbal") * 1000).alias("size_bytes"))
    # whole frames are summed, so the order of rows never shows
    dur = t.segment_table.groupBy("video_id").agg((F.sum("frame_count") / 30.0).alias("clip_sec"))
    x = seg_catalogue(t).join(dur, "video_id").join(size, "video_id", "left")
    return x.select("video_id", "segment_index", "start_frame", "end_frame", X.source_bitrate(F.col("size_bytes"), F.col("clip_sec")).alias("bitrate_bps"), "crf", "vmaf", "compression_ratio")


@query("b20_pair_validation", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS a, o_orderkey % 11 = 0 AS b, (o_orderkey % 5) * 0.1::DOUBLE > 0.3 AS c, o_orderkey % 9 > 5 AS d, o_orderkey % 13 = 0 AS e, o_orderkey % 17 = 0 AS f, o_orderkey % 19 = 0 AS g, o_orderkey % 23 = 0 AS h,
 o_orderstatus = 'F' AS i, o_totalprice IS NULL OR o_totalprice / 100000 > 3.3 AS l FROM orders)
SELECT k AS clip_id, concat_ws(',', CASE WHEN a THEN 'codec' END, CASE WHEN b THEN 'resolution' END, CASE WHEN c THEN 'fps' END, CASE WHEN d THEN 'frames' END, CASE WHEN e THEN 'container' END, CASE WHEN f THEN 'profile' END, CASE WHEN g THEN 'sar' END, CASE WHEN h THEN 'pix_fmt' END,
 CASE WHEN i THEN 'color_space' END, CASE WHEN l THEN 'bitrate' END) AS violations, NOT (a OR b OR c OR d OR e OR f OR g OR h OR i OR l) AS ok FROM p""")
def _(t):
    k = F.col("o_orderkey")
    ref = t.orders.select(k.alias("clip_id"), F.lit("h264").alias("codec"), F.lit(3840).alias("width"), F.lit(2160).alias("height"), F.lit(30.0).alias("fps"), F.lit(900).alias("frames"),
                          F.lit("bt709").alias("color_space"), F.lit("").alias("color_primaries"), F.lit("bt709").alias("color_transfer"), F.lit(3.0).alias("target_bitrate_mbps"))
    out = t.orders.select(k.alias("clip_id"), F.when(k % 7 == 0, "av1").otherwise("hevc").alias("codec"), F.when(k % 11 == 0, 1920).otherwise(3840).alias("width"), F.lit(2160).alias("height"),
                          (F.lit(30.0) + (k % 5) * F.lit(0.1)).alias("fps"), (F.lit(900) + k % 9).alias("frames"), F.when(k % 13 == 0, "ivf").otherwise("MOV,mp4").alias("container"),
                          F.when(k % 17 == 0, "Rext").otherwise("Main 10").alias("profile"), F.when(k % 19 == 0, "4:3").otherwise("1:1").alias("sar"), F.when(k % 23 == 0, "yuv444p").otherwise("yuv420p").alias("pix_fmt"),
                          F.when(F.col("o_orderstatus") == "F", "bt2020").otherwise("bt709").alias("color_space"), F.lit("bt709").alias("color_primaries"), F.lit("").alias("color_transfer"),
                          (F.col("o_totalprice") / 100000).alias("bit_rate_mbps"))
    return X.validate_pairs(ref, out, abr=True).select("clip_id", F.array_join("violations", ",").alias("violations"), "ok")


@query("b24_job_target_bitrate", """WITH j AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '5M' WHEN o_orderpriority = '2-HIGH' THEN ' ' END AS ex, CASE WHEN o_orderstatus <> 'P' THEN 0.25::DOUBLE END AS rate, floor(o_totalprice * 1000) AS b, (o_custkey % 40)::DOUBLE AS d FROM orders),
m AS (SELECT *, nullif(trim(coalesce(ex, '')), '') AS x, rate * b * 8.0 / CASE WHEN d > 0 THEN d END / 1000000.0 AS mbps FROM j), k AS (SELECT *, greatest(1.0, mbps * 1000.0) AS kb FROM m)
SELECT o_orderkey AS job_id, CASE WHEN x IS NOT NULL THEN x WHEN rate IS NULL OR d <= 0 THEN NULL WHEN mbps >= 1 THEN fixed_text(mbps, 3) || 'M' ELSE fixed_text(kb, 0) || 'k' END AS bitrate,
CASE WHEN x IS NOT NULL THEN NULL WHEN rate IS NULL THEN 'no target' WHEN d <= 0 THEN 'bad duration' END AS error FROM k""")
def _(t):
    p = F.col("o_orderpriority")
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), F.when(p == "1-URGENT", "5M").when(p == "2-HIGH", " ").alias("target_bitrate"), F.when(F.col("o_orderstatus") != "P", 0.25).alias("target_compression_rate"))
    feats = t.orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 40).cast("double").alias("duration"), F.floor(F.col("o_totalprice") * 1000).alias("source_bytes"))
    return X.job_bitrates(jobs, feats).select("job_id", "bitrate", "error")


@query("e15_fleet_status", """WITH r AS (SELECT 85 + l_linenumber % 3 * 4 AS t, l_returnflag <> 'N' AS hb, l_linestatus = 'O' AS hr, l_returnflag = 'A' AND l_linenumber <> 6 AS okc, l_extendedprice AS m FROM lineitem),
g AS (SELECT t, count(*) FILTER (hb) AS best_json, count(*) FILTER (hr) AS result_json, count(*) FILTER (okc AND hb) AS ok_best, max(m) FILTER (hb) AS newest FROM r GROUP BY 1),
e AS (SELECT 85 + n_nationkey % 4 * 4 AS t, sum(n_nationkey * 20) AS x FROM nation GROUP BY 1)
SELECT e.t AS vmaf_threshold, CAST(x AS BIGINT) AS expected_jobs, coalesce(best_json, 0) AS best_json, coalesce(result_json, 0) AS result_json, coalesce(ok_best, 0) AS ok_best, newest, coalesce(ok_best, 0) >= x AND x > 0 AS done FROM e LEFT JOIN g USING (t)""")
def _(t):
    r = t.lineitem.select((F.lit(85) + F.col("l_linenumber") % 3 * 4).alias("vmaf_threshold"), (F.col("l_returnflag") != "N").alias("has_best"), (F.col("l_linestatus") == "O").alias("has_result"),
                          F.when(F.col("l_returnflag") == "R", "x").alias("error"), F.when(F.col("l_linenumber") != 6, F.col("l_quantity")).alias("crf"), F.col("l_extendedprice").alias("mtime"))
    e = t.nation.groupBy((F.lit(85) + F.col("n_nationkey") % 4 * 4).alias("vmaf_threshold")).agg(F.sum(F.col("n_nationkey") * 20).alias("expected_jobs"))
    return X.fleet_status(r, e)


@query("g02_latest_results", "SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_totalprice AS crf FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(t):
    return X.latest_results(t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("crf")))


@query("g06_numeric_name_order", "SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS name FROM customer")
def _(t):
    return X.order_names(t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name")).alias("name")), "name")


@query("g06_natural_key_order", "SELECT c_name AS name FROM customer ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT)")
def _(t):
    return t.customer.select(F.col("c_name").alias("name")).orderBy(X.natural_key(F.col("name")))
