"""Score log queries."""

from pyspark.sql import functions as F

from trialspark.functions import text as X
from trialspark.operators import logs as L
from trialspark.plans.registry import query, view

CH = r"Built compression challenge protocol for (\d+) miners, (\d+) queries, VMAF threshold (\d+), codec (\w+), mode (\w+)"

view("v_lp", rf"""SELECT line, value, regexp_matches(value, '{CH}') AS is_ch, contains(value, 'payload:') AS is_pl, contains(value, 'score_compressions:') AS is_sc,
 regexp_extract(value, ', codec (\w+), mode', 1) AS ch_codec, regexp_extract(value, ', mode (\w+)', 1) AS ch_mode,
 CASE WHEN contains(value, 'payload:') THEN regexp_extract_all(value, 'https?://[^\s''"\]]+') END AS urls,
 TRY_CAST(regexp_extract(value, 'score_compressions:\d+ - (\d+)', 1) AS INT) AS uid,
 trim(regexp_extract(value, ' \|\| (.*)$', 1)) AS det
FROM v_log_lines""")
view("v_ctx", """SELECT *, sum(st) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN is_sc AND (lag(is_sc) OVER (ORDER BY line) IS DISTINCT FROM TRUE OR lag(uid) OVER (ORDER BY line) <> uid) THEN 1 ELSE 0 END AS st,
 last_value(CASE WHEN is_ch THEN lower(ch_codec) END IGNORE NULLS) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS cc,
 last_value(CASE WHEN is_ch THEN upper(ch_mode) END IGNORE NULLS) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS cm,
 last_value(CASE WHEN is_ch THEN CAST([] AS VARCHAR[]) WHEN is_pl THEN urls END IGNORE NULLS) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS pend
 FROM v_lp) AS x""")
view("v_rows", r"""SELECT line, '2024-01-01 00:00:00.0' AS ts, uid, CAST(regexp_extract(value, 'VMAF NEG: ([\d.]+)', 1) AS DOUBLE) AS vmaf_neg, TRY_CAST(regexp_extract(value, ' VMAF: (\S+)', 1) AS DOUBLE) AS vmaf,
 CAST(regexp_extract(value, 'VMAF Threshold: ([\d.]+)', 1) AS DOUBLE) AS vmaf_threshold, CAST(regexp_extract(value, 'Compression Rate: ([\d.]+)', 1) AS DOUBLE) AS compression_rate,
 CASE WHEN CAST(regexp_extract(value, 'Compression Rate: ([\d.]+)', 1) AS DOUBLE) > 0 THEN 1.0::DOUBLE / CAST(regexp_extract(value, 'Compression Rate: ([\d.]+)', 1) AS DOUBLE) END AS compression_ratio,
 CAST(regexp_extract(value, 'Final: ([\d.]+)', 1) AS DOUBLE) AS final,
 CASE WHEN starts_with(det, 'success') THEN 'success' WHEN contains(det, 'soft zone') THEN 'vmaf_soft' WHEN contains(det, 'MINER FAILURE') THEN 'miner_failure' ELSE 'other' END AS status,
 cc AS codec, coalesce(nullif(upper(regexp_extract(det, 'mode=(\w+)', 1)), ''), cm) AS mode, TRY_CAST(nullif(regexp_extract(det, 'ref_bpp=([\d.]+)', 1), '') AS DOUBLE) AS ref_bpp,
 CAST(row_number() OVER (PARTITION BY island ORDER BY line) AS INT) AS video_idx, pend, det
FROM v_ctx WHERE is_sc""")
view("v_first_bpp", """SELECT codec, mode, vmaf_threshold, ref_bpp, row_number() OVER (PARTITION BY codec, mode, vmaf_threshold ORDER BY min(line)) AS idx
FROM (SELECT line, coalesce(codec, '?') AS codec, coalesce(mode, '?') AS mode, vmaf_threshold, ref_bpp FROM v_rows WHERE ref_bpp IS NOT NULL) AS x GROUP BY 1, 2, 3, 4""")
view("v_scores", """SELECT r.* EXCLUDE (pend), pend[video_idx] AS video_url, coalesce(replace(split_part(split_part(pend[video_idx], '?', 1), '/', 5), '.mp4', ''),
  CASE WHEN r.ref_bpp IS NULL THEN 'video' || r.video_idx ELSE 'video' || f.idx || '_bpp' || fixed_text(r.ref_bpp, 4) END) AS video_id
FROM v_rows r LEFT JOIN v_first_bpp f ON coalesce(r.codec, '?') = f.codec AND coalesce(r.mode, '?') = f.mode AND r.vmaf_threshold = f.vmaf_threshold AND r.ref_bpp = f.ref_bpp""")
view("v_kept", "SELECT * FROM v_scores WHERE NOT (status = 'miner_failure' AND vmaf IS NULL)")
view("v_summary", """SELECT coalesce(codec, '?') AS codec, coalesce(mode, '?') AS mode, vmaf_threshold, uid, count(*) AS n, avg(final) AS mean_final, max(final) AS max_final,
 avg(vmaf_neg) AS mean_neg, min(vmaf_neg) AS min_neg, avg(compression_rate) AS mean_rate, avg(compression_ratio) AS mean_ratio, count(*) FILTER (status = 'success') AS ok,
 count(*) FILTER (status = 'vmaf_soft') AS soft, count(*) FILTER (status = 'vmaf_hard_fail') AS hard FROM v_scores GROUP BY 1, 2, 3, 4""")
MEANS = "mean_final mean_neg mean_rate mean_ratio"


@query("b01_score_log_extraction", """SELECT line, ts, uid, vmaf_neg, vmaf, vmaf_threshold, compression_rate, compression_ratio, final, status, status = 'success' AS success,
codec, mode, ref_bpp, video_idx, det AS details FROM v_rows""", "compression_ratio")
def _(t):
    return L.score_rows(t.log_table).select("line", "ts", "uid", "vmaf_neg", "vmaf", "vmaf_threshold", "compression_rate", "compression_ratio",
                                            "final", "status", "success", "codec", "mode", "ref_bpp", "video_idx", "details")


@query("b02_challenge_extraction", rf"""SELECT line, CAST(regexp_extract(value, '{CH}', 1) AS INT) AS n_miners, CAST(regexp_extract(value, '{CH}', 2) AS INT) AS n_queries,
CAST(regexp_extract(value, '{CH}', 3) AS DOUBLE) AS vmaf_threshold, regexp_extract(value, '{CH}', 4) AS codec, regexp_extract(value, '{CH}', 5) AS mode, CAST(NULL AS DOUBLE) AS target_bitrate
FROM v_log_lines WHERE regexp_matches(value, '{CH}')""")
def _(t):
    return L.challenges(t.log_table).drop("file")


DET = """CASE event_id % 7 WHEN 0 THEN 'success; a=1' WHEN 1 THEN 'VMAF 70 below hard cutoff' WHEN 2 THEN 'VMAF in soft zone' WHEN 3 THEN 'Invalid or missing video'
 WHEN 4 THEN 'MINER FAILURE' WHEN 5 THEN 'VMAF is below x' ELSE event_type END"""


@query("b03_status_classification", f"""SELECT event_id, status, status = 'success' AS success FROM (SELECT event_id, CASE WHEN d LIKE 'success%' THEN 'success' WHEN d LIKE '%below hard cutoff%' THEN 'vmaf_hard_fail' WHEN d LIKE '%soft zone%' THEN 'vmaf_soft'
WHEN d LIKE '%Invalid or missing%' THEN 'missing_video' WHEN d LIKE '%MINER FAILURE%' THEN 'miner_failure' WHEN d LIKE '%VMAF%' AND d LIKE '%below%' THEN 'vmaf_fail' ELSE 'other' END AS status
FROM (SELECT event_id, {DET} AS d FROM events) AS x) AS y""")
def _(t):
    st = L.classify_status(F.expr(DET))
    return t.events.select("event_id", st.alias("status"), (st == "success").alias("success"))


TAIL = "concat('ok; mode=', event_type, ' ; x = ', CAST(user_id AS STRING), '; bare; mode=', CASE WHEN event_id % 2 = 0 THEN 'crf' ELSE 'v=b' END)"


@query("b04_kv_tail_to_map", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'crf' ELSE 'v=b' END AS mode, CAST(user_id AS VARCHAR) AS x, 2 AS n_keys FROM events""")
def _(t):
    m = t.events.select("event_id", L.kv_tail(F.expr(TAIL)).alias("m"))
    return m.select("event_id", F.col("m")["mode"].alias("mode"), F.col("m")["x"].alias("x"), F.size("m").alias("n_keys"))


@query("b05_payload_url_explode", """SELECT line, CAST(generate_subscripts(urls, 1) AS INT) AS position, unnest(urls) AS url,
replace(split_part(split_part(unnest(urls), '?', 1), '/', 5), '.mp4', '') AS video_id FROM v_lp WHERE is_pl""")
def _(t):
    return L.payload_urls(t.log_table).drop("file")


@query("b05_url_video_id", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT *, list_extract(string_split(url_decode(path), '/'), -1) AS name FROM p)
SELECT page_id, CASE WHEN name = '' THEN url ELSE regexp_replace(name, '\.mp4$', '') END AS video_id FROM n""")
def _(t):
    return t.pages.select("page_id", X.url_video_id(F.col("url")).alias("video_id"))


@query("c01_score_filter", "SELECT line, uid, final, status FROM v_scores WHERE codec = 'hevc' AND CASE mode WHEN 'ABR' THEN 'VBR' ELSE mode END = 'CRF' AND vmaf_threshold = 85 AND uid IN (0, 2) AND NOT (status = 'miner_failure' AND vmaf IS NULL)")
def _(t):
    return L.filter_scores(L.score_rows(t.log_table), codec="HEVC", mode="rc", vmaf_threshold=85, uids=[0, 2]).select("line", "uid", "final", "status")


@query("c02_video_matcher", """SELECT line, (video_idx = 2 AND starts_with(video_id, 'video2')) OR contains(video_id, 'video2') AS by_name, video_id = '2' OR video_idx = 2 AS by_index,
contains(video_id, 'bpp0') OR contains(coalesce(video_url, ''), 'bpp0') AS by_part FROM v_scores""")
def _(t):
    return L.analyse(t.log_table).select("line", L.matches_video("#Video2").alias("by_name"), L.matches_video("2").alias("by_index"), L.matches_video("bpp0").alias("by_part"))


@query("d07_challenge_carry_forward", "SELECT line, cc AS challenge_codec, cm AS challenge_mode FROM v_ctx WHERE is_sc")
def _(t):
    return L.score_rows(t.log_table).select("line", "challenge_codec", "challenge_mode")


@query("d08_payload_position_join", "SELECT line, video_idx, pend[video_idx] AS video_url FROM v_rows")
def _(t):
    return L.score_rows(t.log_table).select("line", "video_idx", "video_url")


@query("f01_streak_index", "SELECT line, uid, video_idx FROM v_rows")
def _(t):
    # a small chunk, so that streaks cross chunk borders here as well
    return L.carry_context(L.mark_events(t.log_table), lines_per_chunk=512).select("line", "uid", "video_idx")


@query("f02_fallback_labels", "SELECT line, video_idx, video_id FROM v_scores")
def _(t):
    return L.analyse(t.log_table).select("line", "video_idx", "video_id")


@query("e01_uid_summary", "SELECT * FROM v_summary", MEANS)
def _(t):
    return L.summarize(L.score_rows(t.log_table))


@query("e02_challenge_rollup", """SELECT *, CAST(row_number() OVER (PARTITION BY codec, mode, vmaf_threshold ORDER BY mean_final DESC, uid) AS INT) AS uid_rank,
max(mean_final) OVER (PARTITION BY codec, mode, vmaf_threshold) AS top_mean_final FROM v_summary""", MEANS + " top_mean_final")
def _(t):
    return L.challenge_rollup(L.score_rows(t.log_table))


@query("e02_challenge_details", """SELECT coalesce(codec, '?') AS codec, coalesce(mode, '?') AS mode, vmaf_threshold, uid, line, final, video_idx,
CAST(row_number() OVER (PARTITION BY coalesce(codec, '?'), coalesce(mode, '?'), vmaf_threshold, uid ORDER BY final DESC, video_idx, line) AS INT) AS detail_rank FROM v_rows""")
def _(t):
    return L.challenge_details(L.score_rows(t.log_table)).select("codec", "mode", "vmaf_threshold", "uid", "line", "final", "video_idx", "detail_rank")


@query("e19_codecs_seen", "SELECT DISTINCT codec FROM v_rows WHERE codec IS NOT NULL")
def _(t):
    return L.codecs_seen(t.log_table)


@query("g01_entry_sort", "SELECT line, uid, ts, final FROM v_kept ORDER BY final DESC, ts, uid, line")
def _(t):
    return L.sort_entries(L.filter_scores(L.score_rows(t.log_table))).select("line", "uid", "ts", "final")


@query("g01_entry_sort_time", "SELECT line, uid, ts, final FROM v_kept ORDER BY ts DESC, final ASC, line ASC")
def _(t):
    return L.sort_entries(L.filter_scores(L.score_rows(t.log_table)), "time").select("line", "uid", "ts", "final")


@query("g03_ranked_uids", "SELECT codec, mode, vmaf_threshold, uid, mean_final, CAST(row_number() OVER (PARTITION BY codec, mode, vmaf_threshold ORDER BY mean_final DESC, uid) AS INT) AS uid_rank FROM v_summary", "mean_final")
def _(t):
    return L.ranked_uids(L.summarize(L.score_rows(t.log_table))).select("codec", "mode", "vmaf_threshold", "uid", "mean_final", "uid_rank")


@query("g04_challenge_order", """SELECT codec, mode, vmaf_threshold, max(mean_final) AS top_mean_final, count(*) AS uids, CAST(sum(n) AS BIGINT) AS videos FROM v_summary GROUP BY 1, 2, 3
ORDER BY 4 DESC, 3 DESC, 1, 2""", "top_mean_final")
def _(t):
    return L.order_challenges(L.summarize(L.score_rows(t.log_table)))


@query("h03_latest_url_per_path", """WITH u AS (SELECT line, generate_subscripts(urls, 1) AS pos, unnest(urls) AS url FROM v_lp WHERE is_pl),
p AS (SELECT *, regexp_extract(url, '^https://h([^?]*)', 1) AS path FROM u)
SELECT path, arg_max(url, line * 10 + pos) AS url, min(line) AS first_line FROM p GROUP BY 1""")
def _(t):
    return L.latest_urls(t.log_table, "payload", L.URL, "/b/")
