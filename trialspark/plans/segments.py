"""Segment, frame, packet and zone queries."""

from pyspark.sql import functions as F

from trialspark.functions import features as FE
from trialspark.operators import segments as S, trials as T
from trialspark.plans.registry import query, view
from trialspark.session import materialize

view("v_timed", "SELECT *, start_frame / 30.0::DOUBLE AS start_sec, end_frame / 30.0::DOUBLE AS end_sec FROM v_segments_d")
view("v_counts", "SELECT video_id, count(*) AS n FROM v_segments GROUP BY 1")


def timed(t, table=None):
    return (t.segments_d if table is None else table.withColumn("difficulty", FE.segment_difficulty())).withColumns({"start_sec": F.col("start_frame") / 30.0, "end_sec": F.col("end_frame") / 30.0, "fps": F.lit(30.0)})


@query("b18_segment_frame_ranges", """
WITH s AS (SELECT video_id, seg_index, round_even((start_sec + (seg_key % 10) * 0.01::DOUBLE) * 30.0::DOUBLE, 0) AS a, round_even((end_sec + (seg_key % 7) * 0.02::DOUBLE) * 30.0::DOUBLE, 0) AS b FROM v_timed),
c AS (SELECT video_id, sum(frame_count) + video_id % 5 - 2 AS n, max(seg_index) AS li FROM v_segments GROUP BY 1),
j AS (SELECT s.*, n, li, greatest(0, least(a, n)) AS st FROM s JOIN c USING (video_id)),
k AS (SELECT *, greatest(st + 1, least(b, n)) AS en FROM j)
SELECT video_id, seg_index, CAST(st AS INT) AS start_frame, CAST(CASE WHEN seg_index = li THEN greatest(en, n) ELSE en END AS INT) AS end_frame FROM k""")
def _(t):
    n = t.segment_table.groupBy("video_id").agg((F.sum("frame_count") + F.first(F.col("video_id")) % 5 - 2).cast("int").alias("clip_frames"))
    s = timed(t, t.segment_table).withColumns({"start_sec": F.col("start_sec") + (F.col("seg_key") % 10) * F.lit(0.01), "end_sec": F.col("end_sec") + (F.col("seg_key") % 7) * F.lit(0.02)})
    s = s.drop("start_frame", "end_frame", "frame_count").join(n, "video_id")
    return S.segment_frames(s).select("video_id", "seg_index", "start_frame", "end_frame")


@query("d05_packet_range_sum", """SELECT s.video_id, s.seg_index, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS packet_bytes FROM v_frames s
LEFT JOIN v_packets p ON p.video_id = s.video_id AND p.frame >= s.start_frame AND p.frame < s.end_frame GROUP BY 1, 2""")
def _(t):
    return S.packet_bytes(t.segment_table, t.packet_table).select("video_id", "seg_index", "packet_bytes")


view("v_zones", """SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY seg_index) - 1 AS INT) AS zone_pos, start_frame + 2 AS zone_start, CASE WHEN seg_key % 3 = 0 THEN 20.5::DOUBLE + seg_key % 20 END AS crf,
CASE WHEN seg_key % 3 = 1 THEN (15 + seg_key % 20)::DOUBLE END AS qp, CASE WHEN seg_key % 3 = 2 AND seg_key % 2 = 0 THEN (500 + seg_key % 9)::DOUBLE END AS bitrate
FROM v_frames WHERE video_id % 2 = 0 OR frame_count >= 40""")


def zones(t):
    from trialspark.operators.scan import number_rows
    k = F.col("seg_key")
    z = t.segment_table.filter((F.col("video_id") % 2 == 0) | (F.col("frame_count") >= 40))
    z = number_rows(z, ["video_id"], ["seg_index"], F.floor(F.col("seg_index") / 4096).cast("bigint"), "_p")
    return z.select("video_id", "seg_key", (F.col("_p") - 1).cast("int").alias("zone_pos"), (F.col("start_frame") + 2).alias("zone_start"),
                    F.when(k % 3 == 0, F.lit(20.5) + k % 20).alias("crf"), F.when(k % 3 == 1, (F.lit(15) + k % 20).cast("double")).alias("qp"),
                    F.when((k % 3 == 2) & (k % 2 == 0), (F.lit(500) + k % 9).cast("double")).alias("bitrate"))


@query("d06_zone_asof_join", """
WITH c AS (SELECT video_id, n, nz, z0 FROM v_counts JOIN (SELECT video_id, count(*) AS nz, min(zone_start) AS z0 FROM v_zones GROUP BY 1) AS z USING (video_id)),
a AS (SELECT s.video_id, s.seg_index, s.start_frame AS zone_start_frame, z.crf, z.qp, z.bitrate, 'by_position' AS zone_match FROM v_frames s JOIN c USING (video_id) JOIN v_zones z ON z.video_id = s.video_id AND z.zone_pos = s.seg_index WHERE n = nz),
b AS (SELECT video_id, seg_index, zone_start AS zone_start_frame, crf, qp, bitrate, 'by_start' AS zone_match FROM (SELECT s.video_id, s.seg_index, z.zone_start, z.crf, z.qp, z.bitrate,
  row_number() OVER (PARTITION BY s.video_id, s.seg_index ORDER BY z.zone_start DESC, z.zone_pos DESC) AS rn FROM v_frames s JOIN c USING (video_id) JOIN v_zones z ON z.video_id = s.video_id AND z.zone_start <= greatest(s.start_frame, z0) WHERE n <> nz) AS x WHERE rn = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT video_id, seg_index, NULL, NULL, NULL, NULL, 'none' FROM v_frames WHERE video_id NOT IN (SELECT video_id FROM v_zones))
SELECT video_id, seg_index, CAST(zone_start_frame AS BIGINT) AS zone_start_frame, zone_match, CASE WHEN qp IS NOT NULL THEN 'qp' WHEN crf IS NOT NULL THEN 'crf' WHEN bitrate IS NOT NULL THEN 'bitrate' ELSE 'fallback' END AS rc_mode,
CAST(round_even(coalesce(qp, crf), 0) AS INT) AS applied_q, CASE WHEN qp IS NULL THEN crf END AS applied_crf FROM u""")
def _(t):
    return S.attach_zones(t.segment_table, zones(t)).select("video_id", "seg_index", "zone_start_frame", "zone_match", "rc_mode", "applied_q", "applied_crf")


view("v_inseg", """WITH hit AS (SELECT s.video_id, s.seg_index, p.frame, p.size FROM v_frames s JOIN v_packets p ON p.video_id = s.video_id AND p.frame >= s.start_frame AND p.frame < s.end_frame),
bare AS (SELECT video_id, seg_index, (start_frame + end_frame - 1) // 2 AS mid FROM v_frames s WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.video_id = s.video_id AND h.seg_index = s.seg_index)),
near AS (SELECT video_id, seg_index, frame, size FROM (SELECT b.*, p.frame, p.size, row_number() OVER (PARTITION BY b.video_id, b.seg_index ORDER BY abs(p.frame - b.mid), p.frame) AS rn FROM bare b LEFT JOIN v_packets p USING (video_id)) AS x WHERE rn = 1)
SELECT *, FALSE AS is_nearest FROM hit UNION ALL SELECT *, frame IS NOT NULL FROM near""")
view("v_sampled", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_index ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY video_id, seg_index) AS n FROM v_inseg)
SELECT video_id, seg_index, frame, size FROM r WHERE n <= 16 OR p = n - 1 OR list_contains(list_transform(range(0, 15), lambda i: CAST(floor(i * ((n - 1)::DOUBLE / 15.0::DOUBLE)) AS BIGINT)), p)""")


@query("d11_frames_in_segment", "SELECT video_id, seg_index, CAST(frame AS BIGINT) AS frame, size, is_nearest FROM v_inseg")
def _(t):
    return S.frames_in_segments(t.segment_table, t.packet_table, ["size"]).select("video_id", "seg_index", "frame", "size", "is_nearest")


@query("d12_zone_compression", """WITH b AS (SELECT s.video_id, s.seg_index, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS i, CAST(coalesce(sum(CASE WHEN p.size % 4 = 0 THEN 0 ELSE p.size // 3 END), 0) AS BIGINT) AS o
FROM v_frames s LEFT JOIN v_packets p ON p.video_id = s.video_id AND p.frame >= s.start_frame AND p.frame < s.end_frame GROUP BY 1, 2)
SELECT video_id, seg_index, i AS size_in_bytes, o AS size_out_bytes, CASE WHEN i > 0 THEN o / i ELSE 0.0::DOUBLE END AS compression_rate, CASE WHEN o > 0 THEN i / o ELSE 0.0::DOUBLE END AS compression_ratio FROM b""")
def _(t):
    out = t.packet_table.withColumn("size", F.when(F.col("size") % 4 == 0, 0).otherwise(F.floor(F.col("size") / 3)).cast("bigint"))
    return S.zone_compression(t.segment_table, t.packet_table, out).select("video_id", "seg_index", "size_in_bytes", "size_out_bytes", "compression_rate", "compression_ratio")


@query("d15_trials_with_segments", """SELECT t.k1, t.k2, t.k3, t.k4, t.crf, s.start_frame, s.end_frame, s.difficulty, s.edge, s.noise FROM v_trials t JOIN v_segments_d s ON s.video_id = t.video_id AND s.seg_index = t.segment_index""", "difficulty")
def _(t):
    cols = ["start_frame", "end_frame", "difficulty", "edge", "noise"]
    seg = t.segments_d.withColumnRenamed("seg_index", "segment_index")
    return T.attach_segment(t.trials, seg, cols).select("k1", "k2", "k3", "k4", "crf", *cols)


CLIP_SQL = """WITH a AS (SELECT video_id, count(*)::DOUBLE AS segment_count, sum(duration) AS duration, coalesce(sum(duration) FILTER (difficulty >= 0.45), 0) / sum(duration) AS hard_fraction, max(difficulty) AS worst_difficulty,
 avg(difficulty) AS difficulty_mean, sum(difficulty * duration) / sum(duration) AS duration_weighted_difficulty, quantile_cont(difficulty, 0.9) AS difficulty_p90, sum(motion_p90 * duration) / sum(duration) AS motion_mean,
 coalesce(stddev_pop(motion_p90), 0) AS motion_std, max(motion_p90) AS motion_p90, sum(texture * duration) / sum(duration) AS texture, coalesce(stddev_pop(texture), 0) AS texture_std, sum(entropy * duration) / sum(duration) AS entropy,
 sum(edge * duration) / sum(duration) AS edge_density, sum(noise * duration) / sum(duration) AS noise_level, sum(hf_energy * duration) / sum(duration) AS high_freq_energy, sum(flatness * duration) / sum(duration) AS flatness,
 sum(luma_mean * duration) / sum(duration) AS luma_mean FROM v_segments_d GROUP BY 1),
b AS (SELECT *, segment_count - 1 AS cut_count, (segment_count - 1) / greatest(duration, 1e-6) AS cut_rate, least((segment_count - 1) / greatest(duration, 1e-6) / 0.5, 1) AS cut_density FROM a)
SELECT *, texture AS texture_lbp, least(1, 0.35 * least(motion_std / 0.08, 1) + 0.25 * least(texture_std / 0.5, 1) + 0.25 * cut_density + 0.15 * worst_difficulty)::DOUBLE AS volatility, 30.0::DOUBLE AS fps, 3840.0::DOUBLE AS width, 2160.0::DOUBLE AS height,
 2160.0::DOUBLE AS short_side, 8294400.0::DOUBLE AS pixels, motion_p90 / (motion_p90 + 0.145) AS motion_level, texture / (texture + 4.22) AS texture_level, noise_level / (noise_level + 0.048) AS noise_level_norm, edge_density / (edge_density + 0.0475) AS edge_level, cut_density AS cut_level,
 CAST(NULL AS DOUBLE) AS luma_std, CAST(NULL AS DOUBLE) AS sat_mean, CAST(NULL AS DOUBLE) AS chroma_std FROM b"""
CLIP_COLS = [k for k in FE.FEATURE_KEYS if k not in ("luma_std", "sat_mean", "chroma_std")]
view("v_clips_raw", CLIP_SQL)
# setting rules compare against limits: both engines read the features at 6 places
view("v_clips", "SELECT video_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in CLIP_COLS) + " FROM v_clips_raw")


def clips_raw(t):
    return S.clip_summary(t.segments_d, names={"motion_mean": "motion_p90"})


def clips(t):
    return clips_raw(t).select("video_id", *[F.round(c, 6).alias(c) for c in CLIP_COLS])


@query("e03_clip_summary", f"SELECT video_id, {', '.join(FE.FEATURE_KEYS)} FROM v_clips_raw", CLIP_COLS)
def _(t):
    return clips_raw(t)


METRICS = ["motion_p90", "texture", "edge", "noise", "hf_energy", "flatness", "entropy", "difficulty"]
LONG = " UNION ALL ".join(f"SELECT video_id, '{m}' AS metric, {m} AS value FROM v_segments_d" for m in METRICS)


@query("e04_metric_distribution", f"""SELECT video_id, metric, avg(value) AS mean, max(value) AS max, min(value) AS min, quantile_cont(value, 0.95) AS p95, var_pop(value) AS variance, stddev_pop(value) AS std FROM ({LONG}) AS l GROUP BY 1, 2""",
       "mean max min p95 variance std")
def _(t):
    return S.metric_distribution(t.segments_d, METRICS)


@query("e05_difficulty_histogram", """WITH b AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([0.0::DOUBLE, 0.2, 0.4, 0.6, 0.8]) AS lo, unnest([0.2::DOUBLE, 0.4, 0.6, 0.8, 1.0]) AS hi),
c AS (SELECT video_id, bin, lo, hi, count(*) FILTER (difficulty >= lo AND (difficulty < hi OR (bin = 4 AND difficulty <= hi))) AS n FROM v_segments_d, b GROUP BY 1, 2, 3, 4)
SELECT *, n / greatest(sum(n) OVER (PARTITION BY video_id), 1) AS fraction FROM c""", "fraction")
def _(t):
    return S.difficulty_histogram(t.segments_d)


@query("e06_complexity_ratios", """SELECT video_id, coalesce(sum(duration) FILTER (difficulty >= 0.45), 0) / sum(duration) AS high_complexity_ratio, coalesce(sum(duration) FILTER (difficulty <= 0.2), 0) / sum(duration) AS low_complexity_ratio,
count(*) FILTER (difficulty >= 0.45) / count(*) AS high_complexity_segment_ratio, count(*) FILTER (difficulty <= 0.2) / count(*) AS low_complexity_segment_ratio,
first(seg_index ORDER BY difficulty DESC, seg_index) AS worst_segment_index FROM v_segments_d GROUP BY 1""", "high_complexity_ratio low_complexity_ratio high_complexity_segment_ratio low_complexity_segment_ratio")
def _(t):
    return S.complexity_ratios(t.segments_d)


@query("e07_calibration_percentiles", f"""SELECT metric, {', '.join(f'quantile_cont(value, {p / 100}) AS p{p}' for p in S.PERCENTS)}, quantile_cont(value, 0.5) AS suggested_mid, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM ({LONG}) AS l GROUP BY 1""",
       " ".join(f"p{p}" for p in S.PERCENTS) + " suggested_mid mean std")
def _(t):
    return S.calibration(t.segments_d, METRICS)


@query("e08_segment_sample_stats", """SELECT video_id, seg_index, count(frame) AS samples, avg(size / 51234.0::DOUBLE) AS motion_mean, stddev_pop(size / 51234.0::DOUBLE) AS motion_std, quantile_cont(size / 51234.0::DOUBLE, 0.9) AS motion_p90, max(size / 51234.0::DOUBLE) AS motion_max,
avg((size % 97)::DOUBLE) AS noise_mean FROM v_sampled GROUP BY 1, 2""", "motion_mean motion_std motion_p90 motion_max noise_mean")
def _(t):
    fr = t.packet_table.withColumns({"motion": F.col("size") / 51234.0, "noise": (F.col("size") % 97).cast("double")})
    s = S.even_samples(materialize(S.frames_in_segments(t.segment_table, fr, ["motion", "noise"]), "frames"), 16)
    return S.aggregate_samples(s, "motion", ["noise"])


@query("e12_whole_file_setting", """WITH g AS (
  SELECT video_id, sum((20 + seg_key % 20) * frame_count)::BIGINT AS a, sum(frame_count)::BIGINT AS b,
    arg_max('rd=' || (seg_key % 3 + 4), frame_count * 1000000::BIGINT + seg_index) AS params FROM v_segments GROUP BY 1)
SELECT video_id, CAST(a // b + CASE WHEN 2 * (a % b) > b THEN 1 WHEN 2 * (a % b) = b THEN (a // b) % 2 ELSE 0 END AS INT) AS crf, params FROM g""")
def _(t):
    k = F.col("seg_key")
    return S.whole_file_setting(t.segments.withColumns({"crf": F.lit(20) + k % 20, "params": F.concat(F.lit("rd="), (k % 3 + 4).cast("string"))}), "frame_count")


@query("e13_zone_means", """WITH r AS (SELECT *, CASE WHEN seg_key % 9 = 0 THEN NULL ELSE 80 + texture END AS v FROM v_frames)
SELECT video_id, min(v) AS vmaf_min, max(v) AS vmaf_max, avg(v) AS vmaf_mean, sum(v * frame_count) / sum(frame_count) FILTER (v IS NOT NULL) AS vmaf_wmean, min(noise) AS rate_min, max(noise) AS rate_max, sum(noise * frame_count) / sum(frame_count) AS rate_wmean FROM r GROUP BY 1""",
       "vmaf_min vmaf_max vmaf_mean vmaf_wmean rate_wmean")
def _(t):
    return S.zone_means(t.segments.withColumns({"vmaf_neg": F.when(F.col("seg_key") % 9 != 0, F.lit(80.0) + F.col("texture")), "compression_rate": F.col("noise")}))


@query("e17_harmonic_pooling", "SELECT video_id, count(*) / sum(1.0::DOUBLE / greatest((size % 101)::DOUBLE, 1e-6)) AS vmaf FROM v_packets GROUP BY 1", "vmaf")
def _(t):
    return S.harmonic_pool(t.packets.withColumn("s", F.col("size") % 101), "s", ["video_id"])


@query("e21_majority_options", """WITH o AS (SELECT video_id, zone_pos, 'mode' AS option, CASE WHEN qp IS NOT NULL THEN 'qp' WHEN crf IS NOT NULL THEN 'crf' ELSE 'other' END AS value FROM v_zones UNION ALL SELECT video_id, zone_pos, 'odd', CAST(zone_start % 2 AS VARCHAR) FROM v_zones),
c AS (SELECT video_id, option, value, count(*) AS n, min(zone_pos) AS p FROM o GROUP BY 1, 2, 3)
SELECT video_id, option, first(value ORDER BY n DESC, p) AS chosen, count(*) > 1 AS differs FROM c GROUP BY 1, 2""")
def _(t):
    z = zones(t)
    mode = F.when(F.col("qp").isNotNull(), "qp").when(F.col("crf").isNotNull(), "crf").otherwise("other")
    o = z.select("video_id", "zone_pos", F.explode(F.create_map(F.lit("mode"), mode, F.lit("odd"), (F.col("zone_start") % 2).cast("string"))).alias("option", "value"))
    return S.majority_options(o)


HIST = "[(size % 11) / 20.0::DOUBLE, ((size // 11) % 11) / 20.0::DOUBLE, ((size // 121) % 11) / 20.0::DOUBLE]"


@query("f17_cut_detection", f"""WITH f AS (SELECT video_id, frame, size, {HIST} AS h, lag({HIST}) OVER (PARTITION BY video_id ORDER BY frame) AS g FROM v_packets)
SELECT video_id, frame, coalesce((abs(h[1] - g[1]) + abs(h[2] - g[2]) + abs(h[3] - g[3])) / 2.0::DOUBLE >= 0.45 OR (size % 100) / 500.0::DOUBLE >= 0.18, FALSE) AND g IS NOT NULL AS is_cut FROM f""")
def _(t):
    z = F.col("size")
    h = [z % 11, F.floor(z / 11) % 11, F.floor(z / 121) % 11]
    fr = t.packet_table.select("video_id", "frame", F.array(*[x / 20.0 for x in h]).alias("hist"), ((z % 100) / 500.0).alias("diff"))
    return S.detect_cuts(fr).select("video_id", "frame", "is_cut")


@query("f18_motion_between_samples", """SELECT video_id, s * 7 AS frame, coalesce(m, 0) AS motion FROM (SELECT video_id, CAST(ceil(frame / 7.0) AS INT) AS s, max(CASE WHEN frame > 0 THEN size / 51234.0::DOUBLE END) AS m, max(frame) AS e FROM v_packets GROUP BY 1, 2) AS x WHERE e = s * 7""")
def _(t):
    return S.motion_between_samples(t.packet_table.select("video_id", "frame", F.when(F.col("frame") > 0, F.col("size") / 51234.0).alias("motion_inst")), 7)


@query("f19_cuts_to_segments", """
WITH RECURSIVE c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS i, start_frame AS s, end_frame AS e FROM v_frames),
m AS (SELECT video_id, i, 0::BIGINT AS seg, s, e FROM c WHERE i = 1
 UNION ALL SELECT c.video_id, c.i, CASE WHEN c.e - c.s < 45 OR m.e - m.s < 45 THEN m.seg ELSE m.seg + 1 END, CASE WHEN c.e - c.s < 45 OR m.e - m.s < 45 THEN m.s ELSE c.s END, c.e FROM m JOIN c ON c.video_id = m.video_id AND c.i = m.i + 1)
SELECT video_id, min(s) AS start_frame, max(e) AS end_frame FROM m GROUP BY video_id, seg""")
def _(t):
    clips_ = t.segment_table.groupBy("video_id").agg(F.max("end_frame").alias("clip_frames")).withColumn("fps", F.lit(30.0))
    return S.cuts_to_segments(t.segment_table.select("video_id", F.col("start_frame").alias("cut_frame")), clips_, 1.5)


@query("f20_segment_cap", """WITH g AS (SELECT f.*, CASE WHEN n <= 4 THEN seg_index ELSE seg_index // CAST(ceil(n / 4.0) AS INT) END AS gi FROM v_frames f JOIN v_counts USING (video_id))
SELECT video_id, CAST(gi AS INT) AS group_index, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM g GROUP BY 1, 2""")
def _(t):
    return S.limit_segments(t.segment_table, 4)


@query("f21_even_frame_sampling", "SELECT video_id, seg_index, CAST(frame AS BIGINT) AS frame FROM v_sampled")
def _(t):
    return S.even_samples(materialize(S.frames_in_segments(t.segment_table, t.packet_table, []), "frames"), 16).select("video_id", "seg_index", "frame")


@query("f22_even_scene_selection", """SELECT video_id, seg_index FROM v_segments JOIN v_counts USING (video_id) WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: CAST(round_even(i * ((n - 1)::DOUBLE / 4.0::DOUBLE), 0) AS INT)), seg_index)""")
def _(t):
    return S.spread_scenes(t.segment_table, 5).select("video_id", "seg_index")


@query("f23_midpoint_sample_window", """WITH w AS (SELECT *, least(2.5::DOUBLE, greatest(end_sec - start_sec, 1.0::DOUBLE / 30.0::DOUBLE)) AS take FROM v_timed)
SELECT video_id, seg_index, take AS take_sec, CAST(greatest(1, round_even(take * 30, 0)) AS INT) AS take_frames, floor(least(greatest(start_sec, start_sec + (end_sec - start_sec) / 2 - take / 2), greatest(start_sec, end_sec - take))) AS sample_start FROM w""", "take_sec")
def _(t):
    return S.sample_windows(timed(t), 2.5, floor_to_sec=True).select("video_id", "seg_index", "take_sec", "take_frames", "sample_start")


@query("f24_budgeted_windows", """
WITH w AS (SELECT *, CASE WHEN end_sec - start_sec < 0.5 THEN end_sec - start_sec ELSE least(2.5::DOUBLE, end_sec - start_sec) END AS wd FROM v_timed),
x AS (SELECT *, CASE WHEN end_sec - start_sec < 0.5 THEN start_sec ELSE start_sec + greatest(0, (end_sec - start_sec - wd) / 2) END AS ws, sum(wd) OVER (PARTITION BY video_id) AS total,
 6.0::DOUBLE - coalesce(sum(wd) OVER (PARTITION BY video_id ORDER BY difficulty DESC, seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM w WHERE wd > 1e-3),
y AS (SELECT *, CASE WHEN total <= 6 THEN wd ELSE least(wd, remaining) END AS take FROM x WHERE total <= 6 OR round(remaining, 9) >= 0.5)
SELECT video_id, seg_index, ws + (wd - take) / 2 AS window_start, take AS window_sec, difficulty FROM y""", "window_start window_sec difficulty")
def _(t):
    return S.budget_windows(timed(t, t.segment_table), max_seconds=6.0)


view("v_qp", """SELECT *, CAST(round_even(28 + 6.0::DOUBLE * (0.5 - coalesce(tt, 0.5)), 0) AS INT) AS qp, round_even(greatest(0.5, least(1.5, 1 + 0.6::DOUBLE * (coalesce(tt, 0.5) - 0.5))), 3) AS bitrate_factor FROM
(SELECT *, CASE WHEN max(difficulty) OVER w > min(difficulty) OVER w + 1e-9 THEN (difficulty - min(difficulty) OVER w) / (max(difficulty) OVER w - min(difficulty) OVER w) END AS tt FROM v_segments_d WINDOW w AS (PARTITION BY video_id)) AS x""")


@query("f25_difficulty_to_qp", "SELECT video_id, seg_index, qp, bitrate_factor FROM v_qp", "bitrate_factor")
def _(t):
    return S.difficulty_settings(t.segments_d).select("video_id", "seg_index", "qp", "bitrate_factor")


@query("f26_zones_text", "SELECT video_id, 'zones=' || string_agg(start_frame || ',' || end_frame || ',q=' || qp, '/' ORDER BY seg_index) AS zones FROM v_qp GROUP BY 1")
def _(t):
    return S.zones_text(S.difficulty_settings(t.segment_table.withColumn("difficulty", FE.segment_difficulty())))
