"""Ties, nulls, empty groups and duplicates of the ranked and grouped operators."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import fleet as X, logs as L, segments as S, trials as T, ml as M

TRIAL = ("video_id int, segment_index int, crf int, aq_strength double, s_f double, vmaf_neg double, compression_ratio double, encode_ok boolean, gates_ok boolean, "
         "root_rank int, k1 int, k2 int, k3 int, k4 int")


def trials(spark, *rows):
    """rows: (crf, aq, s_f, vmaf, ok, gate) in order"""
    return spark.createDataFrame([(1, 0, c, float(a), s, float(v), 4.0, ok, g, 0, i, 0, 0, 0) for i, (c, a, s, v, ok, g) in enumerate(rows)], TRIAL)


def test_first_of_equal_scores_wins(spark):
    df = trials(spark, (30, 1, .5, 90, True, False), (31, 1, .5, 91, True, True), (32, 1, .9, 91, False, True), (33, 1, None, 91, True, True))
    assert T.best_trial(df).first().crf == 30 and T.best_trial(df, gated="only").first().crf == 31 and T.best_trial(df, gated="prefer").first().crf == 31
    r = T.sweep_summary(df).first()
    assert (r.n_trials, r.n_ok, r.best_crf, r.gated_crf) == (4, 3, 30, 31)
    assert T.best_trial(df.filter("crf = 32")).count() == 0 and T.sweep_summary(df.filter("crf = 32")).first().best_crf is None


def test_last_duplicate_wins(spark):
    df = trials(spark, (30, 1.00004, .5, 90, True, True), (30, 1.00001, .4, 90, True, True)).unionByName(
        trials(spark, (30, 1.0, .1, 90, True, True)).withColumn("root_rank", F.lit(1)))
    assert [r.s_f for r in T.dedupe_last_wins(df).collect()] == [.1]


def test_threshold_label_takes_the_lowest_crf(spark):
    df = trials(spark, (32, 1, .9, 95, True, True), (28, 1, .2, 85, True, True), (28, 2, .3, 86, True, True), (20, 1, .9, 84.9, True, True), (21, 1, .9, 99, True, False))
    r = T.crf_at_threshold(df, ["video_id"], 85.0).first()
    assert (r.crf, r.aq_strength) == (28, 2.0)


def test_search_best_ties(spark):
    df = trials(spark, (30, 1, .5, 90, True, True), (None, 1, .5, 91, True, True), (29, 1, .5, 91, True, True))
    assert T.search_best(df, ["video_id"]).first().crf == 29


def test_incumbents(spark):
    df = trials(spark, (1, 1, .9, 80, False, True), (2, 1, .3, 80, True, True), (3, 1, .3, 82, True, True), (4, 1, .2, 90, True, True), (5, 1, .9, 84, True, True), (6, 1, .2, 99, True, True), (7, 1, .4, 86, True, True))
    for chunk in (None, F.floor(F.col("k1") / 2).cast("bigint")):
        out = T.incumbent_trace(df, ["video_id"], 85.0, chunk).orderBy("k1").collect()
        assert [r.crf for r in out if r.accepted] == [2, 3, 4, 7]
        assert [r.best_s_f for r in out] == [None, .3, .3, .2, .2, .2, .4]


def test_preprocess_winner(spark):
    df = trials(spark, (1, 1, .40, 86, True, True), (2, 1, .45, 85.5, True, True), (3, 1, .60, 90, True, False)).withColumn(
        "preprocess", F.element_at(F.array(F.lit("none"), F.lit("hqdn3d_light"), F.lit("unsharp_mild")), F.col("crf")))
    assert T.preprocess_winner(df, ["video_id"]).first().winner == "hqdn3d_light"
    r = T.preprocess_winner(df.filter("crf = 3"), ["video_id"]).first()
    assert r.winner is None and r.any_passed is False


def test_best_attempt(spark):
    df = trials(spark, (30, 1, .5, 95, True, True), (34, 1, .5, 93, True, True), (36, 1, .5, 80, True, True)).withColumn("encode_percent", F.lit(40.0))
    assert T.best_attempt(df, ["video_id"], 90, 80).first().crf == 34
    assert T.best_attempt(df, ["video_id"], 99, 80).first().crf == 30
    assert [r[0] for r in spark.createDataFrame([(1000, 400), (0, 5)], "a int, b int").select(T.encoded_percent(F.col("a"), F.col("b"))).collect()] == [40.0, 100.0]


def test_flags_by_number_or_text(spark):
    df = trials(spark, (30, 1.0, .5, 90, True, True), (31, 1.0, .5, 90, True, True)).withColumn("params", F.lit("rd=5"))
    lab = spark.createDataFrame([(1, 30, 1.0, None, None, None, "rd=5")], "video_id int, oracle_crf int, oracle_aq_strength double, oracle_params string, crf_at_threshold int, aq_at_threshold double, params_at_threshold string")
    got = [(r.is_oracle_best_sf, r.is_oracle_crf_at_threshold) for r in T.flag_trials(df, lab).orderBy("crf").collect()]
    assert got == [(True, True), (False, True)]
    other = T.flag_trials(df.withColumn("video_id", F.lit(9)), lab).first()
    assert (other.is_oracle_best_sf, other.is_oracle_crf_at_threshold) == (False, False)


def test_rescore(spark):
    base = trials(spark, (30, 1, .5, 90, True, True), (31, 1, .5, 90, False, True), (32, 1, .5, 90, True, True)).withColumns(
        {"compression_rate": F.lit(0.25), "reason": F.lit("success"), "size_out_bytes": F.when(F.col("crf") == 32, 0).otherwise(100)})
    seg = spark.createDataFrame([(1, 0, 1000)], "video_id int, segment_index int, source_bytes bigint")
    r = T.rescore(base, seg, 85.0).orderBy("crf").collect()
    assert [(x.changed, x.compression_rate) for x in r] == [(True, 0.1), (False, 0.25), (False, 0.25)] and r[0].compression_ratio == 10.0
    again = T.rescore(T.rescore(base, seg, 85.0).drop("changed", "size_in_bytes"), seg, 85.0)
    assert not any(x.changed for x in again.collect())


def test_todo_grid_retries_failures(spark):
    df = trials(spark, (30, 1.0, .5, 90, True, True), (31, 1.0, .5, 90, False, True))
    assert sorted((r.crf, r.aq_key) for r in T.todo_grid(df, df, [30, 31], [1.0, 1.2]).collect()) == [(30, 1.2), (31, 1.0), (31, 1.2)]


def test_not_logged_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, 1.0)], "c int, a double")
    assert T.not_logged(a, a.filter("c = 1"), ["c", "a"]).count() == 1


LINES = ["noise", "Built compression challenge protocol for 10 miners, 2 queries, VMAF threshold 89, codec HEVC, mode vbr, bitrate 2.5 Mbps",
         "x payload: ['https://h/b/one.mp4?s=1', 'https://h/b/two.mp4?s=2']", "Uids: [1, 2]"]


def score(uid, det="success; ref_bpp=0.25", vmaf="91.0"):
    return (f"2024-01-01 00:00:0{uid} | INFO score_compressions:12 - {uid} ** VMAF NEG: 90.5 ** VMAF: {vmaf} ** VMAF Threshold: 89.0 ** Compression Rate: 0.2000 ** Final: 0.5 || {det}")


@pytest.mark.parametrize("per_chunk", [1, 3, 1000])
def test_log_context(spark, per_chunk):
    enc = "success; Valid encoding (AV1, 3840x2160, main, level 5.1, fps 30.0, bitrate 4.5 Mbps); mode=crf; target_bitrate=3 Mbps"
    body = [score(3), *LINES, score(1), "noise", score(1), score(1), score(2, enc), "Uids: [9]", score(2, "MINER FAILURE", "N/A"), score(2, "VMAF 80 below hard cutoff; ref_bpp=0.5")]
    df = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(body)], "file string, line int, value string")
    got = L.analyse(df, per_chunk).orderBy("line").collect()
    assert [r.video_idx for r in got] == [1, 1, 2, 3, 1, 1, 2]
    assert [r.video_id for r in got] == ["video1_bpp0.2500", "one", "two", "video1_bpp0.2500", "one", "one", "two"]
    assert [r.challenge_codec for r in got] == [None] + ["hevc"] * 6 and got[0].mode is None and got[1].mode == "VBR"
    e = got[4]
    assert (e.codec, e.mode, e.resolution, e.fps, e.bitrate_mbps, e.target_bitrate) == ("av1", "CRF", "3840x2160", 30.0, 4.5, 3.0)
    assert got[1].target_bitrate == 2.5 and got[5].vmaf is None and [r.status for r in got[4:]] == ["success", "miner_failure", "vmaf_hard_fail"]
    assert [r.line for r in L.filter_scores(L.analyse(df, per_chunk)).filter("status = 'miner_failure'").collect()] == []


def test_log_video_filter(spark):
    df = spark.createDataFrame([("video2_bpp0.25", None, 2), ("uuid-abcd", "https://h/uuid-abcd.mp4", 2), (None, None, 2)], "video_id string, video_url string, video_idx int")
    def hits(q):
        return [r[0] for r in df.select(L.matches_video(q)).collect()]
    assert hits("#video2") == [True, False, True] and hits("2") == [True] * 3 and hits("abcd") == [False, True, False] and hits("abc") == [False] * 3 and hits(None) == [True] * 3


def test_latest_url(spark):
    body = ["compression https://h/b/a.mp4?s=1 https://h/b/c.mp4?s=1,", "other https://h/b/a.mp4?s=2", "Compression https://h/b/a.mp4?s=3 https://h/z/q.mp4"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(body)], "file string, line int, value string")
    assert sorted(map(tuple, L.latest_urls(df, "compression", L.URL, "/b/").collect())) == [("/b/a.mp4", "https://h/b/a.mp4?s=3", 0), ("/b/c.mp4", "https://h/b/c.mp4?s=1", 0)]


def merge_by_hand(cuts, n, least):
    bounds = [0, *sorted(set(cuts)), n]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if out and (b - a < least or out[-1][1] - out[-1][0] < least):
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def test_cut_merging_matches_a_walk(spark):
    import random
    r = random.Random(11)
    clips, cuts, want = [], [], []
    for v in range(60):
        n = r.randint(40, 600)
        own = r.sample(range(1, n), r.randint(0, 12)) if n > 20 else []
        clips.append((v, n, 30.0))
        cuts += [(v, c) for c in own]
        want += [(v, a, b) for a, b in merge_by_hand(own, n, 45)]
    got = S.cuts_to_segments(spark.createDataFrame(cuts, "video_id int, cut_frame int"), spark.createDataFrame(clips, "video_id int, clip_frames int, fps double"), 1.5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def segs(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "video_id int, seg_index int, start_frame bigint, end_frame bigint, difficulty double, duration double")


def test_segment_edge_cases(spark):
    one = segs(spark, (0, 30, 0.5, 1.0))
    assert S.difficulty_settings(one).first().qp == 28 and S.zones_text(S.difficulty_settings(one)).first().zones == "zones=0,30,q=28"
    empty = spark.createDataFrame([], "video_id int, frame int, size bigint")
    assert S.packet_bytes(one, empty).first().packet_bytes == 0
    z = S.zone_compression(one, empty, empty).first()
    assert (z.compression_rate, z.compression_ratio) == (0.0, 0.0)
    h = S.difficulty_histogram(segs(spark, (0, 1, 0.6, 1.0), (1, 2, 1.0, 1.0), (2, 3, 1.5, 1.0))).orderBy("bin").collect()
    assert [r.n for r in h] == [0, 0, 0, 1, 1] and h[3].fraction == 0.5
    c = S.complexity_ratios(segs(spark, (0, 1, 0.5, 2.0), (1, 2, 0.5, 1.0), (2, 3, 0.1, 1.0))).first()
    assert (c.worst_segment_index, c.high_complexity_ratio, c.low_complexity_ratio) == (0, 0.75, 0.25)


def test_long_zone_texts_stay_one_text(spark):
    df = spark.range(2500).select(F.lit(1).alias("video_id"), F.col("id").cast("int").alias("seg_index"), F.col("id").alias("start_frame"), (F.col("id") + 1).alias("end_frame"), F.lit(20).alias("qp"))
    (row,) = S.zones_text(df).collect()
    assert row.zones.count("q=20") == 2500 and row.zones.startswith("zones=0,1,q=20/1,2")


def test_whole_file_setting_ties(spark):
    df = spark.createDataFrame([(1, 0, 30, 2.0, "a"), (1, 1, 31, 2.0, "b")], "video_id int, seg_index int, crf int, duration double, params string")
    assert tuple(S.whole_file_setting(df).first()) == (1, 30, "b")


def test_harmonic_mean(spark):
    df = spark.createDataFrame([(1, 50.0, None), (1, 100.0, None), (2, 1.0, 77.0)], "video_id int, s double, pooled double")
    assert {r.video_id: round(r.vmaf, 6) for r in S.harmonic_pool(df, "s", ["video_id"], "pooled").collect()} == {1: 66.666667, 2: 77.0}


def test_catalogue_preference(spark):
    df = spark.createDataFrame([("v1", 85, 1), ("v1", 89, 2), ("v1", 89, 3), ("v2", 85, 4), ("v2", 93, 5)], "job_id string, vmaf_threshold int, pos int")
    assert {r.job_id: r.pos for r in X.preferred_results(df, 89).collect()} == {"v1": 3, "v2": 4}
    assert {r.job_id: r.pos for r in X.preferred_results(df, None).collect()} == {"v1": 3, "v2": 5}


def test_natural_order(spark):
    df = spark.createDataFrame([("v10",), ("v9",), ("V1",), ("12",), ("7",)], "n string")
    assert [r.n for r in X.order_names(df, "n").collect()] == ["7", "12", "V1", "v10", "v9"]
    assert [r.n for r in df.filter("n like 'v%'").orderBy(X.natural_key(F.col("n"))).collect()] == ["v9", "v10"]


def test_natural_order_of_long_digit_runs(spark):
    df = spark.createDataFrame([("v" + "9" * 50,), ("v1" + "0" * 50,), ("v007",), ("v8",)], "n string")
    assert [len(r.n) for r in df.orderBy(X.natural_key(F.col("n"))).collect()] == [4, 2, 51, 52]
    assert [len(r.n) for r in X.order_names(df.selectExpr("substring(n, 2) AS n"), "n").collect()] == [3, 1, 50, 51]


def test_segments_without_zones_or_frames_stay(spark):
    two = segs(spark, (0, 30, 0.5, 1.0), (30, 60, 0.5, 1.0))
    zones = spark.createDataFrame([], "video_id int, zone_pos int, zone_start int, crf double, qp double, bitrate double")
    assert [(r.rc_mode, r.zone_match, r.crf) for r in S.attach_zones(two, zones).collect()] == 2 * [("fallback", "none", None)]
    none = S.frames_in_segments(two, spark.createDataFrame([], "video_id int, frame int, size bigint"), ["size"]).collect()
    assert [(r.frame, r.size, r.is_nearest) for r in none] == 2 * [(None, None, False)]


def test_folds_split_like_blocks(spark):
    df = spark.range(11).select(F.col("id"))
    got = {r.id: r.fold for r in M.contiguous_folds(df, ["id"], F.floor(F.col("id") / 3).cast("bigint"), 3).collect()}
    assert [got[i] for i in range(11)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_model_is_trained_saved_and_loaded(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS a", "IF(id % 10 < 5, 24, 36) AS y")
    meta = M.train_model(df, ["a"], "y", ["id"], F.floor(F.col("id") / 8).cast("bigint"), str(tmp_path), k=2, rounds=3, depth=2)
    assert meta["rows"] == 40 and [f["n"] for f in meta["folds"]] == [20, 20] and meta["cv_mae_mean"] < 6
    model, again = M.load_model(spark, str(tmp_path))
    assert again == meta
    got = {r.a: r.prediction for r in M.predict(model, again, spark.createDataFrame([(1.0,), (8.0,)], "a double")).collect()}
    assert got[1.0] < got[8.0] and all(22 <= p <= 42 for p in got.values())


def test_training_needs_rows(spark):
    x = M.vectors(spark.range(5).select(F.col("id").alias("f"), F.lit(30).alias("y")), ["f"], "y")
    with pytest.raises(ValueError):
        M.require_rows(x)


def test_regression_query_trains_all_rounds(spark, monkeypatch):
    from trialspark.plans import load_all

    class Trained(Exception):
        pass

    def fit(train, *, rounds=M.ROUNDS, depth=6, **more):
        raise Trained(rounds, depth)

    monkeypatch.setattr(M, "fit", fit)
    with pytest.raises(Trained) as found:
        load_all()["k01_crf_regression"].frame(spark, "/root/testdata/sf0.001")
    assert found.value.args == (400, 6)


def test_json_fields_are_read_from_one_parse(spark):
    from trialspark.functions.documents import with_json_fields

    texts = [None, "", "{", '{"a": 1, "b": {"c": ["x", "7"]}}', '{"a": "4", "b": 3}', '{"a": 1e20}', '{"a": 1, "a": 2}', "[1]"]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(texts)], "i int, text string, a string")
    got = with_json_fields(df, "text", {"a": ("$.a", "int"), "second": ("$.b.c[1]", "int"), "b": ("$.b", "string")})
    assert {r.i: (r.a, r.second, r.b) for r in got.collect()} == {
        0: (None,) * 3, 1: (None,) * 3, 2: (None,) * 3, 3: (1, 7, '{"c":["x","7"]}'), 4: (4, None, "3"), 5: (None,) * 3, 6: (None,) * 3, 7: (None,) * 3}
    assert got.columns == ["i", "text", "a", "second", "b"]
    assert got._jdf.queryExecution().executedPlan().toString().lower().count("parse_json(") + got._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1


def test_fits_run_in_few_tasks_and_need_no_score(spark, monkeypatch):
    """Small training tables are not cut into many tasks; the label of k01 is that of the at-threshold row, also where a CRF is missing."""
    from trialspark.operators import ml, trials
    seen = []

    class Fitted:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(30.0))

    monkeypatch.setattr(ml, "fit", lambda train, **p: seen.append(train.rdd.getNumPartitions()) or Fitted())
    rows = spark.range(0, 200, 1, 16).select("id", (F.col("id") % 5).cast("int").alias("fold"), F.lit(1).alias("features"))
    assert ml.cross_validate(rows).count() == 200 and seen == [1] * 5
    df = spark.createDataFrame([(1, 30, 90.0, True), (1, 28, 86.0, True), (1, 22, 84.0, True), (1, 20, 99.0, False), (2, None, 95.0, True), (2, 25, 95.0, True), (3, 25, 80.0, True)],
                               "video_id int, crf int, vmaf_neg double, gates_ok boolean").withColumns({"s_f": F.lit(0.5), **{k: F.lit(0) for k in trials.SEQ}})
    want = trials.crf_at_threshold(df, ["video_id"], 85.0).select("video_id", "crf")
    assert sorted(map(tuple, trials.lowest_crf_at_threshold(df, ["video_id"], 85.0).collect())) == sorted(map(tuple, want.collect())) == [(1, 28), (2, None)]


def test_windows_on_the_edge_of_a_budget(spark):
    """180 frames are added hardest first, one window after the other, so the total falls on the side of six seconds that SQL's does."""
    clips = {1: [(0, 25, .65), (25, 7, .31), (32, 89, .48), (121, 73, .49)],
             2: [(0, 6, .31), (6, 56, .55), (62, 55, .62), (117, 6, .49), (123, 57, .40)],
             3: [(0, 20, .52), (20, 12, .58), (32, 18, .43), (50, 40, .47), (90, 30, .51), (120, 35, .46), (155, 13, .45), (168, 12, .37)],
             4: [(0, 11, .54), (11, 72, .49), (83, 8, .35), (91, 8, .541), (99, 24, .50), (123, 57, .57)]}
    rows = [(v, i, a / 30.0, (a + n) / 30.0, d) for v, c in clips.items() for i, (a, n, d) in enumerate(c)]
    want = {}
    for v in clips:
        used, kept = 0.0, []
        for _, i, a, b, d in sorted((r for r in rows if r[0] == v), key=lambda r: -r[4]):
            w = b - a if b - a < 0.5 else min(2.5, b - a)
            kept.append((i, a + max(0.0, (b - a - w) / 2), w, 6.0 - used))
            used += w
        for i, a, w, left in kept:
            if used <= 6 or round(left, 9) >= 0.5:
                take = w if used <= 6 else min(w, left)
                want[v, i] = (a + (w - take) / 2, take)
    got = S.budget_windows(spark.createDataFrame(rows, "video_id int, seg_index int, start_sec double, end_sec double, difficulty double"), max_seconds=6.0).collect()
    assert {(r.video_id, r.seg_index): (r.window_start, r.window_sec) for r in got} == want
    assert sorted(want) == [(1, 0), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), *[(3, i) for i in range(8)], *[(4, i) for i in range(6)]]
