"""Operators over trial tables: filters, best-trial picks, joins to labels, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions.numbers import round_even
from trialspark.functions.score import compression_rate, compression_ratio, score_struct
from trialspark.operators.scan import bitmap_semi, max_before, ordered_scan, top_one

SEQ = ["k1", "k2", "k3", "k4"]
SEGMENT = ["video_id", "segment_index"]


def _seq_asc(seq):
    return [F.col(c).asc() for c in seq]


def _seq_desc(seq):
    return [F.col(c).desc() for c in seq]


def _score(col: str = "s_f") -> Column:
    """A missing score counts as zero when trials are compared."""
    return F.coalesce(F.col(col), F.lit(0.0))


# ---------------------------------------------------------------- filters

def truthy(col: Column, default: bool) -> Column:
    """Text 1/true/yes (any case) or a true boolean; missing takes `default`."""
    return F.coalesce(F.lower(col.cast("string")).isin("1", "true", "yes"), F.lit(default))


def select_trials(df: DataFrame, *, gates_only: bool = False, include_failed: bool = True) -> DataFrame:
    if not include_failed:
        df = df.filter(F.coalesce(F.col("encode_ok"), F.lit(False)))
    if gates_only:
        df = df.filter(F.coalesce(F.col("gates_ok"), F.lit(False)))
    return df


def usable_results(df: DataFrame) -> DataFrame:
    """Finished results: no error, a rate control value, and a positive score if any."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    has_rate = F.col("crf").isNotNull() | (F.coalesce(F.col("bitrate"), F.lit("")) != "")
    s = F.col("s_f").cast("string")
    score_ok = s.isNull() | F.coalesce(s.try_cast("double") > 0, F.lit(False))
    return df.filter(no_error & has_rate & score_ok)


def complete_labels(df: DataFrame, threshold: int) -> DataFrame:
    """Labels finished for this threshold (nested `oracle_best_sf`)."""
    best = F.col("oracle_best_sf")
    return df.filter(
        (F.coalesce(F.col("threshold"), F.lit(-1)) == threshold)
        & (F.coalesce(best["params"], F.lit("")) != "")
        & best["crf"].cast("string").try_cast("int").isNotNull()
        & (F.coalesce(F.col("trial_count"), F.lit(0)) > 0))


def interval_state(df: DataFrame, vmaf_thr: float, ratio_thr: float) -> DataFrame:
    """valid flag (strictly above both thresholds) and the reason text when not."""
    ok = truthy(F.col("encode_ok"), False)
    v = F.coalesce(F.col("vmaf_neg"), F.lit(0.0))
    r = F.coalesce(F.col("compression_ratio"), F.lit(0.0))
    low_v, low_r = v <= vmaf_thr, r <= ratio_thr
    why = F.when(~ok, F.lit("encode_failed")).otherwise(F.concat_ws(
        ",", F.when(low_v, F.lit(f"vmaf<={vmaf_thr:g}")), F.when(low_r, F.lit(f"ratio<={ratio_thr:g}"))))
    return df.withColumns({"valid": ok & ~low_v & ~low_r, "invalid_reason": F.nullif(why, F.lit(""))})


def feasible_crf(ok: Column, vmaf: Column, rate: Column, threshold: float,
                 max_rate: float | None = None) -> Column:
    out = F.coalesce(ok, F.lit(False)) & (vmaf > threshold)
    return out if max_rate is None else out & (rate < max_rate)


def feasible_vbr(ok: Column, vmaf: Column, s_f: Column, threshold: float) -> Column:
    return F.coalesce(ok, F.lit(False)) & (vmaf > threshold) & (s_f > 0)


# ---------------------------------------------------------------- best rows

def best_trial(df: DataFrame, keys=SEGMENT, seq=SEQ, gated: str = "plain",
               default_ok: bool = True) -> DataFrame:
    """Highest score per group among encodes that worked; the first wins a tie.

    gated: "plain", "only" (must pass the gates) or "prefer" (gated if any, else plain).
    """
    ok = df.filter(truthy(F.col("encode_ok"), default_ok))
    gate = F.coalesce(F.col("gates_ok"), F.lit(False))
    order = [_score().desc(), *_seq_asc(seq)]
    if gated == "only":
        ok = ok.filter(gate)
    elif gated == "prefer":
        order = [gate.desc(), *order]
    return top_one(ok, keys, *order)


def merge_roots(roots: list[DataFrame]) -> DataFrame:
    """Union of trial roots with differing columns; later roots get a higher rank."""
    out = None
    for rank, df in enumerate(roots):
        df = df.withColumn("root_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dedupe_last_wins(df: DataFrame, keys=SEGMENT, seq=SEQ, aq_digits: int = 4) -> DataFrame:
    """One row per (group, crf, rounded aq): the latest root, then the latest row."""
    df = df.withColumn("aq_key", round_even(F.col("aq_strength"), aq_digits))
    return top_one(df, [*keys, "crf", "aq_key"], F.col("root_rank").desc(), *_seq_desc(seq))


def oracle_best(df: DataFrame, keys, seq=SEQ) -> DataFrame:
    return top_one(df, keys, F.coalesce(F.col("gates_ok"), F.lit(False)).desc(),
                   _score().desc(), F.col("vmaf_neg").desc(), *_seq_asc(seq))


def crf_at_threshold(df: DataFrame, keys, threshold: float, seq=SEQ) -> DataFrame:
    """Lowest gated CRF that reaches the threshold; ties by score, then quality."""
    good = df.filter(F.coalesce(F.col("gates_ok"), F.lit(False)) & (F.col("vmaf_neg") >= threshold))
    return top_one(good, keys, F.col("crf").asc(), _score().desc(), F.col("vmaf_neg").desc(),
                   *_seq_asc(seq))


def lowest_crf_at_threshold(df: DataFrame, keys, threshold: float) -> DataFrame:
    """The `crf` of crf_at_threshold alone, by one aggregate that needs no score; a missing CRF comes first there and here."""
    good = df.filter(F.coalesce(F.col("gates_ok"), F.lit(False)) & (F.col("vmaf_neg") >= threshold))
    return good.groupBy(*keys).agg(F.when(F.count_if(F.col("crf").isNull()) == 0, F.min("crf")).alias("crf"))


def search_best(df: DataFrame, keys, seq=SEQ) -> DataFrame:
    return top_one(df.filter(F.coalesce(F.col("encode_ok"), F.lit(False))), keys,
                   _score().desc(), F.col("vmaf_neg").desc(), F.col("crf").asc_nulls_last(),
                   *_seq_asc(seq))


def preprocess_winner(df: DataFrame, keys, seq=SEQ) -> DataFrame:
    """Best gated preprocess per group; a null name when no candidate passed."""
    gate = F.coalesce(F.col("gates_ok"), F.lit(False))
    won = top_one(df, keys, gate.desc(), _score().desc(), F.col("vmaf_neg").desc(), *_seq_asc(seq))
    return won.withColumns({
        "winner": F.when(gate, F.nullif(F.col("preprocess"), F.lit("none"))),
        "any_passed": gate})


def incumbent_trace(df: DataFrame, keys, threshold: float, chunk: Column | None, seq=SEQ) -> DataFrame:
    """Best-so-far after each trial, and which trials were accepted.

    Only working trials with a positive score count. A trial above the threshold
    beats any that is not; then the score decides, below the threshold also the
    quality.
    """
    counts = F.coalesce(F.col("encode_ok"), F.lit(False)) & (_score() > 0)
    clears = F.col("vmaf_neg") > threshold
    rank = F.when(counts, F.struct(clears.alias("clears"), F.col("s_f").alias("s_f"),
                                   F.when(clears, 0.0).otherwise(F.col("vmaf_neg")).alias("tie")))
    out = df.withColumn("_rank", rank)
    out = ordered_scan(out, keys, seq, chunk, _prev=max_before(F.col("_rank")))
    out = out.withColumn("_best", F.greatest("_prev", "_rank"))
    accepted = F.col("_rank").isNotNull() & (F.col("_prev").isNull() | (F.col("_rank") > F.col("_prev")))
    return (out.withColumns({"accepted": accepted, "best_s_f": F.col("_best.s_f"),
                             "best_clears": F.col("_best.clears")})
            .drop("_rank", "_best", "_prev"))


def best_attempt(df: DataFrame, keys, min_vmaf: float, max_percent: float, seq=SEQ) -> DataFrame:
    """Highest CRF that passes quality and size; otherwise the best quality."""
    passing = (F.coalesce(F.col("encode_ok"), F.lit(False)) & (F.col("vmaf_neg") >= min_vmaf)
               & (F.col("encode_percent") <= max_percent))
    passing = F.coalesce(passing, F.lit(False))
    row = top_one(df.withColumn("_pass", passing), keys, F.col("_pass").desc(),
                  F.when(F.col("_pass"), F.col("crf")).desc(),
                  F.when(~F.col("_pass"), F.col("vmaf_neg")).desc(), *_seq_asc(seq))
    return row.withColumnRenamed("_pass", "passed")


def encoded_percent(sample_bytes: Column, encoded_bytes: Column) -> Column:
    return F.when(sample_bytes <= 0, 100.0).otherwise(encoded_bytes * 100.0 / sample_bytes)


# ---------------------------------------------------------------- joins

def flag_trials(trials: DataFrame, labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Trials left-joined to labels, flagged as the best and the at-threshold trial.

    A trial matches by crf and aq strength, or by parameter text where a number is
    missing. Labels hold one row per video.
    """
    j = trials.join(labels, key, "left")

    def same(crf, aq, params):
        has = F.col(crf).isNotNull() | F.col(aq).isNotNull() | F.col(params).isNotNull()
        numeric = F.col("crf").isNotNull() & F.col(crf).isNotNull() \
            & F.col("aq_strength").isNotNull() & F.col(aq).isNotNull()
        by_number = (F.col("crf") == F.col(crf)) & (F.abs(F.col("aq_strength") - F.col(aq)) < 1e-6)
        by_text = F.coalesce(F.col("params"), F.lit("")) == F.coalesce(F.col(params), F.lit(""))
        return has & F.when(numeric, by_number).otherwise(by_text)

    return j.withColumns({
        "is_oracle_best_sf": same("oracle_crf", "oracle_aq_strength", "oracle_params"),
        "is_oracle_crf_at_threshold": same("crf_at_threshold", "aq_at_threshold", "params_at_threshold")})


def feature_fallback(trials: DataFrame, label_features: DataFrame, doc_features: DataFrame,
                     columns: list[str], key: str = "video_id",
                     default_threshold: int | None = None) -> DataFrame:
    """Features from the label, or from the feature document when the label has none."""
    a = label_features.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = doc_features.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    any_label = F.coalesce(*[F.col(f"_a_{c}").cast("string") for c in columns]).isNotNull()
    out = trials.join(a, key, "left").join(b, key, "left")
    out = out.withColumns({f"feat_{c}": F.when(any_label, F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}"))
                           for c in columns})
    if default_threshold is not None:
        out = out.withColumn("threshold", F.coalesce(F.col("threshold"), F.lit(default_threshold)))
    return out.drop(*[f"_{s}_{c}" for s in "ab" for c in columns])


def todo_grid(segments: DataFrame, trials: DataFrame, crfs: list[int], aqs: list[float],
              keys=SEGMENT) -> DataFrame:
    """Grid points still to run: every (segment, crf, aq) without a successful trial."""
    grid = (segments.select(*keys).distinct()
            .withColumn("crf", F.explode(F.array(*[F.lit(int(c)) for c in crfs])))
            .withColumn("aq_key", F.explode(F.array(*[F.lit(round(float(a), 4)) for a in aqs]))))
    done = (trials.filter(truthy(F.col("encode_ok"), False))
            .select(*keys, "crf", round_even(F.col("aq_strength"), 4).alias("aq_key")).distinct())
    return grid.join(done, [*keys, "crf", "aq_key"], "left_anti")


def not_logged(cached: DataFrame, logged: DataFrame, keys: list[str]) -> DataFrame:
    """Cached rows whose key is not in the log yet (null-safe). Of a long log only rows that may match are shuffled."""
    c, g = cached.alias("c"), bitmap_semi(logged.select(*keys), cached, keys).distinct().alias("g")
    cond = None
    for k in keys:
        e = F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}"))
        cond = e if cond is None else cond & e
    return c.join(g, cond, "left_anti")


def attach_segment(trials: DataFrame, segments: DataFrame, columns: list[str], keys=SEGMENT) -> DataFrame:
    return trials.join(segments.select(*keys, *columns), list(keys), "inner")


def rescore(trials: DataFrame, segment_bytes: DataFrame, threshold: float, keys=SEGMENT) -> DataFrame:
    """Recompute rate, ratio, score and reason from true segment bytes.

    Failed encodes and rows with an unknown size stay untouched; `changed` marks
    rows that moved beyond tolerance.
    """
    j = trials.join(segment_bytes.select(*keys, "source_bytes"), list(keys), "left")
    i = F.coalesce(F.col("source_bytes").cast("double"), F.lit(0.0))
    o = F.coalesce(F.col("size_out_bytes").cast("double"), F.lit(0.0))
    live = F.coalesce(F.col("encode_ok"), F.lit(False)) & (i > 0) & (o > 0)
    j = j.withColumns({"_live": live, "_rate": compression_rate(i, o)})
    j = j.withColumn("_ratio", F.when(o >= i, 1.0).otherwise(F.try_divide(i, o)))
    j = j.withColumn("_sc", score_struct(F.coalesce(F.col("vmaf_neg"), F.lit(0.0)), F.col("_rate"), threshold))

    def old(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    moved = ((F.abs(old("compression_rate") - F.col("_rate")) > 1e-9)
             | (F.abs(old("compression_ratio") - F.col("_ratio")) > 1e-6)
             | (F.abs(old("s_f") - F.col("_sc.s_f")) > 1e-9)
             | (F.coalesce(F.col("reason"), F.lit("")) != F.col("_sc.reason")))
    new = {"compression_rate": F.col("_rate"), "compression_ratio": F.col("_ratio"),
           "s_f": F.col("_sc.s_f"), "reason": F.col("_sc.reason")}
    upd = {c: F.when(F.col("_live"), v).otherwise(F.col(c)) for c, v in new.items()}
    upd["size_in_bytes"] = F.when(F.col("_live"), i.cast("bigint"))
    upd["changed"] = F.col("_live") & F.coalesce(moved, F.lit(True))
    return j.withColumns(upd).drop("_live", "_rate", "_ratio", "_sc", "source_bytes")


# ---------------------------------------------------------------- summaries

def _first_best(cond: Column, seq, **fields) -> Column:
    """Fields of the row with the highest score (first on ties) where `cond` holds."""
    vals = F.struct(*[F.col(v).alias(k) for k, v in fields.items()])
    return F.min(F.when(cond, F.struct((-_score()).alias("_neg"), *[F.col(c) for c in seq], vals.alias("row"))))


def sweep_summary(df: DataFrame, keys=SEGMENT, seq=SEQ) -> DataFrame:
    """Counts and the best plain and gated trial per group, in one aggregation."""
    ok = F.coalesce(F.col("encode_ok"), F.lit(False))
    gate = ok & F.coalesce(F.col("gates_ok"), F.lit(False))
    f = dict(crf="crf", aq="aq_strength", s_f="s_f")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(ok).alias("n_ok"),
                              _first_best(ok, seq, **f).alias("_b"), _first_best(gate, seq, **f).alias("_g"))
    return g.select(*keys, "n_trials", "n_ok",
                    *[F.col(f"_b.row.{k}").alias(f"best_{k}") for k in f],
                    *[F.col(f"_g.row.{k}").alias(f"gated_{k}") for k in f])


def merged_catalogue(df: DataFrame, expected: DataFrame, root_names: list[str], seq=SEQ) -> DataFrame:
    """Per video: merged and raw trial counts, sources, and whether segments are missing.

    `expected` holds (video_id, expected_n_segments).
    """
    names = F.array(*[F.lit(n) for n in root_names])
    raw = df.groupBy("video_id").agg(
        *[F.count_if(F.col("root_rank") == i).alias(f"raw_{n}") for i, n in enumerate(root_names)],
        F.sort_array(F.collect_set(F.element_at(names, F.col("root_rank") + 1))).alias("_src"))
    merged = dedupe_last_wins(df, seq=seq)
    per = merged.groupBy("video_id", "segment_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truthy(F.col("encode_ok"), True)).alias("ok"))
    tot = per.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_trials"),
                                      F.sum("ok").alias("n_ok"))
    out = tot.join(raw, "video_id").join(expected, "video_id", "left")
    return out.withColumns({
        "method_label": F.array_join("_src", "+"),
        "incomplete": F.coalesce(F.col("n_segments") < F.col("expected_n_segments"), F.lit(False))}).drop("_src")


def surface_cells(df: DataFrame, metrics: list[str], keys=SEGMENT, seq=SEQ, gates_only: bool = False) -> DataFrame:
    """One row per tried (group, aq, crf) cell; the last non-null value wins."""
    ok = df.filter(truthy(F.col("encode_ok"), True))
    if gates_only:
        ok = ok.filter(F.coalesce(F.col("gates_ok"), F.lit(False)))
    order = F.struct(F.col("root_rank"), *[F.col(c) for c in seq])
    return (ok.withColumn("aq", round_even(F.col("aq_strength"), 4)).groupBy(*keys, "aq", "crf")
            .agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), order)).alias(m) for m in metrics]))


def surface_pivot(cells: DataFrame, metric: str, crfs: list[int], keys=SEGMENT) -> DataFrame:
    """CRF columns by AQ rows for one metric; null where a cell was not tried."""
    return cells.groupBy(*keys, "aq").agg(
        *[F.max(F.when(F.col("crf") == c, F.col(metric))).alias(f"crf_{c}") for c in crfs])


def surface_summary(df: DataFrame, keys=SEGMENT, gates_only: bool = False) -> DataFrame:
    """Axis sizes and the sparse flag (rows below 85% of the cells)."""
    ok = truthy(F.col("encode_ok"), True)
    if gates_only:
        ok = ok & F.coalesce(F.col("gates_ok"), F.lit(False))
    aq = round_even(F.col("aq_strength"), 4)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(ok).alias("n_ok"),
        F.count_distinct(F.when(ok, F.col("crf"))).alias("n_crf"),
        F.count_distinct(F.when(ok, aq)).alias("n_aq"))
    return g.withColumn("sparse", F.col("n_ok") < F.greatest(F.lit(1), F.col("n_crf") * F.col("n_aq")) * 0.85)


def pass_intervals(df: DataFrame, vmaf_thr: float, ratio_thr: float, keys=SEGMENT, seq=SEQ) -> DataFrame:
    """Lowest and highest valid AQ per (group, crf) over the last trial of each AQ (1 dp)."""
    last = dedupe_last_wins(df, keys, seq, aq_digits=1)
    s = interval_state(last, vmaf_thr, ratio_thr)
    v = F.col("valid")
    best = F.min(F.when(v, F.struct((-_score()).alias("n"), F.col("aq_key").alias("aq"), F.col("s_f").alias("s_f"))))
    g = s.groupBy(*keys, "crf").agg(
        F.min(F.when(v, F.col("aq_key"))).alias("aq_lo"), F.max(F.when(v, F.col("aq_key"))).alias("aq_hi"),
        F.count(F.lit(1)).alias("n_probes"), F.count_if(v).alias("n_valid"), best.alias("_b"))
    return g.withColumns({"is_empty": F.col("n_valid") == 0, "best_aq": F.col("_b.aq"),
                          "best_s_f": F.col("_b.s_f")}).drop("_b")


def param_impact(df: DataFrame, seq=SEQ) -> DataFrame:
    """Quality swing per parameter over working trials, largest first."""
    ok = df.filter(F.coalesce(F.col("ok"), F.lit(False)))
    at = [F.col(c) for c in seq]
    hi = F.min(F.struct((-F.col("vmaf_neg")).alias("n"), *at, F.col("value").alias("value")))
    lo = F.min(F.struct(F.col("vmaf_neg").alias("n"), *at, F.col("value").alias("value")))
    return ok.groupBy("param").agg(
        F.max(F.abs("delta_vmaf_vs_baseline")).alias("max_abs_delta_vmaf"),
        hi["value"].alias("best_value"), F.max("vmaf_neg").alias("best_vmaf_neg"),
        lo["value"].alias("worst_value"), F.min("vmaf_neg").alias("worst_vmaf_neg"),
        F.count(F.lit(1)).alias("trials")).orderBy(F.col("max_abs_delta_vmaf").desc(), "param")


def dashboard_summary(df: DataFrame, keys=SEGMENT, seq=SEQ) -> DataFrame:
    """Best and best-gated point per group, rounded for display, in one aggregation."""
    ok = truthy(F.col("encode_ok"), True)
    gate = ok & F.coalesce(F.col("gates_ok"), F.lit(False))
    f = dict(crf="crf", aq="aq_strength", s_f="s_f", vmaf="vmaf_neg", ratio="compression_ratio")
    g = df.filter(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _first_best(ok, seq, **f).alias("b"),
                                         _first_best(gate, seq, **f).alias("g"))
    return g.select(*keys, "n", F.col("b.row.crf").alias("best_crf"), F.col("b.row.aq").alias("best_aq"),
                    round_even(F.col("b.row.s_f"), 4).alias("best_s_f"),
                    round_even(F.col("b.row.vmaf"), 2).alias("best_vmaf"),
                    round_even(F.col("b.row.ratio"), 2).alias("best_ratio"),
                    F.col("g.row.crf").alias("gated_crf"), F.col("g.row.aq").alias("gated_aq"),
                    round_even(F.col("g.row.s_f"), 4).alias("gated_s_f"))


def ordered_distinct(df: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """First occurrence of every key, with its position kept."""
    return top_one(df, key, *[F.col(c).asc() for c in position])
