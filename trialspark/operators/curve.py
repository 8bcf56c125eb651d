"""Rate/quality curves: interpolation, prediction, next probes.

A curve is the sequence of its trials by whole CQ, then by trial order; every trial counts. Of the trials of one CQ
only a few can decide an answer (the first and last, the two best and two worst qualities, the best scores), so
`observations` keeps these alone: the points of one curve may sit together in an array however many trials were run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialspark.functions.numbers import fixed_text, half_even
from trialspark.functions.score import SOFT_MARGIN, predicted_score
from trialspark.operators.scan import top_one
from trialspark.operators.trials import SEGMENT, SEQ

MIN_CQ, MAX_CQ = 0, 63


def _with_cq(trials: DataFrame) -> DataFrame:
    return trials.withColumn("cq", F.col("crf").try_cast("int"))


def observations(trials: DataFrame, keys=SEGMENT, seq=SEQ, cq_range: tuple[int, int] = (MIN_CQ, MAX_CQ), gates: tuple[float, ...] = ()) -> DataFrame:
    """The trials of each (curve, cq) that can decide an answer about the curve, in trial order (`place`).

    Settings are cut to a whole CQ, so 23 and 23.5 are two observations of CQ 23. Kept of a CQ's working trials: the
    first and last with a quality and with a rate, the two highest and two lowest qualities, the best score, and
    for each quality of `gates` (needed by rule_anchored_crf) the first trial and the best score that reach it. Every
    question of this module has the same answer for these as for all trials. A CQ without a working trial
    has one row with encode_ok false. A missing rate counts as 1, a missing quality or score as 0; trials equal in
    seq and values are one. What lies outside cq_range comes back from rejected_observations.
    """
    c, group = F.col, [*keys, "cq"]
    flags = [c("vmaf") > 0, c("compression_rate") > 0, *[c("vmaf") >= g for g in gates]]
    rows = _with_cq(trials).filter(c("cq").between(*cq_range)).select(
        *group, F.coalesce("encode_ok", F.lit(False)).alias("encode_ok"), *[c(x).alias(f"__s{i}") for i, x in enumerate(seq)],
        F.coalesce("vmaf_neg", F.lit(0.0)).alias("vmaf"), F.coalesce("compression_rate", F.lit(1.0)).alias("compression_rate"),
        "compression_ratio", F.coalesce("s_f", F.lit(0.0)).alias("s_f"))
    rows = rows.select("*", F.round("s_f", 12).alias("__score"), F.array(*flags).alias("__flags"), F.lit(0).alias("place"))
    point = [*[f"__s{i}" for i in range(len(seq))], "vmaf", "compression_rate", "compression_ratio", "s_f"]

    def cut(df):
        df = df.sortWithinPartitions(*group, c("encode_ok").desc(), *point)
        return df.mapInArrow(_deciding(group, ["encode_ok", *point], len(gates)), df.schema)

    kept = cut(cut(rows).repartition(*group))  # once before the shuffle, so that no task gets all rows of a hot group
    ok = c("encode_ok")
    return kept.select(*group, "place", F.when(ok, c("vmaf")).otherwise(0.0).alias("vmaf"),
                       F.when(ok, c("compression_rate")).otherwise(1.0).alias("compression_rate"), F.when(ok, c("compression_ratio")).alias("compression_ratio"),
                       F.when(ok, c("s_f")).otherwise(0.0).alias("s_f"), "encode_ok")


def _deciding(group: list[str], point: list[str], gates: int):
    """Function for mapInArrow that leaves the rows of each group that `observations` keeps, of rows sorted by group and
    point; a group may span batches."""
    def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
        """Whether a row differs from the one before it."""
        out = np.zeros(table.num_rows, bool)
        out[0] = True
        for name in columns:
            a, b = table[name].slice(0, table.num_rows - 1), table[name].slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~same.to_numpy()
        return out

    def marked(table: pa.Table, new: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Places of the deciding rows. A group without a working trial keeps its first row."""
        group = np.cumsum(new)
        ok = table["encode_ok"].to_numpy() & distinct
        vmaf, score = table["vmaf"].to_numpy(), table["__score"].to_numpy()
        flags = pc.list_flatten(table["__flags"]).to_numpy(zero_copy_only=False).reshape(-1, 2 + gates)
        keep = new & ~table["encode_ok"].to_numpy()

        def mark(cond, *by, first=0, last=0):
            """The first and last rows of each group in the order of `by` (the main key last), then of the rows."""
            rows = np.flatnonzero(ok & cond)
            rows = rows[np.lexsort([rows, *[k[rows] for k in by], group[rows]])] if by else rows
            g = group[rows]
            for n in range(first):
                keep[rows[np.r_[np.ones(min(n + 1, len(g)), bool), g[n + 1:] != g[:-n - 1]]]] = True
            for n in range(last):
                keep[rows[np.r_[g[n + 1:] != g[:-n - 1], np.ones(min(n + 1, len(g)), bool)]]] = True

        quality, rate, everything = flags[:, 0], flags[:, 1], np.ones(len(ok), bool)
        mark(quality, first=1, last=1)
        mark(rate, first=1, last=1)
        mark(everything, vmaf, score, last=1)
        mark(everything, vmaf, first=1, last=1)
        mark(quality, vmaf, first=2)
        mark(quality, -vmaf, ~np.isnan(vmaf), first=2)
        for i in range(gates):
            mark(flags[:, 2 + i], first=1)
            mark(flags[:, 2 + i], score, last=1)
        return np.flatnonzero(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if carry is None else pa.concat_tables([carry, table])).combine_chunks()
            if not table.num_rows:
                continue
            new = changes(table, group)
            keep = marked(table, new, new | changes(table, point))
            start = np.flatnonzero(new[keep] | np.r_[True, np.diff(np.cumsum(new)[keep]) > 0])
            place = np.arange(len(keep)) - np.repeat(start, np.diff(np.r_[start, len(keep)]))
            table = table.take(pa.array(keep)).set_column(table.schema.get_field_index("place"), table.schema.field("place"), pa.array(place, pa.int32()))
            carry = table.slice(start[-1])  # the group may go on in the next batch
            yield from table.slice(0, start[-1]).to_batches()
        if carry is not None:
            yield from carry.to_batches()

    return cut


def rejected_observations(trials: DataFrame, cq_range: tuple[int, int] = (MIN_CQ, MAX_CQ)) -> DataFrame:
    """Trials that no curve holds, with the reason: no number, or a CQ outside the range."""
    rows = _with_cq(trials)
    reason = F.when(F.col("cq").isNull(), "no_cq").when(~F.col("cq").between(*cq_range), "cq_out_of_range")
    return rows.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull()).drop("cq")


def curves(obs: DataFrame, keys=SEGMENT) -> DataFrame:
    """One row per curve: `pts` (working points by cq, then place) and `used` (all tried cqs)."""
    place = F.col("place") if "place" in obs.columns else F.lit(0).alias("place")
    pt = F.struct("cq", place, "vmaf", F.col("compression_rate").alias("rate"), "s_f")
    return obs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("encode_ok"), pt))).alias("pts"),
                                  F.sort_array(F.collect_set("cq")).alias("used"))


def _ranked(point: Column, field: str) -> Column:
    """A field to rank points by; scores equal in 12 decimals are ties, whatever engine computed them."""
    return F.round(point[field], 12) if field == "s_f" else point[field]


def _neighbours(p: Column) -> Column:
    n = F.greatest(F.size(p) - 1, F.lit(0))
    return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def crossing(p: Column, target: Column) -> Column:
    """CQ where quality crosses `target`: the first neighbouring pair around it, else
    the line through the two nearest points; a single point stands for itself.
    `p` is a column of points with quality above zero."""
    hit = F.get(F.filter(_neighbours(p), lambda q: ((q["l"]["vmaf"] - target) * (q["r"]["vmaf"] - target) <= 0)
                         & (q["l"]["vmaf"] != q["r"]["vmaf"])), F.lit(0))

    def line(a, b):
        t = (target - a["vmaf"]) / (b["vmaf"] - a["vmaf"])
        return a["cq"] + t * (b["cq"] - a["cq"])

    def flat(two):
        a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        return F.when(a["vmaf"] == b["vmaf"], a["cq"].cast("double")).otherwise(line(a, b))

    near = F.slice(F.sort_array(F.transform(p, lambda x: F.struct(
        F.abs(x["vmaf"] - target).alias("d"), x["cq"].alias("cq"), x["vmaf"].alias("vmaf")))), 1, 2)
    two = F.sort_array(F.transform(near, lambda x: F.struct(x["cq"].alias("cq"), x["vmaf"].alias("vmaf"))))
    return (F.when(F.size(p) == 0, None).when(F.size(p) == 1, F.get(p, F.lit(0))["cq"].cast("double"))
            .otherwise(_once(hit, lambda h: F.when(h.isNotNull(), line(h["l"], h["r"])).otherwise(_once(two, flat)))))


def _once(value: Column, use) -> Column:
    """use(value), with the value computed a single time however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seen(pts: Column) -> Column:
    return F.filter(pts, lambda x: x["vmaf"] > 0)


def with_crossing(df: DataFrame, target: float | Column, out: str = "cq_star") -> DataFrame:
    t = target if isinstance(target, Column) else F.lit(float(target))
    return df.withColumn("_p", seen(F.col("pts"))).withColumn(out, crossing(F.col("_p"), t)).drop("_p")


def interpolated_crf(df: DataFrame, threshold: float, crf_min: int, crf_max: int) -> DataFrame:
    """Integer CRF from the crossing; with one point a step of one towards the gate."""
    thr = F.lit(float(threshold))
    name = f"{threshold:g}"
    x = df.withColumn("_p", seen(F.col("pts"))).withColumn("_star", crossing(F.col("_p"), thr))
    one = F.get("_p", F.lit(0))
    up = one["vmaf"] >= thr
    n = F.size("_p")
    crf = (F.when(n == 0, None)
           .when((n == 1) & up, F.least(F.lit(crf_max), one["cq"] + 1))
           .when(n == 1, F.greatest(F.lit(crf_min), one["cq"] - 1))
           .otherwise(F.greatest(F.least(half_even(F.col("_star")), F.lit(crf_max)), F.lit(crf_min))))
    single = F.concat(F.lit("single_probe_vmaf="), fixed_text(one["vmaf"], 1))
    why = (F.when(n == 0, "no_observations").when((n == 1) & up, F.concat(single, F.lit(f">={name}")))
           .when(n == 1, F.concat(single, F.lit(f"<{name}")))
           .otherwise(F.concat(F.lit(f"interp_vmaf={name} crf*="), fixed_text(F.col("_star"), 2))))
    return x.withColumns({"crf": crf, "crf_reason": why}).drop("_p", "_star")


def predict_at(df: DataFrame, cq: str, threshold: float, pts: str = "pts", out: str = "predicted_s_f") -> DataFrame:
    """Predicted score at column `cq`: neighbours interpolate quality and rate, the
    ends of the curve stand for everything beyond them. At a CQ with several points the first counts, at
    the last CQ of a curve of several CQs the last."""
    x = df.withColumn("_p", F.filter(F.col(pts), lambda v: v["rate"] > 0))
    start, end = F.get("_p", F.lit(0)), F.try_element_at("_p", F.lit(-1))
    beyond = (F.col(cq) >= end["cq"]) & (F.col(cq) > start["cq"])
    x = x.withColumns({"_l": F.when(beyond, end).otherwise(F.try_element_at(F.filter(F.col("_p"), lambda v: v["cq"] < F.col(cq)), F.lit(-1))),
                       "_r": F.when(~beyond, F.get(F.filter(F.col("_p"), lambda v: v["cq"] >= F.col(cq)), F.lit(0)))})
    l, r = F.col("_l"), F.col("_r")
    t = (F.col(cq) - l["cq"]) / (r["cq"] - l["cq"])
    both = l.isNotNull() & r.isNotNull()

    def mix(f):
        return F.when(both, l[f] + t * (r[f] - l[f])).otherwise(F.coalesce(l[f], r[f]))

    x = x.withColumns({"_v": mix("vmaf"), "_rt": mix("rate")})
    return x.withColumn(out, predicted_score(F.col("_v"), F.col("_rt"), threshold)).drop("_p", "_l", "_r", "_v", "_rt")


def predict_candidates(df: DataFrame, crf_min: int, crf_max: int, threshold: float) -> DataFrame:
    x = df.withColumn("candidate", F.explode(F.sequence(F.lit(crf_min), F.lit(crf_max))))
    return predict_at(x, "candidate", threshold)


def with_anchor(df: DataFrame, threshold: float) -> DataFrame:
    """`anchor`: best measured point; `band_lo`/`band_hi`: where the score can still rise."""
    p = F.col("pts")
    good = F.array_max(F.transform(F.filter(p, lambda x: x["s_f"] > 0), lambda x: F.struct(
        _ranked(x, "s_f").alias("a"), x["vmaf"].alias("b"), (-x["cq"]).alias("c"), x.alias("x"))))["x"]
    other = F.array_max(F.transform(p, lambda x: F.struct(
        x["vmaf"].alias("b"), (-x["cq"]).alias("c"), x.alias("x"))))["x"]
    df = df.withColumn("anchor", F.coalesce(good, other))
    a = F.col("anchor")
    right = F.filter(p, lambda x: x["cq"] > a["cq"])
    df = df.withColumn("_right", right)

    def first_below(limit):
        return F.get(F.filter(F.col("_right"), lambda x: x["vmaf"] < limit), F.lit(0))["cq"]

    lo = F.greatest(a["cq"] - 1, F.get(p, F.lit(0))["cq"])
    hi = F.coalesce(first_below(float(threshold) - SOFT_MARGIN), first_below(float(threshold)), F.try_element_at(p, F.lit(-1))["cq"])
    return df.withColumns({"band_lo": F.least(lo, hi), "band_hi": F.greatest(lo, hi)}).drop("_right")


def linspace_cqs(crf_min, crf_max, count: Column) -> Column:
    """`count` evenly spaced integer CQs (all of them when the range is shorter)."""
    lo, hi = F.lit(int(crf_min)), F.lit(int(crf_max))
    gaps = F.greatest(count - 1, F.lit(1))
    many = F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(0), gaps), lambda i: half_even(lo + (hi - lo) * i / gaps))))
    return F.when(count == 1, F.array(half_even((lo + hi) / 2.0))).otherwise(many)


def next_probes(df: DataFrame, count: int, crf_min: int, crf_max: int, threshold: float, keys=SEGMENT,
                used: str = "used") -> DataFrame:
    """Up to `count` unused CQs per curve by biased predicted score, in cq order.

    The candidate set per curve is the CQ range, so the ranking window is bounded.
    """
    thr = float(threshold)
    full = with_crossing(with_anchor(df.filter(F.size("pts") > 0), thr), thr)
    full = full.withColumns({"_cv": half_even(F.col("cq_star")), "_lo": F.greatest(F.lit(crf_min), "band_lo"),
                             "_hi": F.least(F.lit(crf_max), "band_hi")})
    c, a, a_sf = F.col("candidate"), F.col("anchor.cq"), F.col("anchor.s_f")
    free = F.array_except(F.sequence(F.lit(crf_min), F.lit(crf_max)), F.col(used))
    x = predict_at(full.withColumn("candidate", F.explode(free)), "candidate", thr)
    pred = F.col("predicted_s_f")
    beyond = F.array_max(F.transform(F.filter("pts", lambda p: p["cq"] >= c), lambda p: p["vmaf"]))
    near = F.coalesce(F.abs(c - F.col("_cv")) <= 1, F.lit(False))
    in_band = (c >= F.col("_lo")) & (c <= F.col("_hi"))
    plus = (c == a + 1) & (pred >= 0.5 * F.greatest(a_sf, F.lit(1e-9)))
    over = c < a - 1
    fail = F.coalesce(beyond < thr - SOFT_MARGIN, F.lit(False)) & (c > a + 1)
    rules = [(in_band, F.lit(0.02), "sweet_band"), (near, F.lit(0.015), "near_cq_vmaf*"), (plus, F.lit(0.02), "best+1"),
             (over, -0.10 * (a - c), "overshoot_penalty"), (fail, F.lit(-0.25), "known_fail_region")]
    score = pred
    for cond, w, _ in rules:
        score = score + F.when(cond, w).otherwise(0.0)
    reason = F.concat_ws("+", F.lit("pred_s_f"), *[F.when(cond, tag) for cond, _, tag in rules])
    floor_pred = F.when(a_sf > 0, a_sf * 0.95).otherwise(0.0)
    keep = pred.isNotNull() & (c >= a - 1) & ((pred >= floor_pred) | (c == a + 1) | F.coalesce(c == F.col("_cv"), F.lit(False)))
    tag = (F.when(c == a - 1, F.struct(F.lit(0).alias("o"), F.lit("fallback_best-1").alias("t")))
           .when(c == a + 1, F.struct(F.lit(1).alias("o"), F.lit("fallback_best+1").alias("t")))
           .when(c == F.col("_cv"), F.struct(F.lit(2).alias("o"), F.lit("fallback_cq_vmaf*").alias("t"))))
    x = x.withColumns({"_score": score, "_keep": keep, "_tag": tag, "_why": reason})
    by = W.partitionBy(*keys)
    x = x.withColumn("_any", F.max("_keep").over(by)).filter(F.col("_keep") | (~F.col("_any") & F.col("_tag").isNotNull()))
    rank = F.row_number().over(by.orderBy(F.when(~F.col("_any"), F.col("_tag.o")).asc_nulls_first(),
                                          F.col("_score").desc(), pred.desc(), c.asc()))
    picked = x.withColumn("_rank", rank).filter(F.col("_rank") <= count).select(
        *keys, c.alias("cq"), F.coalesce(pred, F.lit(0.0)).alias("predicted_s_f"),
        F.when(F.col("_any"), F.col("_why")).otherwise(F.col("_tag.t")).alias("probe_reason"))
    bare = df.filter(F.size("pts") == 0)
    spread = F.slice(F.array_except(linspace_cqs(crf_min, crf_max, F.size(used) + count), F.col(used)), 1, count)
    blind = bare.select(*keys, F.explode(spread).alias("cq"), F.lit(0.0).alias("predicted_s_f"),
                        F.lit("fallback_linspace").alias("probe_reason"))
    return picked.unionByName(blind)


def handoff(df: DataFrame, count: int, crf_min: int, crf_max: int, threshold: float, keys=SEGMENT) -> DataFrame:
    """The measured anchor first, then interpolated proposals (only the anchor counts as used)."""
    x = with_anchor(df.filter(F.size("pts") > 0), threshold)
    first = x.select(*keys, F.col("anchor.cq").alias("cq"), F.lit("measured_best").alias("reason"),
                     F.col("anchor.s_f").alias("predicted_s_f"), F.lit(0).alias("rank"))
    rest = next_probes(x.withColumn("_u", F.array("anchor.cq")).select(*keys, "pts", "_u"), count - 1, crf_min, crf_max, threshold, keys, "_u")
    more = rest.select(*keys, "cq", F.concat(F.lit("interp_"), "probe_reason").alias("reason"), "predicted_s_f",
                       F.row_number().over(W.partitionBy(*keys).orderBy("cq")).alias("rank"))
    return first.unionByName(more)


def map_offset(hand: DataFrame, offset: int, crf_min: int, crf_max: int, keys=SEGMENT) -> DataFrame:
    """Hand-off CQs shifted by a fixed offset, clamped, first of each CRF kept."""
    lo, hi = min(crf_min, crf_max), max(crf_min, crf_max)
    x = hand.withColumn("crf", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("cq") + F.lit(offset))))
    return top_one(x, [*keys, "crf"], F.col("rank").asc())


def range_map(value: Column, src: tuple[int, int], dst: tuple[int, int]) -> Column:
    frac = (value - src[0]) / max(1e-9, float(src[1] - src[0]))
    return half_even(F.lit(float(dst[0])) + F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0)) * float(dst[1] - dst[0]))


def vmaf_anchored_crfs(df: DataFrame, count: int, cq_range: tuple[int, int], crf_range: tuple[int, int],
                       threshold: float, spread: int = 2, keys=SEGMENT) -> DataFrame:
    """CRFs that match quality targets of the measured curve, one row each.

    Targets: the anchor's quality, one step down and near the gate. Each target's
    CQ is mapped by its relative place from the CQ range to the CRF range; the
    band around the first one fills up what is missing.
    """
    thr = float(threshold)
    spread = max(1, int(spread))
    lo_r, hi_r = sorted(crf_range)
    src, dst = tuple(sorted(cq_range)), (lo_r, hi_r)
    x = df.withColumn("pts", seen(F.col("pts"))).filter(F.size("pts") > 0)
    x = with_anchor(x, thr)
    v, a = F.col("anchor.vmaf"), F.col("anchor.cq")
    mid = F.greatest(F.lit(thr + 1.0), v - 2.0)
    t_mid = F.when((v - thr > 2.0) & (F.abs(mid - v) >= 0.75), mid)
    t_gate = F.when(F.lit(thr + 2.0) < v - 0.5, F.lit(thr + 2.0))
    tags = [(v, F.concat(F.lit("match CQ"), a.cast("string"), F.lit(" V="), fixed_text(v, 1))),
            (t_mid, F.concat(F.lit("push_compression V="), fixed_text(mid, 1))),
            (t_gate, F.concat(F.lit("near_gate V="), F.lit(f"{thr + 2.0:.1f}")))]

    def clamp(c):
        return F.least(F.greatest(c, F.lit(lo_r)), F.lit(hi_r))

    x = x.withColumns({f"_q{i}": F.when(t.isNotNull(), crossing(F.col("pts"), t)) for i, (t, _) in enumerate(tags)})
    at = [F.when(t.isNotNull(), F.struct(clamp(range_map(F.col(f"_q{i}"), src, dst)).alias("crf"), F.concat(F.lit("vmaf_anchor "), tag).alias("reason"), t.alias("target_vmaf")))
          for i, (t, tag) in enumerate(tags)]
    x = x.withColumn("_at", F.array_compact(F.array(*at)))
    first = F.get("_at", F.lit(0))["crf"]
    offsets = [((i // 2) + 1) * spread * (1 if i % 2 == 0 else -1) for i in range(count * 2)]
    around = F.array(*[F.struct(clamp(first + o).alias("crf"), F.concat(F.lit("band_around CRF"), first.cast("string"), F.lit(f"{o:+d}")).alias("reason"),
                                v.alias("target_vmaf")) for o in offsets])
    x = x.withColumn("_all", F.concat("_at", around))
    x = x.withColumn("_crfs", F.transform("_all", lambda s: s["crf"]))
    own = F.filter("_all", lambda s, i: F.array_position(F.col("_crfs"), s["crf"]) == i + 1)
    return x.select(*keys, F.explode(F.slice(own, 1, count)).alias("s")).select(*keys, "s.*")


def rule_anchored_crf(df: DataFrame, candidates: str, mashup: str, crf_min: int, crf_max: int, threshold: float,
                      max_nudge: int = 1, margin: float = 2.0, push_ceiling: float = 0.55) -> DataFrame:
    """Confirm or nudge a probed CRF: all probes pass, all fail, or they bracket the gate.

    `candidates` is the probe plan (array); the answer stays within it, give or take
    `max_nudge`. Hard mashups (at or above `push_ceiling`) are never pushed up. The observations need
    `threshold` among their gates where a CQ was tried more than once.
    """
    thr, aim, k = float(threshold), float(threshold) + float(margin), max(0, int(max_nudge))
    x = df.withColumn("_p", seen(F.col("pts")))
    x = x.withColumns({"_pass": F.filter("_p", lambda o: o["vmaf"] >= thr), "_fail": F.filter("_p", lambda o: o["vmaf"] < thr),
                       "_star": crossing(F.col("_p"), F.lit(thr))})

    def best(arr, *fields):
        return F.array_max(F.transform(arr, lambda o: F.struct(*[_ranked(o, f).alias(f) for f in fields], o.alias("o"))))["o"]

    x = x.withColumns({"_best": best(F.col("_pass"), "s_f", "cq"), "_top": best(F.col("_pass"), "cq", "s_f"),
                       "_low": F.get("_p", F.lit(0)), "_end": F.try_element_at("_p", F.lit(-1))["cq"],
                       "_min": F.array_min(F.transform("_pass", lambda o: o["vmaf"]))})
    x = x.withColumn("_high", F.get(F.filter("_p", lambda o: o["cq"] == F.col("_end")), F.lit(0)))
    lo = F.greatest(F.lit(crf_min), F.array_min(candidates) - k)
    hi = F.least(F.lit(crf_max), F.array_max(candidates) + k)

    def clamp(c):
        return F.least(F.greatest(c, lo), hi)

    push = F.col(mashup) < push_ceiling
    n, np_, nf = F.size("_p"), F.size("_pass"), F.size("_fail")
    low, high, best_, top = (F.col(c) for c in ("_low", "_high", "_best", "_top"))
    room = F.col("_min") - aim
    plan_cq = F.least(F.greatest(half_even(F.col("_star")), F.array_min(candidates)), F.array_max(candidates))
    on_curve = F.get(F.filter("_pass", lambda o: o["cq"] == plan_cq), F.lit(0))
    pick = F.when(on_curve.isNotNull() & (_ranked(on_curve, "s_f") >= _ranked(best_, "s_f")), on_curve).otherwise(best_)
    lean = push & (low["vmaf"] >= thr) & (high["vmaf"] < thr) & (low["vmaf"] >= aim - 0.5) & (high["vmaf"] >= thr - 1.0)
    up = F.least(F.lit(crf_max), low["cq"] + k)
    cases = [
        (n == 0, F.lit(None).cast("int"), "no_observations"),
        ((n == 1) & (np_ == 1) & push & (low["vmaf"] >= aim + 1.0) & F.lit(k > 0), clamp(up), f"single_pass_margin+{k}"),
        ((n == 1) & (np_ == 1) & push & (low["vmaf"] >= aim) & (clamp(up) > low["cq"]), clamp(up), "single_pass_nudge"),
        ((n == 1) & (np_ == 1), clamp(F.least(F.lit(crf_max), low["cq"])), "single_pass_keep"),
        (n == 1, clamp(F.greatest(F.lit(crf_min), low["cq"] - k)), f"single_fail_nudge-{k}"),
        ((nf == 0) & push & (room >= 1.0) & F.lit(k > 0), clamp(F.least(F.lit(crf_max), top["cq"] + k)), f"all_pass_margin+{k}"),
        ((nf == 0) & push & (room >= 0), clamp(top["cq"]), "all_pass_high_crf"),
        (nf == 0, clamp(best_["cq"]), "all_pass_best_s_f"),
        (np_ == 0, clamp(F.greatest(F.lit(crf_min), low["cq"] - k)), f"all_fail_nudge-{k}"),
        (lean, clamp(high["cq"]), "bracket_lean_up")]
    crf, why = None, None
    for cond, value, name in cases:
        crf = F.when(cond, value) if crf is None else crf.when(cond, value)
        why = F.when(cond, name) if why is None else why.when(cond, name)
    return x.withColumns({"crf": crf.otherwise(clamp(pick["cq"])), "crf_reason": why.otherwise("bracket")}).drop(
        "_p", "_pass", "_fail", "_star", "_best", "_top", "_low", "_high", "_end", "_min")
