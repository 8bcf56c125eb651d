"""Compression measure and trial score as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialspark.functions.numbers import fixed_text

# Fixed values of the score.
WEIGHT_COMPRESSION = 0.70
WEIGHT_QUALITY = 0.30
SOFT_MARGIN = 5.0
NORM = 1.12
MAX_RATE = 0.80
MAX_MODEL_DELTA = 3.0


def compression_rate(size_in: Column, size_out: Column) -> Column:
    """out / in; 1.0 where nothing was saved or a size is missing."""
    usable = (size_in > 0) & (size_out > 0) & (size_out < size_in)
    return F.when(usable, size_out / size_in).otherwise(F.lit(1.0))


def compression_ratio(size_in: Column, size_out: Column) -> Column:
    usable = (size_in > 0) & (size_out > 0) & (size_out < size_in)
    return F.when(usable, F.lit(1.0) / (size_out / size_in)).otherwise(F.lit(1.0))


def libm_curve(x: Column, exponent: Column) -> Column:
    """x ** exponent, or the natural logarithm of x where the exponent is missing, in the last bit of the C library, which SQL
    engines and Python use; null for a missing or negative x.

    Scores that agree but for rounding are ordered by it, and Spark's own `pow` and `ln` round some values otherwise.
    """
    def curve(xs: pa.Array, exponents: pa.Array) -> pa.Array:
        # missing numbers come as NaN
        pairs = zip(xs.to_numpy(zero_copy_only=False).tolist(), exponents.to_numpy(zero_copy_only=False).tolist())
        return pa.array([(math.pow(a, b) if b == b else math.log(a) if a > 0 else None) if a >= 0 else None for a, b in pairs], pa.float64())

    return F.arrow_udf(curve, T.DoubleType())(x, exponent)


def score_struct(vmaf: Column, rate: Column, threshold: Column | float,
                 w_comp: float = WEIGHT_COMPRESSION, w_qual: float = WEIGHT_QUALITY,
                 margin: float = SOFT_MARGIN) -> Column:
    """struct(s_f, compression_component, quality_component, reason)."""
    if abs(w_comp + w_qual - 1.0) > 0.01:
        raise ValueError("weights must sum to 1")
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cut = thr - F.lit(float(margin))
    ratio = F.try_divide(F.lit(1.0), rate)
    weak = rate >= F.lit(MAX_RATE)
    below = vmaf < cut
    bad = rate <= 0
    soft = vmaf < thr

    live = ~(weak | below | bad)
    soft_q = F.lit(0.7) * libm_curve(F.when(live & soft, (vmaf - cut) / F.lit(float(margin))), F.lit(2.0))
    # one call for all four curves
    small = ratio <= 20
    curve = libm_curve(
        F.when(live, F.when(~small, ratio / 20.0).when(soft, (ratio - 1.0) / 19.0).otherwise((ratio - 1.25) / 18.75)),
        F.when(small, F.when(soft, 1.5).otherwise(0.9)))
    soft_c = F.when(small, curve).otherwise(F.lit(1.0) + F.lit(0.3) * curve)
    pass_q = F.lit(0.7) + F.lit(0.3) * F.least(
        F.lit(1.0), (vmaf - thr) / F.greatest(F.lit(1e-6), F.lit(100.0) - thr))
    pass_c = F.when(small, curve).otherwise(F.lit(1.0) + F.lit(0.1) * curve)

    zero, none = F.lit(0.0), F.lit(None).cast("double")

    def pick(for_soft, for_pass):
        return (F.when(vmaf.isNull() | rate.isNull(), none).when(weak | below, zero)
                .when(bad, none).when(soft, for_soft).otherwise(for_pass))

    s_f = pick(F.least(F.lit(1.0), soft_c * soft_q / NORM),
               F.least(F.lit(1.0), (F.lit(w_comp) * pass_c + F.lit(w_qual) * pass_q) / NORM))
    comp = pick(soft_c, pass_c)
    qual = pick(soft_q, pass_q)
    reason = (F.when(vmaf.isNull() | rate.isNull(), None)
              .when(weak, F.concat(F.lit("No meaningful compression (ratio: "), fixed_text(ratio, 2),
                                   F.lit("x, rate: "), fixed_text(rate, 2), F.lit(")")))
              .when(below, F.concat(F.lit("VMAF "), fixed_text(vmaf, 2), F.lit(" below hard cutoff ("),
                                    fixed_text(cut, 2), F.lit(")")))
              .when(bad, F.lit("invalid_rate"))
              .when(soft, F.concat(F.lit("VMAF "), fixed_text(vmaf, 2), F.lit(" in soft zone")))
              .otherwise(F.lit("success")))
    return F.struct(s_f.alias("s_f"), comp.alias("compression_component"),
                    qual.alias("quality_component"), reason.alias("reason"))


def predicted_score(vmaf: Column, rate: Column, threshold) -> Column:
    return score_struct(vmaf, rate, threshold)["s_f"]


def with_compression(df: DataFrame, size_in: str = "size_in", size_out: str = "size_out") -> DataFrame:
    i, o = F.col(size_in), F.col(size_out)
    return df.withColumns({"compression_rate": compression_rate(i, o),
                           "compression_ratio": compression_ratio(i, o)})


def with_score(df: DataFrame, threshold: Column | float = 85.0, vmaf: str = "vmaf_neg",
               rate: str = "compression_rate", base: str | None = None) -> DataFrame:
    """Add s_f, both components and the reason. With a `base` quality column, rows
    whose two quality models differ by more than 3 points score zero."""
    sc = score_struct(F.col(vmaf), F.col(rate), threshold)
    out = df.withColumn("_sc", sc).select("*", "_sc.*").drop("_sc")
    if base is None:
        return out
    delta = F.abs(F.col(base) - F.col(vmaf))
    off = F.coalesce(delta > MAX_MODEL_DELTA, F.lit(False))
    text = F.concat(F.lit("VMAF model delta "), fixed_text(delta, 2),
                    F.lit(" > 3.00 (enhancement/sharpening detected)"))
    return out.withColumns({
        "s_f": F.when(off, 0.0).otherwise(F.col("s_f")),
        "compression_component": F.when(off, 0.0).otherwise(F.col("compression_component")),
        "quality_component": F.when(off, 0.0).otherwise(F.col("quality_component")),
        "reason": F.when(off, text).otherwise(F.col("reason")),
        "vmaf_delta": delta})
