"""Known answers of the score and the compression measure."""

import math

import pytest
from pyspark.sql import functions as F

from trialspark.functions import score as S, text as X, numbers as N


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("vmaf, rate, want", [
    (95.0, 0.85, 0.0), (79.9, 0.2, 0.0), (85.0, 1 / 20, (0.7 * 1.0 + 0.3 * 0.7) / 1.12), (100.0, 1 / 20, 1.0 / 1.12),
    (82.5, 1 / 20, 0.7 * 0.25 / 1.12), (90.0, 1 / 40, (0.7 * (1 + 0.1 * math.log(2)) + 0.3 * 0.8) / 1.12)])
def test_score(spark, vmaf, rate, want):
    assert one(spark, S.predicted_score(lit(vmaf), lit(rate), 85.0)) == pytest.approx(want, abs=1e-12)


def test_score_bits(spark):
    """Rounding decides between equal scores, so the score has the bits of the C library."""
    def want(vmaf, rate):
        q = 1.0 / rate
        if vmaf < 85:
            return min(1.0, math.pow((q - 1.0) / 19.0, 1.5) * (0.7 * math.pow((vmaf - 80.0) / 5.0, 2.0)) / 1.12)
        return min(1.0, (0.7 * math.pow((q - 1.25) / 18.75, 0.9) + 0.3 * (0.7 + 0.3 * min(1.0, (vmaf - 85.0) / 15.0))) / 1.12)

    sizes = [(float(p), float(p) * (0.02 + d / 100 * 9.0)) for p in range(1001, 1100) for d in range(1, 9)]
    rows = [(vmaf, out / size) for size, out in sizes for vmaf in (80.94, 84.72, 85.56, 88.92, 96.48)]
    df = spark.createDataFrame(rows, "vmaf double, rate double")
    got = df.select("vmaf", "rate", S.predicted_score(F.col("vmaf"), F.col("rate"), 85.0).alias("s")).collect()
    assert [r.s for r in got] == [want(r.vmaf, r.rate) for r in got]
    assert one(spark, S.predicted_score(lit(85.0), F.lit(None).cast("double"), 85.0)) is None


def test_score_bits_of_small_rates_and_soft_qualities(spark):
    """F3 to F13: logarithms (ratios above 20) and squares (soft zone) have the bits of the C library too."""
    def want(vmaf, rate):
        q = 1.0 / rate
        log = math.log(q / 20.0)
        if vmaf < 85:
            return min(1.0, (1.0 + 0.3 * log) * (0.7 * math.pow((vmaf - 80.0) / 5.0, 2.0)) / 1.12)
        return min(1.0, (0.7 * (1.0 + 0.1 * log) + 0.3 * (0.7 + 0.3 * min(1.0, (vmaf - 85.0) / 15.0))) / 1.12)

    rows = [(80.0 + (i * 7919 % 20000) / 1000.0, 1.0 / (20.0 + (i + 1) / 400.0)) for i in range(40000)]
    df = spark.createDataFrame(rows, "vmaf double, rate double")
    got = df.select("vmaf", "rate", S.predicted_score(F.col("vmaf"), F.col("rate"), 85.0).alias("s")).collect()
    assert sum(r.s != want(r.vmaf, r.rate) for r in got) == 0


def test_score_reasons(spark):
    r = [one(spark, S.score_struct(lit(v), lit(x), 85.0)["reason"]) for v, x in ((90, 0.9), (70, 0.5), (82, 0.5), (90, 0.5), (90, 0.0))]
    assert r == ["No meaningful compression (ratio: 1.11x, rate: 0.90)", "VMAF 70.00 below hard cutoff (80.00)", "VMAF 82.00 in soft zone", "success", "invalid_rate"]
    assert one(spark, S.predicted_score(lit(90), lit(0.0), 85.0)) is None
    assert one(spark, S.predicted_score(lit(None), lit(0.5), 85.0)) is None


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        S.score_struct(lit(90), lit(0.5), 85.0, 0.9, 0.9)


def test_model_delta_zeroes_the_score(spark):
    df = spark.createDataFrame([(90.0, 94.0, 0.2), (90.0, 92.0, 0.2)], "vmaf_neg double, vmaf_base double, compression_rate double")
    a, b = S.with_score(df, 85.0, base="vmaf_base").orderBy(F.col("vmaf_base").desc()).collect()
    assert a.s_f == 0.0 and a.reason.startswith("VMAF model delta 4.00") and b.s_f > 0.3


def test_measure(spark):
    got = [tuple(r) for r in spark.createDataFrame([(1000, 250), (1000, 1000), (0, 5), (10, 0)], "i int, o int")
           .select(S.compression_rate(F.col("i"), F.col("o")), S.compression_ratio(F.col("i"), F.col("o"))).collect()]
    assert got == [(0.25, 4.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]


def test_text_numbers(spark):
    assert [one(spark, N.fixed_text(lit(x), 2)) for x in (1.0, -0.5, 12.345678, 0.004)] == ["1.00", "-0.50", "12.35", "0.00"]
    assert [one(spark, N.short_text(lit(x))) for x in (1.0, 1.15, 0.8, 10.0)] == ["1", "1.15", "0.8", "10"]
    assert [one(spark, N.half_even(lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]


def test_options(spark):
    m = one(spark, X.merge_options(F.lit("aq-mode=3:rd=5:ref=4"), F.lit("rd=6:ref=5")))
    assert m == "aq-mode=3:rd=6:ref=5"
    assert one(spark, X.merge_options(F.lit("a=1"), F.lit(" "))) == "a=1"
    assert one(spark, X.merge_options(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, X.entries_to_map(X.kv_entries(F.lit("x; a=1;a = 2 ;b=c=d")))) == {"a": "2", "b": "c=d"}


def test_urls(spark):
    assert one(spark, X.url_video_id(F.lit("https://h/a/b%20c+d.mp4?x=1#y"))) == "b c+d"
    assert one(spark, X.url_video_id(F.lit("https://h/a/"))) == "https://h/a/"
    assert one(spark, X.url_video_id(F.lit("https://h/a/50%.mp4"))) == "50%"


def test_sanitise(spark):
    assert one(spark, X.sanitize_cell(F.lit("  a\n  b\t"))) == "a b"
    long = one(spark, X.sanitize_cell(F.lit("x" * 300)))
    assert len(long) == 240 and long.endswith("...")
