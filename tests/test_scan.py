"""Chunked scans against plain windows, with one group holding most rows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from trialspark.operators import scan as S


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    data = []
    for i in range(1500):
        k = 0 if r.random() < 0.6 else r.randint(1, 9)
        data.append((k, i if r.random() < 0.7 else i + 4000, i, r.choice([None, r.randint(0, 50)]), float(r.randint(0, 20)) / 4))
    return spark.createDataFrame(data, "k int, pos int, id int, v int, x double").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("width", [1, 37, 100000])
def test_running_ops(rows, width):
    chunk = F.floor(F.col("pos") / width).cast("bigint")
    got = S.ordered_scan(rows, ["k"], ["pos", "id"], chunk, s=S.running_sum(F.col("id")), m=S.running_max(F.col("v")),
                         l=S.last_value(F.col("v")), n=S.next_value(F.col("v")), p=S.previous(F.col("v")), b=S.max_before(F.col("v")), g=S.group_sum(F.lit(1)))
    w = W.partitionBy("k").orderBy("pos", "id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    want = rows.select("*", F.sum("id").over(run).alias("s"), F.max("v").over(run).alias("m"), F.last("v", True).over(run).alias("l"),
                       F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("n"), F.lag("v").over(w).alias("p"),
                       F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("b"),
                       F.count("*").over(W.partitionBy("k")).alias("g"))
    same(got, want.select(got.columns))


def test_reverse_previous_is_next_row(rows):
    got = S.ordered_scan(rows, ["k"], ["pos", "id"], F.floor(F.col("pos") / 50).cast("bigint"), reverse=True, p=S.previous(F.col("id")))
    want = rows.select("*", F.lead("id").over(W.partitionBy("k").orderBy("pos", "id")).alias("p"))
    same(got, want)


def test_no_keys(rows):
    got = S.number_rows(rows, [], ["id"], F.floor(F.col("id") / 100).cast("bigint"))
    assert got.filter("rn <> id + 1").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(rows, keys):
    got = S.exact_quantiles(rows, keys, "x", {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q100": 1.0}, 0.5)
    want = rows.groupBy(*keys).agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in (("q0", 0.0), ("q50", 0.5), ("q90", 0.9), ("q100", 1.0))])
    a, b = ([tuple(round(v, 9) for v in r) for r in sorted(d.collect())] for d in (got, want.select(got.columns)))
    assert a == b


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "k int, x double")
    assert [tuple(r) for r in S.exact_quantiles(df, ["k"], "x", {"q": 0.9}, 1.0).collect()] == [(1, 2.5)]


@pytest.mark.parametrize("longest", [150, 40, 3000])
def test_range_join_matches_brute_force(spark, longest):
    r = random.Random(longest)
    pts = [(r.choice([0, 1, 2, None]), r.randint(-2 * longest, 2 * longest), i) for i in range(300)] + [(0, None, -1)]
    rng = [(r.choice([0, 2, 3, None]), s, s + r.randint(-5, longest), i) for i, s in enumerate(r.choices(range(-2 * longest, 2 * longest), k=40))]
    rng += [(1, 5, 9, 90), (1, 5, 9, 91), (1, None, 9, 92)]
    got = S.range_join(spark.createDataFrame(pts, "k int, f int, _size int"), spark.createDataFrame(rng, "k int, a int, b int, _piece int"), ["k"], "f", "a", "b", 16)
    want = [(ri, pi) for k, a, b, ri in rng for k2, f, pi in pts if k is not None and k == k2 and f is not None and a is not None and a <= f < b]
    assert sorted((x._piece, x._size) for x in got.collect()) == sorted(want) and got.columns == ["k", "a", "b", "_piece", "f", "_size"]


def test_long_range_has_few_pieces(spark):
    ends = [(3, 10_000_003), (-5_000_001, 5_000_000), (0, 64 << 20), (63, 64 << 20), (10, 60)]
    cover = S._pieces(spark.createDataFrame(ends, "a bigint, b bigint"), "a", "b", 64).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, __size)")).alias("buckets")).collect()
    found = {(r.a, r.b): r for r in cover}
    assert all(r.n < 50 for r in cover) and found[(0, 64 << 20)].n == 1 and found[(10, 60)].n == 1
    assert all(found[a, b].buckets == -(-b // 64) - a // 64 for a, b in ends)  # disjoint and without a gap


def test_points_of_short_ranges_are_not_copied(spark):
    pts = spark.createDataFrame([(1, 5), (2, 500)], "k int, f int")
    plan = lambda b: S.range_join(pts, spark.createDataFrame([(1, 0, b)], "k int, a int, b int"), ["k"], "f", "a", "b", 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(50).count("Generate explode") == 1 and plan(5000).count("Generate explode") == 2


def test_asof_and_nearest_match_brute_force(spark):
    r = random.Random(5)
    right = [(k, p, f"{k}-{p}") for k in (0, 1) for p in r.sample(range(500), 25)]
    left = [(r.choice([0, 0, 1, 2]), r.randint(0, 520), i) for i in range(120)]
    ld = spark.createDataFrame(left, "k int, at int, id int")
    rd = spark.createDataFrame(right, "k int, p int, name string")
    got = {x.id: (x.h and x.h.name) for x in S.asof(ld, rd, ["k"], "at", "p", ["name"], "h", 30).collect()}
    near = {x.id: (x.h and x.h.name) for x in S.nearest(ld, rd, ["k"], "at", "p", ["name"], "h", 30).collect()}
    for k, at, i in left:
        own = sorted((p, n) for k2, p, n in right if k2 == k)
        before = [n for p, n in own if p <= at]
        assert got[i] == (before[-1] if before else None)
        assert near[i] == (min(own, key=lambda o: (abs(o[0] - at), o[0]))[1] if own else None)


def test_top_one_limits_before_the_shuffle(rows):
    plan = S.top_one(rows, ["k"], F.col("x").desc(), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_keys_are_one_group_and_long_groups_carry(spark, monkeypatch):
    from trialspark.operators import scan
    monkeypatch.setattr(scan, "CHUNKS_PER_GROUP", 3)
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, "k").alias("g"), F.col("id").alias("at"), F.when(F.col("id") % 7 < 2, F.col("id")).alias("v"))
    out = scan.ordered_scan(df, ["g"], ["at"], F.floor(F.col("at") / 5).cast("bigint"), s=scan.running_sum(F.lit(1)), n=scan.next_value(F.col("v")),
                            p=scan.previous(F.col("v")), m=scan.max_before(F.col("v")), x=scan.last_value(F.col("v")), t=scan.group_sum(F.lit(1)))
    rows = sorted(out.collect(), key=lambda r: r.at)
    for parity in (0, 1):
        own = [r for r in rows if r.at % 2 == parity]
        for i, r in enumerate(own):
            before, after = [o.v for o in own[:i] if o.v is not None], [o.v for o in own[i:] if o.v is not None]
            upto = [o.v for o in own[: i + 1] if o.v is not None]
            assert (r.s, r.t) == (i + 1, 100) and r.p == (own[i - 1].v if i else None)
            assert r.n == (after[0] if after else None) and r.m == (max(before) if before else None) and r.x == (upto[-1] if upto else None)


def test_no_forward_frames(spark):
    from trialspark.operators import scan
    df = spark.range(10).selectExpr("1 AS g", "id AS at", "id AS v")
    plan = scan.ordered_scan(df, ["g"], ["at"], F.floor(F.col("at") / 5).cast("bigint"), n=scan.next_value(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")


@pytest.mark.parametrize("buffered", [10, 1 << 16])
def test_quantiles_between_sketch_bounds(spark, buffered):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=20_000), "b": np.repeat([1.0, 2.0, 2.5], [4000, 1, 3999]), None: rng.exponential(size=3000) * 1e6, "few": np.array([3.0, 1.0])}
    rows = [(k, float(x), "m") for k, v in groups.items() for x in v] + [("a", float("nan"), "m"), ("a", None, "m")]
    df = spark.createDataFrame(rows, "k string, x double, name string").repartition(5)
    qs = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.k: r for r in S.moments_and_quantiles(df, ["k"], "x", qs, buffered=buffered).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v) and got[k].std == pytest.approx(v.std(), rel=1e-9)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, name)
    whole = S.exact_quantiles(df, [], "x", qs, buffered=buffered).collect()
    assert len(whole) == 1 and whole[0].q50 == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_variance_of_large_values(spark):
    df = spark.createDataFrame([(1, 1e9), (1, 1e9 + 1)], "k int, x double")
    assert S.moments_and_quantiles(df, ["k"], "x", {"q": 0.5}).first().variance == pytest.approx(0.25)


def test_exact_sums_do_not_depend_on_order(spark):
    df = spark.range(10_000).selectExpr("id % 3 as k", "cast(id * 0.1 as double) + 1e7 as x")
    sums = {tuple(map(tuple, df.repartition(n).groupBy("k").agg(S.exact_sum(S.F.col("x")).alias("s")).orderBy("k").collect())) for n in (1, 8, 211)}
    assert len(sums) == 1


def test_bitmap_filter_loses_no_match(spark):
    wide = spark.range(60_000).select((F.col("id") % 50_000).cast("int").alias("a"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("b"))
    narrow = wide.filter("a % 97 = 5").withColumn("more", F.lit(1))
    got = S.bitmap_semi(wide, narrow, ["a", "b"])
    want = wide.filter("a % 97 = 5")
    assert got.columns == ["a", "b"] and want.exceptAll(got).isEmpty() and got.count() < want.count() + 0.2 * wide.count()
    assert S.bitmap_semi(wide, narrow.withColumn("a", F.col("a").cast("long")).drop("b").withColumn("b", F.lit(1)), ["a", "b"]).count() == 60_000
    assert S.bitmap_semi(wide, narrow.limit(0), ["a", "b"]).count() == 0


def test_long_log_is_thinned_before_its_shuffle(spark, tmp_path):
    from trialspark.operators.trials import not_logged

    spark.range(5000).selectExpr("id AS a", "cast(id % 3 AS string) AS b").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    cached = spark.createDataFrame([(4998, "0"), (4999, "0"), (6000, None)], "a long, b string")
    out = not_logged(cached, log, ["a", "b"])
    assert sorted(r.a for r in out.collect()) == [4999, 6000]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [a") < plan.index("getbit") or plan.index("Aggregate [a") < plan.index("bit_get")
