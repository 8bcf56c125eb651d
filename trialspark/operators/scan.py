"""Running (prefix) calculations over long ordered groups.

A plain window puts one whole group into one task. Here every group is cut into
chunks by a monotone function of its leading order column: the window runs
inside (group, chunk), one summary row per chunk is carried forward over the
group, and the carry is joined back on (group, chunk). A group that holds a
third of all rows is thus spread over as many tasks as it has chunks, and the
only per-group step sees one row per 4096 chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialspark.session import materialize

CHUNK = "_chunk"
LINES_PER_CHUNK = 65536
_WIDE = "_wide"
CHUNKS_PER_GROUP = 4096


def running_sum(x: Column):
    return ("sum", x)


def running_max(x: Column):
    return ("max", x)


def max_before(x: Column):
    """Largest value of the rows before (null at the start of the group)."""
    return ("pmax", x)


def last_value(x: Column):
    """Latest non-null value up to and including the row."""
    return ("last", x)


def next_value(x: Column):
    """First non-null value from the row on towards the end of the group."""
    return ("next", x)


def previous(x: Column):
    """Value of the row before (null at the start of the group)."""
    return ("lag", x)


def group_sum(x: Column):
    """Sum over the whole group, on every row."""
    return ("gsum", x)


def group_min(x: Column):
    return ("gmin", x)


def group_max(x: Column):
    return ("gmax", x)


_GROUP = {"gsum": F.sum, "gmin": F.min, "gmax": F.max}


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None,
                 *, reverse: bool = False, **ops) -> DataFrame:
    """Add one column per op, computed over `keys` in `order`.

    `chunk` must not decrease along the order (with `reverse` the walk goes from
    the end and `previous` becomes "next"). Without a chunk the group size must
    have a known bound, and a plain window is used. Rows with a null key form a group.
    """
    keys = list(keys)
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    # nulls come first in ascending order and last in descending order: the exact reverse
    backward = [F.col(c).asc() if reverse else F.col(c).desc() for c in order]
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(*ordering)
        run = w.rowsBetween(W.unboundedPreceding, 0)
        back = W.partitionBy(*keys).orderBy(*backward).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: _local(op, w, run, back) for name, op in ops.items()})

    base = df.withColumn(CHUNK, chunk)
    parts = keys + [CHUNK]
    w = W.partitionBy(*parts).orderBy(*ordering)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*parts).orderBy(*backward).rowsBetween(W.unboundedPreceding, 0)
    cols = {f"_l_{name}": _local(op, w, run, back) for name, op in ops.items() if op[0] not in _GROUP}
    if any(op[0] == "lag" for op in ops.values()):
        cols["_first"] = F.row_number().over(w) == 1
    local = base.withColumns(cols)

    # One row per chunk, straight from the input: partial aggregation keeps the
    # rows where they are, only chunk totals are shuffled.
    pick = F.min if reverse else F.max
    at = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    aggs = []
    for name, (kind, x) in ops.items():
        if kind in _GROUP or kind in ("sum", "max", "pmax"):
            agg = (F.sum if kind in ("sum", "gsum") else F.min if kind == "gmin" else F.max)(x)
        else:
            tip = F.struct(*at, F.struct(x.alias("v")).alias("tip"))
            near = (F.max if reverse else F.min) if kind == "next" else pick
            agg = near(F.when(x.isNotNull(), tip) if kind in ("last", "next") else tip)["tip"]["v"]
        aggs.append(agg.alias(f"_c_{name}"))
    summary = base.groupBy(*parts).agg(*aggs)

    prefix = _carry(summary, keys, ops, reverse)
    # null keys are groups of their own
    prefix = prefix.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(parts)], *[f"_p_{name}" for name in ops])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(parts)])
    joined = local.join(prefix, same, "left")
    out = []
    for name, (kind, _) in ops.items():
        loc, pre = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind in _GROUP:
            out.append(pre.alias(name))
            continue
        out.append({
            "sum": loc + F.coalesce(pre, F.lit(0)),
            "max": F.greatest(loc, pre),
            "pmax": F.greatest(loc, pre),
            "last": F.coalesce(loc, pre),
            "next": F.coalesce(loc, pre),
            "lag": F.when(F.col("_first"), pre).otherwise(loc),
        }[kind].alias(name))
    return joined.select(*[F.col(c) for c in df.columns if c not in ops], *out)


def _carry(summary: DataFrame, keys: list[str], ops: dict, reverse: bool, depth: int = 1) -> DataFrame:
    """What each chunk receives from the chunks before it (after it for "next"), or from the whole group.

    Chunks are grouped like rows: CHUNKS_PER_GROUP neighbouring chunks are scanned together, and their
    totals are carried one level up, so that the last step sees few rows even of a very long group.
    """
    down = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    up = F.col(CHUNK).asc() if reverse else F.col(CHUNK).desc()
    place = [*keys, _WIDE] if depth else keys or [F.lit(0)]
    rows = summary.withColumn(_WIDE, F.floor(F.col(CHUNK) / CHUNKS_PER_GROUP).cast("bigint")) if depth else summary
    by_key = W.partitionBy(*place).orderBy(down)
    before = by_key.rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*place).orderBy(up).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*place)
    cols = {}
    for name, (kind, _) in ops.items():
        c = F.col(f"_c_{name}")
        cols[f"_p_{name}"] = (
            _GROUP[kind](c).over(whole) if kind in _GROUP else F.sum(c).over(before) if kind == "sum"
            else F.max(c).over(before) if kind in ("max", "pmax") else F.last(c, ignorenulls=True).over(before) if kind == "last"
            else F.last(c, ignorenulls=True).over(after) if kind == "next" else F.lag(c, 1).over(by_key))
    if not depth:
        return rows.select(*keys, CHUNK, *[v.alias(k) for k, v in cols.items()])
    cols["_first"] = F.row_number().over(by_key) == 1
    near = rows.select(*keys, CHUNK, _WIDE, *[v.alias(k) for k, v in cols.items()])
    pick = F.min if reverse else F.max
    other = F.max if reverse else F.min
    totals = []
    for name, (kind, _) in ops.items():
        c = F.col(f"_c_{name}")
        tip = F.struct(CHUNK, F.struct(c.alias("v")).alias("tip"))
        agg = (F.sum(c) if kind in ("sum", "gsum") else F.min(c) if kind == "gmin" else F.max(c) if kind in ("max", "pmax", "gmax")
               else (pick if kind == "last" else other)(F.when(c.isNotNull(), tip))["tip"]["v"] if kind in ("last", "next") else pick(tip)["tip"]["v"])
        totals.append(agg.alias(f"_c_{name}"))
    far = _carry(rows.groupBy(*keys, F.col(_WIDE)).agg(*totals).withColumnRenamed(_WIDE, CHUNK), keys, ops, reverse, depth - 1)
    parts = [*keys, CHUNK]
    far = far.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(parts)], *[F.col(f"_p_{name}").alias(f"_f_{name}") for name in ops])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*keys, _WIDE])])
    out = []
    for name, (kind, _) in ops.items():
        p, f = F.col(f"_p_{name}"), F.col(f"_f_{name}")
        both = (f if kind in _GROUP else F.coalesce(p + f, p, f) if kind == "sum" else F.greatest(p, f) if kind in ("max", "pmax")
                else F.when(F.col("_first"), f).otherwise(p) if kind == "lag" else F.coalesce(p, f))
        out.append(both.alias(f"_p_{name}"))
    return near.join(far, same, "left").select(*parts, *out)


def _local(op, w, run, back):
    kind, x = op
    if kind in _GROUP:
        return _GROUP[kind](x).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    if kind == "sum":
        return F.sum(x).over(run)
    if kind == "max":
        return F.max(x).over(run)
    if kind == "pmax":
        return F.max(x).over(w.rowsBetween(W.unboundedPreceding, -1))
    if kind in ("last", "next"):  # a forward look is a backward look over the reversed order
        return F.last(x, ignorenulls=True).over(run if kind == "last" else back)
    return F.lag(x, 1).over(w)


def number_rows(df: DataFrame, keys, order, chunk, name: str = "rn") -> DataFrame:
    """1-based position of every row in its group."""
    return ordered_scan(df, keys, order, chunk, **{name: running_sum(F.lit(1).cast("bigint"))})


def top_one(df: DataFrame, keys: list[str], *ordering: Column) -> DataFrame:
    """First row per group. Spark cuts each map task to one row per group before
    the shuffle (window group limit), so hot groups do not travel."""
    w = W.partitionBy(*keys).orderBy(*ordering)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def exact_sum(x: Column) -> Column:
    """Sum of numbers as a double that does not depend on the order of rows: they are added with 12 decimal places.

    What is no finite number adds nothing.
    """
    return F.sum(x.try_cast("decimal(38,12)")).cast("double")


#: Groups of up to so many rows keep their values in one buffer to rank them; larger ones are ranked by _between.
BUFFERED = 1 << 16
#: Size of a sketch, and a rank error that it rarely exceeds (when it does, the whole group is ranked).
SKETCH_K, RANK_ERROR = 800, 0.008


def _same(left: DataFrame, keys: list[str], right: DataFrame):
    """Null-safe equality of the keys; those of right are prefixed by _k."""
    return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    df = df.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return F.broadcast(df) if df.count() <= 100_000 else df


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float],
                    width: float | None = None, buffered: int = BUFFERED) -> DataFrame:
    """Linear-interpolated exact quantiles of `value` per group, one column each. Null and NaN values are ignored.

    `width` is the value range that is ranked together in a large group (see _between).
    """
    return _grouped(df, keys, value, qs, {}, width, buffered)


def moments_and_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], width: float | None = None,
                          buffered: int = BUFFERED) -> DataFrame:
    """exact_quantiles with n, mean, min, max, variance and std of each group."""
    v = F.col(value).cast("double")
    aggs = {"n": F.count(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "variance": F.var_pop(v), "std": F.stddev_pop(v)}
    return _grouped(df, keys, value, qs, aggs, width, buffered)


def _grouped(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], more: dict[str, Column], width: float | None, buffered: int) -> DataFrame:
    """Aggregates and quantiles of small groups in one aggregate; quantiles of large ones from bounded parts of them.

    Keys and values are written once, as they are read more than once.
    """
    group = list(keys) or ["_all"]
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value)
    base = materialize(base if keys else base.withColumn("_all", F.lit(0)), "quantile-values")
    large = materialize(base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > buffered).drop("_n"), "large-groups")
    ranked = F.percentile(F.col(value).cast("double"), [float(q) for q in qs.values()])
    names = [F.col("_q")[i].alias(name) for i, name in enumerate(qs)]
    own, aggs = list(more), [a.alias(name) for name, a in more.items()]
    if large.isEmpty():
        return base.groupBy(*group).agg(*aggs, ranked.alias("_q")).select(*keys, *own, *names)
    mark = _keyed(large, group)
    small = base.join(mark, _same(base, group, mark), "left_anti").groupBy(*group).agg(*aggs, ranked.alias("_q")).select(*group, *own, *names)
    rows = base.join(mark, _same(base, group, mark), "left_semi")
    found = _between(rows, group, value, qs, width)
    if own:
        whole, found = rows.groupBy(*group).agg(*aggs), found.withColumnsRenamed({k: f"_k_{k}" for k in group})
        found = whole.join(found, _same(whole, group, found)).select(*group, *own, *qs)
    return small.unionByName(found).select(*keys, *own, *qs)


def _between(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float], width: float | None) -> DataFrame:
    """Exact quantiles of large groups: a mergeable sketch brackets each wanted rank, and only values inside are ranked.

    One pass makes the sketches, a second counts what lies below each bracket and keeps the counts of the
    values inside. A bracket that turns out not to hold its ranks is opened to the whole group.
    """
    v = F.col(value).cast("double")
    sketch = rows.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("_s"))
    edge = lambda rank: F.kll_sketch_get_quantile_double("_s", F.lit(rank))
    wanted = []
    for name, q in qs.items():
        pos, low, high = F.lit(float(q)) * (F.col("_n") - 1), float(q) - RANK_ERROR, float(q) + RANK_ERROR
        wanted.append(F.struct(F.lit(name).alias("name"), pos.alias("pos"), (edge(low) if low > 0 else F.col("_min")).alias("a"),
                               (edge(high) if high < 1 else F.col("_max")).alias("b")))
    brackets = sketch.select(*keys, "_min", "_max", F.explode(F.array(*wanted)).alias("_w")).select(*keys, "_min", "_max", "_w.*")
    brackets = materialize(brackets, "brackets")
    done = materialize(_ranked(rows, keys, value, brackets, width), "ranked")
    missed = done.filter("lo IS NULL OR hi IS NULL")
    if not missed.isEmpty():
        again = missed.withColumnsRenamed({k: f"_k_{k}" for k in keys}).select(*[f"_k_{k}" for k in keys], F.col("name").alias("_name"))
        wide = brackets.join(again, _same(brackets, keys, again) & (F.col("name") == F.col("_name")), "left_semi")
        whole = _ranked(rows, keys, value, wide.withColumns({"a": F.col("_min"), "b": F.col("_max")}), width)
        done = done.filter("lo IS NOT NULL AND hi IS NOT NULL").unionByName(whole)
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return done.groupBy(*keys).pivot("name", list(qs)).agg(F.max(at))


def _ranked(rows: DataFrame, keys: list[str], value: str, brackets: DataFrame, width: float | None) -> DataFrame:
    """(keys, name, pos, lo, hi): the values around rank `pos`, null where they are outside of the bracket [a, b].

    Every row meets the brackets of its group as columns; only values inside of one are kept.
    """
    names = sorted(r[0] for r in brackets.select("name").distinct().collect())  # as many as quantiles are asked for
    pick = lambda c, name: F.max(F.when(F.col("name") == name, F.col(c)))
    marks = brackets.groupBy(*keys).agg(*[pick(c, name).alias(f"_{c}{i}") for i, name in enumerate(names) for c in "ab"])
    marks = _keyed(marks, keys)
    near = rows.join(marks, _same(rows, keys, marks))
    v = F.col(value)
    # values below a bracket count for one place before it
    below = near.groupBy(*keys).agg(*[F.count_if(v < F.col(f"_a{i}")).alias(f"_n{i}") for i in range(len(names))])
    below = below.select(*keys, F.posexplode(F.array(*[f"_n{i}" for i in range(len(names))])).alias("_i", "_n")).withColumn("_v", F.lit(None).cast("double"))
    inside = F.array_compact(F.array(*[F.when((v >= F.col(f"_a{i}")) & (v <= F.col(f"_b{i}")), F.lit(i)) for i in range(len(names))]))
    held = near.select(*keys, F.explode(inside).alias("_i"), v.cast("double").alias("_v")).groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(below.select(*keys, "_i", "_v", "_n").unionByName(held), "bracket-counts")
    part = F.when(F.col("_v").isNull(), F.lit(-1 << 62)).otherwise(F.floor(F.col("_v") / F.lit(width or 1.0)).cast("bigint"))
    run = ordered_scan(counts, [*keys, "_i"], ["_v"], part, _upto=running_sum(F.col("_n"))).withColumn("_name", F.array(*map(F.lit, names))[F.col("_i")])
    want = _keyed(brackets.select(*keys, "name", "pos"), keys)
    run = run.join(want, _same(run, keys, want) & (F.col("_name") == F.col("name")))
    holds = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    return run.groupBy(*keys, "name", "pos").agg(holds(F.floor("pos")).alias("lo"), holds(F.ceil("pos")).alias("hi"))


#: Bits of one bitmap (fixed by bitmap_construct_agg) and of all bitmaps of a filter: 8 MB are broadcast at most.
BITMAP, MOST_BITS = 1 << 15, 1 << 26


def bitmap_semi(wide: DataFrame, narrow: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wide` whose key may be among those of `narrow`: all that are, and few others. An exact join has to follow.

    One bit is set for each key hash of `narrow`, so a wide table is thinned in its own tasks before it is shuffled. Bits are
    eight for each row of `narrow` up to MOST_BITS; beyond that more rows pass, none is lost. Null keys count as
    equal. Keys that have another type on the other side are left out of the hash.
    """
    types = dict(narrow.dtypes)
    same = [k for k, kind in wide.dtypes if k in keys and types[k] == kind]
    if not same:
        return wide
    bits = min(MOST_BITS, max(BITMAP, 1 << (8 * narrow.count()).bit_length()))
    place = F.pmod(F.xxhash64(*[F.col(k) for k in same]), F.lit(bits))
    where = {"__bucket": F.floor(place / BITMAP).cast("int"), "__bit": (place % BITMAP).cast("int")}
    bitmaps = narrow.select(*[c.alias(n) for n, c in where.items()]).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substr("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = wide.withColumns(where).join(F.broadcast(bitmaps), "__bucket")
    return met.filter(F.getbit(byte, F.col("__bit") % 8) == 1).select(*wide.columns)


#: Ranges that touch more buckets than this are covered by dyadic pieces.
SHORT_BUCKETS = 4


def _pieces(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Ranges with the pieces that cover them: __size and __piece stand for buckets [piece * 2**size, (piece + 1) * 2**size).

    The pieces of a range are disjoint. A short range takes each bucket it touches (size 0); a longer one the largest
    aligned blocks that fill it, at most two of each size, so its copies grow with the logarithm of its length.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    r = ranges.filter(F.col(end) > F.col(start)).withColumns({"__lo": bucket(F.col(start)), "__hi": F.ceil(F.col(end) / F.lit(width)).cast("bigint")})
    lo, hi = F.col("__lo"), F.col("__hi")
    piece = lambda size, at: F.struct(size.cast("int").alias("size"), at.alias("at"))
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1

    def blocks(size: Column) -> Column:
        first, beyond = -F.call_function("shiftright", -lo, size), F.call_function("shiftright", hi, size)
        return F.array(F.when((first < beyond) & odd(first), piece(size, first)), F.when((first < beyond) & odd(beyond), piece(size, beyond - 1)))

    sizes = F.sequence(F.lit(0), F.length(F.bin(hi - lo)) - 1)
    each = F.transform(F.sequence(lo, hi - 1), lambda at: piece(F.lit(0), at))
    cover = F.when(hi - lo <= SHORT_BUCKETS, each).otherwise(F.array_compact(F.flatten(F.transform(sizes, blocks))))
    return r.withColumn("__cover", F.explode(cover)).withColumns({"__size": F.col("__cover.size"), "__piece": F.col("__cover.at")}).drop("__lo", "__hi", "__cover")


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with start <= point < end, as an equi join on (keys, piece); see _pieces.

    A residual condition keeps only true hits, so no (key x key) product is formed. Points travel once, except those
    of keys with long ranges, which travel once for each size of piece their key uses. Null keys, null points and
    empty ranges have no hit; each pair of a point and a range comes once. Columns of both sides: those of the range.
    """
    r = _pieces(ranges, start, end, width)
    long = r.filter("__size > 0").groupBy(*keys).agg(F.sort_array(F.collect_set("__size")).alias("__sizes"))
    long = materialize(long, "long-ranges")  # one row per key with a long range, each of at most 64 sizes
    p = points.withColumn("__at", F.floor(F.col(point) / F.lit(width)).cast("bigint"))
    if long.isEmpty():
        p = p.withColumns({"__size": F.lit(0), "__piece": F.col("__at")})
    else:
        mark = _keyed(long, keys)
        p = p.join(mark, reduce(lambda a, b: a & b, [p[k] == mark[f"_k_{k}"] for k in keys]), "left")
        sizes = F.concat(F.array(F.lit(0)), F.coalesce("__sizes", F.array().cast("array<int>")))
        p = p.withColumn("__size", F.explode(sizes)).withColumn("__piece", F.call_function("shiftright", F.col("__at"), F.col("__size")))
    p, r = p.alias("p"), r.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, "__size", "__piece"]])
    cond = cond & (F.col(f"p.{point}") >= F.col(f"r.{start}")) & (F.col(f"p.{point}") < F.col(f"r.{end}"))
    cols = [F.col(f"r.{c}") for c in ranges.columns]
    cols += [F.col(f"p.{c}") for c in points.columns if c not in ranges.columns]
    return r.join(p, cond).select(*cols)


def _both_sides(left: DataFrame, right: DataFrame, keys, left_at: str, right_at: str, payload, tie) -> DataFrame:
    """Right rows and left rows on one axis; at equal places right rows come first."""
    body = F.struct(*[F.col(c) for c in [right_at, *payload]])
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"),
                     F.struct(*[F.col(c) for c in tie] or [F.lit(0).alias("z")]).alias("_tie"),
                     body.alias("_hit"), F.lit(None).cast(_row_type(left)).alias("_row"))
    lf = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"),
                     F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
                     F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"),
                     F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    return r.unionByName(lf)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
         payload: list[str], name: str, width: int, tie: list[str] = ()) -> DataFrame:
    """Add `name` = struct(right_at, payload) of the last right row at or before
    `left_at`, found in one ordered scan over both sides. Among right rows at the same
    place the last by `tie` wins."""
    both = _both_sides(left, right, keys, left_at, right_at, payload, list(tie))
    done = ordered_scan(both, keys, ["_at", "_side", "_tie"], F.floor(F.col("_at") / F.lit(width)).cast("bigint"),
                        _found=last_value(F.col("_hit")))
    return done.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_found").alias(name))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
            payload: list[str], name: str, width: int) -> DataFrame:
    """Add `name` = struct(right_at, payload) of the right row closest to `left_at`
    (the lower one on ties, null when the group has none), in one ordered scan."""
    both = _both_sides(left, right, keys, left_at, right_at, payload, [])
    done = ordered_scan(both, keys, ["_at", "_side"], F.floor(F.col("_at") / F.lit(width)).cast("bigint"),
                        _lo=last_value(F.col("_hit")), _hi=next_value(F.col("_hit")))
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col("_at")
    pick = F.when(hi.isNull() | (at - lo[right_at] <= hi[right_at] - at), lo).otherwise(hi)
    return done.withColumn("_pick", pick).filter(F.col("_row").isNotNull()).select("_row.*", F.col("_pick").alias(name))


def _row_type(df: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
