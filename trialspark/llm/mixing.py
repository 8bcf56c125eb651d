"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

A document's key is a hash of its id. Sizes are summed by source and leading key bits; the bucket in which
a source's budget ends is found in that histogram and alone is summed again by its next bits, until a
single key is left. Documents below the key are taken, so that nothing is sorted, and a larger budget
takes a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.common import WORD, held

#: Key bits: hex digits of an md5 digest; a level of the histogram reads LEVEL_BITS of them.
KEY_DIGITS = 15
LEVEL_BITS = 12
#: Up to this many rows a table of sources is broadcast; beyond it an ordinary join is used.
BROADCAST_ROWS = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a written table that is broadcast only if its counted rows are few."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def numbered(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with their place by code point, from 0, null last.

    Ranges of sources are numbered by themselves and shifted by the counts of the ranges before, so that
    no task sees all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = held(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "source-ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("own", own).join(before, "part").select("source", "source_size", (F.col("before") + F.col("own") - 1).alias("source_no"))


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """sources with `target`: share of all sizes by weight, at most `most` times the size.

    Excess of full sources goes to the others by weight, until none is above its limit: the level (words for
    a weight of 1) rises with each round that fills another source. Only totals reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = held(sources.withColumn("weight", weight), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit, level = F.col("source_size") * float(most), -1.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        used, open_ = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        new = (share * total - used) / open_
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.round(F.least(limit, F.lit(level) * F.col("weight")), 6))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_no, below): keys below `below` have sizes that sum as near to the budget `rest` as keys allow.

    rows: source_no, size, key. A source without a rest has no row.
    """
    bits = 4 * KEY_DIGITS
    state = held(budgets.filter("rest > 0").select("source_no", "rest", F.lit(0).cast("long").alias("prefix")), "budgets")
    while True:
        bits -= LEVEL_BITS
        inside = join_small(rows, state, "source_no").filter(F.shiftright("key", bits + LEVEL_BITS) == F.col("prefix"))
        bucket = inside.groupBy("source_no", "rest", F.shiftright("key", bits).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        run = F.sum("sum").over(Window.partitionBy("source_no").orderBy("bucket"))
        edge = bucket.withColumn("run", run).filter("run >= rest").groupBy("source_no").agg(F.min(F.struct("bucket", "run", "sum", "k0", "k1", "rest")).alias("b"))
        state = held(edge.select("source_no", F.col("b.bucket").alias("prefix"), F.expr("b.rest - (b.run - b.sum)").alias("rest"), "b.sum", "b.k0", "b.k1"), "boundary")
        if bits == 0 or not state.filter("k0 < k1").head(1):
            break
    # the boundary key itself is taken if that comes nearer
    return state.select("source_no", F.expr("k0 + CASE WHEN 2 * rest >= sum THEN 1 ELSE 0 END").alias("below"))


def _keyed(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, KEY_DIGITS)
    return documents.withColumns({"__source": F.col(source_col).cast("string"), "__size": words_in(F.col(text_col)), "__key": F.conv(digest, 16, 10).cast("long")})


def _plan(rows: DataFrame, share: float, most: int, weights: tuple[float, ...]) -> DataFrame:
    """(name, source_size, target, whole, below) of each source: all its documents whole times, those of keys below once more."""
    totals = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    sources = targets(numbered(totals), share, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = held(sources.withColumnRenamed("source", "name"), "targets")
    keyed = join_small(rows, sources.select("name", "source_no"), F.col("__source").eqNullSafe(F.col("name")))
    keyed = held(keyed.select("source_no", F.col("__size").alias("size"), F.col("__key").alias("key")), "keyed")
    edge = thresholds(keyed, sources.select("source_no", "rest"))
    return held(sources.join(edge, "source_no", "left").select("name", "source_size", "target", "whole", F.coalesce("below", F.lit(-1)).alias("below")), "plan")


def _times():
    return F.col("whole") + F.when(F.col("__key") < F.col("below"), 1).otherwise(0)


def mix(documents: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = (5.0, 2.0, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    size: words of the text (null: 0). Sources, by code point with null last, have the weights in turn;
    together their targets are `share` times all sizes, each at most `most` times its source's size. taken is
    a multiple of size, at most `most` times: all documents of a source are taken as often as its target
    allows, and those of least key once more. Null ids share one key; rows that repeat an id are taken
    together; empty texts take 0; an empty table gives an empty table. Other columns are ignored.
    """
    rows = _keyed(documents.select(id_col, text_col, source_col), id_col, text_col, source_col).select(F.col(id_col).alias("doc_id"), "__source", "__size", "__key")
    rows = held(rows, "sizes")
    plan = _plan(rows, share, most, weights)
    out = join_small(rows, plan, F.col("__source").eqNullSafe(F.col("name")))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * _times()).cast("long").alias("taken"))


def take_mix(documents: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = (5.0, 2.0, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """documents, each row repeated as often as the mix takes it, from not at all to `most` times.

    Rows are taken as in mix(); the table is read once for the sizes and once for the rows, which are not
    shuffled.
    """
    keyed = _keyed(documents, id_col, text_col, source_col)
    plan = _plan(held(keyed.select("__source", "__size", "__key"), "sizes"), share, most, weights)
    rows = join_small(keyed.drop("__size"), plan, F.col("__source").eqNullSafe(F.col("name")))
    rows = rows.withColumn("__times", _times().cast("int")).filter("__times > 0").select(*documents.columns, "__times")
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(documents.columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src),
ordered AS (
  SELECT *, 2.0 * source_size / w AS r, row_number() OVER o AS place, sum(2.0 * source_size) OVER o - 2.0 * source_size AS full_before,
         sum(w) OVER () - (sum(w) OVER o - w) AS open_w, 1.5 * sum(source_size) OVER () AS budget
  FROM weighed WINDOW o AS (ORDER BY 2.0 * source_size / w, no ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT arg_min((budget - full_before) / open_w, place) AS lv FROM ordered WHERE (budget - full_before) / open_w <= r),
target AS (
  SELECT source, source_size, round(least(2.0 * source_size, lv * w), 6) AS target FROM weighed, level),
run AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS whole,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum,
         CAST(sum(s.size) OVER (PARTITION BY s.source, s.key) AS BIGINT) AS own
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
rest AS (SELECT *, target - whole * source_size AS rest FROM run)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND (cum < rest OR (cum - own < rest AND 2 * (rest - (cum - own)) >= own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rest
"""
