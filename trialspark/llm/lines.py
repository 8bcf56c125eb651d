"""Line dedup by site-relative frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import held
from trialspark.llm.mixing import join_small


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _mark(line: Column) -> Column:
    """Hash of a line without surrounding blanks; null for blank lines, which are never boilerplate."""
    text = F.trim(line)
    return F.when(text != "", F.xxhash64(text))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, least_pages: int) -> DataFrame:
    """(host, marks): lines found on more than `ratio` of a host's pages, and on least_pages at least.

    Pages are rows; a line counts once a page. A host has at most (mean lines of a page) / ratio such lines,
    so the list of a host stays small whatever the number of its pages.
    """
    marks = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _mark), lambda x: x.isNotNull()))
    rows = pages.select(host.alias("host"), marks.alias("marks"))
    total = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "site")
    found = rows.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    common = found.join(total, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("n") / F.col("pages") > ratio)
    return common.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """pages with boilerplate lines cut from the text, and n_lines and n_dropped (lines with text).

    Lines end at line feeds; those with equal text but for surrounding blanks are the same. Blank lines and
    all other lines stay as they are, in order. Rows with a null host are one site. Null texts stay null
    with 0 lines; rows of an empty table and repeated rows have no special case: each row is a page of its
    own. Columns n_lines and n_dropped are replaced if present.
    """
    text = F.col(text_col).cast("string")
    bad = held(boilerplate(pages, host, text, ratio, least_pages).select(F.col("host").alias("__site"), F.col("marks").alias("__bad")), "boilerplate")
    rows = join_small(pages.withColumn("__host", host), bad, F.col("__host").eqNullSafe(F.col("__site")), "left")
    # marks beside their lines, so that each line is hashed once
    rows = rows.withColumn("__lines", F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _mark(x).alias("mark"))))
    kept = F.filter("__lines", lambda x: x["mark"].isNull() | ~F.array_contains("__bad", x["mark"]))
    rows = rows.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
    count = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x["mark"].isNotNull())), F.lit(0)).cast("long")
    rows = rows.withColumn("n_lines", F.when(text.isNull(), F.lit(0).cast("long")).otherwise(count("__lines")))
    rows = rows.withColumn("n_dropped", F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - count("__kept")))
    rows = rows.withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(F.transform("__kept", lambda x: x["line"]), "\n")).otherwise(text))
    return rows.drop("__host", "__site", "__bad", "__lines", "__kept")


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents WHERE text IS NOT NULL),
common AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) t ON l.source IS NOT DISTINCT FROM t.source
  WHERE n >= 5 AND n / pages > 0.1),
sites AS (SELECT source, list(line) AS bad FROM common GROUP BY source),
judged AS (
  SELECT d.doc_id, d.source, d.text, list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') <> '') AS full_lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(s.bad, []::VARCHAR[]), trim(x, ' '))) AS kept
  FROM documents d LEFT JOIN sites s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, CAST(coalesce(len(full_lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(full_lines) - len(list_filter(kept, lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM judged
"""
