"""Streaming queries (run to the end of the available files) and their batch twins."""

from pyspark.sql import functions as F, types as T

from trialspark.operators.fleet import fleet_status
from trialspark.plans.registry import query
from trialspark.session import scratch_path
from trialspark.sources.sinks import UpsertTable
from trialspark.streaming import jobs as J

NEWEST = ["created_at", "seq", "crf", "k4"]


def _results(t):
    c = F.col
    return t.lineitem.select(F.concat(F.lit("run"), c("l_suppkey")).alias("run_id"), c("l_partkey").cast("string").alias("job_id"), c("l_shipdate").cast("string").alias("created_at"),
                             c("l_quantity").alias("crf"), c("l_orderkey").alias("seq"), c("l_extendedprice").alias("k4"), F.when(c("l_returnflag") == "R", "x").alias("error"),
                             (F.lit(85) + c("l_linenumber") % 3 * 4).alias("vmaf_threshold"))


LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, job_id ORDER BY created_at DESC, seq DESC, crf DESC, k4 DESC) AS rn FROM
(SELECT 'run' || l_suppkey AS run_id, CAST(l_partkey AS VARCHAR) AS job_id, l_shipdate AS created_at, l_quantity AS crf, l_orderkey AS seq, l_extendedprice AS k4, l_returnflag <> 'R' AS fine, 85 + l_linenumber % 3 * 4 AS vmaf_threshold FROM lineitem) AS a) AS b WHERE rn = 1"""


#: Files that a stream takes at once; the rows come in two such batches.
BATCH_FILES = 12


def _files(t, rows, label):
    path = scratch_path(t.spark, label)
    rows.repartition(2 * BATCH_FILES, "job_id").write.option("compression", "gzip").json(path)
    return path


@query("j01_result_watch", f"""SELECT CAST(e.t AS INT) AS vmaf_threshold, e.x AS expected_jobs, count(*) AS best_json, count(*) FILTER (fine) AS ok_best, count(*) FILTER (fine) >= e.x AS done
FROM ({LATEST}) AS r JOIN (SELECT 85 + n_nationkey % 3 * 4 AS t, CAST(sum(n_nationkey * 100) AS BIGINT) AS x FROM nation GROUP BY 1) AS e ON e.t = r.vmaf_threshold GROUP BY e.t, e.x""")
def _(t):
    rows = _results(t).withColumns({"has_best": F.lit(True), "has_result": F.lit(True), "mtime": F.col("k4")})
    path = _files(t, rows, "result-files")
    e = t.nation.groupBy((F.lit(85) + F.col("n_nationkey") % 3 * 4).cast("int").alias("vmaf_threshold")).agg(F.sum(F.col("n_nationkey") * 100).alias("expected_jobs"))
    stream = J.json_stream(t.spark, path, _nullable(rows.schema), BATCH_FILES)
    work = scratch_path(t.spark, "watch")
    table = UpsertTable(t.spark, work + "/table", NEWEST, buckets=4)
    J.watch_results(stream, table, e, work + "/status", work + "/checkpoint", once=True).awaitTermination()
    status = fleet_status(rows, e).withColumn("batch", F.lit(0).cast("bigint")).schema
    return J.latest_status(t.spark, work + "/status", status).select("vmaf_threshold", "expected_jobs", "best_json", "ok_best", "done")


def _nullable(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


@query("j02_result_ingest", f"SELECT run_id, job_id, crf, seq FROM ({LATEST}) AS r")
def _(t):
    rows = _results(t)
    path = _files(t, rows, "ingest-files")
    stream = J.json_stream(t.spark, path, _nullable(rows.schema), BATCH_FILES)
    work = scratch_path(t.spark, "ingest")
    table = UpsertTable(t.spark, work + "/table", NEWEST, buckets=4)
    J.ingest_results(stream, table, work + "/checkpoint", once=True).awaitTermination()
    return table.read(rows.schema).select("run_id", "job_id", "crf", "seq")


@query("j03_live_progress", """WITH e AS (SELECT 'v' || user_id AS job_id, event_id, event_type = 'purchase' AS done, event_id * 0.5 AS el, floor(value * 10) / 10 AS mib FROM events WHERE event_type <> 'error')
SELECT job_id, elapsed_sec, done, size_mib FROM (SELECT job_id, el::DOUBLE AS elapsed_sec, done, mib AS size_mib, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS rn FROM e) AS x WHERE rn = 1""")
def _(t):
    path = scratch_path(t.spark, "progress-log")
    eid = F.col("event_id")
    ts = F.concat(F.lit("2026-01-01 "), F.lpad(eid.cast("string"), 12, "0"))
    step = F.when(F.col("event_type") == "purchase", "probe CRF30 encode done ").otherwise("probe CRF30 … ")
    line = F.concat(F.lit("["), ts, F.lit("]   [v"), F.col("user_id").cast("string"), F.lit("] "), step, (eid * 0.5).cast("decimal(20,1)").cast("string"), F.lit("s size="),
                    (F.floor(F.col("value") * 10) / 10).cast("decimal(20,1)").cast("string"), F.lit("MiB rate=0.0500 ratio=20.00x"))
    other = F.concat(F.lit("["), ts, F.lit("]   wave 1/15: jobs"))
    t.events.select(F.when(F.col("event_type") == "error", other).otherwise(line).alias("value")).repartition(6).write.text(path)
    work = scratch_path(t.spark, "progress")
    stream = t.spark.readStream.option("maxFilesPerTrigger", 3).text(path)
    table = UpsertTable(t.spark, work + "/table", ["ts", "elapsed_sec"], key=["job_id"], buckets=4)
    J.live_progress(stream, table, work + "/checkpoint", once=True).awaitTermination()
    schema = J.progress_state(J.parse_progress(t.spark.createDataFrame([], "value string"))).schema
    return table.read(schema).select("job_id", "elapsed_sec", "done", "size_mib")


def _scores(t):
    v, e = F.col("value"), F.col("event_type")
    status = F.when(e == "click", "success").when(e == "view", "miner_failure").otherwise("vmaf_soft")
    return t.events.select(F.col("ts").cast("timestamp").alias("event_time"), F.lit("hevc").alias("codec"), F.when(F.col("event_id") % 2 == 0, "CRF").otherwise("VBR").alias("mode"), F.lit(85.0).alias("vmaf_threshold"),
                           (F.col("user_id") % 3).cast("int").alias("uid"), ((v % 10) / 10).alias("final"), (F.lit(70) + v % 30).alias("vmaf_neg"), ((v % 9) / 10).alias("compression_rate"), status.alias("status"))


def _sql(buckets, width):
    return f"""SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(b + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS window_end, 'hevc' AS codec, CASE WHEN event_id % 2 = 0 THEN 'CRF' ELSE 'VBR' END AS mode, 85.0::DOUBLE AS vmaf_threshold, CAST(user_id % 3 AS INT) AS uid,
count(*) AS n, avg((value % 10) / 10) AS mean_final, max((value % 10) / 10) AS max_final, avg(70 + value % 30) AS mean_neg, min(70 + value % 30) AS min_neg, avg((value % 9) / 10) AS mean_rate, count(*) FILTER (event_type = 'click') AS ok,
count(*) FILTER (event_type NOT IN ('click', 'view')) AS soft FROM ({buckets}) AS e GROUP BY 1, 2, 3, 4, 5, 6"""


MEANS = "mean_final max_final mean_neg min_neg mean_rate"


def _text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


@query("j04_windowed_scores_tumbling", _sql("SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events", "1 HOUR"), MEANS)
def _(t):
    return _text(J.windowed_scores(_scores(t), "1 hour"))


@query("j04_windowed_scores_sliding", _sql("SELECT *, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 15 MINUTE * k AS b FROM events, (SELECT unnest(range(0, 4)) AS k) AS s", "1 HOUR"), MEANS)
def _(t):
    return _text(J.windowed_scores(_scores(t), "1 hour", "15 minutes"))
