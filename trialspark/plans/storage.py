"""Reader and writer queries: Spark writes a table to the shared scratch folder, the
reader under test reads it back."""

from pyspark.sql import functions as F

from trialspark import schema as SC
from trialspark.operators import fleet as X, trials as T
from trialspark.plans.registry import query
from trialspark.plans.trials import labels
from trialspark.session import materialize, scratch_path
from trialspark.sources import records as R, sinks as K

SEQ = "k1, k2, k3, k4"
DOCUMENTS_IN_FOLDER = 100


@query("a01_trial_jsonl_source", """SELECT CAST(video_id AS VARCHAR) AS video_stem, segment_index, crf, aq_strength, vmaf_neg, encode_ok, CAST(k1 AS VARCHAR) AS params FROM v_trials""")
def _(t):
    path = scratch_path(t.spark, "trials-jsonl")
    rows = t.trials.select(F.col("video_id").cast("string").alias("video_stem"), F.col("crf").cast("string").alias("crf"), "aq_strength", "vmaf_neg", "encode_ok",
                           F.col("k1").cast("string").alias("params"), F.format_string("segment_%02d", "segment_index").alias("seg_dir"))
    bad = t.nation.select(F.explode(F.array(F.lit("segment_00"), F.lit("segment_05"))).alias("seg_dir"),
                          F.element_at(F.array(F.lit("{broken"), F.lit("[1, 2]"), F.lit("  ")), F.col("n_nationkey") % 3 + 1).alias("value"))
    lines = rows.select("seg_dir", F.to_json(F.struct(*[c for c in rows.columns if c != "seg_dir"])).alias("value")).unionByName(bad)
    lines.write.partitionBy("seg_dir").text(path)
    return R.read_trials(t.spark, path, "*.txt").select("video_stem", "segment_index", "crf", "aq_strength", "vmaf_neg", "encode_ok", "params")


@query("a02_document_source", "SELECT CAST(s_suppkey AS VARCHAR) AS job_id, s_acctbal AS elapsed_sec, s_nationkey::DOUBLE AS crf, s_name AS encoder FROM supplier")
def _(t):
    path = scratch_path(t.spark, "documents")
    c = F.col
    doc = F.to_json(F.struct(c("s_suppkey").cast("string").alias("job_id"), c("s_acctbal").alias("elapsed_sec"),
                             F.struct(c("s_nationkey").cast("double").alias("crf"), c("s_name").alias("encoder")).alias("best")))
    # a file for each document, in folders of about a hundred that one task writes whole: a commit moves folders, not files
    folders = -(-t.supplier.count() // DOCUMENTS_IN_FOLDER) or 1
    docs = t.supplier.select(F.pmod(F.hash("s_suppkey"), F.lit(folders)).alias("folder"), doc.alias("value"))
    docs.repartition(folders, "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    docs = R.read_documents(t.spark, path, SC.RESULT_DOC, recursive=True)
    return docs.select("job_id", "elapsed_sec", "best.crf", "best.encoder")


@query("a03_sweep_source", """SELECT crf, aq_strength, s_f, compression_ratio, vmaf_neg, gates_ok FROM v_scored WHERE encode_ok AND gates_ok""", "s_f compression_ratio vmaf_neg")
def _(t):
    path = scratch_path(t.spark, "sweep")
    (t.scored.select("crf", "aq_strength", "s_f", "compression_ratio", "vmaf_neg", "gates_ok", "encode_ok").write.option("header", True).csv(path + "/results.csv"))
    return R.read_sweep(t.spark, path + "/trials.jsonl", path + "/results.csv", gates_only=True)


@query("a04_log_text_source", "SELECT CAST(line // 4096 AS INT) AS part, row_number() OVER (PARTITION BY line // 4096 ORDER BY line) AS line, value FROM v_log_lines")
def _(t):
    path = scratch_path(t.spark, "log")
    # many log files of consecutive lines
    lines = t.log_lines.withColumn("part", F.floor(F.col("line") / 4096).cast("int"))
    lines.repartition("part").sortWithinPartitions("part", "line").select("part", "value").write.partitionBy("part").text(path)
    got = R.read_log(t.spark, path)
    return got.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "line", "value")


@query("a05_job_manifest", """WITH j AS (SELECT o_orderkey, o_custkey, unnest([0, 1, 2]) AS job_pos FROM orders),
k AS (SELECT *, CASE job_pos WHEN 0 THEN 'clip ' || o_orderkey WHEN 1 THEN 'video-2' ELSE 'r/' || o_custkey END AS job_id, 85 + o_orderkey % 3 * 4 AS thr FROM j), s AS (SELECT *, regexp_replace(job_id, '[^A-Za-z0-9_-]', '_', 'g') AS sid FROM k)
SELECT o_orderkey, CAST(job_pos AS INT) AS job_pos, job_id, 'work/' || thr || '/' || sid AS job_dir, CASE job_pos WHEN 2 THEN 'work/' || thr || '/' || sid || '/input.mp4' ELSE '/in/' || o_custkey || '.mp4' END AS input_path,
CASE job_pos WHEN 0 THEN 'out/' || thr || '/a.mp4' WHEN 1 THEN 'output/fleet/' || thr || '/video-2.mp4' ELSE 'work/' || thr || '/' || sid || '/output.mp4' END AS output_path, CASE job_pos WHEN 1 THEN '7M' ELSE '2M' END AS target_bitrate FROM s""")
def _(t):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    q = F.lit('"')
    doc = F.concat(F.lit('{"work_dir": "work", "target_bitrate": "2M", "vmaf_threshold": '), (F.lit(85) + F.col("o_orderkey") % 3 * 4).cast("string"),
                   F.lit(', "jobs": [{"id": "clip '), k, F.lit('", "input_path": "/in/'), c, F.lit('.mp4", "output_path": "./out/a.mp4"}, {"input_path": "/in/'), c,
                   F.lit('.mp4", "target_bitrate": "7M"}, {"id": "r/'), c, F.lit('", "input_url": "https://h/x", "upload_url": "https://h/y"}]}'))
    req = t.orders.select("o_orderkey", F.from_json(doc, SC.REQUEST).alias("r")).select("o_orderkey", "r.*")
    return R.job_manifest(req).select("o_orderkey", "job_pos", "job_id", "job_dir", "input_path", "output_path", "target_bitrate")


@query("a06_result_upsert", """SELECT run_id, job_id, created_at, crf, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, job_id ORDER BY created_at DESC, seq DESC, crf DESC, k4 DESC) AS rn FROM
(SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE 'run' || l_suppkey END AS run_id, CAST(l_partkey AS VARCHAR) AS job_id, l_shipdate AS created_at, l_quantity AS crf, l_orderkey AS seq, l_extendedprice AS k4 FROM lineitem) AS a) AS b WHERE rn = 1 OR run_id IS NULL""")
def _(t):
    c = F.col
    rows = t.lineitem.select(F.when(c("l_linenumber") != 7, F.concat(F.lit("run"), c("l_suppkey"))).alias("run_id"), c("l_partkey").cast("string").alias("job_id"),
                             c("l_shipdate").alias("created_at"), c("l_quantity").alias("crf"), c("l_orderkey").alias("seq"), c("l_extendedprice").alias("k4"), "l_linestatus")
    table = K.UpsertTable(t.spark, scratch_path(t.spark, "results"), ["created_at", "seq", "crf", "k4"], buckets=8)
    table.upsert(rows.filter("l_linestatus = 'F'").drop("l_linestatus"))
    table.upsert(rows.filter("l_linestatus = 'O'").drop("l_linestatus"))
    return table.read(rows.drop("l_linestatus").schema).drop("k4")


def imports(t):
    n = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("work_root"))
    a = t.supplier.filter("s_acctbal > 4000").join(n, F.col("s_nationkey") == F.col("nk")).select("work_root", F.col("s_suppkey").cast("string").alias("job_id"))
    b = t.customer.join(n, F.col("c_nationkey") == F.col("nk")).select("work_root", F.col("c_custkey").cast("string").alias("job_id"))
    return a, b


@query("a07_bulk_import", """WITH a AS (SELECT n_name AS work_root, CAST(s_suppkey AS VARCHAR) AS job_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 4000), b AS (SELECT n_name AS work_root, CAST(c_custkey AS VARCHAR) AS job_id FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT * FROM b WHERE work_root NOT IN (SELECT work_root FROM a))
SELECT work_root, count(DISTINCT job_id) AS job_count, count(DISTINCT job_id) AS ok_count FROM a GROUP BY 1 UNION ALL SELECT work_root, count(*), count(*) FROM s GROUP BY 1""")
def _(t):
    return K.import_results(*imports(t))[1]


@query("a07_imported_rows", """WITH a AS (SELECT n_name AS work_root, CAST(s_suppkey AS VARCHAR) AS job_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 4000), b AS (SELECT n_name AS work_root, CAST(c_custkey AS VARCHAR) AS job_id FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE work_root NOT IN (SELECT work_root FROM a)""")
def _(t):
    return K.import_results(*imports(t))[0]


@query("a08_training_table_sink", f"SELECT {SEQ}, video_id, crf, vmaf_neg, oracle_crf FROM v_trials JOIN v_labels USING (video_id)")
def _(t):
    path = scratch_path(t.spark, "table")
    tab = t.trials.join(labels(t), "video_id").select("k1", "k2", "k3", "k4", "video_id", "crf", "vmaf_neg", "oracle_crf")
    K.write_table(tab, path, ["video_id", "crf"])
    return t.spark.read.schema(tab.select(*K.ordered_columns(tab.columns, ["video_id", "crf"])).schema).option("header", True).csv(path + "/csv")


@query("a09_published_table", """WITH r AS (SELECT 85 + l_linenumber % 3 * 4 AS threshold, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'x' END AS e, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS crf FROM lineitem)
SELECT CAST(threshold AS INT) AS threshold, count(*) AS job_count, count(*) FILTER (crf IS NOT NULL AND e IS NULL) AS ok_count FROM r WHERE threshold <> 89 OR l_linestatus = 'O' GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "published")
    none = F.lit(None).cast("double")
    r = t.lineitem.select(F.col("l_orderkey").cast("string").alias("job_id"), F.lit("in.mp4").alias("input_path"), F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("crf"),
                          F.lit("rd=5").alias("libx265_params"), F.col("l_discount").alias("s_f"), none.alias("vmaf"), none.alias("vmaf_base"), none.alias("compression_rate"),
                          F.when(F.col("l_returnflag") == "R", "x").alias("error"), (F.lit(85) + F.col("l_linenumber") % 3 * 4).alias("vmaf_threshold"), "l_linestatus")
    K.publish(r, path)
    K.publish(r.filter("vmaf_threshold = 89 AND l_linestatus = 'O'"), path)  # replaces that threshold only
    return K.published_summary(t.spark.read.parquet(path)).select(F.col("threshold").cast("int").alias("threshold"), "job_count", "ok_count")


@query("a10_trial_append", "SELECT DISTINCT video_id, segment_index, crf, aq_strength FROM v_trials")
def _(t):
    path = scratch_path(t.spark, "trial-log")
    keys = ["video_id", "segment_index", "crf", "aq_strength"]
    rows = t.trials.select(*keys, "root_rank")
    first, all_ = rows.filter("root_rank = 0").select(*keys).distinct(), rows.select(*keys).distinct()
    for part in (first, all_):
        K.append_trials(part, path, keys, all_.schema)
    return t.spark.read.schema(all_.schema).json(path)


@query("a11_build_manifest", """SELECT 'videos_seen' AS measure, count(DISTINCT video_id) AS n FROM v_trials UNION ALL SELECT 'trial_rows', count(*) FROM v_trials UNION ALL SELECT 'videos_with_oracle', count(DISTINCT video_id) FROM v_labels UNION ALL SELECT 'label_rows', count(*) FROM v_labels""")
def _(t):
    return K.build_manifest(t.trials, labels(t))


@query("a12_run_ledger", """WITH s AS (SELECT run_id, created_at, strategy FROM (SELECT o_custkey AS run_id, o_orderdate AS created_at, o_orderpriority AS strategy, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F') AS a WHERE rn = 1),
f AS (SELECT * FROM (SELECT o_custkey AS run_id, o_orderdate AS finished_at, o_orderkey % 50 AS job_count, o_orderkey % 40 AS ok_count, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders JOIN s ON run_id = o_custkey AND o_orderdate >= created_at WHERE o_orderstatus = 'F') AS b WHERE rn = 1)
SELECT s.*, finished_at, coalesce(job_count, 0) AS job_count, coalesce(ok_count, 0) AS ok_count FROM s LEFT JOIN f USING (run_id)""")
def _(t):
    c = F.col
    st = t.orders.filter("o_orderstatus <> 'F'").select(c("o_custkey").alias("run_id"), c("o_orderdate").alias("created_at"), c("o_orderpriority").alias("strategy"), c("o_orderkey").alias("seq"))
    fi = t.orders.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("run_id"), c("o_orderdate").alias("finished_at"), (c("o_orderkey") % 50).alias("job_count"), (c("o_orderkey") % 40).alias("ok_count"), c("o_orderkey").alias("seq"))
    return K.merge_runs(st, fi)


@query("a13_clip_listing", "SELECT video_id, seg_index AS clip_index, CAST(start_frame AS INT) AS start_frame, CAST(end_frame AS INT) AS end_frame, frame_count FROM v_frames WHERE seg_key % 6 > 0")
def _(t):
    k = F.col("seg_key") % 6
    name = (F.when(k == 0, F.concat(F.lit("seg"), F.col("seg_index"), F.lit("_f9-9.mp4")))
            .otherwise(F.concat(F.lit("SEG"), F.format_string("%02d", "seg_index"), F.lit("_f"), F.col("start_frame"), F.lit("-"), F.col("end_frame"), F.lit(".MP4"))))
    return R.parse_clip_names(t.segments.select("video_id", name.alias("file")), "file").select("video_id", "clip_index", "start_frame", "end_frame", "frame_count")


@query("c09_feature_staleness", """SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_custkey % 20 < 16""")
def _(t):
    k = F.col("o_orderkey")
    seg = F.struct(F.lit(0).alias("index"), F.lit(1.0).alias("si"), F.when(k % 5 != 0, 2.0).alias("ti"), F.lit(0.3).alias("luma_mean"), F.lit(0.2).alias("sat_mean"))
    meta = F.struct((F.col("o_custkey") % 20).cast("int").alias("samples_per_segment"), F.struct(F.when(F.col("o_orderstatus") == "P", "adaptive").otherwise("content").alias("detector")).alias("scene_detect"))
    docs = t.orders.select("o_orderkey", F.to_json(F.struct(meta.alias("meta"), F.when(F.col("o_orderpriority") != "5-LOW", F.array(seg)).alias("segments"))).alias("doc"))
    docs = docs.select("o_orderkey", F.from_json("doc", SC.FEATURE_DOC).alias("d")).select("o_orderkey", "d.*")
    return X.stale_documents(docs).select("o_orderkey")
