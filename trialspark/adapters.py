"""Trial, segment, packet and log-line views over the given tables.

Each view exists twice: as a DataFrame (here) and as SQL text (`VIEW_SQL`) for
the check engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.functions.features import segment_difficulty
from trialspark.session import materialize
from trialspark.functions.score import with_compression, with_score
from trialspark.operators.scan import ordered_scan, running_sum

THRESHOLD = 85.0
LINE_CHUNK = 65536
FRAME_CHUNK = 4096


class Tables:
    """The given parquet tables of one folder, and the views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def trials(self) -> DataFrame:
        c = F.col
        return self.read("lineitem").select(
            c("l_suppkey").alias("video_id"), (c("l_partkey") % 8).cast("int").alias("segment_index"),
            (F.lit(22) + c("l_partkey") % 21).cast("int").alias("crf"),
            ((F.lit(2) + c("l_orderkey") % 25).cast("double") / 10.0).alias("aq_strength"),
            (c("l_returnflag") != "R").alias("encode_ok"), (c("l_returnflag") == "A").alias("gates_ok"),
            F.when(c("l_linestatus") == "F", 0).otherwise(1).alias("root_rank"),
            (F.lit(78.0) + c("l_quantity") * 0.42).alias("vmaf_neg"),
            c("l_extendedprice").alias("size_in"),
            (c("l_extendedprice") * (F.lit(0.02) + c("l_discount") * 9.0)).alias("size_out"),
            c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_shipdate").alias("k3"),
            c("l_extendedprice").alias("k4"))

    @cached_property
    def scored(self) -> DataFrame:
        return with_score(with_compression(self.trials), THRESHOLD)

    @cached_property
    def segments(self) -> DataFrame:
        """Numbered segments with frame ranges (both from one ordered scan)."""
        c = F.col
        base = self.read("orders").select(
            c("o_custkey").alias("video_id"), c("o_orderkey").alias("seg_key"), c("o_orderdate"))
        base = base.withColumn("frame_count", (F.lit(5) + c("seg_key") % 90).cast("int"))
        month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
        num = ordered_scan(base, ["video_id"], ["o_orderdate", "seg_key"], month,
                           _n=running_sum(F.lit(1)), _f=running_sum(c("frame_count")))

        def share(mod: int, scale: float | None = None):
            v = (c("seg_key") % mod).cast("double") / float(mod)
            return v if scale is None else v * scale

        return num.select(
            "video_id", "seg_key", (c("_n") - 1).cast("int").alias("seg_index"), "frame_count",
            (c("frame_count").cast("double") / 30.0).alias("duration"),
            share(997, 0.3).alias("motion_p90"), share(613, 8.0).alias("texture"),
            share(389, 0.1).alias("noise"), share(211, 0.2).alias("edge"), share(101).alias("flatness"),
            share(151).alias("entropy"), share(73).alias("luma_mean"), share(67, 5.0).alias("hf_energy"),
            (c("_f") - c("frame_count")).cast("bigint").alias("start_frame"), c("_f").cast("bigint").alias("end_frame"))

    @cached_property
    def segment_table(self) -> DataFrame:
        """The numbered segments, written once for queries that read them several times."""
        return materialize(self.segments, "segments")

    @cached_property
    def packet_table(self) -> DataFrame:
        return materialize(self.packets, "packets")

    @cached_property
    def segments_d(self) -> DataFrame:
        return self.segments.withColumn("difficulty", segment_difficulty())

    @cached_property
    def packets(self) -> DataFrame:
        c = F.col
        base = self.read("events").select("event_id", (c("user_id") % 20).alias("video_id"), "ts", "value")
        hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
        num = ordered_scan(base, ["video_id"], ["ts", "event_id"], hour, _n=running_sum(F.lit(1)))
        return num.select("event_id", "video_id", (c("_n") - 1).cast("int").alias("frame"),
                          F.floor(c("value") * 100).cast("bigint").alias("size"))

    @cached_property
    def log_table(self) -> DataFrame:
        """The log lines, written once: text is built (or read) a single time."""
        return materialize(self.log_lines, "log-lines")

    @cached_property
    def log_lines(self) -> DataFrame:
        """(file, line, value): the events table read as one score log."""
        e = F.col("event_type")
        eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")

        def dec(x, p, s):
            return x.cast(f"decimal({p},{s})").cast("string")

        challenge = F.concat(
            F.lit("Built compression challenge protocol for "), uid.cast("string"),
            F.lit(" miners, 4 queries, VMAF threshold "), (F.lit(85) + (eid % 3) * 4).cast("string"),
            F.lit(", codec hevc, mode "), F.when(eid % 20 == 0, "CRF").otherwise("VBR"))
        payload = F.concat(F.lit("payload: ['https://h/b/"), eid.cast("string"), F.lit(".mp4?s=1', 'https://h/b/"),
                           (eid + 1).cast("string"), F.lit(".mp4?s=1']"))
        score = F.concat(
            F.lit("2024-01-01 00:00:00.0 | x score_compressions:9 - "), (uid % 3).cast("string"),
            F.lit(" ** VMAF NEG: "), dec(F.lit(70) + v % 30, 6, 2), F.lit(" ** VMAF: "),
            F.when(e == "view", "N/A").otherwise(dec(F.lit(71) + v % 29, 6, 2)),
            F.lit(" ** VMAF Threshold: 85.0 ** Compression Rate: "), dec(F.lit(0.01) + (v % 9) / 10, 6, 4),
            F.lit(" ** Final: "), dec((v % 10) / 10, 6, 4), F.lit(" || "),
            F.when(e == "view", "MINER FAILURE").when(e == "click", "success; ref_bpp=0.25; mode=crf")
            .otherwise("VMAF 83.00 in soft zone; ref_bpp=0.50"))
        line = (F.when((e == "error") & (eid % 10 == 0), challenge).when(e == "error", payload).otherwise(score))
        return self.read("events").select(F.lit("events").alias("file"), eid.alias("line"), line.alias("value"))


VIEW_SQL = {
    "v_trials": """
SELECT l_suppkey AS video_id, CAST(l_partkey % 8 AS INT) AS segment_index,
       CAST(22 + l_partkey % 21 AS INT) AS crf,
       CAST(2 + l_orderkey % 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS aq_strength,
       l_returnflag <> 'R' AS encode_ok, l_returnflag = 'A' AS gates_ok,
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS root_rank,
       CAST(78 AS DOUBLE) + l_quantity * CAST(0.42 AS DOUBLE) AS vmaf_neg,
       l_extendedprice AS size_in, l_extendedprice * (CAST(0.02 AS DOUBLE) + l_discount * CAST(9 AS DOUBLE)) AS size_out,
       l_orderkey AS k1, l_linenumber AS k2, l_shipdate AS k3, l_extendedprice AS k4
FROM lineitem""",
    "v_measured": """
SELECT *, CASE WHEN size_in > 0 AND size_out > 0 AND size_out < size_in THEN size_out / size_in ELSE 1.0::DOUBLE END AS compression_rate,
       CASE WHEN size_in > 0 AND size_out > 0 AND size_out < size_in THEN 1.0::DOUBLE / (size_out / size_in) ELSE 1.0::DOUBLE END AS compression_ratio
FROM v_trials""",
    "v_scored": """
SELECT m.*,
  CASE WHEN compression_rate >= 0.8 OR vmaf_neg < 80 THEN 0
       WHEN vmaf_neg < 85 THEN least(1.0, (CASE WHEN compression_ratio <= 20 THEN pow((compression_ratio - 1) / 19, 1.5) ELSE 1.0 + 0.3 * ln(compression_ratio / 20) END)
            * (0.7 * pow((vmaf_neg - 80) / 5, 2)) / 1.12)
       ELSE least(1.0, (0.7 * (CASE WHEN compression_ratio <= 20 THEN pow((compression_ratio - 1.25) / 18.75, 0.9) ELSE 1.0 + 0.1 * ln(compression_ratio / 20) END)
            + 0.3 * (0.7 + 0.3 * least(1.0, (vmaf_neg - 85) / 15))) / 1.12) END::DOUBLE AS s_f,
  CASE WHEN compression_rate >= 0.8 THEN 'No meaningful compression (ratio: ' || fixed_text(compression_ratio, 2) || 'x, rate: ' || fixed_text(compression_rate, 2) || ')'
       WHEN vmaf_neg < 80 THEN 'VMAF ' || fixed_text(vmaf_neg, 2) || ' below hard cutoff (80.00)'
       WHEN vmaf_neg < 85 THEN 'VMAF ' || fixed_text(vmaf_neg, 2) || ' in soft zone' ELSE 'success' END AS reason
FROM v_measured m""",
    "v_segments": """
SELECT o_custkey AS video_id, o_orderkey AS seg_key,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS seg_index,
       CAST(5 + o_orderkey % 90 AS INT) AS frame_count,
       CAST(5 + o_orderkey % 90 AS DOUBLE) / CAST(30 AS DOUBLE) AS duration,
       CAST(o_orderkey % 997 AS DOUBLE) / CAST(997 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS motion_p90,
       CAST(o_orderkey % 613 AS DOUBLE) / CAST(613 AS DOUBLE) * CAST(8 AS DOUBLE) AS texture,
       CAST(o_orderkey % 389 AS DOUBLE) / CAST(389 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS noise,
       CAST(o_orderkey % 211 AS DOUBLE) / CAST(211 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS edge,
       CAST(o_orderkey % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS flatness,
       CAST(o_orderkey % 151 AS DOUBLE) / CAST(151 AS DOUBLE) AS entropy,
       CAST(o_orderkey % 73 AS DOUBLE) / CAST(73 AS DOUBLE) AS luma_mean,
       CAST(o_orderkey % 67 AS DOUBLE) / CAST(67 AS DOUBLE) * CAST(5 AS DOUBLE) AS hf_energy
FROM orders""",
    "v_frames": """
SELECT s.*, CAST(sum(frame_count) OVER w - frame_count AS BIGINT) AS start_frame, CAST(sum(frame_count) OVER w AS BIGINT) AS end_frame
FROM v_segments s WINDOW w AS (PARTITION BY video_id ORDER BY seg_index ROWS UNBOUNDED PRECEDING)""",
    "v_segments_d": """
SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE,
   0.25::DOUBLE * (motion_p90 / (motion_p90 + 0.145::DOUBLE)) + 0.2::DOUBLE * (texture / (texture + 4.22::DOUBLE))
   + 0.15::DOUBLE * least(entropy, 1.0::DOUBLE) + 0.15::DOUBLE * (noise / (noise + 0.048::DOUBLE))
   + 0.1::DOUBLE * (edge / (edge + 0.0475::DOUBLE)) + 0.1::DOUBLE * (hf_energy / (hf_energy + 4.99::DOUBLE))
   + 0.05::DOUBLE * (1.0::DOUBLE - least(greatest(flatness, 0.0::DOUBLE), 1.0::DOUBLE)))) AS difficulty
FROM v_frames""",
    "v_packets": """
SELECT event_id, user_id % 20 AS video_id,
       CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS INT) AS frame,
       CAST(floor(value * 100) AS BIGINT) AS size
FROM events""",
    "v_log_lines": """
SELECT event_id AS line,
  CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN
    concat('Built compression challenge protocol for ', CAST(user_id AS STRING), ' miners, 4 queries, VMAF threshold ', CAST(85 + (event_id % 3) * 4 AS STRING), ', codec hevc, mode ', CASE WHEN event_id % 20 = 0 THEN 'CRF' ELSE 'VBR' END)
  WHEN event_type = 'error' THEN concat('payload: [''https://h/b/', CAST(event_id AS STRING), '.mp4?s=1'', ''https://h/b/', CAST(event_id + 1 AS STRING), '.mp4?s=1'']')
  ELSE concat('2024-01-01 00:00:00.0 | x score_compressions:9 - ', CAST(user_id % 3 AS STRING),
    ' ** VMAF NEG: ', CAST(CAST(70 + value % 30 AS DECIMAL(6,2)) AS STRING), ' ** VMAF: ', CASE WHEN event_type='view' THEN 'N/A' ELSE CAST(CAST(71 + value % 29 AS DECIMAL(6,2)) AS STRING) END,
    ' ** VMAF Threshold: 85.0 ** Compression Rate: ', CAST(CAST(0.01 + (value % 9) / 10 AS DECIMAL(6,4)) AS STRING), ' ** Final: ', CAST(CAST((value % 10) / 10 AS DECIMAL(6,4)) AS STRING),
    ' || ', CASE event_type WHEN 'view' THEN 'MINER FAILURE' WHEN 'click' THEN 'success; ref_bpp=0.25; mode=crf' ELSE 'VMAF 83.00 in soft zone; ref_bpp=0.50' END)
  END AS value
FROM events""",
}

_CALL = re.compile(r"\bfixed_text\(([^(),]+), (\d)\)")


def _fixed_sql(m: re.Match) -> str:
    return f"printf('%.{m.group(2)}f', {m.group(1).strip()})"


def with_views(sql: str, views: dict[str, str]) -> str:
    """Prefix a check query with the views it names, in dependency order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(views[name])
                need.append(name)

    visit(sql)
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({views[n].strip()})" for n in need)
    if ctes:
        if body.upper().startswith("WITH RECURSIVE "):
            body = f"WITH RECURSIVE {ctes},\n{body[15:]}"
        elif body.upper().startswith("WITH "):
            body = f"WITH {ctes},\n{body[5:]}"
        else:
            body = f"WITH {ctes}\n{body}"
    return _CALL.sub(_fixed_sql, body)
