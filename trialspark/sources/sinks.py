"""Writers: upserted results, ledgers, published and training tables, trial logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.operators.scan import top_one
from trialspark.sources import files

KEY = ["run_id", "job_id"]


def flatten_result(docs: DataFrame) -> DataFrame:
    """Result documents to result rows: best fields as columns, JSON copies beside them."""
    b = F.col("best")
    names = ("encoder", "mode", "crf", "vmaf", "vmaf_base", "vmaf_delta", "s_f", "compression_rate", "compression_ratio")
    return docs.filter(F.coalesce("job_id", F.lit("")) != "").select(
        "run_id", "job_id", "created_at", "strategy", "input_path", "output_path", "elapsed_sec", "vmaf_threshold",
        F.coalesce("uploaded", F.lit(False)).cast("int").alias("uploaded"), F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("use_gpu", F.lit(False)).cast("int").alias("use_gpu"), b["recipe"].alias("recipe"), *[b[n].alias(n) for n in names],
        F.to_json(F.coalesce("features", F.expr("map()").cast("map<string,double>"))).alias("features_json"),
        F.to_json(F.coalesce("stage_timings", F.expr("map()").cast("map<string,double>"))).alias("stage_timings_json"),
        F.to_json("best").alias("best_json"))


def latest_rows(df: DataFrame, newest: list[str], key=KEY, within=()) -> DataFrame:
    """Newest row per key; rows without a run never replace each other.

    within: columns that follow from the key; a table already shuffled by them is not shuffled again.
    """
    keyed = top_one(df.filter(F.col(key[0]).isNotNull()), [*within, *key], *[F.col(c).desc() for c in newest])
    return keyed.unionByName(df.filter(F.col(key[0]).isNull()))


class UpsertTable:
    """A result table without a table format.

    Rows live in hash buckets of their key. An upsert writes its batch once, rewrites only the buckets that the
    batch falls into, into a folder of a fresh name, and then creates the next manifest, a small file that names
    the current folder of each bucket; readers see the old or the new state, never a mix. A crash before that
    leaves folders nobody names, and the retry starts over. Of two writers one creates the manifest; the other
    merges again on top of it. The manifest keeps the last stream batch, so a repeated batch is skipped, and the
    rows of each bucket: when they and the batch exceed `bucket_rows` on average, the upsert doubles the buckets.
    """

    def __init__(self, spark: SparkSession, path: str, newest: list[str], key=tuple(KEY), buckets: int = 16, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.newest, self.key = spark, path.rstrip("/"), list(newest), list(key)
        self.buckets, self.bucket_rows = buckets, bucket_rows

    def _manifest(self) -> dict:
        # names sort by version
        found = files.glob(self.spark, f"{self.path}/_manifest/*.json")
        return json.loads(files.read_small(self.spark, found[-1])) if found else {"version": 0, "batch": -1, "buckets": self.buckets, "parts": {}, "rows": {}}

    def _load(self, parts: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*parts)

    def parts(self) -> dict[str, str]:
        """Current folder of each bucket."""
        return self._manifest()["parts"]

    def read(self, schema) -> DataFrame:
        parts = list(self.parts().values())
        return self._load(parts, schema) if parts else self.spark.createDataFrame([], schema)

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int"))

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        m = self._manifest()
        if batch is not None and batch <= m["batch"]:
            return False
        schema = rows.schema
        fresh = f"{self.path}/batch-{uuid.uuid4().hex}"
        latest_rows(rows, self.newest, self.key).write.parquet(fresh)  # the only pass over the batch
        while True:
            new = self.spark.read.schema(schema).parquet(fresh)
            buckets, have = m["buckets"], sum(m["rows"].values()) + new.count()
            while have > self.bucket_rows * buckets:
                buckets *= 2
            # one number for each bucket comes to the driver
            touched = {str(r[0]) for r in self._bucketed(new, buckets).select("_bucket").distinct().collect()}
            old = list(m["parts"].values()) if buckets > m["buckets"] else [m["parts"][b] for b in touched if b in m["parts"]]
            both = self._load(old, schema).unionByName(new) if old else new
            folder = f"{self.path}/v-{uuid.uuid4().hex}"
            # one shuffle: rows of a key are in one bucket, so the pick of the newest needs no other
            placed = self._bucketed(both, buckets).repartition("_bucket")
            latest_rows(placed, self.newest, self.key, within=["_bucket"]).write.partitionBy("_bucket").parquet(folder)
            written = {str(r[0]): r[1] for r in self.spark.read.parquet(folder).groupBy("_bucket").count().collect()} if touched else {}
            kept = {} if buckets > m["buckets"] else m
            state = {"version": m["version"] + 1, "batch": m["batch"] if batch is None else batch, "buckets": buckets,
                     "parts": dict(kept.get("parts", {})) | {b: f"{folder}/_bucket={b}" for b in written},
                     "rows": dict(kept.get("rows", {})) | written}
            if files.create_small(self.spark, f"{self.path}/_manifest/{state['version']:020d}.json", json.dumps(state)):
                return True
            m = self._manifest()
            if batch is not None and batch <= m["batch"]:
                return False


def import_results(per_job: DataFrame, batch: DataFrame, root: str = "work_root") -> tuple[DataFrame, DataFrame]:
    """(rows, runs): per-job results, or the batch list of a work root that has none."""
    valid = [d.filter(F.coalesce("job_id", F.lit("")) != "") for d in (per_job, batch)]
    spare = valid[1].join(valid[0].select(root).distinct(), root, "left_anti")
    rows = valid[0].unionByName(spare)
    # per-job files are counted by distinct job, batch items one by one
    a = valid[0].groupBy(root).agg(F.count_distinct("job_id").alias("job_count"))
    b = spare.groupBy(root).agg(F.count(F.lit(1)).alias("job_count"))
    return rows, a.unionByName(b).withColumn("ok_count", F.col("job_count"))


def merge_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Run ledger: the latest start of a run, with the latest finish after it."""
    s = top_one(starts, ["run_id"], F.col("created_at").desc(), F.col("seq").desc()).drop("seq")
    f = finishes.join(s.select("run_id", "created_at"), "run_id").filter(F.col("finished_at") >= F.col("created_at"))
    f = top_one(f.drop("created_at"), ["run_id"], F.col("finished_at").desc(), F.col("seq").desc()).drop("seq")
    out = s.join(f, "run_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("job_count", "ok_count")})


def ordered_columns(columns: list[str], preferred: list[str]) -> list[str]:
    first = [c for c in preferred if c in columns]
    return first + sorted(set(columns) - set(first))


def write_table(df: DataFrame, path: str, preferred: list[str]) -> list[str]:
    """The table as CSV and Parquet with the preferred columns first."""
    cols = ordered_columns(df.columns, preferred)
    out = df.select(*cols)
    out.write.option("header", True).csv(f"{path}/csv")
    out.write.parquet(f"{path}/parquet")
    return cols


# Columns of a published result.
PUBLISHED = ("job_id", "input_path", "crf", "libx265_params", "s_f", "vmaf", "vmaf_base", "compression_rate", "error")


def publish(results: DataFrame, path: str) -> None:
    """Slim results by threshold; the thresholds in the input are replaced as a whole."""
    (results.select(*PUBLISHED, F.col("vmaf_threshold").alias("threshold")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("threshold").parquet(path))


def published_summary(published: DataFrame) -> DataFrame:
    ok = F.col("crf").isNotNull() & (F.coalesce("error", F.lit("")) == "")
    return published.groupBy("threshold").agg(F.count(F.lit(1)).alias("job_count"), F.count_if(ok).alias("ok_count"))


def append_trials(cached: DataFrame, path: str, keys: list[str], schema) -> None:
    """Append the cached trials whose key is not in the log yet."""
    from trialspark.operators.trials import not_logged
    spark = cached.sparkSession
    rows = cached
    if files.exists(spark, path):
        rows = not_logged(cached, spark.read.schema(schema).json(path), keys)
    rows.write.mode("append").json(path)


def build_manifest(trials: DataFrame, labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Counts over the built tables: videos seen, videos with labels, rows of both."""
    seen = trials.select(key).unionByName(labels.select(key)).agg(F.count_distinct(key).alias("videos_seen"))
    t = trials.agg(F.count(F.lit(1)).alias("trial_rows"))
    lab = labels.agg(F.count(F.lit(1)).alias("label_rows"), F.count_distinct(key).alias("videos_with_oracle"))
    # three one-row tables
    out = None
    for name, df in (("videos_seen", seen), ("trial_rows", t), ("videos_with_oracle", lab), ("label_rows", lab)):
        row = df.select(F.lit(name).alias("measure"), F.col(name).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
