"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "trialspark", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators were written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        # larger methods are not JIT-compiled; split projections run faster
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **(extra or {}),
    }
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written tables: the checkpoint folder the cluster names.

    Only where none is set (tests on one machine) a local folder is taken.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/trialspark"
    if spark.sparkContext.master.startswith("local"):
        base = os.environ.get("TRIALSPARK_SCRATCH")
        if not base:
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            os.environ["TRIALSPARK_SCRATCH"] = base
        return "file:" + base
    raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing there is ever overwritten."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage where a costly result (parsed text) feeds several branches;
    the copy is columnar, so each branch reads only the columns it needs, and it
    outlives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
