"""Small file-system helpers over the session's Hadoop file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern (metadata only)."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in found) if found else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_small(spark: SparkSession, path: str) -> str:
    """A control file of a few kilobytes."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_small(spark: SparkSession, path: str, text: str) -> bool:
    """Write a control file under a name that must be new; False if another writer took it first."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    ctx = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        ctx.rename(tmp, p, none)
        return True
    except Py4JJavaError:
        if not fs.exists(p):
            raise
        fs.delete(tmp, False)
        return False
