"""Small text files and folders on any file system that Spark knows, by Hadoop's API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from cohortloom.session import ensure_checkpoint_dir


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def join(*parts: str) -> str:
    """Path or URI of the parts; a scheme such as s3:// is kept as it is."""
    first, *rest = (str(p) for p in parts)
    return "/".join([first.rstrip("/") if first.strip("/") else first, *[r.strip("/") for r in rest]])


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"scratch-{uuid.uuid4().hex}")
