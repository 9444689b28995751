"""Writers of the study's outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources import files


def parquet(df: DataFrame, path: str, *, partition: str | None = None, compression: str = "zstd", mode: str = "overwrite") -> None:
    """Parquet, optionally one folder per value of ``partition``; rows of a value are brought together first, large ones by AQE in several files."""
    if partition:
        df = df.hint("rebalance", partition)
        df.write.mode(mode).option("compression", compression).partitionBy(partition).parquet(path)
    else:
        df.write.mode(mode).option("compression", compression).parquet(path)


def sorted_csv(df: DataFrame, path: str, *order: str, most: int = 5_000_000) -> None:
    """A table as one sorted CSV file with header. One file is one task: more than ``most`` rows are refused."""
    if df.count() > most:
        raise ValueError(f"more than {most} rows are too many for one sorted file")
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def fasta(df: DataFrame, path: str) -> None:
    """Header and one-line sequence of each record."""
    df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence"))).write.mode("overwrite").text(path)


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Rewrite a table that ``df`` may itself read: write beside it, then swap."""
    new, old = f"{path}__new", f"{path}__old"
    parquet(df, new)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(conf)
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)


def cohort(spark: SparkSession, path: str, meta: dict, **tables: DataFrame) -> None:
    """A cohort folder: metadata.json and one Parquet table per artefact."""
    for name, df in tables.items():
        parquet(df, files.join(path, name))
    files.write_text(spark, files.join(path, "metadata.json"), json.dumps(meta, indent=1))
