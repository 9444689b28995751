"""Incremental trimming of new measurement shards: the batch operator, run on each micro-batch of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.cache import trim_measurement
from cohortloom.sources.readers import strings

COLUMNS = ("person_id", "measurement_date", "measurement_concept_id", "value_as_number")


def measurement_stream(spark: SparkSession, folder: str, codebook: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the trimmed rows of CSV shards that arrive in ``folder`` to Parquet in ``out``, each shard exactly once; ends when all are read."""
    raw = spark.readStream.schema(strings(*COLUMNS)).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(folder)
    return trim_measurement(raw, codebook).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
