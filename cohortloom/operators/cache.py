"""Raw exports trimmed to typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dates import date_or_null, double_or_null, imputed_end, int_or_null, long_or_null
from cohortloom.functions.ids import in_sample


def trim_observation(raw: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(person_id, obs_start, obs_end): first start and last end of each person; gaps between periods are not kept."""
    rows = raw.select(long_or_null(F.col("person_id")).alias("person_id"), date_or_null(F.col("observation_period_start_date")).alias("a"), date_or_null(F.col("observation_period_end_date")).alias("b"))
    return rows.where(F.col("person_id").isNotNull() & in_sample(F.col("person_id"), ratio)).groupBy("person_id").agg(F.min("a").alias("obs_start"), F.max("b").alias("obs_end"))


def trim_exposure(raw: DataFrame, mapping: DataFrame, base: DataFrame, *, with_end_date: bool = False) -> DataFrame:
    """Exposures of base persons: one row per ingredient of the product, or, ``with_end_date``, one per exposure with an end that is given or imputed."""
    start = date_or_null(F.col("drug_exposure_start_date"))
    cols = [long_or_null(F.col("person_id")).alias("person_id"), long_or_null(F.col("drug_concept_id")).alias("drug_concept_id"), start.alias("exp_date")]
    if with_end_date:
        cols.append(imputed_end(start, date_or_null(F.col("drug_exposure_end_date")), int_or_null(F.col("days_supply"))).alias("end_date"))
    rows = raw.select(*cols).where("exp_date is not null").join(base.select("person_id"), "person_id", "left_semi")
    if with_end_date:
        return rows.join(mapping.select("drug_concept_id"), "drug_concept_id", "left_semi").select("person_id", "drug_concept_id", "exp_date", "end_date")
    return rows.join(mapping, "drug_concept_id").select("person_id", "drug_concept_id", "exp_date", "ingredient_id", "is_monotherapy")


def trim_measurement(raw: DataFrame, codebook: DataFrame) -> DataFrame:
    """Measurements of the codebook's concepts that hold a number."""
    typed = raw.select(
        long_or_null(F.col("person_id")).alias("person_id"), date_or_null(F.col("measurement_date")).alias("measurement_date"),
        long_or_null(F.col("measurement_concept_id")).alias("measurement_concept_id"), double_or_null(F.col("value_as_number")).alias("value_as_number"),
    )
    return typed.where("value_as_number is not null").join(codebook.select(F.col("concept_id").alias("measurement_concept_id")).distinct(), "measurement_concept_id", "left_semi").select(*typed.columns)
