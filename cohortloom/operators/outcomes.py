"""Nearest-in-window outcome measurements, their changes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.dates import window_name
from cohortloom.session import small

#: Days after t0, both ends included, and the day each window aims at.
WINDOWS = {"baseline": (-90, 0), "m6": (120, 240), "m12": (300, 420)}
AIMS = {"baseline": 0, "m6": 182, "m12": 365}


def plausible(measurements: DataFrame, codebook: DataFrame) -> DataFrame:
    """(person_id, measurement_date, biomarker, val) inside the codebook's ranges."""
    book = codebook.select(F.col("concept_id").alias("measurement_concept_id"), "biomarker", "lo", "hi")
    return (
        measurements.join(small(book), "measurement_concept_id").where(F.col("value_as_number").between(F.col("lo"), F.col("hi")))
        .select("person_id", "measurement_date", "biomarker", F.col("value_as_number").alias("val"))
    )


def windowed_outcomes(index: DataFrame, values: DataFrame, windows: dict[str, tuple[int, int]] = WINDOWS, aims: dict[str, int] = AIMS) -> DataFrame:
    """(drug_id, person_id, biomarker, one value per window, deltas, pair flags) where at least one window has a value.

    Of a window the value nearest to its aim wins, then the later day, then the smaller value; an
    aggregate picks it, so nothing is sorted. Non-null persons and days only.
    """
    low, high = min(w[0] for w in windows.values()), max(w[1] for w in windows.values())
    # a value lies in one stretch of days, a start reaches a few: persons with very many of either are spread over time
    stretch = lambda c: F.floor(c / F.lit(max(1, high - low)))
    start = F.unix_date("t0")
    seeks = index.select("drug_id", "person_id", "t0").where("t0 is not null").withColumn("stretch", F.explode(F.sequence(stretch(start + low), stretch(start + high))))
    held = values.where("measurement_date is not null and val is not null").withColumn("stretch", stretch(F.unix_date("measurement_date")))
    near = seeks.join(held, ["person_id", "stretch"])
    gap = F.datediff("measurement_date", "t0")
    near = near.where(gap.between(low, high)).withColumn("win", window_name(F.col("measurement_date"), F.col("t0"), windows)).where("win is not null")
    picks = []
    for name, aim in aims.items():
        order = F.struct(F.abs(gap - aim).alias("far"), (-gap).alias("early"), F.col("val").alias("val"))
        picks.append(F.min(F.when(F.col("win") == name, order)).getField("val").alias(f"{name}_val"))
    return with_deltas(near.groupBy("drug_id", "person_id", "biomarker").agg(*picks))


def with_deltas(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "delta_6m": F.col("m6_val") - F.col("baseline_val"), "delta_12m": F.col("m12_val") - F.col("baseline_val"),
            "has_pair_6m": F.col("m6_val").isNotNull() & F.col("baseline_val").isNotNull(), "has_pair_12m": F.col("m12_val").isNotNull() & F.col("baseline_val").isNotNull(),
        }
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per drug and biomarker: values of each window and complete pairs."""
    return outcomes.groupBy("drug_id", "biomarker").agg(
        F.count("baseline_val").alias("n_baseline"), F.count("m6_val").alias("n_m6"), F.count("m12_val").alias("n_m12"),
        F.count_if("has_pair_6m").alias("n_complete_pair_6m"), F.count_if("has_pair_12m").alias("n_complete_pair_12m"),
    )


def completeness(outcomes: DataFrame, cohort_sizes: DataFrame) -> DataFrame:
    """Counts, percent of the cohort, mean baseline and median change at six months per drug and biomarker; ``cohort_sizes`` has drug_id, n."""
    agg = outcomes.groupBy("drug_id", "biomarker").agg(
        F.count("baseline_val").alias("n_baseline"), F.count_if("has_pair_6m").alias("n_pair_6m"), F.count_if("has_pair_12m").alias("n_pair_12m"),
        F.avg("baseline_val").alias("mean_baseline"), F.percentile("delta_6m", 0.5).alias("median_delta_6m"),
    )
    pct = lambda c: F.col(c) * 100.0 / F.col("n")
    return agg.join(cohort_sizes.select("drug_id", "n"), "drug_id").select(
        "drug_id", "biomarker", "n", "n_baseline", pct("n_baseline").alias("pct_baseline"), "n_pair_6m", pct("n_pair_6m").alias("pct_pair_6m"), "n_pair_12m", pct("n_pair_12m").alias("pct_pair_12m"),
        "mean_baseline", "median_delta_6m",
    )


def deduplicated(outcomes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return outcomes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
