"""Validity audits of cohorts, all drugs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import Protocol


def manifest_matches(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """T0: saved cohorts whose rows differ from the manifest."""
    n = index.groupBy("drug_id").agg(F.count("*").alias("n_rows"))
    return manifest.where("status = 'SAVED'").join(n, "drug_id", "left").select("drug_id", "n_final", F.coalesce("n_rows", F.lit(0)).alias("n_rows")).where("n_final != n_rows")


def duplicate_persons(index: DataFrame) -> DataFrame:
    """T1: rows beyond one per person."""
    return index.groupBy("drug_id").agg((F.count("*") - F.count_distinct("person_id")).alias("n_duplicates"))


def window_violations(index: DataFrame, observation: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """T2: persons outside their observation, with too little history or follow-up, or a wrong twelve-month flag."""
    j = index.join(observation, "person_id", "left")
    before, ahead = F.datediff("t0", "obs_start"), F.datediff("obs_end", "t0")
    return j.groupBy("drug_id").agg(
        F.count_if(~F.coalesce(F.col("t0").between(F.col("obs_start"), F.col("obs_end")), F.lit(False))).alias("n_outside"), F.count_if(before < protocol.history_days).alias("n_short_history"),
        F.count_if(ahead < protocol.follow_up_days).alias("n_short_follow_up"), F.count_if(F.col("has_12m_followup") != (ahead >= protocol.full_follow_up_days)).alias("n_wrong_flag"),
    )


def washout_leaks(index: DataFrame, exposures: DataFrame, comparators: DataFrame | None = None, protocol: Protocol = Protocol()) -> DataFrame:
    """T3, T4: persons exposed to the target (or a comparator) within the wash-out before t0."""
    target = index.select("drug_id", "person_id", "t0", F.col("drug_id").alias("ingredient_id"))
    if comparators is not None:
        target = index.select("drug_id", "person_id", "t0").join(comparators.select(F.col("ingredient_id").alias("drug_id"), F.col("comparator_id").alias("ingredient_id")), "drug_id")
    hit = target.join(exposures.select("person_id", "ingredient_id", "exp_date"), ["person_id", "ingredient_id"]).where((F.col("exp_date") >= F.date_sub("t0", protocol.washout_days)) & (F.col("exp_date") < F.col("t0")))
    return hit.groupBy("drug_id").agg(F.count_distinct("person_id").alias("n_leaks"))


def coinitiations(index: DataFrame, exposures: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """T5: persons who began another drug on t0, one they had not taken within the wash-out."""
    e = exposures.select("person_id", "ingredient_id", "exp_date").distinct()
    on_day = index.select("drug_id", "person_id", "t0").join(e, "person_id").where("exp_date = t0 and ingredient_id != drug_id").drop("exp_date")
    past = on_day.join(e, ["person_id", "ingredient_id"]).where((F.col("exp_date") >= F.date_sub("t0", protocol.washout_days)) & (F.col("exp_date") < F.col("t0"))).drop("exp_date").distinct()
    return on_day.join(past, ["drug_id", "person_id", "t0", "ingredient_id"], "left_anti").groupBy("drug_id").agg(F.count_distinct("person_id").alias("n_coinitiations"))


def demographics(index: DataFrame, person: DataFrame, female: int = 8532) -> DataFrame:
    """T6: age at t0 and sex; minors and impossible ages are counted."""
    age = F.year("t0") - F.col("year_of_birth")
    return index.join(person, "person_id").withColumn("age", age).groupBy("drug_id").agg(
        F.count("*").alias("n"), F.round(F.avg("age"), 1).alias("mean_age"), F.percentile("age", 0.5).alias("median_age"), F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        F.count_if(F.col("age") < 18).alias("n_minors"), F.count_if((F.col("age") < 0) | (F.col("age") > 110)).alias("n_impossible"),
        F.round(F.count_if(F.col("gender_concept_id") == female) * 100.0 / F.count("*"), 1).alias("pct_female"),
    )


def calendar(index: DataFrame) -> DataFrame:
    """T7: inclusions per year."""
    return index.groupBy("drug_id", F.year("t0").alias("year")).agg(F.count("*").alias("n"))


def calendar_summary(index: DataFrame) -> DataFrame:
    """First, last and busiest year (the earliest of equal ones)."""
    y = calendar(index)
    return y.groupBy("drug_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(F.struct((-F.col("n")).alias("n"), "year")).getField("year").alias("peak_year"))


def pick_column(df: DataFrame, *candidates: str) -> str:
    """First of the candidate names that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")
