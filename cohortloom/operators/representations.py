"""Patient representations: passes for an external model, alignment by key, and prediction times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.dates import minute_before, minute_text
from cohortloom.functions.vectors import column_array

KEYS = ["drug_id", "person_id", "t0"]


def remaining_passes(index: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(pass_id, drug_id, person_id, t0, prediction_time) of instances not done: a person's n-th instance belongs to pass n, from 0."""
    rest = index.select(*KEYS)
    if done is not None:
        rest = rest.join(done.select(*KEYS).distinct(), KEYS, "left_anti")
    order = Window.partitionBy("person_id").orderBy("t0", "drug_id")
    return rest.select((F.row_number().over(order) - 1).cast("int").alias("pass_id"), *KEYS, minute_before(F.col("t0")).alias("prediction_time"))


def prediction_times(index: DataFrame, timepoint: str = "t0", person: str = "person_id") -> DataFrame:
    """Distinct (patient_id, prediction_time) as text to the minute, sorted; ``timepoint`` is t0, t_6m or t_12m, ``person`` the id column."""
    if timepoint not in ("t0", "t_6m", "t_12m"):
        raise ValueError(f"unknown timepoint {timepoint!r}")
    return index.select(F.col(person).cast("long").alias("patient_id"), minute_text(F.col(timepoint).cast("timestamp_ntz")).alias("prediction_time")).where("prediction_time is not null").distinct().orderBy("patient_id", "prediction_time")


def blood_draws(index: DataFrame, draws: DataFrame, least: float = 3.0, most: float = 24.0) -> DataFrame:
    """(eid, t0, blood_draw_date, months_to_draw) of starts (eid, t0) with a draw (eid, blood_draw_date) ``least`` to ``most`` months later, of 30.4375 days.

    Of several draws the earliest in that window counts. Null ids and days match nothing; repeated rows change nothing.
    """
    both = index.select("eid", "t0").distinct().join(draws.select("eid", "blood_draw_date"), "eid")
    both = both.withColumn("months_to_draw", F.datediff("blood_draw_date", "t0") / 30.4375).where(F.col("months_to_draw").between(least, most))
    first = F.min(F.struct("blood_draw_date", "months_to_draw"))
    return both.groupBy("eid", "t0").agg(first.alias("x")).select("eid", "t0", "x.*")


def inferred(times: DataFrame, model, width: int) -> DataFrame:
    """Representations (person_id, prediction_time, vec) by ``model``: it gets a pandas frame of rows (person_id, prediction_time), a batch at
    a time, and gives an array of ``width`` numbers for each. The model is sent to the workers and may load what it needs there."""

    def run(stream):
        for pdf in stream:
            if len(pdf):
                got = np.asarray(model(pdf), np.float32)
                if got.shape != (len(pdf), width):
                    raise ValueError(f"the model gave {got.shape}, not {(len(pdf), width)}")
                yield pdf.assign(vec=list(got))

    kinds = dict(times.dtypes)
    cols = ["person_id", "prediction_time"]
    return times.select(*cols).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", vec array<float>")


def dispatch(pass_rows: DataFrame, representations: DataFrame) -> DataFrame:
    """Representations of one pass given back to cohorts: (drug_id, person_id, t0, feature columns); a patient occurs once in a pass."""
    return pass_rows.select(*KEYS, F.col("person_id").alias("patient_id")).join(representations, "patient_id").drop("patient_id")


def dispatch_all(passes: DataFrame, representations: DataFrame) -> DataFrame:
    """The same for all passes at once: ``representations`` has pass_id, patient_id and the feature columns."""
    rows = passes.select("pass_id", *KEYS, F.col("person_id").alias("patient_id"))
    return rows.join(representations, ["pass_id", "patient_id"]).drop("pass_id", "patient_id", "prediction_time")


def merged(existing: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Union with one row per key; the new row wins."""
    both = existing.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("gen"))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "gen")


def aligned(index: DataFrame, features: DataFrame, keys: list[str] = ["person_id", "t0"], name: str = "vec") -> DataFrame:
    """Index rows with their feature array, by key; rows without features are left out and counted by ``missing``."""
    cols = [c for c in features.columns if c not in keys]
    wide = any(c.startswith(("data_", "emb_")) for c in cols)
    vec = column_array(features) if wide else F.array(*[F.col(c) for c in cols])
    return index.join(features.select(*keys, vec.cast("array<float>").alias(name)), keys)


def missing(index: DataFrame, features: DataFrame, keys: list[str] = ["person_id", "t0"]) -> DataFrame:
    return index.join(features.select(*keys), keys, "left_anti").groupBy("drug_id").agg(F.count("*").alias("n_missing"))
