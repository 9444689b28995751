"""New-user cohorts of all drugs in one set-based plan.

An exposure is new if the person's previous exposure to the same ingredient lies more than the wash-out
before it. That does not depend on the target drug, so one window per (person, ingredient) serves all targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.config import Protocol
from cohortloom.functions.ids import pair_id

INDEX = ["person_id", "t0", "t_6m", "t_12m", "history_days_prior", "follow_up_days", "has_12m_followup"]


@dataclass(frozen=True)
class Steps:
    """Every candidate with the outcome of each step, how many drugs began on its t0, and the smallest and largest of them."""

    candidates: DataFrame


def screen(exposures: DataFrame, observation: DataFrame, protocol: Protocol = Protocol(), comparators: DataFrame | None = None) -> Steps:
    """Candidates of all targets: first mono exposure ever, observation window, wash-out and what else began that day.

    ``exposures``: person_id, exp_date, ingredient_id, is_monotherapy (a bag; rows with a null among the first
    three do not count). ``observation``: person_id, obs_start, obs_end. ``comparators``, if given, has
    (ingredient_id, comparator_id): persons exposed to one in the wash-out are dropped as well.

    Repeated exposures merge before the first shuffle, which spreads a hot person over all tasks; what is left of a
    person, one row per drug and day, then meets once, and both windows and the join work on that partitioning.
    """
    rows = exposures.where("person_id is not null and exp_date is not null and ingredient_id is not null").select("person_id", "ingredient_id", "exp_date", "is_monotherapy")
    days = rows.groupBy("person_id", "ingredient_id", "exp_date").agg(F.bool_and("is_monotherapy").alias("all_mono"), F.bool_or("is_monotherapy").alias("any_mono")).repartition("person_id")
    line = Window.partitionBy("person_id", "ingredient_id").orderBy("exp_date")
    whole = Window.partitionBy("person_id", "ingredient_id")
    together = Window.partitionBy("person_id", "exp_date")
    days = days.withColumn("before", F.lag("exp_date").over(line)).withColumn("t0", F.min(F.when(F.col("any_mono"), F.col("exp_date"))).over(whole))
    days = days.withColumn("is_new", F.col("before").isNull() | (F.col("before") < F.date_sub("exp_date", protocol.washout_days)))
    new = lambda c: F.when(F.col("is_new"), F.col(c))
    days = days.withColumns(
        {
            "n_new": F.count(new("ingredient_id")).over(together), "new_mono": F.bool_and(new("all_mono")).over(together),
            "new_low": F.min(new("ingredient_id")).over(together), "new_high": F.max(new("ingredient_id")).over(together),
        }
    )
    first = days.where(F.col("exp_date") == F.col("t0"))
    seen = observation.groupBy("person_id", "obs_start", "obs_end").count().drop("count")
    history, ahead = F.datediff("t0", "obs_start"), F.datediff("obs_end", "t0")
    inside = F.col("t0").between(F.col("obs_start"), F.col("obs_end")) & (history >= protocol.history_days) & (ahead >= protocol.follow_up_days)
    cand = first.join(seen, "person_id", "left").withColumn("observed", F.coalesce(inside, F.lit(False))).select(
        F.col("ingredient_id").alias("drug_id"), "person_id", "t0", F.date_add("t0", 182).alias("t_6m"), F.date_add("t0", 365).alias("t_12m"),
        history.cast("int").alias("history_days_prior"), ahead.cast("int").alias("follow_up_days"), (ahead >= protocol.full_follow_up_days).alias("has_12m_followup"),
        "observed", (F.col("observed") & F.col("is_new")).alias("washed"), "n_new", F.coalesce("new_mono", F.lit(True)).alias("all_mono"), "new_low", "new_high",
    )
    if comparators is not None:
        hit = (
            cand.where("washed").select("drug_id", "person_id", "t0")
            .join(comparators.select(F.col("ingredient_id").alias("drug_id"), "comparator_id").distinct(), "drug_id")
            .join(rows.select("person_id", F.col("ingredient_id").alias("comparator_id"), "exp_date").distinct(), ["person_id", "comparator_id"])
            .where((F.col("exp_date") >= F.date_sub("t0", protocol.washout_days)) & (F.col("exp_date") < F.col("t0")))
            .select("drug_id", "person_id", "t0").distinct().withColumn("leak", F.lit(True))
        )
        cand = cand.join(hit, ["drug_id", "person_id", "t0"], "left").withColumn("washed", F.col("washed") & F.col("leak").isNull()).drop("leak")
    return Steps(cand)


def mono_cohorts(steps: Steps) -> DataFrame:
    """(drug_id, index columns): nothing but the target began on t0, as a single-ingredient product."""
    return steps.candidates.where("washed and n_new = 1 and all_mono").select("drug_id", *INDEX)


def attrition(steps: Steps) -> DataFrame:
    """(drug_id, step, n) of the four labelled steps, in one pass."""
    c = steps.candidates.groupBy("drug_id").agg(
        F.count("*").alias("n1"), F.count_if("observed").alias("n2"), F.count_if("washed").alias("n3"), F.count_if(F.expr("washed and n_new = 1 and all_mono")).alias("n4")
    )
    labels = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"n{i}").alias("n")) for i, s in enumerate(("candidate", "observed", "washed_out", "monotherapy"), 1)])
    return c.select("drug_id", F.explode(labels).alias("x")).select("drug_id", "x.step", "x.n")


def pair_members(steps: Steps) -> DataFrame:
    """Two drugs began on t0, both as single-ingredient products: (drug_id, other_id, index columns)."""
    two = steps.candidates.where("washed and n_new = 2 and all_mono")
    other = F.when(F.col("drug_id") == F.col("new_low"), F.col("new_high")).otherwise(F.col("new_low"))
    return two.select("drug_id", other.alias("other_id"), *INDEX)


def pair_cohorts(members: DataFrame, names: DataFrame | None = None, least: int = 50) -> DataFrame:
    """Cohorts of unordered pairs with at least ``least`` persons, one row a person: of a person found from both sides
    the row of the target with the larger id, then the later t0, stays. Adds pair_id and name."""
    low, high = F.least("drug_id", "other_id"), F.greatest("drug_id", "other_id")
    last = Window.partitionBy("ing_a", "ing_b", "person_id").orderBy(F.desc("drug_id"), F.desc("t0"))
    one = members.withColumns({"ing_a": low, "ing_b": high}).withColumn("r", F.row_number().over(last)).where("r = 1")
    big = one.groupBy("ing_a", "ing_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = one.join(big, ["ing_a", "ing_b"]).withColumn("pair_id", pair_id(F.col("ing_a"), F.col("ing_b")))
    if names is not None:
        for side in "ab":
            out = out.join(names.select(F.col("drug_id").alias(f"ing_{side}"), F.col("name").alias(f"name_{side}")), f"ing_{side}", "left")
    else:
        out = out.withColumns({"name_a": F.lit(None).cast("string"), "name_b": F.lit(None).cast("string")})
    label = F.concat(F.coalesce("name_a", F.col("ing_a").cast("string")), F.lit(" + "), F.coalesce("name_b", F.col("ing_b").cast("string")), F.lit(" (De Facto)"))
    return out.select("pair_id", "ing_a", "ing_b", label.alias("name"), *INDEX)


def manifest(index: DataFrame, names: DataFrame, kind: str = "monotherapy") -> DataFrame:
    """(drug_id, drug_name, kind, n_final, n_with_12m_followup, status) of every drug in ``names``, the empty ones too."""
    got = index.groupBy("drug_id").agg(F.count("*").alias("n_final"), F.count_if("has_12m_followup").alias("n_with_12m_followup"))
    out = names.select("drug_id", F.col("name").alias("drug_name")).join(got, "drug_id", "left").fillna(0, ["n_final", "n_with_12m_followup"])
    return out.select("drug_id", "drug_name", F.lit(kind).alias("kind"), "n_final", "n_with_12m_followup", F.when(F.col("n_final") > 0, "SAVED").otherwise("ZERO_PATIENT").alias("status"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by drug_id; largest first."""
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("drug_id").orderBy(F.desc("gen"), F.desc("n_final"))
    return both.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "gen").orderBy(F.desc("n_final"), "drug_id")


def remaining(queue: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Drugs still to be done: those without a manifest row, in order of id."""
    rest = queue.join(done.select("drug_id"), "drug_id", "left_anti").orderBy("drug_id")
    return rest if limit is None else rest.limit(limit)


def retention(manifest_rows: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Share of persons with twelve months of follow-up, in percent, and, given (drug_id, n_raw_candidates), of raw candidates kept."""
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 2)).otherwise(0.0)
    out = manifest_rows.withColumn("retention_12m_pct", share("n_with_12m_followup", "n_final"))
    return out if raw is None else out.join(raw, "drug_id", "left").withColumn("retention_rate_pct", F.coalesce(share("n_final", "n_raw_candidates"), F.lit(0.0)))


def family_comparators(drugs: DataFrame) -> DataFrame:
    """(ingredient_id, comparator_id): other drugs of the same five-letter ATC family; ``drugs`` has drug_id, atc.

    The bridge is as long as families are large, as a family of n drugs has n (n - 1) comparators.
    """
    fam = drugs.where("atc is not null").select("drug_id", F.substring(F.upper("atc"), 1, 5).alias("family"))
    other = fam.select(F.col("drug_id").alias("comparator_id"), "family")
    return fam.join(other, "family").where("drug_id != comparator_id").select(F.col("drug_id").alias("ingredient_id"), "comparator_id").distinct()
