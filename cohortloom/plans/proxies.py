"""Views of the test tables in the shapes that the cohort operators read, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import load

EXPOSURE_SQL = """
SELECT o_custkey AS person_id, l_partkey AS drug_concept_id, CAST(o_orderdate AS DATE) AS exp_date,
       CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS ingredient_id, p_type <> 'PROMO' AS is_monotherapy
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"""
OBSERVATION_SQL = "SELECT o_custkey AS person_id, min(CAST(o_orderdate AS DATE)) AS obs_start, max(CAST(o_orderdate AS DATE)) AS obs_end FROM orders GROUP BY o_custkey"
ANCESTOR_SQL = "SELECT DISTINCT l_suppkey AS ancestor_concept_id, l_partkey AS descendant_concept_id FROM lineitem WHERE l_quantity >= 49"
AFFINITY_SQL = """
SELECT CAST(l_partkey AS VARCHAR) AS drug_chembl_id, CAST(l_suppkey AS VARCHAR) AS uniprot_id,
       CASE l_returnflag WHEN 'R' THEN 'Kd' WHEN 'A' THEN 'Ki' ELSE 'IC50' END AS standard_type, l_extendedprice AS min_affinity_nm FROM lineitem"""
EVENT_INDEX_SQL = "SELECT CAST(1 AS BIGINT) AS drug_id, user_id AS person_id, min(CAST(ts AS DATE)) AS t0 FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' GROUP BY user_id"
EVENT_VALUE_SQL = "SELECT user_id AS person_id, CAST(ts AS DATE) AS measurement_date, event_type AS biomarker, value AS val FROM events WHERE value BETWEEN 0.05 AND 400"

EVENT_WINDOWS = {"baseline": (-4, 0), "m6": (5, 9), "m12": (12, 18)}
EVENT_AIMS = {"baseline": 0, "m6": 7, "m12": 15}


def exposure(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("exp_date"))
    p = load(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("ingredient_id"), (F.col("p_type") != "PROMO").alias("is_monotherapy"))
    item = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return item.join(p, item.l_partkey == p.p_partkey).join(o, item.l_orderkey == o.o_orderkey).select("person_id", F.col("l_partkey").alias("drug_concept_id"), "exp_date", "ingredient_id", "is_monotherapy")


def observation(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.min(day).alias("obs_start"), F.max(day).alias("obs_end"))


def drug_names(spark: SparkSession, d: str) -> DataFrame:
    brand = load(spark, d, "part").select("p_brand").distinct()
    return brand.select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("drug_id"), F.col("p_brand").alias("name"))


def comparators(spark: SparkSession, d: str) -> DataFrame:
    """Two comparators of each of the 25 targets."""
    ids = drug_names(spark, d).select(F.col("drug_id").alias("i"))
    return ids.select(F.col("i").alias("ingredient_id"), F.explode(F.array(F.col("i") % 25 + 1, (F.col("i") + 6) % 25 + 1)).alias("comparator_id"))


def ancestor(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("ancestor_concept_id"), F.col("l_partkey").alias("descendant_concept_id")).distinct()


def supplier_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("concept_name"))


def affinity(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "Kd").when(F.col("l_returnflag") == "A", "Ki").otherwise("IC50")
    return load(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("drug_chembl_id"), F.col("l_suppkey").cast("string").alias("uniprot_id"), kind.alias("standard_type"), F.col("l_extendedprice").alias("min_affinity_nm"))


def event_index(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("event_type = 'purchase' and ts >= timestamp_ntz'2024-01-05 00:00:00'")
    return e.groupBy(F.col("user_id").alias("person_id")).agg(F.min(F.to_date("ts")).alias("t0")).select(F.lit(1).cast("long").alias("drug_id"), "person_id", "t0")


def event_values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where("value between 0.05 and 400").select(F.col("user_id").alias("person_id"), F.to_date("ts").alias("measurement_date"), F.col("event_type").alias("biomarker"), F.col("value").alias("val"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """final_pairs as outcomes: the first recorded row of each (drug, person, biomarker), NaN as null."""
    vals = [F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in ("baseline_val", "m6_val", "m12_val")]
    rows = load(spark, d, "final_pairs").select("pair_id", "drug_id", "person_id", "biomarker", *vals)
    first = rows.groupBy("drug_id", "person_id", "biomarker").agg(F.min_by(F.struct("baseline_val", "m6_val", "m12_val"), "pair_id").alias("x"))
    return first.select("drug_id", "person_id", "biomarker", "x.*")


OUTCOME_SQL = """
SELECT drug_id, person_id, biomarker, baseline_val, m6_val, m12_val, m6_val - baseline_val AS delta_6m, m12_val - baseline_val AS delta_12m,
       m6_val IS NOT NULL AND baseline_val IS NOT NULL AS has_pair_6m, m12_val IS NOT NULL AND baseline_val IS NOT NULL AS has_pair_12m
FROM final_pairs QUALIFY row_number() OVER (PARTITION BY drug_id, person_id, biomarker ORDER BY pair_id) = 1"""
