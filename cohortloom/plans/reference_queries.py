"""Queries of the cohort operators over the test tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import Screening
from cohortloom.functions import dates as D
from cohortloom.functions import ids as I
from cohortloom.functions import text as T
from cohortloom.functions import vectors as V
from cohortloom.operators import audit, cache, catalog, cohorts, features, outcomes, pairs, representations, stats, targets, vocabulary
from cohortloom.plans import proxies as X
from cohortloom.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- cohorts

_BASE = f"""
WITH e AS ({X.EXPOSURE_SQL}), o AS ({X.OBSERVATION_SQL}),
cand AS (SELECT ingredient_id AS drug_id, person_id, min(exp_date) AS t0 FROM e WHERE is_monotherapy GROUP BY 1, 2),
obs AS (SELECT c.*, date_diff('day', obs_start, t0) AS h, date_diff('day', t0, obs_end) AS f FROM cand c JOIN o USING (person_id)
        WHERE t0 BETWEEN obs_start AND obs_end AND date_diff('day', obs_start, t0) >= 365 AND date_diff('day', t0, obs_end) >= 182),
past AS (SELECT DISTINCT drug_id, obs.person_id, ingredient_id FROM obs JOIN e ON e.person_id = obs.person_id AND exp_date >= t0 - 365 AND exp_date < t0),
washed AS (SELECT * FROM obs WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.drug_id = obs.drug_id AND p.person_id = obs.person_id AND p.ingredient_id = obs.drug_id)
           {{comparators}}),
began AS (SELECT w.drug_id, w.person_id, w.t0, w.h, w.f, e.ingredient_id, e.is_monotherapy FROM washed w JOIN e ON e.person_id = w.person_id AND e.exp_date = w.t0
          WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.drug_id = w.drug_id AND p.person_id = w.person_id AND p.ingredient_id = e.ingredient_id)),
n AS (SELECT drug_id, person_id, count(DISTINCT ingredient_id) AS n_new, bool_and(is_monotherapy) AS mono FROM began GROUP BY 1, 2),
mono AS (SELECT w.* FROM washed w JOIN n USING (drug_id, person_id) WHERE n_new = 1 AND mono)
"""
_PLAIN = _BASE.format(comparators="")
_COLS = (
    "{t}drug_id, {t}person_id, {t}t0, {t}t0 + 182 AS t_6m, {t}t0 + 365 AS t_12m, CAST({t}h AS INTEGER) AS history_days_prior, CAST({t}f AS INTEGER) AS follow_up_days, {t}f >= 365 AS has_12m_followup"
)
_PAIR = "SELECT DISTINCT w.drug_id, b.ingredient_id AS other_id, w.person_id, w.t0, w.h, w.f FROM washed w JOIN n USING (drug_id, person_id) JOIN began b ON b.drug_id = w.drug_id AND b.person_id = w.person_id AND b.ingredient_id <> w.drug_id WHERE n_new = 2 AND mono"


def _steps(spark: SparkSession, d: str, comparators: DataFrame | None = None) -> cohorts.Steps:
    return cohorts.screen(X.exposure(spark, d), X.observation(spark, d), comparators=comparators)


@query(_PLAIN + "SELECT " + _COLS.format(t="") + " FROM mono")
def cohort_mono(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.mono_cohorts(_steps(spark, d))


@query(
    _PLAIN
    + """SELECT drug_id, 'candidate' AS step, count(*) AS n FROM cand GROUP BY 1
UNION ALL SELECT c.drug_id, 'observed', count(o.person_id) FROM cand c LEFT JOIN obs o USING (drug_id, person_id) GROUP BY 1
UNION ALL SELECT c.drug_id, 'washed_out', count(o.person_id) FROM cand c LEFT JOIN washed o USING (drug_id, person_id) GROUP BY 1
UNION ALL SELECT c.drug_id, 'monotherapy', count(o.person_id) FROM cand c LEFT JOIN mono o USING (drug_id, person_id) GROUP BY 1"""
)
def cohort_attrition(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.attrition(_steps(spark, d))


_COMPARED = _BASE.format(comparators="AND NOT EXISTS (SELECT 1 FROM past p WHERE p.drug_id = obs.drug_id AND p.person_id = obs.person_id AND p.ingredient_id IN (obs.drug_id % 25 + 1, (obs.drug_id + 6) % 25 + 1))")


@query(_COMPARED + "SELECT " + _COLS.format(t="") + " FROM mono")
def cohort_mono_comparators(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.mono_cohorts(_steps(spark, d, X.comparators(spark, d)))


@query(_PLAIN + ", p AS (" + _PAIR + ") SELECT other_id, " + _COLS.format(t="") + " FROM p")
def cohort_pair_members(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.pair_members(_steps(spark, d))


@query(
    _PLAIN
    + ", p AS ("
    + _PAIR
    + """), u AS (SELECT *, least(drug_id, other_id) AS a, greatest(drug_id, other_id) AS b FROM p
     QUALIFY row_number() OVER (PARTITION BY least(drug_id, other_id), greatest(drug_id, other_id), person_id ORDER BY drug_id DESC) = 1),
z AS (SELECT *, count(*) OVER (PARTITION BY a, b) AS size FROM u)
SELECT CAST(('0x' || substr(md5(a || '_' || b), 1, 12)) AS BIGINT) % 1000000000000 + 9000000000000 AS pair_id, a AS ing_a, b AS ing_b,
       'Brand#' || a || ' + ' || 'Brand#' || b || ' (De Facto)' AS name, person_id, t0, t0 + 182 AS t_6m, t0 + 365 AS t_12m, CAST(h AS INTEGER) AS history_days_prior, CAST(f AS INTEGER) AS follow_up_days, f >= 365 AS has_12m_followup
FROM z WHERE size >= 5"""
)
def cohort_pair_export(spark: SparkSession, d: str) -> DataFrame:
    names = X.drug_names(spark, d).select("drug_id", F.concat(F.lit("Brand#"), F.col("drug_id").cast("string")).alias("name"))
    return cohorts.pair_cohorts(cohorts.pair_members(_steps(spark, d)), names, least=5)


_MANIFEST = """, m AS (SELECT drug_id, count(*) AS n_final, count(*) FILTER (WHERE f >= 365) AS n12 FROM mono GROUP BY 1),
d AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS drug_id, p_brand AS drug_name FROM part),
man AS (SELECT drug_id, drug_name, 'monotherapy' AS kind, coalesce(n_final, 0) AS n_final, coalesce(n12, 0) AS n_with_12m_followup,
        CASE WHEN coalesce(n_final, 0) > 0 THEN 'SAVED' ELSE 'ZERO_PATIENT' END AS status FROM d LEFT JOIN m USING (drug_id))
"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.manifest(cohort_mono(spark, d), X.drug_names(spark, d))


@query(_PLAIN + _MANIFEST + "SELECT * FROM man")
def cohort_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


@query(_PLAIN + _MANIFEST + "SELECT drug_id, n_final, CASE WHEN n_final > 0 THEN round(n_with_12m_followup / n_final * 100, 2) ELSE 0.0 END AS retention_12m_pct, CASE WHEN n_raw > 0 THEN round(n_final / n_raw * 100, 2) ELSE 0.0 END AS retention_rate_pct FROM man LEFT JOIN (SELECT drug_id, count(*) AS n_raw FROM cand GROUP BY 1) USING (drug_id)")
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    raw = s.candidates.groupBy("drug_id").agg(F.count("*").alias("n_raw_candidates"))
    man = cohorts.manifest(cohorts.mono_cohorts(s), X.drug_names(spark, d))
    return cohorts.retention(man, raw).select("drug_id", "n_final", "retention_12m_pct", "retention_rate_pct")


@query(
    """WITH g AS (SELECT o_custkey AS drug_id, o_orderpriority AS p, count(*) AS n_final FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2)
SELECT drug_id, n_final, p AS status FROM g QUALIFY row_number() OVER (PARTITION BY drug_id ORDER BY p DESC) = 1"""
)
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    gen = lambda p: o.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("drug_id")).agg(F.count("*").alias("n_final")).withColumn("status", F.lit(p))
    return cohorts.upsert_manifest(gen("1-URGENT"), gen("5-LOW"))


@query("SELECT DISTINCT c_custkey AS drug_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def resume_queue(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("drug_id"))
    return cohorts.remaining(load(spark, d, "customer").select(F.col("c_custkey").alias("drug_id")).distinct(), done)


@query("WITH f AS (SELECT p_partkey AS d, lpad(CAST(p_partkey // 4 AS VARCHAR), 5, '0') AS k FROM part) SELECT DISTINCT a.d AS ingredient_id, b.d AS comparator_id FROM f a JOIN f b ON a.k = b.k AND a.d <> b.d")
def family_comparators(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lpad(F.floor(F.col("p_partkey") / 4).cast("string"), 5, "0"), F.lit("x"), F.col("p_partkey").cast("string"))
    return cohorts.family_comparators(load(spark, d, "part").select(F.col("p_partkey").alias("drug_id"), code.alias("atc")))


_DAY = r"CASE WHEN regexp_matches(trim({c}, ' '), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_cast(regexp_extract(trim({c}, ' '), '^(\d{{4}}-\d{{1,2}}-\d{{1,2}})', 1) AS DATE) END"
_CACHED_OBS = f"SELECT person_id, min({_DAY.format(c='observation_period_start_date')}) AS obs_start, max({_DAY.format(c='observation_period_end_date')}) AS obs_end FROM observation_period WHERE person_id IS NOT NULL GROUP BY person_id"


@query(_CACHED_OBS)
def cache_observation(spark: SparkSession, d: str) -> DataFrame:
    return cache.trim_observation(load(spark, d, "observation_period"))


@query(
    f"""WITH o AS ({_CACHED_OBS}),
e AS (SELECT person_id, ingredient_id, exp_date, bool_and(is_monotherapy) AS mono, bool_or(is_monotherapy) AS any_mono FROM drug_exposure
      WHERE person_id IS NOT NULL AND ingredient_id IS NOT NULL AND exp_date IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT *, lag(exp_date) OVER w AS before FROM e WINDOW w AS (PARTITION BY person_id, ingredient_id ORDER BY exp_date)),
s AS (SELECT *, before IS NULL OR before < exp_date - 365 AS is_new FROM x),
b AS (SELECT person_id, exp_date AS t0, count(*) AS n_new, bool_and(mono) AS mono FROM s WHERE is_new GROUP BY 1, 2),
t AS (SELECT person_id, ingredient_id AS drug_id, min(exp_date) AS t0 FROM e WHERE any_mono GROUP BY 1, 2)
SELECT t.drug_id, t.person_id, t.t0, t.t0 + 182 AS t_6m, t.t0 + 365 AS t_12m, CAST(t.t0 - obs_start AS INTEGER) AS history_days_prior, CAST(obs_end - t.t0 AS INTEGER) AS follow_up_days, obs_end - t.t0 >= 365 AS has_12m_followup
FROM t JOIN o ON o.person_id = t.person_id AND t.t0 BETWEEN obs_start AND obs_end AND t.t0 - obs_start >= 365 AND obs_end - t.t0 >= 182
JOIN s ON s.person_id = t.person_id AND s.ingredient_id = t.drug_id AND s.exp_date = t.t0 AND s.is_new
JOIN b ON b.person_id = t.person_id AND b.t0 = t.t0 AND n_new = 1 AND b.mono IS NOT FALSE"""
)
def cohort_clinical(spark: SparkSession, d: str) -> DataFrame:
    obs = cache.trim_observation(load(spark, d, "observation_period"))
    steps = cohorts.screen(load(spark, d, "drug_exposure"), obs)
    return cohorts.mono_cohorts(steps)


# ---------------------------------------------------------------- vocabulary and cache

_MAPPING = f"WITH a AS ({X.ANCESTOR_SQL}), r AS (SELECT a.* FROM a WHERE ancestor_concept_id IN (SELECT s_suppkey FROM supplier)) SELECT ancestor_concept_id AS ingredient_id, descendant_concept_id AS drug_concept_id, count(*) OVER (PARTITION BY descendant_concept_id) = 1 AS is_monotherapy FROM r"


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.product_mapping(X.ancestor(spark, d), X.supplier_ingredients(spark, d))


@query(_MAPPING)
def vocabulary_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _mapping(spark, d)


@query(f"WITH m AS ({_MAPPING}) SELECT count(*) AS n_rows, count(DISTINCT ingredient_id) AS n_ingredients, count(*) FILTER (WHERE is_monotherapy) AS n_mono FROM m")
def vocabulary_summary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.mapping_summary(_mapping(spark, d))


@query("SELECT concept_id, concept_name FROM concept WHERE concept_class_id = 'Ingredient' AND vocabulary_id = 'RxNorm' AND standard_concept = 'S'")
def vocabulary_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.ingredients(load(spark, d, "concept"), standard=True)


@query(
    f"""WITH a AS ({X.ANCESTOR_SQL}), r AS (SELECT DISTINCT ancestor_concept_id AS i, descendant_concept_id AS p FROM a WHERE ancestor_concept_id <> descendant_concept_id AND ancestor_concept_id IN (SELECT s_suppkey FROM supplier)),
c AS (SELECT i, p, count(*) OVER (PARTITION BY p) = 1 AS mono FROM r), w AS (SELECT DISTINCT s_suppkey AS i FROM supplier WHERE s_nationkey < 12)
SELECT ingredient_id, drug_concept_id, bool_or(mono) AS is_monotherapy FROM (SELECT i AS ingredient_id, p AS drug_concept_id, mono FROM c WHERE i IN (SELECT i FROM w) UNION ALL SELECT i, i, true FROM w) GROUP BY 1, 2"""
)
def vocabulary_catalog_mapping(spark: SparkSession, d: str) -> DataFrame:
    concept = X.supplier_ingredients(spark, d).withColumns({"concept_class_id": F.lit("Ingredient"), "vocabulary_id": F.lit("RxNorm"), "standard_concept": F.lit("S")})
    wanted = load(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("ingredient_id"))
    return vocabulary.catalog_mapping(X.ancestor(spark, d), concept, wanted)


_RAW = """SELECT o_custkey, l_partkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS s, CASE WHEN l_linenumber % 2 = 0 THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') END AS e,
CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def _raw_exposure(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = load(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_custkey").cast("string").alias("person_id"), F.col("l_partkey").cast("string").alias("drug_concept_id"), F.to_date("o_orderdate").cast("string").alias("drug_exposure_start_date"),
        F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate").cast("string")).alias("drug_exposure_end_date"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int").cast("string")).alias("days_supply"),
    )


@query(f"WITH m AS ({_MAPPING}), x AS ({_RAW}) SELECT o_custkey AS person_id, drug_concept_id, CAST(s AS DATE) AS exp_date, ingredient_id, is_monotherapy FROM x JOIN m ON l_partkey = drug_concept_id WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cache_exposure(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("person_id"))
    return cache.trim_exposure(_raw_exposure(spark, d), _mapping(spark, d), base)


@query(f"WITH m AS ({_MAPPING}), x AS ({_RAW}) SELECT o_custkey AS person_id, l_partkey AS drug_concept_id, CAST(s AS DATE) AS exp_date, coalesce(CAST(e AS DATE), CAST(s AS DATE) + coalesce(n, 30)) AS end_date FROM x WHERE l_partkey IN (SELECT drug_concept_id FROM m) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cache_exposure_end(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("person_id"))
    return cache.trim_exposure(_raw_exposure(spark, d), _mapping(spark, d), base, with_end_date=True)


@query("SELECT person_id, measurement_date, measurement_concept_id, val AS value_as_number FROM filtered_measurements WHERE val IS NOT NULL AND measurement_concept_id IN (SELECT concept_id FROM biomarker_codebook)")
def cache_measurement(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "filtered_measurements").select(*[F.col(c).cast("string").alias(n) for c, n in (("person_id", "person_id"), ("measurement_date", "measurement_date"), ("measurement_concept_id", "measurement_concept_id"), ("val", "value_as_number"))])
    return cache.trim_measurement(raw, load(spark, d, "biomarker_codebook"))


# ---------------------------------------------------------------- outcomes

_WIN = f"""
WITH i AS ({X.EVENT_INDEX_SQL}), v AS ({X.EVENT_VALUE_SQL}),
j AS (SELECT drug_id, i.person_id, biomarker, val, measurement_date, CAST(measurement_date - t0 AS INTEGER) AS g FROM i JOIN v USING (person_id)),
w AS (SELECT *, CASE WHEN g BETWEEN -4 AND 0 THEN 'baseline' WHEN g BETWEEN 5 AND 9 THEN 'm6' WHEN g BETWEEN 12 AND 18 THEN 'm12' END AS win,
      CASE WHEN g BETWEEN -4 AND 0 THEN abs(g) WHEN g BETWEEN 5 AND 9 THEN abs(g - 7) WHEN g BETWEEN 12 AND 18 THEN abs(g - 15) END AS far FROM j),
r AS (SELECT * FROM w WHERE win IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drug_id, person_id, biomarker, win ORDER BY far, measurement_date DESC, val) = 1),
p AS (SELECT drug_id, person_id, biomarker, max(CASE WHEN win = 'baseline' THEN val END) AS baseline_val, max(CASE WHEN win = 'm6' THEN val END) AS m6_val, max(CASE WHEN win = 'm12' THEN val END) AS m12_val FROM r GROUP BY 1, 2, 3),
out AS (SELECT *, m6_val - baseline_val AS delta_6m, m12_val - baseline_val AS delta_12m, m6_val IS NOT NULL AND baseline_val IS NOT NULL AS has_pair_6m, m12_val IS NOT NULL AND baseline_val IS NOT NULL AS has_pair_12m FROM p)
"""


def _event_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.windowed_outcomes(X.event_index(spark, d), X.event_values(spark, d), X.EVENT_WINDOWS, X.EVENT_AIMS)


@query(_WIN + "SELECT drug_id, person_id, biomarker, baseline_val, m6_val, m12_val, round(delta_6m, 6) AS delta_6m, round(delta_12m, 6) AS delta_12m, has_pair_6m, has_pair_12m FROM out")
def outcome_windows(spark: SparkSession, d: str) -> DataFrame:
    return _event_outcomes(spark, d).withColumns({c: F.round(c, 6) for c in ("delta_6m", "delta_12m")})


_SUMMARY = "SELECT drug_id, biomarker, count(baseline_val) AS n_baseline, count(m6_val) AS n_m6, count(m12_val) AS n_m12, count(*) FILTER (WHERE has_pair_6m) AS n_complete_pair_6m, count(*) FILTER (WHERE has_pair_12m) AS n_complete_pair_12m FROM {t} GROUP BY 1, 2"


@query(_WIN + _SUMMARY.format(t="out"))
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcome_summary(_event_outcomes(spark, d))


def _clinical(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.with_deltas(X.outcomes(spark, d))


@query(f"WITH out AS ({X.OUTCOME_SQL}) " + _SUMMARY.format(t="out"))
def outcome_summary_clinical(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcome_summary(_clinical(spark, d))


@query(
    """WITH b AS (SELECT concept_id, biomarker, lo, hi FROM biomarker_codebook)
SELECT person_id, measurement_date, biomarker, val FROM filtered_measurements JOIN b ON concept_id = measurement_concept_id WHERE val BETWEEN lo AND hi"""
)
def outcome_plausible(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.plausible(load(spark, d, "filtered_measurements").withColumnRenamed("val", "value_as_number"), load(spark, d, "biomarker_codebook"))


@query(
    f"""WITH out AS ({X.OUTCOME_SQL}), s AS (SELECT drug_id, count(DISTINCT person_id) AS n FROM stanford_index GROUP BY 1),
a AS (SELECT drug_id, biomarker, count(baseline_val) AS n_baseline, count(*) FILTER (WHERE has_pair_6m) AS n_pair_6m, count(*) FILTER (WHERE has_pair_12m) AS n_pair_12m, avg(baseline_val) AS mb, quantile_cont(delta_6m, 0.5) AS md FROM out GROUP BY 1, 2)
SELECT drug_id, biomarker, n, n_baseline, round(n_baseline * 100.0 / n, 8) AS pct_baseline, n_pair_6m, round(n_pair_6m * 100.0 / n, 8) AS pct_pair_6m, n_pair_12m, round(n_pair_12m * 100.0 / n, 8) AS pct_pair_12m,
       round(mb, 8) AS mean_baseline, round(md, 8) AS median_delta_6m FROM a JOIN s USING (drug_id)"""
)
def outcome_completeness(spark: SparkSession, d: str) -> DataFrame:
    size = load(spark, d, "stanford_index").groupBy("drug_id").agg(F.count_distinct("person_id").alias("n"))
    return stats.rounded(outcomes.completeness(_clinical(spark, d), size), 8)


# ---------------------------------------------------------------- statistics

_MOMENTS = """SELECT biomarker, count(delta_6m) AS n, round(avg(delta_6m), 6) AS mean, round(stddev_samp(delta_6m), 6) AS sd, round(stddev_pop(delta_6m), 6) AS sd_pop, round(quantile_cont(delta_6m, 0.5), 6) AS median,
 round(quantile_cont(delta_6m, 0.25), 6) AS q25, round(quantile_cont(delta_6m, 0.75), 6) AS q75, round(stddev_samp(delta_6m) / sqrt(count(delta_6m)), 6) AS sem,
 round(avg(delta_6m) - 1.96 * stddev_samp(delta_6m) / sqrt(count(delta_6m)), 6) AS ci_low, round(avg(delta_6m) + 1.96 * stddev_samp(delta_6m) / sqrt(count(delta_6m)), 6) AS ci_high,
 round(avg(delta_6m) / stddev_samp(delta_6m), 6) AS cohens_d, round(avg(delta_6m) / (stddev_samp(delta_6m) / sqrt(count(delta_6m))), 6) AS t FROM out WHERE delta_6m IS NOT NULL GROUP BY 1"""


@query(f"WITH out AS ({X.OUTCOME_SQL}) {_MOMENTS}")
def stats_moments(spark: SparkSession, d: str) -> DataFrame:
    return stats.rounded(stats.moments(_clinical(spark, d), ["biomarker"], "delta_6m"))


_WILCOXON = f"""WITH out AS ({X.OUTCOME_SQL}), x AS (SELECT drug_id, biomarker, abs(delta_6m) AS size, delta_6m > 0 AS up FROM out WHERE delta_6m <> 0),
k AS (SELECT *, rank() OVER (PARTITION BY drug_id, biomarker ORDER BY size) + (count(*) OVER (PARTITION BY drug_id, biomarker, size) - 1) / 2 AS rk, count(*) OVER (PARTITION BY drug_id, biomarker, size) AS ties FROM x),
s AS (SELECT drug_id, biomarker, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS wp, sum(CASE WHEN up THEN 0 ELSE rk END) AS wm, sum(CAST(ties AS DOUBLE) * ties - 1) AS tt FROM k GROUP BY 1, 2)
"""


@query(_WILCOXON + "SELECT drug_id, biomarker, CAST(n AS BIGINT) AS n_nonzero, round(wp, 3) AS w_plus, round(wm, 3) AS w_minus, round(CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tt / 48 > 0 THEN (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48) END, 6) AS z FROM s")
def stats_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    out = stats.wilcoxon(_clinical(spark, d), ["drug_id", "biomarker"], "delta_6m")
    return out.select("drug_id", "biomarker", "n_nonzero", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), F.round("z", 6).alias("z"))


@query()
def stats_significance(spark: SparkSession, d: str) -> DataFrame:
    return stats.significance(_clinical(spark, d))


@query()
def stats_effects(spark: SparkSession, d: str) -> DataFrame:
    pairs_ = _clinical(spark, d).select("drug_id", "biomarker").distinct().withColumn("unit", F.lit("own"))
    return stats.effect_table(_clinical(spark, d), pairs_)


_SIZES = "SELECT drug_id, count(*) AS n_final, count(*) FILTER (WHERE has_12m_followup) AS n_with_12m_followup FROM stanford_index GROUP BY 1"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "stanford_index").groupBy("drug_id").agg(F.count("*").alias("n_final"), F.count_if("has_12m_followup").alias("n_with_12m_followup"))


@query(f"WITH s AS ({_SIZES}) SELECT count(*) AS n_cohorts, quantile_cont(n_final, 0.5) AS p50, quantile_cont(n_final, 0.75) AS p75, quantile_cont(n_final, 0.9) AS p90, quantile_cont(n_final, 0.99) AS p99, max(n_final) AS largest, count(*) FILTER (WHERE n_final >= 100) AS n_100, count(*) FILTER (WHERE n_final >= 1000) AS n_1000 FROM s")
def stats_cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.cohort_size_report(_sizes(spark, d))


@query(f"WITH s AS ({_SIZES}), t AS (SELECT log10(max(n_final)) AS top FROM s) SELECT CAST(least(49, floor(log10(n_final) / top * 49) + 1) AS BIGINT) AS bin, count(*) AS n FROM s, t GROUP BY 1")
def stats_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_histogram(_sizes(spark, d), "n_final")


@query(f"WITH s AS ({_SIZES}) SELECT drug_id, n_final, n_with_12m_followup, round(n_with_12m_followup / n_final, 4) AS share_12m FROM s ORDER BY n_final DESC, drug_id LIMIT 15")
def stats_top_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_cohorts(_sizes(spark, d))


@query("SELECT action_type, count(*) AS n FROM chembl_mechanisms GROUP BY 1")
def stats_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(load(spark, d, "chembl_mechanisms"), "action_type")


# ---------------------------------------------------------------- drug targets and vectors

_SALTS = ", ".join(f"'{w}'" for w in T.SALT_WORDS)
_NORM = f"""
CASE WHEN len(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(replace({{c}}, chr(160), ' ')), '\\([^)\\n]*\\)', '', 'g'), '[,;:\\-_/]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND NOT list_contains([{_SALTS}], w))) > 0
THEN array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(replace({{c}}, chr(160), ' ')), '\\([^)\\n]*\\)', '', 'g'), '[,;:\\-_/]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND NOT list_contains([{_SALTS}], w)), ' ')
ELSE trim(regexp_replace(regexp_replace(lower(replace({{c}}, chr(160), ' ')), '\\([^)\\n]*\\)', '', 'g'), '[,;:\\-_/]', ' ', 'g'), ' ') END"""
_ANY = lambda words, c: "regexp_matches(" + c + ", '" + "|".join(words) + "')"
_DIRECTION = f"CASE WHEN {_ANY(T.NEGATIVE, 'a')} THEN -1 WHEN {_ANY(T.POSITIVE, 'a')} THEN 1 ELSE -1 END"


@query(f"SELECT mech_id, {_NORM.format(c=chr(99) + 'oalesce(drug_name, ' + chr(39) * 2 + ')')} AS match_name FROM chembl_mechanisms")
def name_normalization(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chembl_mechanisms").select("mech_id", T.normalized_name(F.col("drug_name")).alias("match_name"))


@query(
    f"""WITH m AS (SELECT mech_id, action_type, lower(coalesce(action_type, '') || ' ' || coalesce(mechanism_of_action, '')) AS a, upper(coalesce(action_type, '')) AS u FROM chembl_mechanisms)
SELECT mech_id, CAST({_DIRECTION} AS INTEGER) AS direction, CASE WHEN {_ANY(T.ACTION_NEGATIVE, 'u')} THEN -1.0 WHEN {_ANY(T.ACTION_POSITIVE, 'u')} THEN 1.0 ELSE 0.0 END::DOUBLE AS action FROM m"""
)
def target_direction(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chembl_mechanisms").select("mech_id", T.effect_direction(F.col("action_type"), F.col("mechanism_of_action")).alias("direction"), T.action_direction(F.col("action_type")).alias("action"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice <= 0 THEN 10 WHEN l_extendedprice > 10000 THEN 0 ELSE greatest(0, 9 - log10(l_extendedprice)) END, 6)::DOUBLE AS score FROM lineitem")
def target_potency(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.potency_score(F.col("l_extendedprice")), 6).alias("score"))


_PRIORITY = "CASE upper(standard_type) WHEN 'KD' THEN 1 WHEN 'KI' THEN 2 WHEN 'IC50' THEN 3 ELSE 4 END"


@query(f"WITH a AS ({X.AFFINITY_SQL}) SELECT drug_chembl_id, uniprot_id, standard_type, min_affinity_nm FROM a QUALIFY row_number() OVER (PARTITION BY drug_chembl_id, uniprot_id ORDER BY {_PRIORITY}, min_affinity_nm NULLS FIRST, standard_type) = 1")
def target_best_affinity(spark: SparkSession, d: str) -> DataFrame:
    return targets.best_affinity_per_type(X.affinity(spark, d))


_MECH_AFF = "SELECT drug_chembl_id, uniprot_id, CASE mech_id % 3 WHEN 0 THEN 'Kd' WHEN 1 THEN 'Ki' ELSE 'EC50' END AS standard_type, CASE WHEN mech_id % 11 = 0 THEN NULL ELSE CAST(mech_id * 37 % 20000 AS DOUBLE) END AS min_affinity_nm FROM chembl_mechanisms WHERE drug_chembl_id IS NOT NULL AND uniprot_id IS NOT NULL"
_TARGETS = f"""WITH g AS (SELECT concept_id, concept_name FROM concept WHERE concept_class_id = 'Ingredient' AND vocabulary_id = 'RxNorm' AND standard_concept = 'S'),
a AS (SELECT * FROM ({_MECH_AFF}) QUALIFY row_number() OVER (PARTITION BY drug_chembl_id, uniprot_id ORDER BY {_PRIORITY}, min_affinity_nm NULLS FIRST, standard_type) = 1),
m AS (SELECT *, {_NORM.format(c='drug_name')} AS match_name, lower(coalesce(action_type, '') || ' ' || coalesce(mechanism_of_action, '')) AS a FROM chembl_mechanisms WHERE drug_name IS NOT NULL),
t AS (SELECT concept_id, concept_name, m.drug_chembl_id, m.uniprot_id, action_type, mechanism_of_action, CAST({_DIRECTION} AS INTEGER) AS direction, standard_type, min_affinity_nm
      FROM m JOIN g ON lower(concept_name) = match_name LEFT JOIN a ON a.drug_chembl_id = m.drug_chembl_id AND a.uniprot_id = m.uniprot_id WHERE match_name <> ''
      QUALIFY row_number() OVER (PARTITION BY concept_id, m.uniprot_id ORDER BY min_affinity_nm NULLS LAST, m.drug_chembl_id NULLS LAST, action_type NULLS LAST, mechanism_of_action NULLS LAST) = 1)
"""


def _mech_affinity(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mech_id")
    kind = F.when(m % 3 == 0, "Kd").when(m % 3 == 1, "Ki").otherwise("EC50")
    return load(spark, d, "chembl_mechanisms").where("drug_chembl_id is not null and uniprot_id is not null").select("drug_chembl_id", "uniprot_id", kind.alias("standard_type"), F.when(m % 11 != 0, (m * 37 % 20000).cast("double")).alias("min_affinity_nm"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return targets.drug_targets(vocabulary.ingredients(load(spark, d, "concept"), standard=True), load(spark, d, "chembl_mechanisms"), _mech_affinity(spark, d))


@query(_TARGETS + "SELECT * FROM t")
def target_matching(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


_SCORE = "CASE WHEN min_affinity_nm IS NULL THEN 7.0 WHEN min_affinity_nm <= 0 THEN 10.0 WHEN min_affinity_nm > 10000 THEN 0.0 ELSE greatest(0.0, 9 - log10(min_affinity_nm)) END"
_WEIGHTED = f", s AS (SELECT *, {_SCORE} AS score FROM t), w AS (SELECT *, CAST(direction AS DOUBLE) AS sigma, score / sum(score) OVER (PARTITION BY concept_id) AS weight FROM s WHERE score > 0)"


@query(_TARGETS + _WEIGHTED + "SELECT concept_id, uniprot_id, sigma, round(score, 6)::DOUBLE AS score, round(weight, 6)::DOUBLE AS weight FROM w")
def target_weights(spark: SparkSession, d: str) -> DataFrame:
    w = targets.weighted_targets(_targets(spark, d))
    return w.select("concept_id", "uniprot_id", "sigma", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


@query(_TARGETS + "SELECT concept_id, count(*) AS n_all, count(*) FILTER (WHERE min_affinity_nm > 10000) AS n_eliminated FROM t GROUP BY 1")
def target_eliminated(spark: SparkSession, d: str) -> DataFrame:
    return targets.eliminated_targets(_targets(spark, d))


# target vectors: each protein that the mechanisms name gets the embedding whose number is the count of names before it, modulo the number of embeddings
_PROTEINS = "u AS (SELECT uniprot_id, row_number() OVER (ORDER BY uniprot_id) - 1 AS k FROM (SELECT DISTINCT split_part(trim(uniprot_id), '-', 1) AS uniprot_id FROM chembl_mechanisms WHERE uniprot_id IS NOT NULL)), n AS (SELECT count(*) AS c FROM embeddings), v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), p AS (SELECT uniprot_id, embedding AS vp FROM u, n, v WHERE k % c = i)"


def _protein_vectors(spark: SparkSession, d: str) -> DataFrame:
    acc = load(spark, d, "chembl_mechanisms").where("uniprot_id is not null").select(T.protein_accession(F.col("uniprot_id")).alias("uniprot_id")).distinct()
    numbered = lambda df, key, name: spark.createDataFrame(df.orderBy(key).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])), f"{key} {dict(df.dtypes)[key]}, {name} long")
    e = load(spark, d, "embeddings")
    n = e.count()
    return numbered(acc, "uniprot_id", "k").withColumn("i", F.col("k") % n).join(numbered(e.select("vec_id"), "vec_id", "i"), "i").join(e, "vec_id").select("uniprot_id", F.col("embedding").alias("vp"))


@query(
    _TARGETS
    + ", "
    + _PROTEINS
    + f""", s AS (SELECT t.*, split_part(trim(uniprot_id), '-', 1) AS acc, {_SCORE} AS score FROM t), w AS (SELECT *, CAST(direction AS DOUBLE) AS sigma, score / sum(score) OVER (PARTITION BY concept_id) AS weight FROM s JOIN p ON p.uniprot_id = acc WHERE score > 0),
x AS (SELECT concept_id, weight * sigma AS f, unnest(vp) AS y, generate_subscripts(vp, 1) AS i FROM w), y AS (SELECT concept_id, i, sum(f * y) AS z FROM x GROUP BY 1, 2),
ua AS (SELECT concept_id, round(sqrt(sum(z * z)), 4) AS length, round(sum(z * i), 3) AS checksum FROM y GROUP BY 1),
c AS (SELECT concept_id, count(*) AS n_targets, min(drug_chembl_id) AS chembl_id FROM w GROUP BY 1)
SELECT g.concept_id AS drug_id, chembl_id, coalesce(n_targets, 0) AS n_targets, coalesce(length, 0)::DOUBLE AS length, coalesce(checksum, 0)::DOUBLE AS checksum FROM g LEFT JOIN c USING (concept_id) LEFT JOIN ua USING (concept_id)"""
)
def catalog_vectors(spark: SparkSession, d: str) -> DataFrame:
    cat = _catalog(spark, d)
    weighted = F.aggregate(F.transform("ua", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return cat.select(F.col("ingredient_concept_id").alias("drug_id"), "chembl_id", "n_targets", F.round(V.norm(F.col("ua")), 4).alias("length"), F.round(weighted, 3).alias("checksum"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return targets.theoretical_catalog(vocabulary.ingredients(load(spark, d, "concept"), standard=True), _targets(spark, d), _protein_vectors(spark, d), dim=64)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """drug_item as the catalog: single drugs with usable vectors."""
    i = load(spark, d, "drug_item").where("drug_id > 0 and target_vector is not null and text_embedding is not null").where(F.size("ingredient_concept_ids") == 1)
    return i.select("drug_id", "name", "kind", "ingredient_concept_ids", F.col("target_vector").cast("array<double>").alias("target_vector"), F.col("text_embedding").cast("array<double>").alias("text_embedding"))


_ITEMS = "i AS (SELECT drug_id, name FROM drug_item WHERE drug_id > 0 AND target_vector IS NOT NULL AND text_embedding IS NOT NULL AND len(ingredient_concept_ids) = 1)"
_MAP2 = "r AS (SELECT DISTINCT ingredient_id, drug_concept_id, is_monotherapy FROM drug_exposure WHERE ingredient_id IS NOT NULL AND drug_concept_id IS NOT NULL AND is_monotherapy IS NOT NULL)"


def _exposure_mapping(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "drug_exposure").where("ingredient_id is not null and drug_concept_id is not null and is_monotherapy is not null").select("ingredient_id", "drug_concept_id", "is_monotherapy").distinct()


@query(
    f"""WITH {_ITEMS}, {_MAP2}, c AS (SELECT drug_concept_id, list_sort(list(DISTINCT ingredient_id)) AS ids FROM r WHERE NOT is_monotherapy GROUP BY 1 HAVING count(DISTINCT ingredient_id) = 2)
SELECT drug_concept_id AS prescribed_concept_id, ids[1] AS id_a, ids[2] AS id_b FROM c WHERE ids[1] IN (SELECT drug_id FROM i) AND ids[2] IN (SELECT drug_id FROM i)"""
)
def catalog_combination_codes(spark: SparkSession, d: str) -> DataFrame:
    items, codes = catalog.fixed_combinations(_exposure_mapping(spark, d), _items(spark, d))
    return codes.join(items.select("drug_id", "ingredient_concept_ids"), "drug_id").select("prescribed_concept_id", F.element_at("ingredient_concept_ids", 1).alias("id_a"), F.element_at("ingredient_concept_ids", 2).alias("id_b"))


@query(f"WITH {_ITEMS}, {_MAP2} SELECT prescribed_concept_id, arg_max(drug_id, gen * 1e12 + drug_id) AS drug_id FROM (SELECT drug_id AS prescribed_concept_id, drug_id, 0 AS gen FROM i UNION ALL SELECT drug_concept_id, ingredient_id, 1 FROM r WHERE is_monotherapy AND ingredient_id IN (SELECT drug_id FROM i)) GROUP BY 1")
def catalog_code_index(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "prescribed_concept_id long, drug_id long")
    return catalog.code_index(_items(spark, d), _exposure_mapping(spark, d), none)


@query(f"WITH {_MAP2} SELECT count(*) AS n_ignored FROM (SELECT drug_concept_id FROM r WHERE NOT is_monotherapy GROUP BY 1 HAVING count(DISTINCT ingredient_id) > 2)")
def catalog_ignored(spark: SparkSession, d: str) -> DataFrame:
    return catalog.large_combinations(_exposure_mapping(spark, d))


@query()
def catalog_audit(spark: SparkSession, d: str) -> DataFrame:
    singles, mapping = _items(spark, d), _exposure_mapping(spark, d)
    combos, codes = catalog.fixed_combinations(mapping, singles)
    return catalog.catalog_audit(singles.unionByName(combos), catalog.code_index(singles, mapping, codes))


@query()
def catalog_observed_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    pairs_ = load(spark, d, "stanford_index").join(items.select("drug_id"), "drug_id", "left_semi").select("person_id", "drug_id", "t0").where("t0 is not null").distinct()
    both = pairs_.select("person_id", "t0", F.col("drug_id").alias("a")).join(pairs_.select("person_id", "t0", F.col("drug_id").alias("b")), ["person_id", "t0"]).where("a < b").select("a", "b")
    return catalog.observed_combinations(both, items).select("drug_id", "name", "kind", "ingredient_concept_ids", F.round(V.norm(F.col("target_vector")), 4).alias("length"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS length,
 round(1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))), 5) AS distance, len(list_concat(embedding, embedding)) AS size, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS any_nonzero FROM embeddings"""
)
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, d, "embeddings").select(
        "vec_id", F.round(V.norm(e), 5).alias("length"), F.round(V.cosine_distance(e, F.transform(e, lambda x: F.abs(x).cast("double"))), 5).alias("distance"),
        F.size(V.modality("concat", e, e)).cast("long").alias("size"), V.any_nonzero(V.unit(e)).alias("any_nonzero"),
    )


# ---------------------------------------------------------------- protein features


@query(
    """WITH g AS (SELECT upper(p_brand) AS gene, arg_max(p_retailprice, p_partkey) AS a, CAST(arg_max(p_size, p_partkey) AS DOUBLE) AS b FROM part GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS uniprot_id, round(ln(1 + a), 6) AS liver, round(ln(1 + b), 6) AS lung FROM part JOIN g ON upper(p_brand) = gene"""
)
def feature_expression(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    lines = p.select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("line"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("tpm"))
    vocab = p.select(F.col("id").alias("concept_code"), F.concat("p_brand", F.lit(" protein")).alias("concept_name"))
    out = features.expression_embeddings(lines, vocab, p.select(F.col("id").alias("uniprot_id")), 2)
    return out.select("uniprot_id", F.round(F.get("gtex_embedding", F.lit(0)), 6).alias("liver"), F.round(F.get("gtex_embedding", F.lit(1)), 6).alias("lung"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("uniprot_id"))


@query()
def feature_pathways(spark: SparkSession, d: str) -> DataFrame:
    """Truncated SVD of supplier by size of part; checked by its Gram matrix in the tests."""
    sold = load(spark, d, "lineitem").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    hits = sold.select(F.col("l_suppkey").cast("string").alias("uniprot_id"), F.col("p_size").cast("string").alias("pathway_id"), F.lit("Homo sapiens").alias("species"))
    return features.pathway_embeddings(hits, _suppliers(spark, d)).select("uniprot_id", F.round(V.norm(F.col("reactome_embedding")), 6).alias("length"))


@query()
def feature_interactions(spark: SparkSession, d: str) -> DataFrame:
    pairs_ = load(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("protein1"), F.concat(F.lit("p"), F.col("l_partkey")).alias("protein2"), (F.col("l_quantity") * 20).cast("int").alias("combined_score"))
    alias = _suppliers(spark, d).select(F.concat(F.lit("s"), "uniprot_id").alias("string_id"), F.col("uniprot_id").alias("alias"))
    return features.interaction_embeddings(pairs_, alias, _suppliers(spark, d)).select("uniprot_id", F.round(V.norm(F.col("string_embedding")), 6).alias("length"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:16]), lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e)
SELECT CAST(vec_id AS VARCHAR) AS uniprot_id, len(v)::INTEGER AS dim, round(v[1] / l, 4) AS head, round(v[64] / l, 4) AS mid, round(v[80] / l, 4) AS tail FROM n"""
)
def feature_assembly(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("uniprot_id"), "embedding")
    other = e.select("uniprot_id", F.slice("embedding", 1, 16).alias("part"))
    return features.assembled_vectors(e, other).select("uniprot_id", F.size("vp").alias("dim"), *[F.round(F.get("vp", F.lit(i)).cast("double"), 4).alias(n) for i, n in ((0, "head"), (63, "mid"), (79, "tail"))])


# ---------------------------------------------------------------- pairs of cohorts


@query()
def pair_prototypes(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("label").cast("long").alias("drug_id"), F.col("vec_id").alias("person_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return pairs.prototypes(e).select("drug_id", "k_id", F.round(V.norm(F.col("proto")), 6).alias("length"))


_FIRST = f"e AS ({X.EXPOSURE_SQL}), f AS (SELECT ingredient_id AS drug_id, person_id, min(exp_date) AS t0 FROM e GROUP BY 1, 2)"


def _first_exposures(spark: SparkSession, d: str) -> DataFrame:
    return X.exposure(spark, d).groupBy(F.col("ingredient_id").alias("drug_id"), "person_id").agg(F.min("exp_date").alias("t0"))


@query(f"WITH {_FIRST} SELECT x.drug_id AS a, y.drug_id AS b, count(*) FILTER (WHERE x.t0 = y.t0) AS n_concomitant, count(*) FILTER (WHERE x.t0 < y.t0) AS n_a_first, count(*) FILTER (WHERE x.t0 > y.t0) AS n_b_first FROM f x JOIN f y ON x.person_id = y.person_id AND x.drug_id < y.drug_id GROUP BY 1, 2")
def pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pairs.incident_overlap(_first_exposures(spark, d))


@query(
    f"""WITH {_FIRST}, n AS (SELECT drug_id, count(*) AS n FROM f GROUP BY 1),
o AS (SELECT x.drug_id AS a, y.drug_id AS b, count(*) FILTER (WHERE x.t0 = y.t0) AS c, count(*) FILTER (WHERE x.t0 < y.t0) AS af, count(*) FILTER (WHERE x.t0 > y.t0) AS bf FROM f x JOIN f y ON x.person_id = y.person_id AND x.drug_id < y.drug_id GROUP BY 1, 2)
SELECT p.drug_id AS a, q.drug_id AS b, p.n AS n_raw_a, q.n AS n_raw_b, p.n - coalesce(c, 0) - coalesce(bf, 0) AS n_clean_a, q.n - coalesce(c, 0) - coalesce(af, 0) AS n_clean_b, coalesce(af + bf, 0) AS n_cross_dropped, coalesce(c, 0) AS n_concomitant_dropped
FROM n p JOIN n q ON p.drug_id < q.drug_id LEFT JOIN o ON o.a = p.drug_id AND o.b = q.drug_id"""
)
def pair_incident_sizes(spark: SparkSession, d: str) -> DataFrame:
    f = _first_exposures(spark, d)
    ids = f.select("drug_id").distinct()
    every = ids.select(F.col("drug_id").alias("a")).join(ids.select(F.col("drug_id").alias("b")), F.col("a") < F.col("b"))
    return pairs.incident_sizes(every, f)


_DIST = "WITH q AS (SELECT CAST(label AS BIGINT) AS l, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), z AS (SELECT x.l AS a, y.l AS b, greatest(0, least(2, 1 - max(list_inner_product(x.v, y.v)))) AS distance FROM q x JOIN q y ON x.l < y.l GROUP BY 1, 2)"


def _label_distances(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("label").cast("long").alias("drug_id"), F.col("embedding").cast("array<double>").alias("proto"))
    return pairs.cohort_distances(e)


@query(_DIST + " SELECT a, b, round(distance, 6)::DOUBLE AS distance FROM z")
def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    return _label_distances(spark, d).withColumn("distance", F.round("distance", 6))


_NEAR = _DIST + ", w AS (SELECT a, b, distance FROM z UNION ALL SELECT b, a, distance FROM z), t AS (SELECT * FROM w WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 3)"


@query(_NEAR + " SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(distance), 6)::DOUBLE AS distance FROM t GROUP BY least(a, b), greatest(a, b)")
def pair_nearest(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest_cohorts(_label_distances(spark, d), Screening(neighbours=3, max_distance=2.0)).withColumn("distance", F.round("distance", 6))


@query(_NEAR + " SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(distance), 6)::DOUBLE AS distance FROM t GROUP BY least(a, b), greatest(a, b) HAVING count(*) = 2")
def pair_nearest_mutual(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest_cohorts(_label_distances(spark, d), Screening(neighbours=3, max_distance=2.0, mutual=True)).withColumn("distance", F.round("distance", 6))


@query()
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Screening over cohorts of first exposures, persons standing for the embeddings of their number."""
    f = _first_exposures(spark, d)
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("person_id"), F.col("embedding").cast("array<double>").alias("vec"))
    points = f.select("drug_id", "person_id").join(e, "person_id")
    return pairs.candidate_pairs(points, f, X.drug_names(spark, d), Screening(max_distance=1.0))


# ---------------------------------------------------------------- representations, embeddings by name

_IDX = "SELECT DISTINCT drug_id, person_id, t0 FROM stanford_index WHERE t0 IS NOT NULL"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "stanford_index").where("t0 is not null").select("drug_id", "person_id", "t0", "t_6m", "t_12m").distinct()


@query(f"WITH i AS ({_IDX}) SELECT CAST(row_number() OVER (PARTITION BY person_id ORDER BY t0, drug_id) - 1 AS INTEGER) AS pass_id, drug_id, person_id, t0, CAST(t0 AS TIMESTAMP) - INTERVAL 1 MINUTE AS prediction_time FROM i WHERE (drug_id + person_id) % 7 <> 0")
def representation_passes(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "stanford_index").where("t0 is not null").select("drug_id", "person_id", "t0").distinct()
    return representations.remaining_passes(i, i.where("(drug_id + person_id) % 7 = 0"))


@query("SELECT DISTINCT person_id AS patient_id, strftime(t_6m, '%Y-%m-%d %H:%M:00') AS prediction_time FROM stanford_index WHERE t0 IS NOT NULL AND t_6m IS NOT NULL")
def representation_times(spark: SparkSession, d: str) -> DataFrame:
    return representations.prediction_times(_index(spark, d), "t_6m")


@query(
    f"""WITH i AS ({_IDX}), r AS (SELECT vec_id AS k, embedding FROM embeddings) SELECT drug_id, person_id, t0, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM (SELECT *, (person_id + date_diff('day', DATE '1970-01-01', t0)) % (SELECT count(*) FROM embeddings) AS k FROM i) JOIN r USING (k)"""
)
def representation_alignment(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "stanford_index").where("t0 is not null").select("drug_id", "person_id", "t0").distinct()
    e = load(spark, d, "embeddings")
    n = e.count()
    feats = i.select("person_id", "t0").distinct().withColumn("k", (F.col("person_id") + F.unix_date("t0")) % n).join(e.select(F.col("vec_id").alias("k"), *[F.get("embedding", F.lit(j)).alias(f"data_{j}") for j in range(64)]), "k").drop("k")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return representations.aligned(i, feats).select("drug_id", "person_id", "t0", F.round(total, 4).alias("total"))


@query("SELECT n.concept_name AS name, min(e.drug_id) AS concept_id FROM (SELECT DISTINCT concept_name FROM concept WHERE concept_class_id = 'Ingredient' AND concept_name IS NOT NULL) n LEFT JOIN drug_item e ON lower(trim(e.name)) = lower(trim(n.concept_name)) GROUP BY 1")
def name_embeddings(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "concept").where("concept_class_id = 'Ingredient' and concept_name is not null").select(F.col("concept_name").alias("name")).distinct()
    have = load(spark, d, "drug_item").select(F.col("drug_id").alias("concept_id"), F.col("name").alias("concept_name"), F.col("text_embedding").alias("dense_embedding"))
    return catalog.name_embeddings(names, have).select("name", "concept_id")


_TRIPLE = "WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS name, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), t AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, CAST(l_quantity AS INTEGER)::VARCHAR AS c FROM lineitem)"


@query(
    _TRIPLE
    + """, d AS (SELECT l_orderkey || '-' || l_linenumber AS id, 1 - list_cosine_similarity(x.v, y.v) AS ab, 1 - list_cosine_similarity(x.v, z.v) AS ac
FROM t LEFT JOIN e x ON x.name = a LEFT JOIN e y ON y.name = b LEFT JOIN e z ON z.name = c)
SELECT id, round(ab, 5) AS d_ab, round(ac, 5) AS d_ac, round(ac - ab, 5) AS delta FROM d"""
)
def triplet_audit(spark: SparkSession, d: str) -> DataFrame:
    return catalog.triplet_audit(*_triplets(spark, d)).select("id", *[F.round(c, 5).alias(c) for c in ("d_ab", "d_ac", "delta")])


def _triplets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = load(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), F.col("l_quantity").cast("int").cast("string").alias("c"))
    e = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("dense_embedding"))
    return t, e


# ---------------------------------------------------------------- audits

@query(_PLAIN + _MANIFEST + "SELECT drug_id, n_final, n_final AS n_rows FROM man WHERE false")
def audit_manifest(spark: SparkSession, d: str) -> DataFrame:
    index = cohort_mono(spark, d)
    return audit.manifest_matches(index, cohorts.manifest(index, X.drug_names(spark, d)))


@query("SELECT drug_id, count(*) - count(DISTINCT person_id) AS n_duplicates FROM stanford_index GROUP BY 1")
def audit_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_persons(load(spark, d, "stanford_index"))


@query(
    f"""WITH o AS ({_CACHED_OBS}) SELECT drug_id, count(*) FILTER (WHERE NOT coalesce(t0 BETWEEN obs_start AND obs_end, false)) AS n_outside, count(*) FILTER (WHERE t0 - obs_start < 365) AS n_short_history,
 count(*) FILTER (WHERE obs_end - t0 < 182) AS n_short_follow_up, count(*) FILTER (WHERE has_12m_followup <> (obs_end - t0 >= 365)) AS n_wrong_flag FROM stanford_index LEFT JOIN o USING (person_id) GROUP BY 1"""
)
def audit_windows(spark: SparkSession, d: str) -> DataFrame:
    return audit.window_violations(load(spark, d, "stanford_index"), cache.trim_observation(load(spark, d, "observation_period")))


@query("SELECT i.drug_id, count(DISTINCT i.person_id) AS n_leaks FROM stanford_index i JOIN drug_exposure e ON e.person_id = i.person_id AND e.ingredient_id = i.drug_id AND exp_date >= t0 - 365 AND exp_date < t0 GROUP BY 1")
def audit_washout(spark: SparkSession, d: str) -> DataFrame:
    return audit.washout_leaks(load(spark, d, "stanford_index"), load(spark, d, "drug_exposure"))


@query(
    """WITH e AS (SELECT DISTINCT person_id, ingredient_id, exp_date FROM drug_exposure WHERE ingredient_id IS NOT NULL), c AS (SELECT DISTINCT i.drug_id, i.person_id, t0, ingredient_id FROM stanford_index i JOIN e ON e.person_id = i.person_id AND exp_date = t0 AND ingredient_id <> i.drug_id)
SELECT drug_id, count(DISTINCT person_id) AS n_coinitiations FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.person_id = c.person_id AND e.ingredient_id = c.ingredient_id AND exp_date >= t0 - 365 AND exp_date < t0) GROUP BY 1"""
)
def audit_coinitiations(spark: SparkSession, d: str) -> DataFrame:
    return audit.coinitiations(load(spark, d, "stanford_index"), load(spark, d, "drug_exposure").where("ingredient_id is not null"))


_PERSON = "p AS (SELECT c_custkey AS person_id, CAST(1940 + c_custkey % 60 AS INTEGER) AS year_of_birth, CASE WHEN c_custkey % 2 = 0 THEN 8532 ELSE 8507 END AS gender_concept_id FROM customer)"


@query(
    _PLAIN
    + ", "
    + _PERSON
    + """, a AS (SELECT drug_id, year(t0) - year_of_birth AS age, gender_concept_id FROM mono JOIN p USING (person_id))
SELECT drug_id, count(*) AS n, round(avg(age), 1) AS mean_age, quantile_cont(age, 0.5)::DOUBLE AS median_age, min(age)::INTEGER AS min_age, max(age)::INTEGER AS max_age, count(*) FILTER (WHERE age < 18) AS n_minors,
 count(*) FILTER (WHERE age < 0 OR age > 110) AS n_impossible, round(count(*) FILTER (WHERE gender_concept_id = 8532) * 100.0 / count(*), 1) AS pct_female FROM a GROUP BY 1"""
)
def audit_demographics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    person = load(spark, d, "customer").select(c.alias("person_id"), (1940 + c % 60).cast("int").alias("year_of_birth"), F.when(c % 2 == 0, 8532).otherwise(8507).alias("gender_concept_id"))
    return audit.demographics(cohort_mono(spark, d), person)


@query("SELECT drug_id, CAST(year(t0) AS INTEGER) AS year, count(*) AS n FROM stanford_index GROUP BY 1, 2")
def audit_calendar(spark: SparkSession, d: str) -> DataFrame:
    return audit.calendar(load(spark, d, "stanford_index"))


@query("WITH y AS (SELECT drug_id, year(t0) AS y, count(*) AS n FROM stanford_index WHERE t0 IS NOT NULL GROUP BY 1, 2) SELECT drug_id, CAST(min(y) AS INTEGER) AS first_year, CAST(max(y) AS INTEGER) AS last_year, CAST(arg_min(y, -n * 10000 + y) AS INTEGER) AS peak_year FROM y GROUP BY 1")
def audit_calendar_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.calendar_summary(load(spark, d, "stanford_index").where("t0 is not null"))


# ---------------------------------------------------------------- scalar functions

@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS minute, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 1 MINUTE AS before, CASE WHEN day(ts) BETWEEN 1 AND 9 THEN 'early' WHEN day(ts) BETWEEN 10 AND 20 THEN 'mid' END AS win FROM events")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts")
    return load(spark, d, "events").select("event_id", D.minute_text(F.col("ts")).alias("minute"), D.minute_before(day).alias("before"), D.window_name(day, F.lit("2024-01-01").cast("date"), {"early": (0, 8), "mid": (9, 19)}).alias("win"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, CAST(('0x' || substr(md5(least(l_partkey, l_suppkey) || '_' || greatest(l_partkey, l_suppkey)), 1, 12)) AS BIGINT) % 1000000000000 + 9000000000000 AS id FROM lineitem")
def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return load(spark, d, "lineitem").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), I.pair_id(a, b).alias("id")).distinct()
