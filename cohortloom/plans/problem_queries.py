"""Queries p1, p2, p3 and p7 over the test tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.hotkeys import heavy_keys, key_quantiles
from cohortloom.operators.intervals import merge_periods, readable_day
from cohortloom.operators.spikes import flag_spikes
from cohortloom.operators.units import convert_units
from cohortloom.session import load

READINGS = ["baseline_val", "m6_val", "m12_val"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flags = flag_spikes(
        load(spark, d, "final_pairs"), record_id="pair_id", group_cols=["site_id", "biomarker"], fields=READINGS,
        log_scale=F.col("biomarker").isin("alt", "crp"),
    )
    return flags.select("pair_id", "val_field")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    spans = merge_periods(
        load(spark, d, "observation_period"), entity="person_id",
        start=readable_day(F.col("observation_period_start_date")), end=readable_day(F.col("observation_period_end_date")),
    )
    return spans.select("span_kind", "person_id", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(load(spark, d, "drug_exposure"), ["ingredient_id", "person_id"]).select("key_field", "key_id")


def p3_ingredient_days(spark: SparkSession, d: str) -> DataFrame:
    return key_quantiles(load(spark, d, "drug_exposure"), "ingredient_id", "exp_date")


def p3_person_days(spark: SparkSession, d: str) -> DataFrame:
    return key_quantiles(load(spark, d, "drug_exposure"), "person_id", "exp_date")


def _converted(spark: SparkSession, d: str) -> DataFrame:
    return convert_units(spark, load(spark, d, "filtered_measurements"), load(spark, d, "biomarker_codebook"), load(spark, d, "unit_reference"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).where("unit_code != common_unit").select("measurement_id", "unit_code")


def p7_common(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).select("measurement_id", "biomarker", F.round("common_value", 6).alias("common_value"), "common_unit")


def p7_review(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose unit is not certain: missing ones of which the forest is not sure, and stated ones that the range corrects."""
    return _converted(spark, d).where("needs_review").select("measurement_id", "biomarker", "unit_code", "unit_origin", "confidence")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_ingredient_days, p3_person_days, p7_found, p7_common, p7_review)}


def _unpivoted() -> str:
    return " UNION ALL ".join(f"SELECT pair_id, site_id, biomarker, '{f}' AS val_field, {f} AS v FROM final_pairs" for f in READINGS)


# a level is judged by its whole source here; a stretch is a run of readings, so nulls are left out before runs are formed
P1 = f"""
WITH r AS ({_unpivoted()}),
v AS (SELECT *, biomarker IN ('alt', 'crp') AS on_log FROM r WHERE v IS NOT NULL AND NOT isnan(v)),
l AS (SELECT *, CASE WHEN v <= 0 THEN NULL WHEN on_log THEN ln(v) ELSE v END AS y FROM v),
g AS (SELECT site_id, biomarker, median(y) AS m, 1.482602218505602 * mad(y) AS s FROM l GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY site_id, biomarker, val_field ORDER BY pair_id)
             - row_number() OVER (PARTITION BY site_id, biomarker, val_field, v ORDER BY pair_id) AS island FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY site_id, biomarker, val_field, v, island) AS n FROM i)
SELECT pair_id, val_field FROM k
JOIN g ON k.site_id IS NOT DISTINCT FROM g.site_id AND k.biomarker IS NOT DISTINCT FROM g.biomarker
WHERE v <= 0 OR n >= 6 OR abs(y - m) > 5.65 * s
"""

_DAY = "try_cast(nullif(regexp_extract({}, '^[ \\t]*(\\d{{4}}-\\d{{2}}-\\d{{2}})([ T]\\d{{1,2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?)?[ \\t]*$', 1), '') AS DATE)"

P2 = f"""
WITH i AS (SELECT person_id, {_DAY.format('observation_period_start_date')} AS a, {_DAY.format('observation_period_end_date')} AS b FROM observation_period),
v AS (SELECT DISTINCT person_id, a, b FROM i WHERE person_id IS NOT NULL AND a <= b),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY person_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM n),
p AS (SELECT person_id, min(a) AS a, max(b) AS b FROM s GROUP BY person_id, k),
q AS (SELECT *, lag(b) OVER (PARTITION BY person_id ORDER BY a) AS before FROM p)
SELECT 'period' AS span_kind, person_id, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day FROM q
UNION ALL
SELECT 'gap', person_id, strftime(before + 1, '%Y-%m-%d'), strftime(a - 1, '%Y-%m-%d') FROM q WHERE before IS NOT NULL
"""

P3 = " UNION ALL ".join(
    f"SELECT '{f}' AS key_field, {f} AS key_id FROM drug_exposure WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) * 50 >= (SELECT count(*) FROM drug_exposure)"
    for f in ("ingredient_id", "person_id")
)


def _days(key: str) -> str:
    picks = ", ".join(f"max(CASE WHEN i = greatest(1, (n * {p} + 99) // 100) THEN exp_date END) AS p{p}" for p in (25, 50, 75))
    return f"""
WITH o AS (SELECT {key}, exp_date, row_number() OVER (PARTITION BY {key} ORDER BY exp_date) AS i, count(*) OVER (PARTITION BY {key}) AS n
           FROM drug_exposure WHERE {key} IS NOT NULL AND exp_date IS NOT NULL)
SELECT {key}, n AS n_values, {picks} FROM o GROUP BY {key}, n
"""


_ALIASES = {
    "mg/dL": ["mg/dl", "mg%", "mgperdl", "mg/100ml", "milligram/decilitre"], "mmol/L": ["mmol/l", "mm", "mmolperlitre", "millimole/liter"],
    "g/L": ["g/l", "gperlitre", "gram/l"], "%": ["%", "pct", "percent", "%ngsp", "%(dcct)", "%ofhb"],
    "mmol/mol": ["mmol/mol", "mmol/molhb", "mmol/molifcc", "mmolpermol", "millimole/mole"], "fraction": ["fraction", "hbfraction", "l/l", "proportion", "ratio"],
    "mL/min/1.73m2": ["ml/min/1.73m2", "ml/minper1.73m2", "ml/mn/1.73m2"], "mL/s/1.73m2": ["ml/s/1.73m2", "ml/sec/1.73m2", "ml/sper1.73m2"],
    "U/L": ["u/l", "iu/l", "ui/l", "units/l", "uperlitre"], "ukat/L": ["ukat/l", "mckat/l", "microkat/l"], "nkat/L": ["nkat/l", "nanokat/l"],
    "mg/L": ["mg/l", "mgperl", "milligram/litre"], "nmol/L": ["nmol/l", "nm", "nanomole/l"], "mmHg": ["mmhg", "mmofmercury", "mm-hg"],
    "kPa": ["kpa", "kilopascal"], "cmHg": ["cmhg"],
}


def _key(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), 'µμ²,', 'uu2.'), '[\\s\\[\\]{{}}_]', '', 'g')"


_NAMES = ", ".join(f"('{k}', '{v}')" for v, ks in _ALIASES.items() for k in ks)
_TAIL = "regexp_extract(regexp_replace(value_text, '(hb)?a1c', '', 'i'), '(^|[ =.])[-+]?\\d+([.,]\\d+)?\\s*([^\\d\\s;].*)$', 3)"
P7_ALL = f"""
WITH names(k, unit_code) AS (VALUES {_NAMES}),
m AS (SELECT f.*, b.biomarker, b.lo, b.hi,
        coalesce(CASE WHEN NOT isnan(val) THEN val END, try_cast(replace(nullif(regexp_extract(
          regexp_replace(regexp_replace(value_text, '(hb)?a1c', '', 'i'), '(reported in.*|\\[.*\\]\\s*$)', ''), '(^|[ =])([-+]?\\d+([.,]\\d+)?)', 2), ''), ',', '.') AS DOUBLE)) AS value,
        {_key('unit_text')} AS k1,
        {_key("CASE WHEN value_text LIKE '%unit=%' THEN regexp_extract(value_text, 'unit=(.*)$', 1) WHEN value_text LIKE 'reported in %' THEN substr(value_text, 13) WHEN regexp_matches(value_text, '\\[.*\\]\\s*$') AND NOT regexp_matches(regexp_replace(value_text, '(hb)?a1c', '', 'i'), '(^|[ =])\\d') THEN regexp_extract(value_text, '\\[(.*)\\]', 1) WHEN regexp_matches(value_text, '\\d\\s*mg/100') THEN 'mg/dl' ELSE " + _TAIL + " END")} AS k2
      FROM filtered_measurements f JOIN biomarker_codebook b ON f.measurement_concept_id = b.concept_id),
s AS (SELECT m.*, coalesce(u1.unit_code, u2.unit_code) AS stated FROM m
      LEFT JOIN names n1 ON n1.k = k1 LEFT JOIN unit_reference u1 ON u1.biomarker = m.biomarker AND u1.unit_code = n1.unit_code
      LEFT JOIN names n2 ON n2.k = k2 LEFT JOIN unit_reference u2 ON u2.biomarker = m.biomarker AND u2.unit_code = n2.unit_code
      WHERE value IS NOT NULL),
h0 AS (SELECT site_id, biomarker, stated, count(*) AS n FROM s WHERE stated IS NOT NULL GROUP BY site_id, biomarker, stated),
h AS (SELECT site_id, biomarker, stated AS usual FROM h0 QUALIFY row_number() OVER (PARTITION BY site_id, biomarker ORDER BY n DESC, stated) = 1),
d AS (SELECT s.*, coalesce(stated, usual, c.unit_code) AS first_unit, c.unit_code AS common_unit FROM s
      LEFT JOIN h ON s.site_id IS NOT DISTINCT FROM h.site_id AND s.biomarker = h.biomarker
      LEFT JOIN unit_reference c ON c.biomarker = s.biomarker AND c.is_common),
p AS (SELECT d.*, u.unit_code AS cand, u.factor, u.shift, value * u.factor + u.shift BETWEEN lo AND hi AS ok FROM d JOIN unit_reference u ON u.biomarker = d.biomarker),
z AS (SELECT measurement_id, biomarker, value, common_unit, first_unit,
        CASE WHEN bool_or(ok AND cand = first_unit) OR count(*) FILTER (ok AND cand <> first_unit) <> 1 THEN first_unit ELSE max(cand) FILTER (ok AND cand <> first_unit) END AS unit_code
      FROM p GROUP BY measurement_id, biomarker, value, common_unit, first_unit)
"""
P7 = P7_ALL + "SELECT measurement_id, unit_code FROM z WHERE unit_code <> common_unit"
P7_COMMON = P7_ALL + "SELECT measurement_id, z.biomarker, round(value * u.factor + u.shift, 6) AS common_value, common_unit FROM z JOIN unit_reference u ON u.biomarker = z.biomarker AND u.unit_code = z.unit_code"

SQL = {
    "p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_ingredient_days": _days("ingredient_id"), "p3_person_days": _days("person_id"),
    "p7_found": P7, "p7_common": P7_COMMON,
}
