"""Descriptive and inferential statistics; p-values are worked out on the few aggregated rows, natively where erfc is not needed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortloom.session import small


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return math.nan if t != t or df <= 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_pvalue(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(float(x)) / math.sqrt(2)) if pd.notna(x) else None for x in z])


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: n, mean, sd (n - 1), sem, 95 % limits, median, quartiles, paired effect size (0 without spread) and t."""
    v = F.col(value)
    out = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_pop"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"),
    )
    sem = F.col("sd") / F.sqrt("n")
    return out.withColumns(
        {
            "sem": sem, "ci_low": F.col("mean") - 1.96 * sem, "ci_high": F.col("mean") + 1.96 * sem,
            "cohens_d": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0), "t": F.when(F.col("sd") > 0, F.col("mean") / sem),
        }
    )


def wilcoxon(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Signed-rank test per key: n without zeros, rank sums of either sign, and the tie-corrected normal score z.

    Ranks are average ranks, from counts per distinct size rather than from single rows: a hot key is first reduced to its distinct values.
    """
    v = F.col(value)
    sizes = df.where(v.isNotNull() & (v != 0)).groupBy(*keys, F.abs(v).alias("size")).agg(F.count("*").alias("ties"), F.count_if(v > 0).alias("up"))
    run = Window.partitionBy(*keys).orderBy("size")
    ranked = sizes.withColumn("rank", F.sum("ties").over(run) - (F.col("ties") - 1) / 2)
    out = ranked.groupBy(*keys).agg(
        F.sum("ties").alias("n_nonzero"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("ties") - F.col("up"))).alias("w_minus"),
        F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("tie_term"),
    )
    n = F.col("n_nonzero").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    return out.withColumn("z", F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread)).drop("tie_term")


def significance(outcomes: DataFrame, least: int = 30, alpha: float = 0.01) -> DataFrame:
    """Change at six months per (drug_id, biomarker) with a complete pair in at least ``least`` persons, by Wilcoxon."""
    keys = ["drug_id", "biomarker"]
    pairs = outcomes.where("has_pair_6m")
    base = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("delta_6m"), 2).alias("mean_delta"), F.round(F.percentile("delta_6m", 0.5), 2).alias("median_delta")).where(F.col("n") >= least)
    out = base.join(wilcoxon(pairs, keys, "delta_6m").select(*keys, "z"), keys, "left").withColumn("p_value", F.coalesce(normal_p("z"), F.lit(1.0)))
    return out.withColumn("significant", F.col("p_value") < alpha).orderBy(*keys)


def effect_table(outcomes: DataFrame, indications: DataFrame, least: int = 10) -> DataFrame:
    """Effect of both horizons for (drug_id, biomarker, unit) of ``indications``: baseline mean and sd, change with limits, effect size and p-values."""
    keys = ["drug_id", "biomarker", "unit", "horizon"]
    rows = outcomes.join(small(indications), ["drug_id", "biomarker"])
    long = rows.select("drug_id", "biomarker", "unit", "baseline_val", F.explode(F.array(F.struct(F.lit(6).alias("horizon"), F.col("delta_6m").alias("delta")), F.struct(F.lit(12).alias("horizon"), F.col("delta_12m").alias("delta")))).alias("x"))
    long = long.select("drug_id", "biomarker", "unit", "baseline_val", "x.*").where("delta is not null")
    base = long.groupBy(*keys).agg(F.avg("baseline_val").alias("baseline_mean"), F.stddev_samp("baseline_val").alias("baseline_sd"))
    out = moments(long, keys, "delta").where(F.col("n") >= least).join(base, keys).join(wilcoxon(long, keys, "delta").select(*keys, "z"), keys, "left")
    return out.withColumn("p_t", student_p("t", F.col("n") - 1)).withColumn("p_wilcoxon", normal_p("z"))


def cohort_size_report(manifest: DataFrame) -> DataFrame:
    """One row over non-empty cohorts: percentiles, largest, and how many reach 100 and 1,000."""
    n = F.col("n_final")
    pct = [F.percentile(n, p / 100).alias(f"p{p}") for p in (50, 75, 90, 99)]
    return manifest.where(n > 0).agg(F.count("*").alias("n_cohorts"), *pct, F.max(n).alias("largest"), F.count_if(n >= 100).alias("n_100"), F.count_if(n >= 1000).alias("n_1000"))


def log_histogram(df: DataFrame, value: str, edges: int = 50) -> DataFrame:
    """(bin, n) over ``edges`` - 1 bins of equal width of log10(value), from 1 to the largest value, which belongs to the last bin."""
    top = df.where(F.col(value) >= 1).agg(F.log10(F.max(value))).first()[0]
    if not top:
        return df.where(F.col(value) >= 1).agg(F.lit(1).cast("long").alias("bin"), F.count("*").alias("n"))
    at = F.least(F.width_bucket(F.log10(value), F.lit(0.0), F.lit(float(top)), F.lit(edges - 1)), F.lit(edges - 1).cast("long"))
    return df.where(F.col(value) >= 1).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def top_cohorts(manifest: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest cohorts with their share of twelve-month follow-up, smallest of them first."""
    top = manifest.orderBy(F.desc("n_final"), "drug_id").limit(n)
    return top.withColumn("share_12m", F.when(F.col("n_final") > 0, F.round(F.col("n_with_12m_followup") / F.col("n_final"), 4)).otherwise(0.0)).orderBy("n_final", F.desc("drug_id"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(col).asc_nulls_last())
    return out if top is None else out.limit(top)


def rounded(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles of ``df`` rounded, for comparison."""

    def one(name: str, kind: str) -> Column:
        return F.round(name, digits).alias(name) if kind == "double" and name not in but else F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])
