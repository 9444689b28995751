"""Every query of the core with SQL gives what the SQL gives; the others run. Acceptance counts of the cohort funnel."""

import pytest

from cohortloom.plans import artefact_queries, problem_queries, reference_queries
from tests.conftest import DATA

QUERIES = problem_queries.QUERIES | reference_queries.QUERIES | artefact_queries.QUERIES
SQL = problem_queries.SQL | reference_queries.SQL | artefact_queries.SQL
SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, compare, name):
    got, want = compare(spark, QUERIES[name], SQL[name], SMALL)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("sf, want", [("sf0.001", (2502, 1259, 1199, 68, 150)), ("sf0.01", (26623, 13526, 13047, 654, 1654))])
def test_cohort_funnel(spark, sf, want):
    steps = reference_queries._steps(spark, f"{DATA}/{sf}").candidates.selectExpr(
        "count(*)", "count_if(observed)", "count_if(washed)", "count_if(washed and n_new = 1 and all_mono)", "count_if(washed and n_new = 2 and all_mono)"
    )
    assert tuple(steps.first()) == want


def test_outcome_counts(spark):
    got = reference_queries.outcome_windows(spark, f"{DATA}/sf0.01").selectExpr("count(*)", "count(baseline_val)", "count(m6_val)", "count(m12_val)", "count_if(has_pair_6m)", "count_if(has_pair_12m)").first()
    assert tuple(got) == (750, 686, 679, 705, 620, 646)


def test_pair_overlap_counts(spark):
    got = reference_queries.pair_overlap(spark, SMALL).selectExpr("count(*)", "sum(n_concomitant)", "sum(n_a_first)", "sum(n_b_first)").first()
    assert tuple(got) == (300, 3116, 11055, 11368)


def test_result_does_not_depend_on_partitioning(spark):
    a = sorted(map(tuple, reference_queries.cohort_mono(spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, reference_queries.cohort_mono(spark, SMALL).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
