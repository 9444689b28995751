"""Column functions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dates as D
from cohortloom.functions import ids as I
from cohortloom.functions import text as T
from cohortloom.functions import vectors as V


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_names(spark):
    cases = {"metformin hydrochloride": "metformin", "Atorvastatin Calcium": "atorvastatin", "Amlodipine (as besilate)": "amlodipine", "sodium chloride": "sodium chloride", "": "", None: "", "a-b/c;  d": "a b c d", "insulin x sodium": "insulin x"}
    assert column(spark, [(k,) for k in cases], "n string", T.normalized_name(F.col("n"))) == list(cases.values())


def test_directions(spark):
    cases = [("ANTAGONIST", None, -1), ("INVERSE AGONIST", None, -1), ("AGONIST", None, 1), (None, "Receptor opener", 1), ("OTHER", None, -1), (None, None, -1)]
    assert column(spark, [c[:2] for c in cases], "a string, m string", T.effect_direction(F.col("a"), F.col("m"))) == [c[2] for c in cases]
    assert column(spark, [("inverse agonist",), ("Replacement",), ("other",), (None,)], "a string", T.action_direction(F.col("a"))) == [-1.0, 1.0, 0.0, 0.0]
    assert column(spark, [("1", "ANTAGONIST"), ("0", "ANTAGONIST"), ("x", "AGONIST"), (None, None)], "d string, a string", T.effective_direction(T.resolved_direction(F.col("d"), F.col("a")))) == [1.0, -1.0, 1.0, -1.0]


def test_potency(spark):
    cases = [(1.0, 9.0), (100.0, 7.0), (10000.0, 5.0), (10001.0, 0.0), (0.0, 10.0), (-3.0, 10.0), (None, 7.0), (float("nan"), 7.0)]
    assert column(spark, [(c[0],) for c in cases], "a double", F.round(T.potency_score(F.col("a")), 9)) == [c[1] for c in cases]
    assert column(spark, [("Kd",), ("KI",), ("ic50",), ("EC50",), (None,)], "t string", T.affinity_priority(F.col("t"))) == [1, 2, 3, 4, 4]
    assert column(spark, [(" P12345-1 ",), ("Q9",)], "u string", T.protein_accession(F.col("u"))) == ["P12345", "Q9"]
    assert column(spark, [("a10ba02",)], "u string", T.atc_family(F.col("u"))) == ["A10BA"]


def test_dates(spark):
    cases = {"2020": None, "20200102": None, " 2020-01-02 ": dt.date(2020, 1, 2), "2020-01-02T03:04:05": dt.date(2020, 1, 2), "2020-1-2": dt.date(2020, 1, 2), None: None, "2020-02-30": None}
    assert column(spark, [(k,) for k in cases], "t string", D.date_or_null(F.col("t"))) == list(cases.values())
    assert column(spark, [("3.7",), ("x",), (None,), ("12",)], "t string", D.int_or_null(F.col("t"))) == [4, None, None, 12]
    day = dt.date(2020, 1, 1)
    assert column(spark, [(day, None, None), (day, None, 5), (day, dt.date(2020, 3, 1), 5)], "s date, e date, n int", D.imputed_end(F.col("s"), F.col("e"), F.col("n"))) == [dt.date(2020, 1, 31), dt.date(2020, 1, 6), dt.date(2020, 3, 1)]
    assert column(spark, [(day,)], "d date", D.minute_before(F.col("d"))) == [dt.datetime(2019, 12, 31, 23, 59)]
    from cohortloom.operators.outcomes import WINDOWS

    offs = {-91: None, -90: "baseline", 0: "baseline", 1: None, 119: None, 120: "m6", 240: "m6", 241: None, 299: None, 300: "m12", 420: "m12", 421: None}
    rows = [(day + dt.timedelta(o), day) for o in offs]
    assert column(spark, rows, "d date, t date", D.window_name(F.col("d"), F.col("t"), WINDOWS)) == list(offs.values())


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0])]
    s = "a array<float>, b array<float>"
    assert column(spark, rows, s, V.unit(F.col("a"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert column(spark, rows[:1], s, V.cosine_distance(F.col("a"), F.col("b"))) == [1.0]
    assert column(spark, rows, s, V.mean_of_two(F.col("a"), F.col("b"))) == [[3.5, 0.5], [0.5, 0.0]]
    assert column(spark, rows, s, V.any_nonzero(F.col("a"))) == [True, False]
    assert column(spark, rows[:1], s, V.padded(F.col("a"), 4)) == [[3.0, 4.0, 0.0, 0.0]]
    assert column(spark, [(None,)], "a array<double>", V.or_zero(F.col("a"), 2)) == [[0.0, 0.0]]
    assert column(spark, [(None, [1.0])], s, V.modality("concat", F.col("a"), F.col("b"))) == [None]
    assert column(spark, [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>", V.masked_mean(F.col("t"), F.col("m"))) == [[2.0, 3.0]]
    with pytest.raises(ValueError):
        V.modality("audio", F.lit(1), F.lit(2))


def test_ids(spark):
    import hashlib

    rows = [(7, 3), (3, 7)]
    want = int(hashlib.md5(b"3_7").hexdigest()[:12], 16) % 10**12 + 9 * 10**12
    assert column(spark, rows, "a long, b long", I.pair_id(F.col("a"), F.col("b"))) == [want, want]
    x, y = column(spark, rows, "a long, b long", I.synthetic_pair_id(F.col("a"), F.col("b")))
    assert x == y < 0
    people = spark.range(20000).withColumnRenamed("id", "p")
    n = people.where(I.in_sample(F.col("p"), 0.29)).count()
    assert abs(n / 20000 - 0.28) < 0.02 and people.where(I.in_sample(F.col("p"), 1.0)).count() == 20000
