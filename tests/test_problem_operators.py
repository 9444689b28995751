"""Spikes, intervals, hot keys and units: defined results for nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators.hotkeys import heavy_keys, key_quantiles
from cohortloom.operators.intervals import merge_periods, readable_day, union_runs
from cohortloom.operators.spikes import flag_spikes, stuck_mask
from cohortloom.operators.units import convert_units

PAIR = "pair_id long, site_id int, biomarker string, a double, b double, grp string, bin long, block long"


def spikes(df, **kw):
    return flag_spikes(df, record_id="pair_id", group_cols=["site_id", "biomarker"], fields=["a", "b"], log_scale=F.col("biomarker") == "crp", **kw)


def found(df):
    return sorted((r["pair_id"], r["val_field"]) for r in df.collect())


def test_spikes_by_blocks_match_whole_groups(spark):
    rng = random.Random(1)
    rows = [(i, 1 if rng.random() < 0.4 else rng.randint(2, 5), "ldl", rng.gauss(100, 10), rng.gauss(100, 10), "x", 1, 2) for i in range(6000)]
    rows[17] = (17, 1, "ldl", -3.0, 400.0, "x", 1, 2)
    for i in range(3000, 3007):
        rows[i] = (i, 3, "ldl", 97.0, rng.gauss(100, 10), "x", 1, 2)
    df = spark.createDataFrame(rows, PAIR)
    whole = found(spikes(df))
    assert (17, "a") in whole and (17, "b") in whole and all((i, "a") in whole for i in range(3000, 3007)) and len(whole) == 9
    assert found(spikes(df, block_rows=400, id_bin=256)) == whole


def test_run_over_a_block_border(spark):
    rows = [(i, 1, "ldl", 5.0 if 250 <= i < 262 else 5.0 + (i % 50) / 10 + 0.05, float(i % 97) + 1, None, None, None) for i in range(1000)]
    got = found(spikes(spark.createDataFrame(rows, PAIR), block_rows=64, id_bin=64))
    assert [p for p, f in got if f == "a"] == list(range(250, 262))


def test_spikes_nulls_repeats_and_small_groups(spark):
    rows = [(1, None, None, 0.0, None, None, None, None), (None, 1, "ldl", -1.0, -1.0, None, None, None), (2, None, None, float("nan"), None, None, None, None), (3, 1, "ldl", 1e9, 2.0, None, None, None)]
    rows += [(10 + i, 7, "crp", 4.0, None, None, None, None) for i in range(5)] + [(15, 7, "crp", None, None, None, None, None)] + [(16 + i, 7, "crp", 4.0, None, None, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, PAIR)
    stuck = [(i, "a") for i in [*range(10, 15), *range(16, 21)]]
    assert found(spikes(df)) == [(1, "a"), *stuck]
    assert found(spikes(df.limit(0))) == []
    assert found(spikes(df.where("pair_id >= 10"), min_run=10)) == stuck and found(spikes(df.where("pair_id >= 10"), min_run=11)) == []
    assert found(spikes(df.where("pair_id >= 10"), min_run=10, block_rows=2, id_bin=2)) == stuck


def test_stuck_over_nulls_and_many_blocks(spark):
    """Runs of readings with nulls inside, over blocks that hold no reading of the field or one run only."""
    rng = random.Random(9)
    rows, v = [], 50.0
    for i in range(1500):
        if rng.random() < 0.25:
            v = 40.0 + rng.randrange(200) / 10
        gap = 300 <= i < 420 or rng.random() < 0.2
        rows.append((i * 3, rng.choice([1, 2]), "ldl", None if gap else v, rng.gauss(50, 5), None, None, None))
    want = set()
    for s in (1, 2):
        seq = [(r[0], r[3]) for r in rows if r[1] == s and r[3] is not None]
        a = 0
        for z in range(1, len(seq) + 1):
            if z == len(seq) or seq[z][1] != seq[a][1]:
                want |= {(p, "a") for p, _ in seq[a:z]} if z - a >= 6 else set()
                a = z
    df = spark.createDataFrame(rows, PAIR)
    assert len(want) > 50
    for kw in ({}, {"block_rows": 16, "id_bin": 8}, {"block_rows": 100, "id_bin": 64}):
        assert {x for x in found(spikes(df, threshold=1e9, **kw))} == want


def test_rolling_window_follows_a_drift(spark):
    """A level that drifts: the far reading is normal for the whole source, but not for its neighbours; blocks don't matter."""
    rng = random.Random(4)
    rows = [(i, 1, "ldl", 100 + i / 10 + rng.gauss(0, 3), None, None, None, None) for i in range(4000)]
    rows[200] = (200, 1, "ldl", 260.0, None, None, None, None)
    rows[3900] = (3900, 1, "ldl", 350.0, None, None, None, None)
    df = spark.createDataFrame(rows, PAIR)
    want = [(200, "a"), (3900, "a")]
    for kw in ({}, {"block_rows": 300, "id_bin": 128}, {"block_rows": 64, "id_bin": 32}):
        assert found(spikes(df, reach=100, threshold=6.5, **kw)) == want
    assert found(spikes(df, reach=4000, threshold=6.5)) == []


def test_infinite_is_far(spark):
    rows = [(i, 1, "ldl", float("inf") if i == 4 else 10.0 + i, None, None, None, None) for i in range(40)]
    assert found(spikes(spark.createDataFrame(rows, PAIR))) == [(4, "a")]


@given(st.lists(st.sampled_from([1.0, 2.0, math.nan]), max_size=40), st.integers(2, 7))
def test_stuck_mask(values, least):
    there = [v for v in values if v == v]
    marks = []
    for i, v in enumerate(there):
        a = z = i
        while a > 0 and there[a - 1] == v:
            a -= 1
        while z + 1 < len(there) and there[z + 1] == v:
            z += 1
        marks.append(z - a + 1 >= least)
    left = iter(marks)
    want = [v == v and next(left) for v in values]
    assert stuck_mask(np.array(values, float), least).tolist() == want


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 60), st.integers(0, 9)), max_size=60))
@settings(max_examples=200)
def test_union_runs(items):
    rows = sorted((k, 0, a, a + n) for k, a, n in items)
    cols = [np.array([r[i] for r in rows], np.int64) for i in range(4)]
    got = list(zip(*[c.tolist() for c in union_runs(*cols)])) if rows else []
    days = {}
    for k, _, a, z in rows:
        days.setdefault(k, set()).update(range(a, z + 1))
    want = []
    for k in sorted(days):
        for d in sorted(days[k]):
            if d - 1 not in days[k]:
                e = d
                while e + 1 in days[k]:
                    e += 1
                want.append((k, 0, d, e))
    assert got == want


def test_periods_against_day_sets(spark):
    rng = random.Random(3)
    base = dt.date(2010, 1, 1)
    rows = []
    for i in range(3000):
        a = base + dt.timedelta(rng.randint(0, 2500))
        rows.append((rng.choice([1, 1, 1, rng.randint(2, 60)]), a, a + dt.timedelta(rng.randint(-2, 40)), "w", 3))
    rows += [(99, dt.date(1, 1, 1), dt.date(9999, 12, 31), "w", 3), (None, base, base, "w", 3), (5, None, base, "w", 3), (98, dt.date(1960, 1, 1), dt.date(1969, 12, 31), "w", 3), (98, dt.date(1970, 1, 1), dt.date(1970, 1, 2), "w", 3)]
    df = spark.createDataFrame(rows, "person_id long, a date, b date, who string, shard int")
    cover = {}
    for p, a, b, *_ in rows:
        if p and a and b and a <= b and p != 99:
            cover.setdefault(p, set()).update(range(a.toordinal(), b.toordinal() + 1))
    want = [("period", 99, dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    for p, days in cover.items():
        last = None
        for d in sorted(days):
            if last is None or d > last + 1:
                if last is not None:
                    want.append(("gap", p, dt.date.fromordinal(last + 1), dt.date.fromordinal(d - 1)))
                e = d
                while e + 1 in days:
                    e += 1
                want.append(("period", p, dt.date.fromordinal(d), dt.date.fromordinal(e)))
            last = d
    for shard in (32768, 100):
        keep = df if shard > 1000 else df.where("person_id != 99")
        got = merge_periods(keep, entity="person_id", start=F.col("a"), end=F.col("b"), shard_days=shard, buffer_rows=500).collect()
        assert Counter(map(tuple, got)) == Counter(w for w in want if shard > 1000 or w[1] != 99)
    assert merge_periods(df.limit(0), entity="person_id", start=F.col("a"), end=F.col("b")).count() == 0


def test_readable_day(spark):
    texts = {"2020-02-29": 1, " 2020-01-05\t": 1, "2020-01-05T00:00:00": 1, "2020-01-05 23:59:59": 1, "2021-02-29": 0, "2020-13-01": 0, "20200105": 0, "2020": 0, "2020-1-5": 0, "05.01.2020": 0, "": 0, None: 0, "2020-01-0x": 0, "x2020-01-05": 0}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", readable_day(F.col("t")).isNotNull().alias("ok"))
    assert {r["t"]: int(r["ok"]) for r in df.collect()} == texts


def test_heavy_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-7, 10**12, rng.randint(-(10**15), 10**15)]), rng.choice([0, None, rng.randint(1, 10**6)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = {(r["key_field"], r["key_id"]): r["n_rows"] for r in heavy_keys(df, ["a", "b"], Fraction(2, 100)).collect()}
    want = {}
    for i, f in enumerate("ab"):
        want |= {(f, k): n for k, n in Counter(r[i] for r in rows).items() if k is not None and n * 50 >= len(rows)}
    assert got == want
    assert heavy_keys(df.limit(0), ["a", "b"]).count() == 0
    assert heavy_keys(df.where("b is null"), ["b"]).count() == 0
    tie = spark.createDataFrame([(i % 50,) for i in range(100)], "a long")
    assert heavy_keys(tie, ["a"]).count() == 50


def test_key_quantiles(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 2, rng.randint(3, 9), None]), rng.choice([None, rng.randint(-(10**6), 10**6)])) for _ in range(3000)] + [(50, 4), (50, 4), (51, None)]
    df = spark.createDataFrame(rows, "k long, x long")
    got = {r["k"]: (r["n_values"], r["p25"], r["p50"], r["p99"]) for r in key_quantiles(df, "k", "x", (25, 50, 99)).collect()}
    by = {}
    for k, x in rows:
        if k is not None and x is not None:
            by.setdefault(k, []).append(x)
    rank = lambda v, p: sorted(v)[max(1, -(-len(v) * p // 100)) - 1]
    assert got == {k: (len(v), rank(v, 25), rank(v, 50), rank(v, 99)) for k, v in by.items()}
    assert key_quantiles(df.limit(0), "k", "x").count() == 0


BOOK = [(1, "ldl", 8.0, 420.0), (2, "hba1c", 3.2, 19.0)]
UNITS = [("ldl", "mg/dL", 1.0, 0.0, True), ("ldl", "mmol/L", 38.67, 0.0, False), ("ldl", "g/L", 100.0, 0.0, False), ("hba1c", "%", 1.0, 0.0, True), ("hba1c", "mmol/mol", 0.0915, 2.15, False), ("hba1c", "fraction", 100.0, 0.0, False)]


def units(spark, rows, **kw):
    m = spark.createDataFrame(rows, "measurement_id long, measurement_concept_id long, val double, unit_text string, value_text string, site_id int, biomarker string, units int")
    book = spark.createDataFrame(BOOK, "concept_id long, biomarker string, lo double, hi double")
    ref = spark.createDataFrame(UNITS, "biomarker string, unit_code string, factor double, shift double, is_common boolean")
    return {r["measurement_id"]: r for r in convert_units(spark, m, book, ref, **kw).collect()}


def test_units_rules(spark):
    rows = [(i, 1, 100.0 + i, "mg/dl", None, 1, "x", 1) for i in range(60)] + [(100 + i, 1, 2.0 + i / 50, " MMOL/L", None, 2, "x", 1) for i in range(60)]
    rows += [
        (200, 1, 110.0, None, None, 1, "x", 1), (201, 1, 3.0, None, None, 2, "x", 1), (202, 1, 120.0, None, None, 2, "x", 1), (203, 2, None, None, "HbA1c 7,5 %", 1, "x", 1),
        (204, 2, 0.07, None, "reported in fraction", 1, "x", 1), (205, 2, None, None, "result=48;unit=mmol/mol IFCC", None, "x", 1), (206, 2, None, None, "pending", 1, "x", 1), (207, 9, 5.0, "%", None, 1, "x", 1),
        (208, None, 5.0, "%", None, 1, "x", 1), (209, 1, float("nan"), None, "98 mg/100 mL", 3, "x", 1), (210, 1, 5000.0, "mg/dL", None, 1, "x", 1), (211, 2, 6.1, "mg/dL", "HbA1c [%]", 1, "x", 1),
    ]
    got = units(spark, rows)
    code = {k: r["unit_code"] for k, r in got.items()}
    assert (code[200], code[201], code[202]) == ("mg/dL", "mmol/L", "mg/dL")
    assert (code[203], code[204], code[205], code[209], code[210], code[211]) == ("%", "fraction", "mmol/mol", "mg/dL", "mg/dL", "%")
    assert not {206, 207, 208} & set(got) and math.isclose(got[205]["common_value"], 48 * 0.0915 + 2.15) and got[203]["value"] == 7.5
    assert got[202]["needs_review"] or got[202]["unit_origin"] == "forest"


def test_units_without_labels_or_rows(spark):
    got = units(spark, [(1, 1, 100.0, None, None, None, None, None)])
    assert got[1]["unit_code"] == "mg/dL" and got[1]["needs_review"]
    assert units(spark, []) == {}


def test_forest_on_held_out_rows(spark):
    """The classifier predicts hidden units of rows it was not fitted on."""
    from cohortloom.operators.units import UnitForest, _with_habits, settle
    from cohortloom.session import load

    d = "/root/testdata/sf0.01"
    rows = _with_habits(spark, load(spark, d, "filtered_measurements"), load(spark, d, "biomarker_codebook"), load(spark, d, "unit_reference"))
    told = rows.where("stated is not null")
    fit, rest = told.where("measurement_id % 2 = 0"), told.where("measurement_id % 2 = 1")
    out = UnitForest.fit(fit, sample_rows=4000).predict(rest).withColumn("truth", settle(F.col("stated")))
    acc, sure = out.selectExpr("avg(cast(guess = truth as double))", "avg(case when confidence >= 0.9 then cast(guess = truth as double) end)").first()
    assert acc > 0.85 and sure > 0.93


def test_confident_forest_decides_and_doubt_is_reviewed(spark):
    """Units that only the size of the value tells: the forest goes against the source's habit where it is confident."""
    rng = random.Random(8)
    rows = [(i, 2, *((rng.gauss(7, 0.5), "%") if rng.random() < 0.75 else (rng.gauss(15, 0.5), "mmol/mol")), None, i % 3, "x", 1) for i in range(3000)]
    rows += [(9000, 2, 7.1, None, None, 1, "x", 1), (9001, 2, 15.0, None, None, 1, "x", 1), (9002, 2, 11.0, None, None, 1, "x", 1)]
    got = units(spark, rows)
    assert (got[9000]["unit_code"], got[9000]["unit_origin"], got[9000]["needs_review"]) == ("%", "forest", False)
    assert (got[9001]["unit_code"], got[9001]["unit_origin"]) == ("mmol/mol", "forest")
    unsure = units(spark, rows, confident=1.1)
    assert (unsure[9001]["unit_code"], unsure[9001]["unit_origin"], unsure[9001]["needs_review"]) == ("%", "site", True)


def test_units_of_biomarkers_without_reference(spark):
    m = spark.createDataFrame([(1, 1, 100.0, None, None, 1), (2, 2, 6.0, "%", None, 1), (3, 1, None, None, "LDL 99 mg/dL", None), (4, 1, 50.0, "x" * 100_000, None, 1)], "measurement_id long, measurement_concept_id long, val double, unit_text string, value_text string, site_id int")
    book = spark.createDataFrame([*BOOK, (3, None, None, None)], "concept_id long, biomarker string, lo double, hi double")
    ref = spark.createDataFrame([u for u in UNITS if u[0] == "hba1c"], "biomarker string, unit_code string, factor double, shift double, is_common boolean")
    got = {r["measurement_id"]: (r["unit_code"], r["needs_review"]) for r in convert_units(spark, m, book, ref).collect()}
    assert got == {1: (None, True), 2: ("%", False), 3: (None, True), 4: (None, True)}
    assert {r["unit_code"] for r in convert_units(spark, m, book, ref.limit(0)).collect()} == {None}
    assert convert_units(spark, m, book.limit(0), ref).count() == 0
