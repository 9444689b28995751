"""Cohorts, catalog, pairs, statistics, representations and audits on small made cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.config import Screening
from cohortloom.operators import audit, cache, catalog, cohorts, features, outcomes, pairs, representations, stats, svd, targets, vocabulary

D0 = dt.date(2015, 1, 1)
EXP = "person_id long, exp_date date, ingredient_id long, is_monotherapy boolean"
OBS = "person_id long, obs_start date, obs_end date"


def day(n):
    return D0 + dt.timedelta(n)


def run(spark, exposures, obs=((1, -400, 400),), comparators=None):
    e = spark.createDataFrame([(p, day(d), i, m) for p, d, i, m in exposures], EXP)
    o = spark.createDataFrame([(p, day(a), day(b)) for p, a, b in obs], OBS)
    c = spark.createDataFrame(comparators, "ingredient_id long, comparator_id long") if comparators else None
    return cohorts.screen(e, o, comparators=c)


def mono(steps):
    return sorted((r["drug_id"], r["person_id"]) for r in cohorts.mono_cohorts(steps).collect())


@pytest.mark.parametrize("history, ahead, full, ok", [(365, 182, False, True), (364, 182, False, False), (365, 181, False, False), (365, 364, False, True), (365, 365, True, True)])
def test_observation_edges(spark, history, ahead, full, ok):
    rows = cohorts.mono_cohorts(run(spark, [(1, 0, 5, True)], [(1, -history, ahead)])).collect()
    assert bool(rows) == ok
    if rows:
        r = rows[0]
        assert (r["history_days_prior"], r["follow_up_days"], r["has_12m_followup"], r["t_6m"], r["t_12m"]) == (history, ahead, full, day(182), day(365))


def test_washout_edges(spark):
    assert mono(run(spark, [(1, 0, 5, True), (1, -365, 5, False)])) == []
    assert mono(run(spark, [(1, 0, 5, True), (1, -366, 5, False)], [(1, -900, 400)])) == [(5, 1)]
    # a chronic refill on t0 does not exclude, a new second drug makes a pair, three make neither
    assert mono(run(spark, [(1, 0, 5, True), (1, 0, 6, True), (1, -100, 6, True)], [(1, -900, 400)])) == [(5, 1), (6, 1)]
    two = run(spark, [(1, 0, 5, True), (1, 0, 6, True)])
    assert mono(two) == [] and sorted((r["drug_id"], r["other_id"]) for r in cohorts.pair_members(two).collect()) == [(5, 6), (6, 5)]
    three = run(spark, [(1, 0, 5, True), (1, 0, 6, True), (1, 0, 7, True)])
    assert mono(three) == [] and cohorts.pair_members(three).count() == 0
    # mono and combo row of the target on one day: not all mono
    assert mono(run(spark, [(1, 0, 5, True), (1, 0, 5, False)])) == []
    assert mono(run(spark, [(1, 0, 5, True), (1, -30, 8, True)], [(1, -500, 400)], [(5, 8)])) == [(8, 1)]
    assert (5, 1) in mono(run(spark, [(1, 0, 5, True), (1, -30, 8, True)], [(1, -500, 400)]))


def test_cohort_nulls_and_empty(spark):
    e = spark.createDataFrame([(None, day(0), 5, True), (1, None, 5, True), (1, day(0), None, True), (2, day(0), 5, None)], EXP)
    o = spark.createDataFrame([(1, day(-400), day(400)), (2, day(-400), day(400))], OBS)
    assert mono(cohorts.screen(e, o)) == [] and mono(cohorts.screen(e.limit(0), o)) == [] and mono(cohorts.screen(e, o.limit(0))) == []
    assert cohorts.attrition(cohorts.screen(e.limit(0), o)).count() == 0


def test_pair_cohort_keeps_the_later_target(spark):
    rows = [(6, 5, 1, day(9)), (5, 6, 1, day(3)), (5, 6, 2, day(1)), (6, 5, 2, day(1))]
    m = spark.createDataFrame([(a, b, p, t, t, t, 1, 1, True) for a, b, p, t in rows], "drug_id long, other_id long, person_id long, t0 date, t_6m date, t_12m date, history_days_prior int, follow_up_days int, has_12m_followup boolean")
    got = {r["person_id"]: r for r in cohorts.pair_cohorts(m, least=2).collect()}
    assert got[1]["t0"] == day(9) and got[1]["name"] == "5 + 6 (De Facto)" and len(got) == 2
    assert cohorts.pair_cohorts(m, least=3).count() == 0


def test_manifest_upsert_and_resume(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "drug_id long, name string")
    idx = spark.createDataFrame([(1, True), (1, False), (2, True)], "drug_id long, has_12m_followup boolean")
    m = cohorts.manifest(idx, names)
    assert [(r["drug_id"], r["n_final"], r["status"]) for r in m.orderBy("drug_id").collect()] == [(1, 2, "SAVED"), (2, 1, "SAVED"), (3, 0, "ZERO_PATIENT")]
    new = m.where("drug_id = 3").withColumn("n_final", F.lit(9).cast("long"))
    assert [(r["drug_id"], r["n_final"]) for r in cohorts.upsert_manifest(m, new).collect()] == [(3, 9), (1, 2), (2, 1)]
    assert [r["drug_id"] for r in cohorts.remaining(names, m.where("drug_id = 2"), 1).collect()] == [1]


def test_outcome_ties(spark):
    idx = spark.createDataFrame([(9, 1, day(0))], "drug_id long, person_id long, t0 date")
    v = [(1, day(-3), "ldl", 5.0), (1, day(-3), "ldl", 4.0), (1, day(180), "ldl", 1.0), (1, day(184), "ldl", 2.0), (1, day(100), "ldl", 7.0), (1, None, "ldl", 7.0), (1, day(0), "crp", None)]
    out = outcomes.windowed_outcomes(idx, spark.createDataFrame(v, "person_id long, measurement_date date, biomarker string, val double")).collect()
    assert [(r["biomarker"], r["baseline_val"], r["m6_val"], r["m12_val"], r["delta_6m"], r["has_pair_6m"], r["has_pair_12m"]) for r in out] == [("ldl", 4.0, 2.0, None, -2.0, True, False)]


def test_cache_edges(spark):
    raw = spark.createDataFrame([("1", "2020", "2020-01-05"), ("1", " 2019-01-02 ", "20200102"), ("x", "2019-01-02", "2019-01-03"), (None, None, None)], "person_id string, observation_period_start_date string, observation_period_end_date string")
    assert [tuple(r) for r in cache.trim_observation(raw).collect()] == [(1, dt.date(2019, 1, 2), dt.date(2020, 1, 5))]


def test_vocabulary_counts_ingredients_once(spark):
    anc = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (1, 11), (9, 11)], "ancestor_concept_id long, descendant_concept_id long")
    ing = spark.createDataFrame([(1, "a"), (2, "b")], "concept_id long, concept_name string")
    assert sorted(map(tuple, vocabulary.product_mapping(anc, ing).collect())) == [(1, 10, True), (1, 11, False), (2, 11, False)]


def test_catalog_roundtrip(spark):
    ing = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "gamma")], "concept_id long, concept_name string")
    mech = spark.createDataFrame([("alpha sodium", "C1", "P1-2", "ANTAGONIST", "m"), ("Beta", "C2", "P1", "AGONIST", None), ("Beta", "C2", "P2", "AGONIST", None), (None, "C3", "P2", None, None)], "drug_name string, drug_chembl_id string, uniprot_id string, action_type string, mechanism_of_action string")
    aff = spark.createDataFrame([("C2", "P1", "Ki", 1.0), ("C2", "P2", "Ki", 20000.0)], "drug_chembl_id string, uniprot_id string, standard_type string, min_affinity_nm double")
    vp = spark.createDataFrame([("P1", [1.0, 0.0]), ("P2", [0.0, 1.0])], "uniprot_id string, vp array<float>")
    cat = targets.theoretical_catalog(ing, targets.drug_targets(ing, mech, aff), vp, dim=2)
    ua = {r["ingredient_concept_id"]: r["ua"] for r in cat.collect()}
    assert ua == {1: [-1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 0.0]}
    text = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "concept_id long, dense_embedding array<float>")
    items = catalog.single_items(catalog.merge_text_embeddings(cat, text))
    mapping = spark.createDataFrame([(1, 100, False), (2, 100, False), (1, 101, True), (1, 102, False), (2, 102, False), (3, 102, False)], "ingredient_id long, drug_concept_id long, is_monotherapy boolean")
    combos, codes = catalog.fixed_combinations(mapping, items)
    both = items.unionByName(combos)
    c = combos.collect()
    assert len(c) == 1 and c[0]["drug_id"] < 0 and c[0]["name"] == "Alpha + beta" and c[0]["target_vector"] == [0.0, 0.0]
    index = {r[0]: r[1] for r in catalog.code_index(items, mapping, codes).collect()}
    assert index[101] == 1 and index[100] == c[0]["drug_id"] and index[3] == 3 and 102 not in index
    audit_rows = {r["metric"]: r["value"] for r in catalog.catalog_audit(both, catalog.code_index(items, mapping, codes)).collect()}
    assert audit_rows["n_items"] == 4 and audit_rows["worst_additivity"] == 0.0 and audit_rows["n_duplicate_ids"] == 0
    ask = spark.createDataFrame([(3, 1), (1, 3), (2, 1)], "a long, b long")
    made = catalog.observed_combinations(ask, both).collect()
    assert [sorted(r["ingredient_concept_ids"]) for r in made] == [[1, 3]]
    with pytest.raises(Exception, match="unknown ingredient 77"):
        catalog.observed_combinations(spark.createDataFrame([(77, 1)], "a long, b long"), both).collect()


def test_svd_gram(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 2, (12, 7)).astype(float)
    e = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(7)], "i long, j long, x double")
    got = features.truncated_svd(e, 4, n_rows=12, n_cols=7).orderBy("i").collect()
    a = np.array([r["vec"] for r in got])
    u, s, _ = np.linalg.svd(m)
    want = u[:, :4] * s[:4]
    assert np.allclose(a @ a.T, want @ want.T, atol=1e-6)


def test_svd_takes_few_passes(spark):
    """An iteration that runs a job for every vector takes hundreds of jobs."""
    rng = np.random.default_rng(2)
    m = np.where(rng.random((300, 300)) < 0.1, rng.random((300, 300)), 0)
    e = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "i long, j long, x double")
    sc = spark.sparkContext
    sc.setJobGroup("few passes", "few passes")
    try:
        got = {r["i"]: r["vec"] for r in features.truncated_svd(e, 16, n_rows=300, n_cols=300).collect()}
        assert 0 < len(sc.statusTracker().getJobIdsForGroup("few passes")) < 100
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    u, s, _ = np.linalg.svd(m)
    want, a = u[:, :16] * s[:16], np.array([got[i] for i in range(300)])
    assert np.allclose(a @ a.T, want @ want.T, atol=1e-6)


@pytest.mark.parametrize("dense, part", [(2048, 4_000_000), (8, 4_000_000), (50, 100)])
def test_svd_of_connected_parts(spark, monkeypatch, dense, part):
    """Three equal parts and a larger one, either side the longer one, solved by tasks, by block Lanczos or by one pass; cells in halves."""
    monkeypatch.setattr(svd, "DENSE", dense)
    monkeypatch.setattr(svd, "PART", part)
    rng = np.random.default_rng(3)
    m, small = np.zeros((55, 81)), 4 * rng.random((5, 7))
    m[:40, :60] = rng.random((40, 60))
    for i in range(3):
        m[40 + 5 * i : 45 + 5 * i, 60 + 7 * i : 67 + 7 * i] = small
    for x in (m, m.T):
        cells = [(f"r{i:02}", f"c{j:02}", float(x[i, j]) / 2) for i, j in np.argwhere(x)]
        e = spark.createDataFrame(cells * 2 + [(None, "c00", 1.0), ("r00", None, 1.0), ("r00", "c00", None)], "i string, j string, x double")
        got = {r["i"]: r["vec"] for r in features.truncated_svd(e, 4, n_rows=x.shape[0], n_cols=x.shape[1]).collect()}
        a = np.array([got[f"r{i:02}"] for i in range(len(x))])
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        want = u[:, :4] * s[:4]
        assert a.shape == want.shape and np.allclose(a @ a.T, want @ want.T, atol=1e-6)


def test_largest_finds_equal_values_and_low_ranks():
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(90, 90)))[0]
    for values, k in (([5.0, 5.0, 5.0, 1.0], 4), ([5.0, 5.0, 5.0, 1.0], 6), (list(np.linspace(9, 1, 90)), 3)):
        g = (q[:, : len(values)] * values) @ q[:, : len(values)].T
        value, vec = svd.largest(lambda x, g=g: g @ x, 90, k)
        n = min(k, len(values))
        assert np.allclose(value[:n], values[:n]) and np.allclose(value[n:], 0, atol=1e-9)
        assert np.allclose(g @ vec, vec * value, atol=1e-7) and np.allclose(vec.T @ vec, np.eye(vec.shape[1]))
    n, s, x = np.array([2, 1, 3]), np.array([0, 2, 1, 0, 1, 3]), np.arange(1.0, 7)
    full = np.zeros((3, 40))
    full[np.repeat(np.arange(3), n), s] = x
    assert np.allclose(svd.gram(n, s, x, 40), full.T @ full) and np.allclose(svd.gram(n, s, x, 4), (full.T @ full)[:4, :4])
    assert svd.labels(7, np.array([5, 3, 1]), np.array([3, 1, 6])).tolist() == [0, 1, 2, 1, 4, 1, 1]


def test_largest_finds_equal_values_with_small_blocks():
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(400, 400)))[0]
    for values, k, block in (([5.0] * 9 + [1.0], 9, 2), ([5.0] * 3 + [1.0], 2, 1), ([9.0] * 7 + list(np.linspace(8, 1, 300)), 12, 3), ([8.9] * 10 + list(np.linspace(9, 1, 390)), 14, 2)):
        values = np.sort(values)[::-1]
        g = (q[:, : len(values)] * values) @ q[:, : len(values)].T
        value, vec = svd.largest(lambda x, g=g: g @ x, 400, k, block=block)
        assert np.allclose(value, values[:k]) and np.allclose(g @ vec, vec * value, atol=1e-7) and np.allclose(vec.T @ vec, np.eye(k))


def test_svd_of_a_large_part_leaves_little_on_disk(spark, monkeypatch):
    """Sums of the passes over one large part, with several blocks, do not pile up as shuffle files."""
    monkeypatch.setattr(svd, "DENSE", 8)
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 1500 * 3000, 60_000))
    cells = [(int(c) // 3000, int(c) % 3000, float(x)) for c, x in zip(at, 0.5 + rng.random(len(at)), strict=True)]
    e = spark.createDataFrame(cells, "i long, j long, x double")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> int:
        files = manager.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    before = shuffled()
    got = {r["i"]: r["vec"] for r in features.truncated_svd(e, 32, n_rows=1500, n_cols=3000).collect()}
    assert shuffled() - before < 20_000_000
    m = np.zeros((1500, 3000))
    m.ravel()[at] = [c[2] for c in cells]
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want, a = u[:, :32] * s[:32], np.array([got[i] for i in range(1500)])
    assert np.allclose(a @ a.T, want @ want.T, atol=1e-6)


def test_protein_features(spark):
    prot = spark.createDataFrame([("A",), ("B",), ("C",)], "uniprot_id string")
    re_ = spark.createDataFrame([("A", "p1", "", "", "", "Homo sapiens"), ("B", "p1", "", "", "", "Homo sapiens"), ("B", "p2", "", "", "", "Homo sapiens"), ("A", "p9", "", "", "", "Mus")], "uniprot_id string, pathway_id string, url string, pathway_name string, evidence string, species string")
    r = {x[0]: x[1] for x in features.pathway_embeddings(re_, prot, k=3).collect()}
    assert set(r) == {"A", "B", "C"} and r["C"] == [0.0] * 3 and any(r["A"]) and all(len(v) == 3 for v in r.values())
    links = spark.createDataFrame([("s1", "s2", 900), ("s2", "s1", 900), ("s2", "s3", 399), ("s2", "s4", 500), ("s4", "s2", 500)], "protein1 string, protein2 string, combined_score int")
    al = spark.createDataFrame([("s1", "A", "x"), ("s9", "A", "x"), ("s3", "B", "x")], "string_id string, alias string, source string")
    s = {x[0]: x[1] for x in features.interaction_embeddings(links, al, prot, k=2).collect()}
    assert any(s["A"]) and not any(s["B"]) and not any(s["C"])
    exp = spark.createDataFrame([("g1", 1, [0.0, 1.0]), ("G1", 2, [math.e - 1, 0.0])], "gene string, line long, tpm array<double>")
    voc = spark.createDataFrame([("A", "g1 protein")], "concept_code string, concept_name string")
    g = {x[0]: x[1] for x in features.expression_embeddings(exp, voc, prot, 2).collect()}
    assert np.allclose(g["A"], [1.0, 0.0]) and g["B"] == [0.0, 0.0]
    v = features.assembled_vectors(spark.createDataFrame([("A", [3.0])], "uniprot_id string, x array<float>"), spark.createDataFrame([("A", [4.0]), ("B", [1.0])], "uniprot_id string, y array<float>")).collect()
    assert [r["uniprot_id"] for r in v] == ["A"] and np.allclose(v[0]["vp"], [0.6, 0.8])


def test_prototypes_of_a_large_cohort_use_every_point(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 3)) + [2, 0, 0]
    x[::7, 1] += 30
    points = spark.createDataFrame([(d, i, v.tolist()) for d, n in ((1, 400), (2, 30)) for i, v in enumerate(x[:n])], "drug_id long, person_id long, vec array<double>")
    for k in (1, 2):
        got = {(r["drug_id"], r["k_id"]): r["proto"] for r in pairs.prototypes(points, k=k, sample=64).collect()}
        far = np.arange(400) % 7 == 0
        for d, n in ((1, 400), (2, 30)):
            groups = [x[:n]] if k == 1 else [x[:n][far[:n]], x[:n][~far[:n]]]
            want = sorted((g.mean(0) / np.linalg.norm(g.mean(0))).tolist() for g in groups)
            assert np.allclose(sorted(list(got[d, i]) for i in range(k)), want)


def test_prototypes_and_pairs(spark):
    rng = np.random.default_rng(0)
    centres = {1: [[1, 0, 0]], 2: [[0.99, 0.05, 0], [0, 1, 0]], 3: [[0, 0, 1]]}
    pts, idx = [], []
    for d, cs in centres.items():
        for i in range(60):
            pts.append((d, d * 1000 + i, (np.array(cs[i % len(cs)]) + rng.normal(0, 0.01, 3)).tolist()))
            idx.append((d, d * 1000 + i, day(i)))
    points = spark.createDataFrame(pts, "drug_id long, person_id long, vec array<double>")
    proto = pairs.prototypes(points, k=2)
    assert all(abs(np.linalg.norm(r["proto"]) - 1) < 1e-9 for r in proto.collect()) and proto.count() == 6
    few = pairs.prototypes(points.where("person_id in (1000, 1001, 1002)"), k=3)
    assert few.count() == 3
    one, many = pairs.cohort_distances(proto), pairs.cohort_distances(proto, block=2)
    key = lambda df: sorted((r["a"], r["b"], round(r["distance"], 9)) for r in df.collect())
    assert key(one) == key(many) and len(key(one)) == 3
    index = spark.createDataFrame(idx + [(2, 1000 + i, day(i + 1)) for i in range(5)] + [(2, 1010, day(10))], "drug_id long, person_id long, t0 date")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "drug_id long, name string")
    got = pairs.candidate_pairs(points, index, names, Screening(prototypes=2)).collect()
    assert [(r["drug_a_id"], r["drug_b_id"], r["n_raw_a"], r["n_raw_b"], r["n_clean_a"], r["n_clean_b"], r["n_cross_dropped"], r["n_concomitant_dropped"]) for r in got] == [(1, 2, 60, 66, 59, 60, 5, 1)]
    assert pairs.candidate_pairs(points.limit(0), index, names).count() == 0


def test_statistics(spark):
    assert abs(stats.t_pvalue(2.0, 10) - 0.07338803) < 1e-7 and abs(stats.t_pvalue(0.0, 5) - 1) < 1e-12
    x = [1.0, -2.0, 3.0, 3.0, -3.0, 4.0, 0.0, 5.5, 6.0]
    df = spark.createDataFrame([("k", v) for v in x], "k string, v double")
    w = stats.wilcoxon(df, ["k"], "v").first()
    # ranks of 1 2 3 3 3 4 5.5 6: 1 2 4 4 4 6 7 8
    assert (w["n_nonzero"], w["w_plus"], w["w_minus"]) == (8, 30.0, 6.0)
    assert abs(w["z"] - (6 - 18) / math.sqrt(8 * 9 * 17 / 24 - 24 / 48)) < 1e-12
    m = stats.moments(df, ["k"], "v").first()
    assert m["n"] == 9 and abs(m["mean"] - np.mean(x)) < 1e-12 and abs(m["sd"] - np.std(x, ddof=1)) < 1e-12 and m["median"] == 3.0
    flat = stats.moments(spark.createDataFrame([("k", 2.0), ("k", 2.0)], "k string, v double"), ["k"], "v").first()
    assert flat["cohens_d"] == 0.0 and flat["t"] is None
    sizes = spark.createDataFrame([(1,), (10,), (100,), (0,)], "n long")
    assert sum(r["n"] for r in stats.log_histogram(sizes, "n").collect()) == 3 and stats.log_histogram(sizes.limit(0), "n").agg(F.sum("n")).first()[0] in (0, None)


def test_representations(spark):
    idx = spark.createDataFrame([(2, 1, day(0)), (1, 1, day(0)), (1, 1, day(5)), (1, 7, day(0))], "drug_id long, person_id long, t0 date")
    p = representations.remaining_passes(idx, idx.where("person_id = 7"))
    assert sorted((r["pass_id"], r["drug_id"], r["t0"]) for r in p.collect()) == [(0, 1, day(0)), (1, 2, day(0)), (2, 1, day(5))]
    f = spark.createDataFrame([(1, day(0), 1.0, 2.0)], "person_id long, t0 date, data_1 double, data_0 double")
    assert sorted((r["drug_id"], r["vec"]) for r in representations.aligned(idx, f).collect()) == [(1, [2.0, 1.0]), (2, [2.0, 1.0])]
    assert sorted(map(tuple, representations.missing(idx, f).collect())) == [(1, 2)]
    with pytest.raises(ValueError):
        representations.prediction_times(idx, "t_3m")
    old = idx.withColumn("x", F.lit(1))
    assert representations.merged(old, old.limit(1).withColumn("x", F.lit(2))).where("x = 2").count() == 1


def test_audits_find_what_is_wrong(spark):
    idx = spark.createDataFrame([(5, 1, day(0), True), (5, 1, day(0), True)], "drug_id long, person_id long, t0 date, has_12m_followup boolean")
    exp = spark.createDataFrame([(1, day(-10), 5, True), (1, day(0), 6, True), (1, day(0), 7, True), (1, day(-5), 7, True)], EXP)
    obs = spark.createDataFrame([(1, day(-100), day(200))], OBS)
    assert audit.duplicate_persons(idx).first()["n_duplicates"] == 1
    assert audit.washout_leaks(idx, exp).first()["n_leaks"] == 1
    assert audit.coinitiations(idx, exp).first()["n_coinitiations"] == 1
    w = audit.window_violations(idx, obs).first()
    assert (w["n_outside"], w["n_short_history"], w["n_short_follow_up"], w["n_wrong_flag"]) == (0, 2, 0, 2)
    man = spark.createDataFrame([(5, 3, "SAVED"), (6, 0, "ZERO_PATIENT")], "drug_id long, n_final long, status string")
    assert [(r["drug_id"], r["n_rows"]) for r in audit.manifest_matches(idx, man).collect()] == [(5, 2)]
    assert audit.washout_leaks(idx, exp, spark.createDataFrame([(5, 7)], "ingredient_id long, comparator_id long")).first()["n_leaks"] == 1
    with pytest.raises(KeyError):
        audit.pick_column(idx, "x", "y")


def test_triplets(spark):
    e = spark.createDataFrame([("A ", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "name string, dense_embedding array<float>")
    t = spark.createDataFrame([("1", "a", "B", "c"), ("2", "a", "b", "zz")], "id string, a string, b string, c string")
    got = {r["id"]: r["passed"] for r in catalog.triplet_audit(t, e).collect()}
    assert got == {"1": True, "2": None}
