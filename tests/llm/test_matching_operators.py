"""Nearest time and similar vectors against brute force on small tables."""

import datetime as dt
import random

import numpy as np
import pytest

from cohortloom.llm import queries, similar
from cohortloom.llm.nearest_time import Target, nearest_in_time
from cohortloom.llm.similar import PStable, pack, similar_pairs, unpack

DATA = "/root/testdata"
D0 = dt.date(2015, 1, 1)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, compare, name):
    got, want = compare(spark, queries.QUERIES[name], queries.SQL[name], f"{DATA}/sf0.001")
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


TARGETS = [Target("base", "t0", 90, 0), Target("later", "t1", 10, 60)]


def nearest(items, records, shard=1461, rows=60_000):
    return nearest_in_time(items, records, TARGETS, item="drug", person="person", kind="kind", day="day", record="rec", shard_days=shard, group_rows=rows)


@pytest.mark.parametrize("shard, rows", [(1461, 60_000), (200, 100), (97, 50)])
def test_nearest_against_brute_force(spark, shard, rows):
    rng = random.Random(shard)
    day = lambda: None if rng.random() < 0.05 else D0 + dt.timedelta(rng.randint(-200, 700))
    person = lambda: rng.choice([1, 1, None, rng.randint(2, 12)])
    items = [(rng.randint(1, 30), person(), day(), day(), "x") for _ in range(120)]
    items += items[:10]
    recs = [(i, person(), rng.choice(["ldl", "crp", None]), day(), 3) for i in range(900)]
    got = nearest(
        spark.createDataFrame(items, "drug long, person long, t0 date, t1 date, shard string"), spark.createDataFrame(recs, "rec long, person long, kind string, day date, bucket int"), shard, rows
    ).collect()
    want = []
    for drug, p, *days, _ in set(items):
        for t, d in zip(TARGETS, days):
            for kind in ("ldl", "crp"):
                c = [((abs((x - d).days), -x.toordinal(), i), i) for i, q, k, x, _ in recs if d and x and q is not None and q == p and k == kind and -t.before <= (x - d).days <= t.after]
                if c:
                    want.append((drug, p, kind, t.name, min(c)[1]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_of_nothing(spark):
    i = spark.createDataFrame([(1, 1, D0, None)], "drug long, person long, t0 date, t1 date")
    r = spark.createDataFrame([(5, 1, "ldl", D0), (4, 1, "ldl", D0)], "rec long, person long, kind string, day date")
    assert [tuple(x) for x in nearest(i, r).collect()] == [(1, 1, "ldl", "base", 4)]
    assert nearest(i.limit(0), r).count() == 0 and nearest(i, r.limit(0)).count() == 0


def brute(rows, dim, k, least):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, x in use:
        c = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), j) for j, y in use if j != i)[:k]
        out |= {(min(i, j), max(i, j)) for s, j in c if -s >= least}
    return out


def found(df):
    return {(r["id_a"], r["id_b"]) for r in df.collect()}


def clustered(rng, n, dim, groups, noise=0.5):
    centres = rng.standard_normal((groups, dim))
    return [(int(i), (centres[i % groups] + noise * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in rng.permutation(n)]


def test_similar_small_is_nearly_exact(spark):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 300, 32, 20)
    got = found(similar_pairs(spark.createDataFrame(rows, "id long, v array<float>"), item="id", fields={"v": 32}))
    want = brute(rows, 32, 5, 0.5)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_similar_with_many_buckets_and_parts(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 1500, 24, 60, 0.4)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute(rows, 24, 5, 0.5)
    for kw in (dict(bucket_rows=100), dict(bucket_rows=100, bucket_cap=20, team_rows=10), dict(bucket_cap=100, team_rows=30, few_needs=0, chunk_teams=2)):
        got = found(similar_pairs(df, item="id", fields={"v": 24}, **kw))
        assert len(got & want) / len(want) > 0.9, kw


def test_similar_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 0.0, 0.0]
    rows = [(i, base) for i in range(1, 11)] + [(20, [2.0, 4.0, 0.0, 0.0]), (21, [0.0, 0.0, 1.0, 0.0]), (22, [0.0, 0.0, 0.0, 0.0]), (23, None), (24, [1.0]), (25, [nan, 1.0, 1.0, 1.0]), (26, [inf, 1.0, 1.0, 1.0]), (27, [None, 1.0, 2.0, 3.0]), (None, base), (28, [1.0, 0.5, 0.0, -0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, v array<float>, copy string, f int")
    got = found(similar_pairs(df, item="id", fields={"v": 4}))
    assert got == brute(rows, 4, 5, 0.5)
    assert found(similar_pairs(df.limit(0), item="id", fields={"v": 4})) == set()
    assert found(similar_pairs(df.where("id >= 22 and id < 28"), item="id", fields={"v": 4})) == set()


def test_similar_hot_group_of_a_third_in_cut_clusters(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(24)
    rows = [(i + 1, (base + 0.4 * rng.standard_normal(24) if i % 3 == 0 else rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(900)]
    got = found(similar_pairs(spark.createDataFrame(rows, "id long, v array<float>"), item="id", fields={"v": 24}, team_rows=20, bucket_cap=400, per_bucket=2, candidates=3))
    want = {p for p in brute(rows, 24, 5, 0.5) if p[0] % 3 == p[1] % 3 == 1}
    assert len(got & want) / len(want) > 0.99


def test_multiples_share_a_direction_and_ties_go_to_small_ids():
    x = np.random.default_rng(5).integers(-9, 9, 40).astype(np.float32)
    unit = [v / np.sqrt((v**2).sum()) for v in (x.astype(float), (3 * x).astype(float), (x + np.eye(40)[0]).astype(float))]
    assert similar.direction_key(unit[0]) == similar.direction_key(unit[1]) != similar.direction_key(unit[2])
    assert sorted(similar._top(np.array([[0.5, 0.9, 0.5, 0.5, 0.1]]), 3)[0]) == [0, 1, 2]


def test_probes_come_in_order_of_success():
    rng = np.random.default_rng(0)
    maker = PStable(16, 1, 4, 6, seed=5)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.12 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = maker.buckets(x.astype(np.float32))[:, 0], maker.buckets(y.astype(np.float32))[:, 0, 0]
    hit = [(a[:, p] == b).mean() for p in range(7)]
    assert hit[0] > hit[1] > hit[3] and sum(hit) > hit[0] * 1.2 and len(np.unique(a[:, 0])) > 20


def test_pack():
    import zstandard

    x = np.random.default_rng(0).standard_normal(50).astype(np.float32)
    assert (unpack(pack(x, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor()) == x).all()
