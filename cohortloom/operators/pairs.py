"""Screening of cohort pairs: prototypes, min-linkage distances, candidate pairs and incident users."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.config import Screening
from cohortloom.session import cut


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, starts: int = 4) -> np.ndarray:
    """Centres of k-means with k-means++ starts; the best of several."""
    rng = np.random.default_rng(seed)
    best, best_cost = x[:k], np.inf
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            p = d / d.sum() if d.sum() > 0 else None
            c = np.vstack([c, x[rng.choice(len(x), p=p)]])
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if cost < best_cost:
            best, best_cost = c, cost
    return best


def prototypes(points: DataFrame, k: int = 3, seed: int = 42, sample: int = 20_000, rounds: int = 100) -> DataFrame:
    """(drug_id, k_id, proto): unit centres of each cohort's vectors; cohorts of at most ``k`` points stand for themselves.

    ``points`` has drug_id, person_id, vec. A cohort of at most ``sample`` points is fitted by one task. A larger one only starts
    from the centres of about so many of its points, drawn by hash of the person; the rounds after that go over all of its points,
    with sums and counts made where the points lie.
    """
    sizes = cut(points.groupBy("drug_id").agg(F.count("*").alias("n")))
    # each of 16 salts keeps its share of a large cohort, so a hot cohort is never sorted by one task
    w = Window.partitionBy("drug_id", "salt").orderBy("h")
    large = sizes.where(F.col("n") > sample).select("drug_id")
    whole = points.join(large, "drug_id", "left_anti").select("drug_id", "person_id", "vec")
    fields = "drug_id long, k_id int, proto array<double>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("person_id")["vec"].to_numpy()).astype(float)
        c = x if len(x) <= k else kmeans(x, k, seed)
        return pd.DataFrame({"drug_id": pdf["drug_id"].iloc[0], "k_id": np.arange(len(c), dtype=np.int32), "proto": list(c)})

    fitted = whole.groupBy("drug_id").applyInPandas(fit, fields)
    if large.take(1):
        hot = cut(points.join(large, "drug_id", "left_semi").select(F.col("drug_id").cast("long").alias("drug_id"), "person_id", "vec"))
        some = (
            hot.withColumn("h", F.xxhash64("person_id")).withColumn("salt", F.pmod("h", F.lit(16)))
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, sample // 16)).select("drug_id", "person_id", "vec")
        )
        centres = {}
        for r in some.groupBy("drug_id").applyInPandas(fit, fields).orderBy("drug_id", "k_id").collect():
            centres.setdefault(r["drug_id"], []).append(r["proto"])
        centres = {d: np.array(c) for d, c in centres.items()}
        moving = dict(centres)
        for _ in range(rounds):
            moved = {d: c.copy() for d, c in moving.items()}
            for d, i, n, total in _sums(hot, moving):
                moved[d][i] = np.array(total) / n
            centres |= moved
            moving = {d: c for d, c in moved.items() if not np.allclose(c, moving[d])}
            if not moving:
                break
        rows = [(d, i, x.tolist()) for d, c in centres.items() for i, x in enumerate(c)]
        fitted = fitted.unionByName(points.sparkSession.createDataFrame(rows, fields))
    length = F.sqrt(F.aggregate("proto", F.lit(0.0), lambda s, x: s + x * x))
    return fitted.withColumn("length", F.greatest(length, F.lit(1e-8))).select("drug_id", "k_id", F.transform("proto", lambda x: x / F.col("length")).alias("proto"))


def _sums(points: DataFrame, centres: dict[int, np.ndarray]) -> list[tuple[int, int, int, list[float]]]:
    """(drug_id, k_id, count, sum of vectors) of the points nearest to each centre of the cohorts in ``centres``."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def part(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for pdf in stream:
            for d, g in pdf.groupby("drug_id"):
                c = sent.value.get(int(d))
                if c is None:
                    continue
                x = np.stack(g["vec"].to_numpy()).astype(float)
                near = np.stack([((x - y) ** 2).sum(1) for y in c], 1).argmin(1)
                for i in np.unique(near):
                    own = held.setdefault((int(d), int(i)), [0, 0.0])
                    own[0] += int((near == i).sum())
                    own[1] = own[1] + x[near == i].sum(0)
        yield pd.DataFrame([(d, i, n, total.tolist()) for (d, i), (n, total) in held.items()], columns=["drug_id", "k_id", "n", "total"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(pdf["total"].to_numpy())
        # in a fixed order, so that the sum does not depend on the shuffle
        total = total[np.lexsort(total.T)].sum(0)
        return pd.DataFrame({"drug_id": pdf["drug_id"].iloc[:1], "k_id": pdf["k_id"].iloc[:1], "n": [pdf["n"].sum()], "total": [total.tolist()]})

    fields = "drug_id long, k_id int, n long, total array<double>"
    got = points.select("drug_id", "vec").mapInPandas(part, fields).groupBy("drug_id", "k_id").applyInPandas(added, fields).collect()
    sent.unpersist()
    return [tuple(r) for r in got]


def cohort_distances(protos: DataFrame, block: int = 2000, *, keep: int | None = None, most: float = 2.0) -> DataFrame:
    """(a, b, distance), a < b: 1 - the largest product of any two prototypes, within 0 and 2, and at most ``most``.

    With ``keep`` a pair of blocks gives only the pairs that are among the ``keep`` nearest of one of their two cohorts in it, smaller
    ids first if tied: no other can be among its nearest of all.
    The screening sets every cohort against all others; it is done in pairs of blocks of about ``block`` prototypes, by matrix product.
    """
    blocks = max(1, -(-protos.count() // block))
    mine = F.pmod(F.xxhash64("drug_id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = protos.withColumn("mine", mine).withColumn("other", other).select(F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "drug_id", "proto")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.sort_values("drug_id", kind="stable")
        left, right = pdf[pdf["mine"] == lo], pdf[pdf["mine"] == hi]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64", "distance": float})
        sim = np.stack(left["proto"].to_numpy()) @ np.stack(right["proto"].to_numpy()).T
        ids_l, start_l = np.unique(left["drug_id"].to_numpy(), return_index=True)
        ids_r, start_r = np.unique(right["drug_id"].to_numpy(), return_index=True)
        best = np.maximum.reduceat(np.maximum.reduceat(sim, start_l, axis=0), start_r, axis=1)
        far = np.clip(1 - best, 0, 2)
        good = (ids_l[:, None] < ids_r[None, :]) if lo == hi else (ids_l[:, None] != ids_r[None, :])
        if keep is not None:
            apart = np.where(ids_l[:, None] != ids_r[None, :], far, np.inf)
            # both lists are in order of id, so stable sorting puts smaller ids first
            near = np.zeros(far.shape, bool)
            np.put_along_axis(near, np.argsort(apart, 1, kind="stable")[:, :keep], True, 1)
            back = np.zeros(far.shape, bool)
            np.put_along_axis(back, np.argsort(apart, 0, kind="stable")[:keep], True, 0)
            good &= near | back | (near | back).T if lo == hi else near | back
        i, j = np.nonzero(good & (far <= most))
        return pd.DataFrame({"a": np.minimum(ids_l[i], ids_r[j]), "b": np.maximum(ids_l[i], ids_r[j]), "distance": far[i, j]})

    return rows.groupBy("lo", "hi").applyInPandas(measure, "a long, b long, distance double")


def nearest_cohorts(distances: DataFrame, params: Screening = Screening()) -> DataFrame:
    """Pairs (a, b, distance) where one (or, mutual, each) is among the other's nearest ``neighbours`` within ``max_distance``."""
    both = distances.unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    w = Window.partitionBy("a").orderBy("distance", "b")
    top = both.withColumn("r", F.row_number().over(w)).where((F.col("r") <= params.neighbours) & (F.col("distance") <= params.max_distance))
    pairs = top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance"), F.count("*").alias("sides"))
    return pairs.where("sides = 2" if params.mutual else "sides >= 1").drop("sides")


def incident_overlap(index: DataFrame) -> DataFrame:
    """(a, b, n_concomitant, n_a_first, n_b_first) of every pair of cohorts that share persons; ``index`` has drug_id, person_id, t0, one row a person and cohort."""
    a = index.select("person_id", F.col("drug_id").alias("a"), F.col("t0").alias("ta"))
    b = index.select("person_id", F.col("drug_id").alias("b"), F.col("t0").alias("tb"))
    return a.join(b, "person_id").where("a < b").groupBy("a", "b").agg(
        F.count_if(F.col("ta") == F.col("tb")).alias("n_concomitant"), F.count_if(F.col("ta") < F.col("tb")).alias("n_a_first"), F.count_if(F.col("ta") > F.col("tb")).alias("n_b_first")
    )


def incident_sizes(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs with raw and clean sizes: the earlier t0 keeps a shared person, equal days drop the person from both; an empty side makes all counts 0."""
    n = index.groupBy("drug_id").agg(F.count("*").alias("n"))
    side = lambda s: n.select(F.col("drug_id").alias(s), F.col("n").alias(f"n_raw_{s}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").join(incident_overlap(index), ["a", "b"], "left").fillna(0)
    live = (F.col("n_raw_a") > 0) & (F.col("n_raw_b") > 0)
    return out.withColumns(
        {
            "n_clean_a": F.when(live, F.col("n_raw_a") - F.col("n_concomitant") - F.col("n_b_first")).otherwise(0),
            "n_clean_b": F.when(live, F.col("n_raw_b") - F.col("n_concomitant") - F.col("n_a_first")).otherwise(0),
            "n_cross_dropped": F.col("n_a_first") + F.col("n_b_first"), "n_concomitant_dropped": F.col("n_concomitant"),
        }
    ).drop("n_concomitant", "n_a_first", "n_b_first")


def candidate_pairs(points: DataFrame, index: DataFrame, names: DataFrame, params: Screening = Screening()) -> DataFrame:
    """Screened pairs with names, distance and sizes, nearest first: both cohorts large enough before and after incident users are resolved."""
    big = index.groupBy("drug_id").agg(F.count("*").alias("n")).where(F.col("n") >= params.least_patients).select("drug_id")
    near = nearest_cohorts(cohort_distances(prototypes(points.join(big, "drug_id", "left_semi"), params.prototypes), keep=params.neighbours, most=params.max_distance), params)
    sized = incident_sizes(near, index).where((F.col("n_clean_a") >= params.least_patients) & (F.col("n_clean_b") >= params.least_patients))
    name = lambda s: names.select(F.col("drug_id").alias(s), F.col("name").alias(f"name_{s}"))
    out = sized.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return out.select(
        F.col("a").alias("drug_a_id"), F.col("name_a").alias("drug_a_name"), F.col("b").alias("drug_b_id"), F.col("name_b").alias("drug_b_name"), F.col("distance").alias("min_cosine_dist"),
        "n_raw_a", "n_raw_b", "n_clean_a", "n_clean_b", "n_cross_dropped", "n_concomitant_dropped",
    ).orderBy("min_cosine_dist", "drug_a_id", "drug_b_id")
