"""Mixing sources to target weights: temperature weights, repetition caps, budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut


#: Sources up to which the plan of a mixture is sent to all workers; beyond, it is shuffled.
FEW_SOURCES = 10_000
#: Most names of sources or targets that the driver takes.
MOST_SOURCES = 100_000


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent: 1 is natural, 0 uniform."""
    logs = {s: exponent * math.log(n) for s, n in sizes.items() if n > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(good, low: float, high: float, steps: int = 200) -> float:
    """The smallest x in [low, high] with good(x), for a condition that stays true once it is."""
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def temperature_weights(sizes: dict[str, float], *, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> tuple[float, dict[str, float]]:
    """Exponent in [0, 1] and shares size ** exponent: the flattest mixture (or the one of ``target_entropy``)
    that repeats no source more than ``max_repeats`` times in ``budget`` tokens (by default all there are).

    Entropy falls and repetition of small sources falls as the exponent grows, so both are bisected.
    """
    sizes = {s: n for s, n in sizes.items() if n > 0}
    if not sizes:
        return 1.0, {}
    budget = budget or sum(sizes.values())

    def fine(x: float) -> bool:
        w = tempered(sizes, x)
        cool = target_entropy is None or entropy(w) <= target_entropy + 1e-12
        return cool and (max_repeats is None or all(w[s] * budget <= max_repeats * n * (1 + 1e-12) for s, n in sizes.items()))

    x = bisect(fine, 0.0, 1.0)
    return x, tempered(sizes, x)


def realise(docs: DataFrame, budgets: dict[str, float], sizes: dict[str, tuple[int, int]], *, seed: int = 0, block_docs: int = 4096) -> DataFrame:
    """Rows (doc_id, source, n_tokens, copies): each source's budget as whole epochs and a part of a permutation.

    Documents are permuted by hash; a block is a range of hashes of about ``block_docs`` documents. Whole
    blocks are taken while they fit in what is left after whole epochs; only the block on the border is
    ordered document by document. Nothing sorts a whole source. ``sizes`` has (tokens, documents) per source.
    """
    spark = docs.sparkSession
    plan = []
    for s, b in budgets.items():
        tokens, n = sizes[s]
        whole = int(b // tokens)
        blocks = max(1, -(-n // block_docs))
        plan.append((s, whole, float(b - whole * tokens), blocks))
    plan_df = spark.createDataFrame(plan, "source string, whole int, rest double, blocks int")
    spin = F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), F.lit(1 << 40))
    # one row a source; source_sizes bounds their number
    rows = docs.join(F.broadcast(plan_df) if len(plan) <= FEW_SOURCES else plan_df, "source").withColumn("spin", spin).withColumn("block", F.floor(F.col("spin") * F.col("blocks") / F.lit(1 << 40)))
    upto = Window.partitionBy("source").orderBy("block")
    blocks = (
        rows.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("size"))
        .withColumn("before", F.sum("size").over(upto) - F.col("size"))
        .select("source", "block", "before", (F.col("before") + F.col("size") <= F.col("rest")).alias("inside"), (F.col("before") < F.col("rest")).alias("touched"))
    )
    placed = rows.join(blocks, ["source", "block"])
    settled = placed.where("inside or not touched").withColumn("extra", F.col("inside").cast("int"))
    inner = Window.partitionBy("source", "block").orderBy("spin", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where("touched and not inside").withColumn("extra", (F.col("before") + F.sum("n_tokens").over(inner) <= F.col("rest")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return settled.select(*cols).unionByName(border.select(*cols)).where("copies > 0")


def source_sizes(docs: DataFrame) -> dict[str, tuple[int, int]]:
    """(tokens, documents) of each source that is not null; sources are a list of names, checked to stay small."""
    rows = docs.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; name a coarser source")
    return {r["source"]: (int(r["t"] or 0), r["n"]) for r in rows}


def toward(sizes: dict[str, float], shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights natural * (target / natural) ** exponent, normalised: 0 is natural, 1 the target shares."""
    total = sum(sizes[s] for s in shares)
    logs = {s: math.log(sizes[s] / total) + exponent * (math.log(p) - math.log(sizes[s] / total)) for s, p in shares.items() if p > 0 and sizes.get(s, 0) > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def target_weights(sizes: dict[str, float], shares: dict[str, float], caps: dict[str, float], budget: float) -> tuple[float, dict[str, float]]:
    """(exponent, tokens per source): the largest exponent in [0, 1] with which no source is repeated beyond its cap,
    then what is left of each target share as far as the caps allow.

    One exponent moves all sources alike, so where a cap binds it would hold back every other source too. The sources at
    their cap are therefore settled, and the exponent of the others is bisected anew over the rest of the budget, until
    no cap binds: with the exponent at 1, the others stand in the ratio of their targets.
    """
    live = {s: p for s, p in shares.items() if p > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    whole = {s: sizes[s] for s in live}
    fits = lambda x: all(w * budget <= caps[s] * (1 + 1e-12) for s, w in toward(whole, live, x).items())
    exponent = 1 - bisect(lambda y: fits(1 - y), 0.0, 1.0)
    tokens: dict[str, float] = {}
    left = min(budget, sum(caps[s] for s in live))
    while live:
        weights = toward({s: sizes[s] for s in live}, live, 1.0)
        over = [s for s, w in weights.items() if w * left >= caps[s]]
        if not over:
            tokens |= {s: w * left for s, w in weights.items()}
            break
        for s in over:
            tokens[s] = float(caps[s])
            left -= caps[s]
            del live[s]
    return exponent, tokens


def _report(docs: DataFrame, mixture: DataFrame, listed: dict[str, tuple[float, float]], sizes: dict[str, tuple[int, int]]) -> DataFrame:
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    rows = [(s, float(p), float(m), sizes.get(s, (0, 0))[0]) for s, (p, m) in listed.items()]
    have = docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats double, available_tokens long")
    report = have.join(got, "source", "left").fillna(0, ["mixed_tokens"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.withColumn("reached_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0))
    return report.withColumn("repeats", F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).otherwise(0.0))


def mix(docs: DataFrame, targets: DataFrame, *, budget: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mixture and report of (doc_id, source, n_tokens) against (source, target_share, max_repeats).

    The budget is by default what the listed sources hold. Sources that are not listed, or null, are left out; listed
    ones that do not exist, or hold no token, get a share of 0 in the report. Null shares and repeats count as
    0. A document never comes more than max_repeats times; repeated rows of ``docs`` are documents of their
    own. Report: source, target_share, max_repeats, available_tokens, mixed_tokens, reached_share, repeats.
    """
    docs = cut(docs.select("doc_id", "source", "n_tokens"))
    sizes = source_sizes(docs)
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    listed = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in rows}
    here = {s: sizes[s] for s in listed if s in sizes and sizes[s][0] > 0}
    tokens = {s: float(t) for s, (t, _) in here.items()}
    _, budgets = target_weights(tokens, {s: listed[s][0] for s in here}, {s: listed[s][1] * t for s, t in tokens.items()}, budget or sum(tokens.values()))
    mixture = cut(realise(docs, budgets, here, seed=seed))
    return mixture, _report(docs, mixture, listed, sizes)


def mix_tempered(
    docs: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Mixture and report of (doc_id, source, n_tokens) by temperature alone: all sources that are not null, each with the weight
    of ``temperature_weights``; the target share of the report is that weight. Other cases as for ``mix``."""
    docs = cut(docs.select("doc_id", "source", "n_tokens"))
    sizes = {s: x for s, x in source_sizes(docs).items() if x[0] > 0}
    tokens = {s: float(t) for s, (t, _) in sizes.items()}
    budget = budget or sum(tokens.values())
    _, shares = temperature_weights(tokens, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    mixture = cut(realise(docs, {s: w * budget for s, w in shares.items()}, sizes, seed=seed))
    limit = float(max_repeats) if max_repeats is not None else float("inf")
    return mixture, _report(docs, mixture, {s: (w, limit) for s, w in shares.items()}, sizes)
