"""Results per key under heavy skew: exact selection by refining histograms of mergeable counts.

A histogram bin is a bit prefix of the value. A round counts the rows of the bins still in question, one
digit finer than the last; counts merge map-side, so no task ever sees the rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import cut

#: Bits that a round adds to the prefix: 1024 bins below each bin in question.
DIGIT = 10


def _shifts(low: int, high: int) -> list[int]:
    """Right shifts of the rounds, coarse to exact."""
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << DIGIT:
        shift += 1
    out = [shift]
    while out[-1]:
        out.append(max(0, out[-1] - DIGIT))
    return out


def heavy_keys(df: DataFrame, key_fields: Sequence[str], share: Fraction = Fraction(2, 100)) -> DataFrame:
    """Rows (key_field, key_id, n_rows) of every key value that holds at least ``share`` of all rows of ``df``.

    The key domain itself is refined: of each digit only bins that hold ``share`` of all rows go on, at
    most 1 / share of them, which is all that reaches the driver. Keys are integers; null is no key, but
    its rows count in the total. Ties and repeated rows count as they stand; an empty table gives no row.
    """
    spark = df.sparkSession
    keys = [F.col(f).cast("long").alias(f"k{i}") for i, f in enumerate(key_fields)]
    src = df.select(*keys)
    stats = src.agg(F.count("*").alias("n"), *[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(len(keys)) for f in (F.min, F.max)]).first()
    least = share * stats["n"]
    floor = -(-least.numerator // least.denominator)
    plans = {i: _shifts(stats[f"min{i}"], stats[f"max{i}"]) for i in range(len(keys)) if stats[f"min{i}"] is not None}
    found: list[tuple[str, int, int]] = []
    active: dict[int, list[int] | None] = dict.fromkeys(plans)
    level = 0
    while active:
        bins = []
        for i, alive in active.items():
            now = plans[i][level]
            key = F.col(f"k{i}")
            asked = key.isNotNull() if alive is None else F.shiftright(key, plans[i][level - 1]).isin(alive)
            bins.append(F.when(asked, F.struct(F.lit(i).alias("f"), F.shiftright(key, now).alias("bin"))))
        counted = (
            src.select(F.explode(F.array_compact(F.array(*bins))).alias("x"))
            .groupBy("x.f", "x.bin").count().where(F.col("count") >= floor).collect()
        )
        nxt: dict[int, list[int] | None] = {}
        for r in counted:
            if plans[r["f"]][level] == 0:
                found.append((key_fields[r["f"]], r["bin"], r["count"]))
            else:
                nxt.setdefault(r["f"], []).append(r["bin"])
        active, level = nxt, level + 1
    return spark.createDataFrame(found, "key_field string, key_id long, n_rows long")


def _as_long(df: DataFrame, value: str):
    kind = df.schema[value].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long"), lambda c: F.date_from_unix_date(c.cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(value).cast("timestamp")), lambda c: F.timestamp_micros(c)
    if isinstance(kind, T.IntegralType):
        return F.col(value).cast("long"), lambda c: c.cast(kind)
    raise TypeError(f"{value} is {kind.simpleString()}; integers, dates and timestamps have bit prefixes")


def key_quantiles(df: DataFrame, key: str, value: str, percents: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """Rows (<key>, n_values, p<percent>...): exact quantiles (nearest rank) of ``value`` per key.

    Rank of percent p among n values is ceil(p n / 100), 1 at least. Rows with a null key or value do
    not count; a key without values has no row. Every round is one count per (key, bin) with map-side
    combining, hashed by both, so the rows of a hot key spread over all tasks.
    """
    as_long, back = _as_long(df, value)
    src = df.select(F.col(key).alias("k"), as_long.alias("v")).where("k is not null and v is not null")
    bounds = src.agg(F.min("v"), F.max("v")).first()
    shifts = _shifts(*bounds) if bounds[0] is not None else [0]
    state = None
    for level, shift in enumerate(shifts):
        counts = src.groupBy("k", F.shiftright("v", shift).alias("bin")).count()
        if state is None:
            whole = counts.groupBy("k").agg(F.sum("count").alias("n"))
            ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100)).alias("rank")) for p in percents]))
            asked = whole.select("k", "n", ranks.alias("x")).select("k", "n", "x.pct", "x.rank")
            rows = asked.join(counts, "k")
        else:
            up = shifts[level - 1] - shift
            rows = state.join(counts.withColumn("parent", F.shiftright("bin", up)), ["k", "parent"])
        run = Window.partitionBy("k", "pct").orderBy("bin")
        state = (
            rows.withColumn("upto", F.sum("count").over(run))
            .where("upto >= rank and upto - count < rank")
            .select("k", "n", "pct", (F.col("rank") - F.col("upto") + F.col("count")).alias("rank"), F.col("bin").alias("parent"))
        )
        if shift:
            state = cut(state)
    wide = state.groupBy("k", "n").agg(*[F.max(F.when(F.col("pct") == p, F.col("parent"))).alias(f"p{p}") for p in percents])
    return wide.select(F.col("k").alias(key), F.col("n").alias("n_values"), *[back(F.col(f"p{p}")).alias(f"p{p}") for p in percents])
