"""Continuous periods and gaps of overlapping intervals, by run-compressed day bitmaps.

An interval becomes runs of set days, one per time shard it touches. The runs are united inside each
input partition before anything is shuffled, so a hot entity sends at most one compressed bitmap per
partition and shard; the bitmaps of a shard are then united again, and only the few remaining set runs
of an entity meet to be joined across shard borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READABLE_DAY = r"^[ \t]*(\d{4}-\d{2}-\d{2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?[ \t]*$"


def readable_day(text: Column) -> Column:
    """The date of a text YYYY-MM-DD with blanks around it or a time of day after it; else null."""
    found = F.regexp_extract(text, READABLE_DAY, 1)
    return F.when(found != "", found.try_cast("date"))


def union_runs(key: np.ndarray, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unite runs sorted by (key, shard, lo); runs that overlap or touch inside one bitmap become one."""
    n = len(lo)
    if n == 0:
        return key, shard, lo, hi
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    part = np.cumsum(fresh) - 1
    span = np.int64(hi.max() - min(lo.min(), hi.min()) + 2)
    base = np.int64(min(lo.min(), hi.min()))
    reach = np.maximum.accumulate((hi - base) + part * span) - part * span + base
    start = fresh.copy()
    start[1:] |= lo[1:] > reach[:-1] + 1
    first = np.flatnonzero(start)
    last = np.append(first[1:], n) - 1
    return key[first], shard[first], lo[first], reach[last]


def _batches(stream: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in stream:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def merge_periods(df: DataFrame, *, entity: str, start: Column, end: Column, shard_days: int = 32768, buffer_rows: int = 200_000) -> DataFrame:
    """Rows (span_kind, <entity>, first_day, last_day): 'period' and, between succeeding periods, 'gap'.

    ``entity`` is an integer column, ``start`` and ``end`` are date columns; both days are covered.
    Rows with a null in any of the three, or with start after end, do not count. Touching intervals are
    continuous. Repeated rows change nothing; an empty table gives no row; other columns are ignored.
    """
    day = F.unix_date
    runs = (
        df.select(F.col(entity).cast("long").alias("who"), start.alias("a"), end.alias("b"))
        .where("who is not null and a <= b")
        .select("who", day("a").cast("long").alias("s"), day("b").cast("long").alias("e"))
        .select("who", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / shard_days), F.floor(F.col("e") / shard_days))).alias("shard"))
        .select(
            "who", "shard",
            F.greatest("s", F.col("shard") * shard_days).alias("lo"),
            F.least("e", (F.col("shard") + 1) * shard_days - 1).alias("hi"),
        )
    )
    schema = "who long, shard long, lo long, hi long"

    def columns(t: pa.Table) -> list[np.ndarray]:
        return [t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("who", "shard", "lo", "hi")]

    def batch(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["who", "shard", "lo", "hi"])

    def inside_partition(stream):
        for t in _batches(stream, buffer_rows):
            who, shard, lo, hi = columns(t)
            o = np.lexsort((lo, shard, who))
            yield batch(union_runs(who[o], shard[o], lo[o], hi[o]))

    def sorted_stream(stream):
        open_run = None
        for t in _batches(stream, buffer_rows):
            cols = columns(t)
            if open_run is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(open_run, cols)]
            cols = union_runs(*cols)
            open_run = [c[-1:] for c in cols]
            yield batch([c[:-1] for c in cols])
        if open_run is not None:
            yield batch(open_run)

    united = (
        runs.mapInArrow(inside_partition, schema)
        .repartition("who", "shard")
        .sortWithinPartitions("who", "shard", "lo")
        .mapInArrow(sorted_stream, schema)
    )
    by_time = Window.partitionBy("who").orderBy("lo")
    stitched = (
        united.withColumn("fresh", (F.col("lo") > F.lag("hi").over(by_time) + 1).cast("int"))
        .withColumn("period", F.sum(F.coalesce("fresh", F.lit(0))).over(by_time))
        .groupBy("who", "period")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("before", F.lag("hi").over(by_time))
    )

    def span(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("span_kind"), a.alias("a"), b.alias("b"))

    spans = F.when(F.col("before").isNull(), F.array(span("period", F.col("lo"), F.col("hi")))).otherwise(
        F.array(span("period", F.col("lo"), F.col("hi")), span("gap", F.col("before") + 1, F.col("lo") - 1))
    )
    as_date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return stitched.select("who", F.explode(spans).alias("x")).select(
        F.col("x.span_kind").alias("span_kind"), F.col("who").alias(entity), as_date("x.a").alias("first_day"), as_date("x.b").alias("last_day")
    )
