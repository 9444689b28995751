"""Nearest record in time per entity within a tolerance: hash-partitioned Arrow groups, ASOF joins inside each.

Time is cut into shards. A target lies in one shard; a record is given to its shard and, near a border, to
the neighbour whose targets may reach it, so every target is settled inside one group. Records are first
reduced to the one that would win of each (entity, kind, day), which bounds what a hot entity brings into a shard; the
targets of an entity with very many in one shard are split, and each part gets the records.
"""

from __future__ import annotations

from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import shuffle_parts, small


@dataclass(frozen=True)
class Target:
    """A date column to be matched: records from ``before`` days ahead of it to ``after`` days behind it."""

    name: str
    column: str
    before: int
    after: int


ASOF = """
WITH kinds AS (SELECT DISTINCT person, shard, part, kind FROM m),
q AS (SELECT t.*, kinds.kind FROM t JOIN kinds USING (person, shard, part)),
c AS (
  SELECT q.*, m.day AS found, m.record FROM q ASOF JOIN m
    ON q.person = m.person AND q.shard = m.shard AND q.part = m.part AND q.kind = m.kind AND q.day >= m.day
  UNION ALL
  SELECT q.*, m.day AS found, m.record FROM q ASOF JOIN m
    ON q.person = m.person AND q.shard = m.shard AND q.part = m.part AND q.kind = m.kind AND q.day <= m.day
)
SELECT item, person, kind, target, arg_min(record, {'far': abs(found - day), 'early': -found}) AS record
FROM c WHERE found BETWEEN lo AND hi GROUP BY item, person, kind, target, day
"""


def nearest_in_time(
    items: DataFrame,
    records: DataFrame,
    targets: list[Target],
    *,
    item: str,
    person: str,
    kind: str,
    day: str,
    record: str,
    shard_days: int = 1461,
    group_rows: int = 60_000,
    rows: int | None = None,
) -> DataFrame:
    """Rows (<item>, <person>, <kind>, target_name, <record>), one at most per distinct item row, kind and target.

    ``items`` has item, person and the date columns of ``targets``; ``records`` has person, kind, day (date)
    and record (an integer id). The smallest distance in days wins, then the later day, then the smaller
    record id. ``rows`` is about the number of targets and records, if known; it sizes the groups. Null persons, kinds, days and target dates match nothing; repeated rows change nothing; empty
    tables give no row; other columns are ignored.
    """
    reach_back = max(t.before for t in targets)
    reach_on = max(t.after for t in targets)
    shard = lambda c: F.floor(c / F.lit(shard_days)).cast("int")
    names = {t.name: i for i, t in enumerate(targets)}

    want = items.where(F.col(person).isNotNull()).select(F.col(item).alias("item"), F.col(person).alias("person"), *[F.unix_date(t.column).alias(t.column) for t in targets]).distinct()
    want = want.select(
        "item", "person",
        F.explode(F.array(*[
            F.struct(F.lit(names[t.name]).alias("target"), F.col(t.column).alias("day"), (F.col(t.column) - t.before).alias("lo"), (F.col(t.column) + t.after).alias("hi"))
            for t in targets
        ])).alias("x"),
    ).select("item", "person", "x.*").where("day is not null").withColumn("shard", shard(F.col("day")))
    have = (
        records.where(F.col(person).isNotNull() & F.col(kind).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(person).alias("person"), F.col(kind).alias("kind"), F.unix_date(day).alias("day"))
        .agg(F.min(record).alias("record"))
        .withColumn("shard", F.explode(F.sequence(shard(F.col("day") - reach_on), shard(F.col("day") + reach_back))))
    )
    if rows is None:
        rows = items.count() * len(targets) + records.count()
    groups = max(shuffle_parts(items.sparkSession), -(-rows // group_rows))
    bucket = F.pmod(F.xxhash64("person", "shard", "part"), F.lit(groups)).cast("int").alias("bucket")
    hot = want.groupBy("person", "shard").count().where(F.col("count") > group_rows).select("person", "shard", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    hot = small(hot)
    want = want.join(hot, ["person", "shard"], "left").withColumn("part", F.pmod(F.xxhash64("item", "target"), F.coalesce("parts", F.lit(1))).cast("int"))
    have = have.join(hot, ["person", "shard"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    out = pa.schema([("item", pa.int64()), ("person", pa.int64()), ("kind", pa.string()), ("target", pa.int32()), ("record", pa.int64())])

    def match(t: pa.Table, m: pa.Table) -> pa.Table:
        if t.num_rows == 0 or m.num_rows == 0:
            return out.empty_table()
        # groups are bounded, so nothing has to spill to a disk of this machine
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        try:
            con.register("t", t.drop_columns(["bucket"]))
            con.register("m", m.drop_columns(["bucket"]))
            return con.sql(ASOF).to_arrow_table().cast(out)
        finally:
            con.close()

    found = (
        want.select(bucket, "item", "person", "shard", "part", "target", "day", "lo", "hi").groupBy("bucket")
        .cogroup(have.select(bucket, "person", "shard", "part", "kind", "day", "record").groupBy("bucket"))
        .applyInArrow(match, "item long, person long, kind string, target int, record long")
    )
    label = F.get(F.array(*[F.lit(t.name) for t in targets]), F.col("target"))
    return found.select(F.col("item").alias(item), F.col("person").alias(person), F.col("kind").alias(kind), label.alias("target_name"), F.col("record").alias(record))
