"""Implausible readings: Hampel filter per source, stuck values, physical bounds.

The records of a source (a group of ``group_cols``) are ranked by their id without sorting a whole source:
counts of id bins give the rank at which every bin starts. Each short stretch of succeeding records is judged by
the median and MAD of the window around it, which moves along with it. Sources are cut into blocks that bring the
neighbouring records of their windows along, so a source that holds a third of all rows is many equal tasks.
Windows hang on ranks and not on blocks: the answer is the same for any size of block.

Stuck values are runs over succeeding readings of one field, nulls left out. A run that touches the border of a
block is kept apart (its few readings, or its length if it is stuck already), and runs of neighbouring blocks are
put together afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut

#: 1 / (75 % quantile of the normal law): turns a median absolute deviation into a standard deviation.
MAD_TO_SD = 1.482602218505602

COLUMNS = ["record_id", "val_field", "below_bound", "far", "stuck", "grp", "block", "edge", "level", "size"]
JUDGED = "record_id long, val_field string, below_bound boolean, far boolean, stuck boolean, grp string, block long, edge int, level double, size long"


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal succeeding values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(values)))


def stuck_mask(values: np.ndarray, min_run: int) -> np.ndarray:
    """True where a value belongs to at least ``min_run`` equal succeeding readings; NaN is no reading and breaks no run."""
    out = np.zeros(len(values), bool)
    at = np.flatnonzero(~np.isnan(values))
    sizes = runs(values[at])[1]
    out[at] = np.repeat(sizes >= min_run, sizes)
    return out


def centre_and_scale(levels: np.ndarray) -> tuple[float, float]:
    """Median and MAD as a standard deviation; where the MAD is 0, the mean absolute deviation stands in."""
    middle = float(np.median(levels))
    away = np.abs(levels - middle)
    scale = float(np.median(away)) * MAD_TO_SD
    return middle, scale if scale > 0 else float(away.mean()) * 1.2533141373155001


def rolling_far(levels: np.ndarray, rank: np.ndarray, n: int, *, reach: int, stride: int, threshold: float, least: int) -> np.ndarray:
    """True where a level (records x fields, NaN for none) lies beyond ``threshold`` scales of its window's middle.

    The window of a stretch of ``stride`` records goes ``reach`` records to either side; at the ends of the source (of
    ``n`` records) it is shifted inwards. Rows must hold succeeding records with all that the windows of the asked ranks need.
    """
    out = np.zeros(levels.shape, bool)
    if not len(rank):
        return out
    usable = np.isfinite(levels)
    flat = levels[usable]
    upto = np.concatenate([[0], np.cumsum(usable.sum(1))])
    width = 2 * reach + stride
    base = int(rank[0])
    seen: tuple[int, int] | None = None
    middle, scale = 0.0, 0.0
    for stretch in range(int(rank[0]) // stride, int(rank[-1]) // stride + 1):
        a = min(max(stretch * stride - reach, 0), max(0, n - width))
        z = min(n, a + width)
        lo, hi = max(stretch * stride - base, 0), min((stretch + 1) * stride - base, len(rank))
        # records whose window is not all here belong to other blocks
        if a < base or z > base + len(rank):
            continue
        if seen != (a, z):
            seen = (a, z)
            window = flat[upto[a - base] : upto[z - base]]
            middle, scale = centre_and_scale(window) if len(window) >= least else (0.0, 0.0)
        if scale > 0:
            with np.errstate(invalid="ignore"):
                out[lo:hi] = np.abs(levels[lo:hi] - middle) > threshold * scale
    return out


def flag_spikes(
    df: DataFrame,
    *,
    record_id: str,
    group_cols: Sequence[str],
    fields: Sequence[str],
    log_scale: Column,
    threshold: float = 5.65,
    min_run: int = 6,
    min_readings: int = 8,
    reach: int = 1024,
    stride: int = 32,
    block_rows: int = 16384,
    id_bin: int = 4096,
) -> DataFrame:
    """One row (record_id, val_field, below_bound, far, stuck) per bad reading.

    ``record_id`` is an integer that orders the records; rows without one are no records and left out, and so are
    rows without any reading. ``log_scale`` is a boolean column: judge the group on logarithms. A null group value
    forms a group of its own. Null and NaN are no readings and break no run; an infinite one is far. The window
    takes the positive readings of all ``fields`` of ``reach`` records on either side of a stretch of ``stride``
    records; with fewer than ``min_readings``, or with no spread at all, it gives no level test. An empty table gives
    no row. Repeated rows count as records of their own. Other columns of ``df`` are ignored.
    """
    names = list(fields)
    reading = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in names]
    src = (
        df.where(F.col(record_id).isNotNull())
        .select(
            F.col(record_id).cast("long").alias("rid"),
            F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)])).alias("grp"),
            F.coalesce(log_scale, F.lit(False)).alias("on_log"),
            *[r.alias(f"v{i}") for i, r in enumerate(reading)],
        )
        .where(F.coalesce(*[F.col(f"v{i}") for i in range(len(names))]).isNotNull())
        .withColumn("bin", F.floor(F.col("rid") / F.lit(id_bin)))
    )
    # rank of the first record of every bin, in two steps, so that no task sums up all bins of a large source
    bins = src.groupBy("grp", "bin").count().withColumn("span", F.floor(F.col("bin") / F.lit(id_bin)))
    by_span = Window.partitionBy("grp").orderBy("span")
    spans = (
        bins.groupBy("grp", "span").agg(F.sum("count").alias("in_span"), F.max("count").alias("widest"))
        .withColumn("span_start", F.sum("in_span").over(by_span) - F.col("in_span"))
        .withColumn("n", F.sum("in_span").over(Window.partitionBy("grp")))
        .withColumn("widest", F.max("widest").over(Window.partitionBy("grp")))
        .select("grp", "span", "span_start", "n", "widest")
    )
    by_bin = Window.partitionBy("grp", "span").orderBy("bin")
    far_back = 2 * reach + stride
    block = lambda rank: F.floor(rank / F.lit(block_rows))
    placed = (
        bins.withColumn("before", F.sum("count").over(by_bin) - F.col("count")).join(spans, ["grp", "span"])
        .withColumn("start", F.col("span_start") + F.col("before"))
        .withColumn("from", F.greatest(block(F.col("start") - far_back - F.col("widest")), F.lit(0)))
        .withColumn("upto", F.least(block(F.col("start") + F.col("count") - 1 + far_back), block(F.col("n") - 1)))
        .select("grp", "bin", "start", "n", block(F.col("start")).alias("home"), F.sequence("from", "upto").alias("blocks"))
    )
    spread = src.join(placed, ["grp", "bin"]).withColumn("block", F.explode("blocks")).select(
        "grp", "block", (F.col("block") == F.col("home")).alias("own"), "start", "n", "rid", "on_log", *[f"v{i}" for i in range(len(names))]
    )

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable")
        own = pdf["own"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=COLUMNS)
        rid = pdf["rid"].to_numpy()
        values = np.stack([pdf[f"v{i}"].to_numpy(dtype=float, na_value=np.nan) for i in range(len(names))], 1)
        low = values <= 0
        with np.errstate(all="ignore"):
            levels = np.where(low, np.nan, np.log(values) if pdf["on_log"].iloc[0] else values)
        rank = int(pdf["start"].iloc[0]) + np.arange(len(pdf))
        far = rolling_far(levels, rank, int(pdf["n"].iloc[0]), reach=reach, stride=stride, threshold=threshold, least=min_readings)
        grp, at_block = pdf["grp"].iloc[0], int(pdf["block"].iloc[0])
        out = []
        for f, name in enumerate(names):
            at = np.flatnonzero(own & ~np.isnan(values[:, f]))
            starts, sizes = runs(values[at, f])
            stuck = np.repeat(sizes >= min_run, sizes)
            settled = np.ones(len(at), bool)
            for edge, k in enumerate([0, len(starts) - 1][: min(2, len(starts))]):
                here = slice(starts[k], starts[k] + sizes[k])
                border = {"val_field": name, "grp": grp, "block": at_block, "edge": edge, "level": values[at[starts[k]], f]}
                if sizes[k] >= min_run:
                    out.append(pd.DataFrame([border | {"size": sizes[k]}]))
                else:
                    i, settled[here] = at[here], False
                    out.append(pd.DataFrame({"record_id": rid[i], "below_bound": low[i, f], "far": far[i, f], **border, "size": 1}))
            hit = settled & (low[at, f] | far[at, f] | stuck)
            i = at[hit]
            out.append(pd.DataFrame({"record_id": rid[i], "val_field": name, "below_bound": low[i, f], "far": far[i, f], "stuck": stuck[hit]}))
        return pd.concat(out, ignore_index=True).reindex(columns=COLUMNS)

    judged = cut(spread.groupBy("grp", "block").applyInPandas(judge, JUDGED))
    # runs at the borders of succeeding blocks are one run if they have one value and nothing lies between them
    along = Window.partitionBy("grp", "val_field").orderBy("block", "edge", "record_id")
    last = F.lag(F.struct("block", "edge", "level")).over(along)
    apart = (F.col("edge") == 1) & ((last["block"] != F.col("block")) | (last["edge"] != 1))
    ends = judged.where("edge is not null").withColumn("fresh", (last.isNull() | apart | (last["level"] != F.col("level"))).cast("int"))
    ends = ends.withColumn("run", F.sum("fresh").over(along)).withColumn("whole", F.sum("size").over(Window.partitionBy("grp", "val_field", "run")))
    joined = ends.where("record_id is not null").select("record_id", "val_field", "below_bound", "far", (F.col("whole") >= min_run).alias("stuck"))
    settled = judged.where("edge is null").select("record_id", "val_field", "below_bound", "far", "stuck")
    return settled.unionByName(joined.where("below_bound or far or stuck")).withColumnRenamed("record_id", record_id)
