"""The k most similar vectors of every vector: multiprobe p-stable hashing and exact reranking.

1. One pass over the vectors gives, per vector, a key of its direction, a short random-projection sketch and,
   per hash table, its bucket and the perturbed buckets a query visits, in estimated success order.
   Only one vector of each group of copies (equal vectors and exact multiples) goes on.
2. Each bucket scores its queries against its entries by sketch; a query's candidates of all tables
   and probes are merged and the best estimates kept.
3. Candidates name the cluster a vector belongs to (least label over a few hops). Each cluster is
   one task: it fetches its members and their further candidates once, ranks them by an
   exact product in single precision, and the best again by the cosine in double precision.

Large buckets are cut into parts that each query visits. Large clusters are cut into parts too, and every pair of
parts is one task, so each member is ranked against all others: hot groups cost the square of their size. Candidates
by sketch are few (``candidates``); what is similar beyond them is found inside the cluster only.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut, small


def as_matrix(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of an Arrow column, and their rows: right length, finite, not all zero, no null inside."""
    length = np.asarray(col.value_lengths().fill_null(-1))
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = col.take(pa.array(at)).flatten()
    rows = np.asarray(flat.cast(pa.float32()).fill_null(np.nan)).reshape(-1, dim)
    with np.errstate(over="ignore"):
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(norms) & (norms > 0)
    return at[ok], rows[ok]


def pack(row: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Lossless: byte planes of a float32 vector, compressed."""
    return z.compress(np.ascontiguousarray(row.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes, z: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(z.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.float32).ravel()


class PStable:
    """Tables of ``width``-wide Gaussian projections of unit vectors, and a sketch of ``sketch`` projections of 4 bits."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, width: float = 2.0, sketch: int = 320, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.hashes, self.probes, self.width = tables, hashes, probes if hashes else 0, width
        self.sketcher = (rng.standard_normal((dim, sketch)) / math.sqrt(sketch)).astype(np.float32)
        self.lines = rng.standard_normal((dim, tables * hashes)).astype(np.float32)
        self.offsets = rng.uniform(0, width, tables * hashes).astype(np.float32)
        self.mixer = (rng.integers(1, 1 << 62, hashes or 1, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        # perturbations: one or two coordinates moved to the neighbouring slot below (even) or above (odd)
        singles = [(i,) for i in range(2 * hashes)]
        pairs = [p for p in itertools.combinations(range(2 * hashes), 2) if p[0] // 2 != p[1] // 2]
        self.moves = singles + pairs

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """Projections in 16 even steps of 0.335 standard deviations, two to a byte."""
        p = unit @ self.sketcher
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        level = np.clip(np.floor(p * (math.sqrt(p.shape[1]) / 0.335)) + 8, 0, 15).astype(np.uint8)
        return level[:, 0::2] | level[:, 1::2] << 4

    @staticmethod
    def directions(sketches: list[bytes]) -> np.ndarray:
        """Unit vectors of sketches, up to their rounding."""
        packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        x = np.concatenate([packed & 15, packed >> 4], 1).astype(np.float32) - 7.5
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def _key(self, table: int, slots: np.ndarray) -> np.ndarray:
        h = np.full(slots.shape[:-1], 0x9E3779B97F4A7C15 + table * 0x51ED27 & (1 << 63) - 1, np.uint64)
        for i in range(self.hashes):
            h ^= slots[..., i].astype(np.int64).view(np.uint64)
            h *= self.mixer[i]
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + probes) bucket keys; the first of a table is the vector's own bucket."""
        n = len(unit)
        out = np.zeros((n, self.tables, 1 + self.probes), np.int64)
        at = (unit @ self.lines + self.offsets) / self.width
        for t in range(self.tables):
            x = at[:, t * self.hashes : (t + 1) * self.hashes]
            home = np.floor(x).astype(np.int64)
            out[:, t, 0] = self._key(t, home)
            if not self.probes:
                continue
            # squared distance to the border that a move crosses: small ones are likeliest to hold neighbours
            gap = np.empty((n, 2 * self.hashes), np.float32)
            gap[:, 0::2] = (x - home) ** 2
            gap[:, 1::2] = (1 - (x - home)) ** 2
            score = np.stack([gap[:, list(m)].sum(1) for m in self.moves], 1)
            order = np.argsort(score, 1)[:, : self.probes]
            shift = np.zeros((len(self.moves), self.hashes), np.int64)
            for k, m in enumerate(self.moves):
                for i in m:
                    shift[k, i // 2] += 1 if i % 2 else -1
            out[:, t, 1 : 1 + order.shape[1]] = self._key(t, home[:, None, :] + shift[order])
            for short in range(order.shape[1], self.probes):
                out[:, t, 1 + short] = out[:, t, 0]
        return out


def direction_key(unit: np.ndarray) -> bytes:
    """Key of a double precision unit vector at 12 decimals: equal for exact multiples, whose cosines with any vector are equal at 9 decimals."""
    return hashlib.blake2b((np.round(unit, 12) + 0.0).tobytes(), digest_size=16).digest()


def _top(score: np.ndarray, m: int) -> np.ndarray:
    """Columns of the ``m`` largest scores of each row; of equal ones the first columns."""
    if score.shape[1] <= m:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    worst = np.take_along_axis(score, top, 1).min(1)
    for r in np.flatnonzero((score >= worst[:, None]).sum(1) > m):
        over = np.flatnonzero(score[r] > worst[r])
        top[r] = np.concatenate([over, np.flatnonzero(score[r] == worst[r])[: m - len(over)]])
    return top


def _slices(stream: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short pieces of wide batches."""
    for b in stream:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _parts(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of equal keys of a sorted stream; a long group comes in several stretches."""
    for b in stream:
        pdf = b.to_pandas()
        if not len(pdf):
            continue
        edge = np.zeros(len(pdf) - 1, bool)
        for key in keys:
            k = pdf[key].to_numpy()
            edge |= k[1:] != k[:-1]
        starts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(pdf)]
        for a, z in zip(starts, starts[1:]):
            part = pdf.iloc[a:z]
            yield tuple(part[key].iloc[0] for key in keys), part


def _groups(stream: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream sorted by ``key``."""
    held: list[pd.DataFrame] = []
    last = None
    for now, part in _parts(stream, [key]):
        if held and now != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(part)
        last = now
    if held:
        yield pd.concat(held, ignore_index=True)


def _cosines(x: np.ndarray, y: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Cosines of the rows of x with those of y in double precision, at 9 decimals."""
    x = x.astype(np.float64)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    out = np.empty((len(x), len(y)))
    for a in range(0, len(y), rows):
        part = y[a : a + rows].astype(np.float64)
        out[:, a : a + rows] = x @ part.T / np.sqrt(np.einsum("ij,ij->i", part, part))
    return np.round(out, 9)


class BucketScorer:
    """Best entries by sketch for the queries of one bucket part: entries are held, queries stream by."""

    def __init__(self, per_bucket: int, floor: float, query_rows: int = 256, entry_rows: int = 8192):
        self.per_bucket, self.floor, self.query_rows, self.entry_rows = per_bucket, floor, query_rows, entry_rows
        self.own: list[pd.DataFrame] = []
        self.entries: tuple[np.ndarray, np.ndarray] | None = None

    def close(self) -> Iterator[pa.RecordBatch]:
        """All entries are there: they become queries too."""
        if self.entries is None and self.own:
            own = pd.concat(self.own, ignore_index=True)
            self.entries = (PStable.directions(own["sketch"].tolist()), own["id"].to_numpy())
            self.own = []
            yield from self.ask(own)

    def ask(self, g: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        if self.entries is None:
            return
        entry, entry_ids = self.entries
        for a in range(0, len(g), self.query_rows):
            q = g.iloc[a : a + self.query_rows]
            unit, ids = PStable.directions(q["sketch"].tolist()), q["id"].to_numpy()
            cands, ests = [], []
            for z in range(0, len(entry), self.entry_rows):
                est = unit @ entry[z : z + self.entry_rows].T
                near = entry_ids[z : z + self.entry_rows]
                at = np.minimum(np.searchsorted(near, ids), len(near) - 1) if np.all(near[1:] > near[:-1]) else None
                if at is not None:
                    same = np.flatnonzero(near[at] == ids)
                    est[same, at[same]] = -2
                else:
                    est[ids[:, None] == near[None, :]] = -2
                top = _top(est, self.per_bucket)
                cands.append(near[top])
                ests.append(np.take_along_axis(est, top, 1))
            cand, est = np.concatenate(cands, 1), np.concatenate(ests, 1)
            if len(cands) > 1:
                top = _top(est, self.per_bucket)
                cand, est = np.take_along_axis(cand, top, 1), np.take_along_axis(est, top, 1)
            good = est >= self.floor
            n = good.sum(1)
            keep = n > 0
            if keep.any():
                offsets = pa.array(np.concatenate([[0], np.cumsum(n[keep])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["f"].to_numpy()[keep]), pa.array(ids[keep]), pa.ListArray.from_arrays(offsets, pa.array(cand[good])), pa.ListArray.from_arrays(offsets, pa.array(est[good].astype(np.float32)))],
                    ["f", "id", "cand", "est"],
                )


def similar_pairs(
    df: DataFrame,
    *,
    item: str,
    fields: dict[str, int],
    k: int = 5,
    least: float = 0.5,
    tables: int = 3,
    probes: int = 2,
    bucket_rows: int = 1500,
    per_bucket: int = 8,
    candidates: int = 12,
    slack: float = 0.08,
    bucket_cap: int = 8192,
    team_rows: int = 1024,
    hops: int = 3,
    few_needs: int = 300_000,
    chunk_teams: int = 1000,
) -> DataFrame:
    """Rows (vec_field, id_a, id_b, cosine), id_a < id_b: one of the two is among the ``k`` most similar of the other.

    ``item`` is a unique integer id; ``fields`` names array<float> columns and their lengths. Cosines are double
    precision rounded to 9 decimals, at least ``least``; ties go to the smaller id. Vectors that are null, all
    zero, of another length, or that hold a null, NaN or infinity take no part; null ids neither. Copies are each
    other's neighbours with cosine 1. An empty table gives no row. The number of hashes of a table follows the
    number of rows, so that buckets keep about ``bucket_rows`` entries. Candidates estimated ``slack`` below ``least`` still count. Recall is measured in the tests.
    """
    names = list(fields)
    df = df.where(F.col(item).isNotNull())
    n = df.count()
    hashes = max(0, round(math.log(max(n, 1) / bucket_rows) / math.log(2))) if n > bucket_rows else 0
    tables, probes = (tables, probes) if hashes else (1, 0)
    dims = [fields[f] for f in names]
    src = df.select(F.col(item).cast("long").alias("id"), *[F.col(f) for f in names])

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [PStable(d, tables, hashes, probes) for d in dims]
        for b in _slices(stream):
            ids = np.asarray(b.column(0))
            for f, maker in enumerate(makers):
                at, rows = as_matrix(b.column(1 + f), dims[f])
                if not len(at):
                    continue
                unit = rows.astype(np.float64)
                unit /= np.sqrt((unit**2).sum(1, keepdims=True))
                keys = [direction_key(u) for u in unit]
                unit = unit.astype(np.float32)
                codes = maker.buckets(unit).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), f, np.int32)), pa.array(ids[at]), pa.array(keys, pa.binary()),
                     pa.array([s.tobytes() for s in maker.sketches(unit)], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    ["f", "id", "copy", "sketch", "codes"],
                )

    base = cut(src.mapInArrow(hashed, "f int, id long, copy binary, sketch binary, codes array<long>"))
    # the first k + 1 ids of each group of copies, in two steps so that no task ranks a hot group alone
    salted = Window.partitionBy("f", "copy", "salt").orderBy("id")
    firsts = (
        base.select("f", "copy", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
        .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(Window.partitionBy("f", "copy").orderBy("id"))).where(F.col("r") <= k + 1)
        .groupBy("f", "copy").agg(F.array_sort(F.collect_list("id")).alias("firsts"))
        .withColumn("rep", F.element_at("firsts", 1))
    )
    firsts = cut(firsts)
    reps = base.join(firsts.select("f", F.col("rep").alias("id")), ["f", "id"], "left_semi")

    per = 1 + probes
    own = reps.select("f", "id", "sketch", F.posexplode("codes").alias("i", "code")).withColumn("bucket", F.xxhash64("f", F.floor(F.col("i") / per), "code"))
    home = own.where(F.col("i") % per == 0)
    big = home.groupBy("bucket").count().where(F.col("count") > bucket_cap).select("bucket", F.ceil(F.col("count") / bucket_cap).cast("int").alias("parts"))
    # a large bucket is cut in parts by its entries; every query of the bucket visits every part
    visits = (
        own.join(big, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("lives", F.when(F.col("i") % per == 0, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).otherwise(-1))
        .select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lives", "f", "id", "sketch")
        .select("bucket", "part", (F.col("lives") != F.col("part")).alias("guest"), "f", "id", "sketch")
    )

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, scorer = None, BucketScorer(per_bucket, least - slack)
        for now, rows in _parts(stream, ["bucket", "part"]):
            if now != last:
                yield from scorer.close()
                last, scorer = now, BucketScorer(per_bucket, least - slack)
            guest = rows["guest"].to_numpy()
            if not guest.all():
                scorer.own.append(rows[~guest])
            if guest.any():
                yield from scorer.close()
                yield from scorer.ask(rows[guest])
        yield from scorer.close()

    lists = visits.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "guest", "id").mapInArrow(score, "f int, id long, cand array<long>, est array<float>")
    best = (
        lists.select("f", "id", F.explode(F.arrays_zip("cand", "est")).alias("x")).select("f", "id", "x.cand", "x.est")
        .groupBy("f", "id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("est")).alias("far"), "cand"))), 1, candidates).alias("all"))
        .select("f", "id", F.transform("all", lambda x: x["cand"]).alias("cand"), F.transform(F.filter("all", lambda x: x["far"] <= -least), lambda x: x["cand"]).alias("sure"))
    )
    best = cut(best)
    # clusters are joined by sure links only; doubtful ones would tie them together by chance
    links = best.select("f", "id", F.explode("sure").alias("to"))
    label = best.select("f", "id", F.array_min(F.concat(F.array("id"), "sure")).alias("label"))
    edges = cut(links.unionByName(links.select("f", F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    for _ in range(hops if n else 0):
        near = edges.join(label.select("f", F.col("id").alias("to"), "label"), ["f", "to"]).groupBy("f", "id").agg(F.min("label").alias("near"))
        label = label.join(near, ["f", "id"], "left").select("f", "id", F.least("label", F.coalesce("near", "label")).alias("label"))
        label = cut(label)
    # a group that outgrows a task goes on until all that its links reach has one label
    while n:
        large = label.groupBy("f", "label").count().where(F.col("count") > 2 * team_rows).select("f", "label")
        hot = label.join(large, ["f", "label"], "left_semi")
        near = edges.join(hot.select("f", F.col("id").alias("to"), "label"), ["f", "to"]).unionByName(hot.select("f", "id", F.col("id").alias("to"), "label"))
        # both ends of a link get the smaller label, and so does what has the larger one
        moved = near.groupBy("f", "id").agg(F.min("label").alias("near")).join(label, ["f", "id"]).where(F.col("near") != F.col("label"))
        moved = moved.select("f", F.greatest("label", "near").alias("label"), F.least("label", "near").alias("near")).groupBy("f", "label").agg(F.min("near").alias("near"))
        moved = cut(moved)
        if not moved.count():
            break
        label = cut(label.join(moved, ["f", "label"], "left").select("f", "id", F.coalesce("near", "label").alias("label")))
    # a large cluster is cut by id; each pair of its parts is a team, where either side asks the other
    sized = label.groupBy("f", "label").agg(F.ceil(F.count("*") / (2 * team_rows)).cast("int").alias("parts"))
    members = label.join(sized, ["f", "label"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = cut(members.select("f", "id", "label", "part", "parts", F.xxhash64("f", "label", "part", "part").alias("team")))
    crossed = (
        members.where("parts > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.col("with") != F.col("part"))
        .select("f", "id", F.xxhash64("f", "label", F.least("part", "with"), F.greatest("part", "with")).alias("team"), F.when(F.col("part") < F.col("with"), 2).otherwise(3).alias("asks"))
    )
    asks = best.join(members, ["f", "id"])
    needs = (
        asks.select("f", "id", "team", F.lit(1).alias("asks"))
        .unionByName(asks.select("f", F.explode("cand").alias("id"), "team", F.lit(0).alias("asks")))
        .unionByName(crossed)
        .groupBy("f", "id", "team").agg(F.max("asks").alias("asks"))
        # a vector that very many teams need has its list in bounded chunks, each of which is a task's own
        .withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("f", "id").orderBy("team")) - 1) / chunk_teams).cast("int"))
        .groupBy("f", "id", "chunk").agg(F.collect_list(F.struct("team", "asks")).alias("teams"))
    )

    def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in _slices(stream):
            ids = np.asarray(b.column(0))
            for f, dim in enumerate(dims):
                at, rows = as_matrix(b.column(1 + f), dim)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(ids[at]), pa.array([pack(r, z) for r in rows], pa.binary())], ["f", "id", "vec"])

    vectors = src.mapInArrow(packed, "f int, id long, vec binary")
    # who needs which vector: sent to all only while the lists are few and short
    needs = cut(needs)
    lists, asked = needs.agg(F.count("*"), F.coalesce(F.sum(F.size("teams")), F.lit(0))).first()
    if lists <= few_needs and asked <= 4 * few_needs:
        found = vectors.join(F.broadcast(needs), ["f", "id"])
    else:
        hubs = small(needs.groupBy("f", "id").agg((F.max("chunk") + 1).alias("chunks")).where("chunks > 1"))
        copies = vectors.join(hubs, ["f", "id"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        found = copies.join(needs.hint("shuffle_hash"), ["f", "id", "chunk"])
    fetched = found.select("f", "id", "vec", F.explode("teams").alias("t")).select("t.team", "t.asks", "f", "id", "vec")

    def rank(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for g in _groups(stream, "team"):
            asks, ids = g["asks"].to_numpy(), g["id"].to_numpy()
            if len(g) < 2:
                continue
            vec = np.stack([unpack(v, z) for v in g["vec"]])
            # the scale of a vector doesn't matter for its cosine, but for overflow it does
            unit = vec / np.abs(vec).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            # 1 asks all of the team, 2 and 3 are the sides of two parts and ask each other
            for side, other in ((1, asks >= 0), (2, asks == 3), (3, asks == 2)):
                ask, near = np.flatnonzero(asks == side), np.flatnonzero(other)
                if not len(ask) or not len(near):
                    continue
                to = unit if len(near) == len(unit) else unit[near]
                for a in range(0, len(ask), 256):
                    q = ask[a : a + 256]
                    est = unit[q] @ to.T
                    if side == 1:
                        est[np.arange(len(q)), q] = -2
                    top = _top(est, max(1, min(k + 4, len(near) - (side == 1))))
                    # ties with the last kept one, as the later order is by double precision and id
                    worst = np.take_along_axis(est, top, 1).min(1)
                    tied = (est >= worst[:, None] - 1e-6) & (est >= least - 1e-3)
                    # many ties: the products of the whole block at once
                    exact = _cosines(vec[q], vec[near]) if tied.sum() > 64 * len(q) else None
                    out_q, out_c, out_s = [], [], []
                    for r, i in enumerate(q):
                        c = np.flatnonzero(tied[r])
                        if not len(c):
                            continue
                        cos = _cosines(vec[i : i + 1], vec[near[c]])[0] if exact is None else exact[r, c]
                        o = np.lexsort((ids[near[c]], -cos))[: k + 1]
                        o = o[cos[o] >= least]
                        out_q.append(np.full(len(o), ids[i])), out_c.append(ids[near[c]][o]), out_s.append(cos[o])
                    if out_q:
                        m = sum(map(len, out_q))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g["f"].iloc[0], np.int32)), pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_s))], ["f", "rep", "other", "cosine"])

    ranked = fetched.repartition("team").sortWithinPartitions("team").mapInArrow(rank, "f int, rep long, other long, cosine double")
    # candidates in another part of a cut cluster come twice
    ranked = ranked.groupBy("f", "rep", "other").agg(F.max("cosine").alias("cosine"))
    # from groups of copies back to items: the first k + 1 items of a group's list serve all its members
    spread = ranked.join(firsts.select("f", F.col("rep").alias("other"), F.col("firsts").alias("them")), ["f", "other"]).select("f", "rep", F.explode("them").alias("other"), "cosine")
    copies = firsts.where(F.size("firsts") > 1).select("f", "rep", F.explode("firsts").alias("other"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("f", "rep").orderBy(F.desc("cosine"), "other")
    lists = spread.unionByName(copies).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("f", "rep").agg(F.array_sort(F.collect_list(F.struct("r", "other", "cosine"))).alias("near"))
    items = base.select("f", "copy", "id").join(firsts.select("f", "copy", "rep"), ["f", "copy"]).join(lists, ["f", "rep"])
    mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    pairs = items.select("f", "id", F.explode(mine).alias("x")).select("f", F.least("id", "x.other").alias("id_a"), F.greatest("id", "x.other").alias("id_b"), "x.cosine").where(F.col("cosine") >= least)
    label_of = F.get(F.array(*[F.lit(x) for x in names]), F.col("f"))
    return pairs.groupBy("f", "id_a", "id_b").agg(F.max("cosine").alias("cosine")).select(label_of.alias("vec_field"), "id_a", "id_b", "cosine")
