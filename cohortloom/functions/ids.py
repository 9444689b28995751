"""Deterministic ids of drug pairs, and person-level sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_id(a: Column, b: Column) -> Column:
    """Id of an observed two-drug cohort: the first 12 hex digits of md5('low_high'), below 10^12, plus 9 * 10^12."""
    digest = F.md5(F.concat_ws("_", F.least(a, b), F.greatest(a, b)))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(10**12)) + F.lit(9 * 10**12)


def synthetic_pair_id(a: Column, b: Column) -> Column:
    """Negative id of a catalog combination, the same for either order; opaque, and unique up to hash collisions."""
    return -F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(10**9))


def in_sample(person: Column, ratio: float) -> Column:
    """Person-level, deterministic sample; everything at a ratio of 1 or more. The ratio counts in whole percent."""
    return F.lit(True) if ratio >= 1.0 else F.pmod(F.xxhash64(person), F.lit(100)) < int(ratio * 100)
