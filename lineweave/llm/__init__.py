"""Operators for large text corpora. Nothing outside of this folder imports it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def share_of(df: DataFrame, keys: list[str], about: float) -> DataFrame:
    """About ``about`` rows of a table of any size (all, if it has fewer), chosen by a hash of their keys: what a fit reads is
    bounded before it is ordered, so tasks send the driver no more as the table grows."""
    part = min(1.0, about / max(df.count(), 1))
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(_PARTS)) < int(part * _PARTS))
