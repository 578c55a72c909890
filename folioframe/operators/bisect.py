"""Isolating one offending entry with any predicate over a DataFrame of entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offending(entries: DataFrame, fails: Callable[[DataFrame], bool], position: str = "pos") -> int | None:
    """Position of an entry in whose presence ``fails`` holds: the range is halved, the left half is tried first.

    Only two bounds live on the driver; None if the whole doesn't fail.
    """
    lo, hi = entries.agg(F.min(position), F.max(position)).first()
    if lo is None or not fails(entries):
        return None
    while lo < hi:
        mid = (lo + hi) // 2
        if fails(entries.filter(F.col(position).between(lo, mid))):
            hi = mid
        else:
            lo = mid + 1
    return lo
