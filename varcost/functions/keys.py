"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*cols: Column) -> Column:
    """SHA-256 of the natural key.

    Unlike a random UUID it is the same on every recomputation of a lost partition and on every
    rerun. Each part carries its length, so ('a|b', 'c') and ('a', 'b|c') differ, and a NULL part has a
    mark of its own.
    """
    parts = [c.cast("string") for c in cols]
    return F.sha2(
        F.concat_ws("|", *(F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts)), 256
    )
