"""Broadcasts of tables whose size has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables of at most this many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is at most ``limit``, else as it is.

    Give a staged table: it is read once more to add up the bytes of its rows.
    """
    plain = 16 + 8 * len(df.columns)
    sizes = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind in ("string", "binary")]
    total = df.agg(F.sum(sum(sizes, F.lit(plain)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
