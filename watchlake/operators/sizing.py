"""Broadcasting behind a check of the real size."""

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 << 20

# Stands for a row's own overhead in a broadcast hash relation.
_ROW_BYTES = 64


def broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``keys``, marked for broadcast if they measure at most ``limit`` bytes.

    Runs one aggregate over ``keys``, so they should be cached or cheap. Without
    the mark a join shuffles both sides, and the adaptive planner splits skew.
    """
    texts = [name for name, kind in keys.dtypes if kind == "string"]
    text_bytes = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    size = keys.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text_bytes), F.lit(0)).alias("text")
    ).first()
    return F.broadcast(keys) if size.rows * _ROW_BYTES + size.text <= limit else keys


def broadcast_if_known_small(rows: DataFrame, size: int | None) -> DataFrame:
    """The same for a size in bytes, or an upper bound of it, that an earlier action has found."""
    return F.broadcast(rows) if (size or 0) <= BROADCAST_BYTES else rows
