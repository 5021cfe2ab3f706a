"""The recency order of events.

Dedup reads it newest first and session folding oldest first. ``event_time`` is
text, so its order is lexicographic; pass ``time_column`` to order by a parsed
timestamp when a feed mixes offsets.
"""

from pyspark.sql import Column, functions as F

# Sort keys, most significant first.
RECENCY = ["event_time", "event_version", "event_header_reemission", "ingest_ts"]


def event_instant(event_time: str = "event_time") -> Column:
    """The instant of a text event time, offset included; NULL for unreadable text."""
    return F.try_to_timestamp(F.col(event_time))


def _keys(time_column: str | None) -> list[str]:
    return [time_column or RECENCY[0], *RECENCY[1:]]


def newest_first(*tie_breaks: str, time_column: str | None = None) -> list[Column]:
    return [F.desc_nulls_last(k) for k in [*_keys(time_column), *tie_breaks]]


def oldest_first(*tie_breaks: str, time_column: str | None = None) -> list[Column]:
    return [F.asc_nulls_last(k) for k in [*_keys(time_column), *tie_breaks]]


def order_key(*tie_breaks: str, time_column: str | None = None) -> Column:
    """The order of ``oldest_first`` as one value to compare and to take a maximum by.

    Structs compare NULL fields first, so a flag before each field puts them last.
    """
    keys = [*_keys(time_column), *tie_breaks]
    parts = [part for i, k in enumerate(keys) for part in (F.col(k).isNull().alias(f"n{i}"), F.col(k).alias(f"k{i}"))]
    return F.struct(*parts)
