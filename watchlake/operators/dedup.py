"""Latest-wins deduplication."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchlake.functions.ordering import newest_first
from watchlake.schemas import SILVER_SCHEMA


def latest_events(events: DataFrame, time_column: str | None = None, *then: Column) -> DataFrame:
    """One row per ``event_id``, the newest, with ``event_date`` from its event time.

    Rank 1 over the recency order is planned as a window group limit: every map
    task keeps one row per id before the shuffle, so an id copied a billion times
    reaches its reducer as one row per map task. Rows equal on the whole order are
    settled by a hash of the Silver columns, so a re-run after a lost executor, or in
    another batch, picks the same row. ``then`` orders copies that are alike in all of that.
    """
    content = [name for name in SILVER_SCHEMA.names if name in events.columns]
    # The hash skips NULLs, so which values are NULL is part of what it reads.
    gaps = [F.col(name).isNull() for name in content]
    settled = events.withColumn("_content", F.xxhash64(*content, *gaps))
    order = [*newest_first("_content", time_column=time_column), *then]
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    return (
        settled.withColumn("_rank", rank)
        .where("_rank = 1")
        .drop("_rank", "_content")
        .withColumn("event_date", F.try_to_date("event_time"))
    )
