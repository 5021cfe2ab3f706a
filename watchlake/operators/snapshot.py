"""Latest state per session."""

from pyspark.sql import DataFrame, Window, functions as F

from watchlake.functions.ordering import newest_first


def latest_rows(accumulated: DataFrame, time_column: str | None = None) -> DataFrame:
    """The last accumulated row of every session; rows without a session are left out."""
    order = newest_first(time_column=time_column)
    frame = Window.partitionBy("session_id").orderBy(*order, F.desc("event_id"))
    return (
        accumulated.where("session_id IS NOT NULL")
        .withColumn("_rank", F.row_number().over(frame))
        .where("_rank = 1")
        .drop("_rank")
    )


def session_snapshot(accumulated: DataFrame, time_column: str | None = None) -> DataFrame:
    """One row per session: who watched what, in which state, where, since when."""
    return latest_rows(accumulated, time_column).select(
        "session_id",
        "user_id",
        "content_id",
        F.col("session_state").alias("current_state"),
        F.coalesce("current_playback_position", F.lit(0)).alias("playback_position_sec"),
        F.try_to_timestamp("event_time").alias("updated_at"),
    )
