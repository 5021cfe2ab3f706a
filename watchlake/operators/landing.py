"""Broker records to Bronze rows."""

from pyspark.sql import Column, DataFrame, functions as F


def land_records(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Project broker records to Bronze: text key and value, ingest time, ingest date.

    ``ingest_ts`` defaults to the processing time, constant within a micro-batch.
    A backfill of archived records passes its own, so a re-run lands the same rows.
    """
    # Names and order of the landed columns.
    stamped = records.select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        "timestampType",
        F.col("key").cast("string").alias("event_key"),
        F.col("value").cast("string").alias("raw_value"),
        (F.current_timestamp() if ingest_ts is None else ingest_ts).alias("ingest_ts"),
    )
    return stamped.withColumn("date", F.to_date("ingest_ts"))
