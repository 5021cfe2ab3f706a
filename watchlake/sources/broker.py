"""Kafka reader and writer. The connector jar comes with the cluster."""

from pyspark.sql import DataFrame, SparkSession

from watchlake.schemas import EVENT_TOPIC


def stream_from_kafka(
    spark: SparkSession,
    servers: str,
    topic: str = EVENT_TOPIC,
    max_offsets: int | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """The topic from its earliest offset.

    ``max_offsets`` bounds a micro-batch, ``min_partitions`` splits large topic
    partitions over more tasks, which evens out a partition with a hot key.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return spark.readStream.format("kafka").options(**options).load()


def publish_to_kafka(messages: DataFrame, servers: str) -> None:
    """Write ``topic``, ``key``, ``value`` and, if present, ``headers`` rows."""
    headers = "headers" in messages.columns
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("kafka.compression.type", "snappy")
        .option("includeHeaders", str(headers).lower())
        .save()
    )
