"""Broker messages, dead letters and spooled records, and the way back from them."""

from pyspark.sql import Column, DataFrame, functions as F

from watchlake.schemas import DEAD_LETTER_FILE_SCHEMA, DEAD_LETTER_TOPIC, EVENT_FIELDS, EVENT_TOPIC, MISSING_KEY

# What every payload says about its own form.
PAYLOAD_CONSTANTS = {"schema_name": "watch_event", "schema_version": 1}


def _epoch_seconds(moment: Column) -> Column:
    return F.unix_micros(moment) / F.lit(1e6)


def _json_payload(text: Column) -> Column:
    """JSON text as a nested document, any other text as a JSON string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def event_payload() -> Column:
    """An event's fields as the JSON text the contract asks for; NULLs are spelled out."""
    constants = [F.lit(value).alias(name) for name, value in PAYLOAD_CONSTANTS.items()]
    return F.to_json(F.struct(*constants, *EVENT_FIELDS), {"ignoreNullFields": "false"})


def to_broker_records(events: DataFrame, topic: str = EVENT_TOPIC, key: str = "session_id") -> DataFrame:
    """Keyed messages with the canonical payload and a random message id."""
    message_id = F.struct(
        F.lit("message_id").alias("key"), F.encode(F.uuid(), "UTF-8").alias("value")
    )
    return events.select(
        F.lit(topic).alias("topic"),
        F.coalesce(F.col(key), F.lit(MISSING_KEY)).alias("key"),
        event_payload().alias("value"),
        F.array(message_id).alias("headers"),
    )


def to_dead_letter(
    rejected: DataFrame, error: Column | str, topic: str = EVENT_TOPIC, at: Column | None = None
) -> DataFrame:
    """Rejected rows (``event_key``, ``raw_value``) as dead-letter rows."""
    return rejected.select(
        F.lit(topic).alias("original_topic"),
        F.coalesce("event_key", F.lit(MISSING_KEY)).alias("key"),
        F.col("raw_value").alias("payload"),
        (F.col(error) if isinstance(error, str) else error).alias("error"),
        _epoch_seconds(F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def dead_letter_messages(letters: DataFrame, topic: str = DEAD_LETTER_TOPIC) -> DataFrame:
    """Dead-letter rows as keyed messages whose value nests the payload.

    Nesting reads well but may reorder keys and change numbers; a dead letter is
    evidence, so ``payload_text`` holds its exact text as well.
    """
    envelope = F.struct(
        "original_topic",
        "key",
        _json_payload(F.col("payload")).alias("payload"),
        "error",
        "timestamp",
        F.col("payload").alias("payload_text"),
    )
    return letters.select(
        F.lit(topic).alias("topic"),
        "key",
        F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"),
    )


def dead_letters_of(messages: DataFrame) -> DataFrame:
    """Dead-letter rows back from their messages, payloads letter by letter."""
    parsed = messages.select(F.from_json("value", DEAD_LETTER_FILE_SCHEMA).alias("m"))
    return exact_text(parsed.select("m.*"), "payload")


def exact_text(records: DataFrame, name: str) -> DataFrame:
    """Read records with ``name`` as its exact text, where they carry one."""
    text = F.coalesce(f"{name}_text", name)
    return records.withColumn(name, text).drop(f"{name}_text")


def to_spool(messages: DataFrame, reason: Column | str, at: Column | None = None) -> DataFrame:
    """Undelivered messages (``topic``, ``key``, ``value``) as spool records."""
    return messages.select(
        "topic",
        "key",
        "value",
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        _epoch_seconds(F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def spool_lines(spool: DataFrame) -> DataFrame:
    """Spool records as JSON lines, ready for a text sink: ``value`` nested, ``value_text`` exact."""
    record = F.struct(
        "topic",
        "key",
        _json_payload(F.col("value")).alias("value"),
        "reason",
        "timestamp",
        F.col("value").alias("value_text"),
    )
    return spool.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def spool_as_bronze(spool: DataFrame) -> DataFrame:
    """Spool records in the columns that parsing and validation read."""
    spooled_at = F.timestamp_micros((F.col("timestamp") * F.lit(1e6)).cast("bigint"))
    return spool.select(
        "topic",
        F.col("key").alias("event_key"),
        F.col("value").alias("raw_value"),
        spooled_at.alias("kafka_timestamp"),
        spooled_at.alias("ingest_ts"),
    )


def dead_letters_as_bronze(letters: DataFrame) -> DataFrame:
    """Dead letters in the columns that parsing and validation read."""
    return spool_as_bronze(
        letters.select(
            F.col("original_topic").alias("topic"), "key", F.col("payload").alias("value"), "timestamp"
        )
    )
