"""Declared schemas and vocabularies of the watch-event model.

Nothing is inferred from data. The parsed payload has one declaration,
``EVENT_FIELDS``; every other layout is written in terms of it.
"""

from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

# Fields of the JSON payload that are parsed, with their Spark types.
EVENT_FIELDS = {
    "event_id": "string",
    "event_type": "string",
    "user_id": "string",
    "session_id": "string",
    "content_id": "string",
    "event_time": "string",
    "event_version": "integer",
    "event_header_reemission": "integer",
    "playback_position": "integer",
    "device_type": "string",
    "platform": "string",
    "network_type": "string",
    "pause_reason": "string",
    "resume_reason": "string",
    "completion_percent": "integer",
    "watch_duration_sec": "integer",
    "abandoned_reason": "string",
}

# Event types, and the session state each one puts a session in.
STATE_OF_EVENT = {
    "play": "PLAYING",
    "pause": "PAUSED",
    "resume": "PLAYING",
    "completed": "COMPLETED",
    "abandoned": "ABANDONED",
}

# Control events and the column that holds each one's reason.
REASON_OF_EVENT = {
    "pause": "pause_reason",
    "resume": "resume_reason",
    "abandoned": "abandoned_reason",
}

# Columns carried forward through a session as ``current_<name>``.
CARRIED_FIELDS = [
    "device_type",
    "platform",
    "network_type",
    "completion_percent",
    "watch_duration_sec",
    "playback_position",
]

# Broker topics and the key of a message without a session.
EVENT_TOPIC = "watch-events"
DEAD_LETTER_TOPIC = "watch-events-dlq"
MISSING_KEY = "unknown"

# Columns kept beside the parsed fields so a row can be traced to its record.
LINEAGE_FIELDS = {
    "event_key": "string",
    "kafka_timestamp": "timestamp",
    "ingest_ts": "timestamp",
    "raw_value": "string",
}


def _struct(fields: dict[str, str | DataType]) -> StructType:
    schema = StructType()
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    return schema


EVENT_SCHEMA = _struct(EVENT_FIELDS)

# Broker and Bronze columns.
BROKER_SCHEMA = _struct(
    {
        "key": "binary",
        "value": "binary",
        "topic": "string",
        "partition": "integer",
        "offset": "long",
        "timestamp": "timestamp",
        "timestampType": "integer",
    }
)

BRONZE_SCHEMA = _struct(
    {
        "topic": "string",
        "partition": "integer",
        "offset": "long",
        "kafka_timestamp": "timestamp",
        "timestampType": "integer",
        "event_key": "string",
        "raw_value": "string",
        "ingest_ts": "timestamp",
        "date": "date",
    }
)

SILVER_SCHEMA = _struct(EVENT_FIELDS | LINEAGE_FIELDS)

# Both halves of Silver in one table, partitioned by the flag.
FLAGGED_SCHEMA = _struct(EVENT_FIELDS | LINEAGE_FIELDS | {"valid": "boolean"})

# A replay says what the contract finds, too.
REPLAYED_SCHEMA = StructType([*FLAGGED_SCHEMA.fields, StructField("violations", StringType())])

CONTROL_EVENT_SCHEMA = _struct({"event_time": "string", "event_type": "string", "reason": "string"})

# The two forms of the control-event history: column name and type.
HISTORY_TYPES = {
    "array": ("control_event_history", ArrayType(CONTROL_EVENT_SCHEMA)),
    "count": ("control_event_count", LongType()),
}


def accumulated_schema(history: str = "array") -> StructType:
    """Layout of the accumulated table, partitioned by ``event_date``."""
    name, kind = HISTORY_TYPES[history]
    carried = {f"current_{field}": EVENT_FIELDS[field] for field in CARRIED_FIELDS}
    return _struct(
        EVENT_FIELDS
        | LINEAGE_FIELDS
        | {"event_date": "date", "session_state": "string"}
        | carried
        | {name: kind}
    )


# ``value`` and ``payload`` hold a JSON document as text.
# Field names and order of the records below.
SPOOL_SCHEMA = _struct(
    {
        "topic": "string",
        "key": "string",
        "value": "string",
        "reason": "string",
        "timestamp": "double",
    }
)

DEAD_LETTER_SCHEMA = _struct(
    {
        "original_topic": "string",
        "key": "string",
        "payload": "string",
        "error": "string",
        "timestamp": "double",
    }
)

# As written: beside the nested document, which is for reading, its exact text.
SPOOL_FILE_SCHEMA = StructType([*SPOOL_SCHEMA.fields, StructField("value_text", StringType())])
DEAD_LETTER_FILE_SCHEMA = StructType([*DEAD_LETTER_SCHEMA.fields, StructField("payload_text", StringType())])
