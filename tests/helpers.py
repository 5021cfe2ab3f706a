"""Literal rows, a brute-force fold, and comparison of frames as multisets."""

from datetime import datetime

from watchlake.schemas import (
    CARRIED_FIELDS,
    EVENT_FIELDS,
    REASON_OF_EVENT,
    SILVER_SCHEMA,
    STATE_OF_EVENT,
)

INGESTED = datetime(2024, 1, 10, 12, 0, 0)


def event(event_id, session_id="s1", event_type="play", event_time="2024-01-10T10:00:00", **given):
    """One Silver row as a dict, with unremarkable values for whatever is not given."""
    row = dict.fromkeys(SILVER_SCHEMA.names)
    row |= {
        "event_id": event_id,
        "session_id": session_id,
        "event_type": event_type,
        "event_time": event_time,
        "user_id": "u1",
        "content_id": "c1",
        "event_version": 1,
        "event_header_reemission": 0,
        "event_key": session_id,
        "kafka_timestamp": INGESTED,
        "ingest_ts": INGESTED,
        "raw_value": "{}",
    }
    if event_type in REASON_OF_EVENT:
        row[REASON_OF_EVENT[event_type]] = f"why-{event_id}"
    return row | given


def silver(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in SILVER_SCHEMA.names) for r in rows], SILVER_SCHEMA)


def document(**changes):
    """A well-formed payload; a change to ``...`` removes the field."""
    payload = dict.fromkeys(EVENT_FIELDS) | {
        "schema_name": "watch_event",
        "schema_version": 1,
        "event_id": "e1",
        "event_type": "play",
        "user_id": "u1",
        "session_id": "s1",
        "content_id": "c1",
        "event_time": "2024-01-10T10:00:00",
        "event_version": 1,
        "event_header_reemission": 0,
        "playback_position": 7,
    }
    return {k: v for k, v in (payload | changes).items() if v is not ...}


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, comparable across plans."""
    picked = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def recency(row):
    keys = ("event_time", "event_version", "event_header_reemission", "ingest_ts")
    return tuple((row[k] is None, 0 if row[k] is None else row[k]) for k in keys) + (row["event_id"],)


def fold(rows, own_null_sessions=False):
    """Brute force over deduplicated dict rows: event_id -> (state, carried, history)."""
    groups = {}
    for row in rows:
        alone = row["event_id"] if row["session_id"] is None and own_null_sessions else None
        groups.setdefault((row["session_id"], alone), []).append(row)
    folded = {}
    for group in groups.values():
        state, carried, history = None, dict.fromkeys(CARRIED_FIELDS), []
        for row in sorted(group, key=recency):
            state = STATE_OF_EVENT.get(row["event_type"], state)
            carried |= {f: row[f] for f in CARRIED_FIELDS if row[f] is not None}
            if row["event_type"] in REASON_OF_EVENT:
                reason = row[REASON_OF_EVENT[row["event_type"]]]
                history = [*history, (row["event_time"], row["event_type"], reason)]
            folded[row["event_id"]] = (state, tuple(carried.values()), tuple(history))
    return folded


def folded_rows(accumulated):
    """The same shape from an accumulated frame with array history."""
    names = [f"current_{f}" for f in CARRIED_FIELDS]
    return {
        r.event_id: (
            r.session_state,
            tuple(r[n] for n in names),
            tuple(tuple(entry) for entry in r.control_event_history),
        )
        for r in accumulated.collect()
    }
