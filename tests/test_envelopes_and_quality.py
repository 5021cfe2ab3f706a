import json
from datetime import timedelta

import pytest
from pyspark.sql import Observation, functions as F

from helpers import INGESTED, event, rows_of, silver
from watchlake.operators import envelopes, quality
from watchlake.operators.parsing import parse_events
from watchlake.schemas import DEAD_LETTER_SCHEMA, EVENT_FIELDS, SPOOL_FILE_SCHEMA, SPOOL_SCHEMA


def test_messages_are_keyed_and_spell_out_nulls(spark):
    rows = silver(spark, [event("1"), event("2", None)]).select(*EVENT_FIELDS)
    sent = {json.loads(r.value)["event_id"]: r for r in envelopes.to_broker_records(rows).collect()}
    assert (sent["1"].key, sent["2"].key) == ("s1", "unknown")
    assert list(json.loads(sent["1"].value)) == [*envelopes.PAYLOAD_CONSTANTS, *EVENT_FIELDS]
    assert json.loads(sent["1"].value)["platform"] is None
    ids = {bytes(r.headers[0]["value"]).decode() for r in sent.values()}
    assert len(ids) == 2 and all(len(i) == 36 for i in ids)
    assert sent["1"].headers[0]["key"] == "message_id" and sent["1"].topic == "watch-events"


def test_dead_letters_nest_their_payload(spark):
    rejected = spark.createDataFrame(
        [("s1", '{"a": 1}', "bad a"), (None, "not json", "malformed"), ("s3", None, "malformed")],
        "event_key STRING, raw_value STRING, why STRING",
    )
    letters = envelopes.to_dead_letter(rejected, "why", at=F.lit(INGESTED))
    assert [(f.name, f.dataType) for f in letters.schema] == [
        (f.name, f.dataType) for f in DEAD_LETTER_SCHEMA
    ]
    sent = {r.key: json.loads(r.value) for r in envelopes.dead_letter_messages(letters).collect()}
    assert sent["s1"] == {
        "original_topic": "watch-events",
        "key": "s1",
        "payload": {"a": 1},
        "error": "bad a",
        "timestamp": 1704888000.0,
        "payload_text": '{"a": 1}',
    }
    assert sent["unknown"]["payload"] == "not json"
    assert sent["s3"]["payload"] is None
    back = envelopes.dead_letters_as_bronze(letters)
    assert rows_of(back, "event_key", "raw_value") == [
        ("s1", '{"a": 1}'),
        ("s3", None),
        ("unknown", "not json"),
    ]


def test_spool_round_trip(spark, tmp_path):
    messages = spark.createDataFrame(
        [("t", "k1", '{"b":1}'), ("t", "k2", "not json"), ("t", "k3", None)], "topic STRING, key STRING, value STRING"
    )
    spool = envelopes.to_spool(messages, "broker_unavailable", at=F.lit(INGESTED))
    path = str(tmp_path / "spool")
    envelopes.spool_lines(spool).write.text(path)
    assert rows_of(spark.read.schema(SPOOL_SCHEMA).json(path)) == rows_of(spool)


ODD_TEXTS = ['{"b":1,"a":1e400}', '{"n":' + "9" * 50 + "}", '"abc"', '{"b" : 1.0, "b":2}', "", " [1]", "é\\n", None]


def test_odd_texts_survive_letter_by_letter(spark, tmp_path):
    """A document that nesting would alter comes back as it was."""
    rows = spark.createDataFrame([(str(i), t, "why") for i, t in enumerate(ODD_TEXTS)], "event_key STRING, raw_value STRING, why STRING")
    letters = envelopes.to_dead_letter(rows, "why", at=F.lit(INGESTED))
    back = envelopes.dead_letters_of(envelopes.dead_letter_messages(letters))
    assert rows_of(back, *letters.columns) == rows_of(letters, *letters.columns)
    spool = envelopes.to_spool(rows.selectExpr("'t' AS topic", "event_key AS key", "raw_value AS value"), "down", at=F.lit(INGESTED))
    path = str(tmp_path / "spool")
    envelopes.spool_lines(spool).write.text(path)
    again = envelopes.exact_text(spark.read.schema(SPOOL_FILE_SCHEMA).json(path), "value")
    assert rows_of(again, *spool.columns) == rows_of(spool, *spool.columns)


@pytest.fixture
def parsed(spark):
    texts = ['{"event_id":"1","user_id":"u","event_type":"play","event_header_reemission":1}', "{}", "x"]
    rows = [("k", t, INGESTED, INGESTED + timedelta(milliseconds=ms)) for t, ms in zip(texts, (5, 300, 20_000))]
    return parse_events(
        spark.createDataFrame(rows, "event_key STRING, raw_value STRING, kafka_timestamp TIMESTAMP, ingest_ts TIMESTAMP")
    )


def test_counts(parsed):
    expected = {"accepted": 3, "delivered": 1, "failed": 2, "reemitted": 1}
    assert dict(rows_of(quality.quality_counts(parsed), "outcome", "n")) == expected
    watch = Observation("q")
    assert quality.observed(parsed, watch).count() == 3
    assert watch.get == expected


def test_lag_histogram_is_cumulative(parsed):
    got = {r.le: r.n for r in quality.ingest_lag(parsed).collect()}
    assert len(got) == 15
    assert (got["0.005"], got["0.25"], got["0.5"], got["10.0"], got["+Inf"]) == (1, 1, 2, 2, 3)


def test_lag_percentiles(parsed):
    assert rows_of(quality.lag_percentiles(parsed, (0.5, 0.99)), "share", "lag_sec") == [(0.5, 0.3), (0.99, 20.0)]
