"""The outbox: positions, rounds of records, acknowledgements one by one and round by round."""

import json

import pytest
from pyspark.sql import functions as F

from watchlake.schemas import SPOOL_SCHEMA
from watchlake.sinks.outbox import Outbox, each_record, whole_round
from watchlake.streaming import jobs


def spool(spark, n, key=lambda i: f"k{i % 7}"):
    rows = [("watch-events", key(i), f'{{"i": {i}}}', "down", float(i)) for i in range(n)]
    return spark.createDataFrame(rows, SPOOL_SCHEMA)


def note_to(path, broken=()):
    """A client that notes each record in a file, and fails for some positions."""

    def connect():
        def send(topic, key, value, digest, position):
            if position in broken:
                raise ConnectionError(f"no answer for {position}")
            with open(path, "a") as notes:
                notes.write(json.dumps([position, topic, key, value, digest]) + "\n")

        return send

    return connect


def noted(path):
    with open(path) as notes:
        return [json.loads(line) for line in notes]


def test_failure_at_the_third_record_leaves_two_acknowledged(spark, tmp_path):
    box, notes = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "notes")
    assert box.add(spool(spark, 10, key=lambda i: "one")) == 10
    assert box.send(each_record(note_to(notes, broken={2}), tasks=2), records=10) == 2
    assert {r.position for r in box.pending().collect()} == set(range(2, 10))
    assert [(r.position, r.error) for r in box.failures().collect()] == [(2, "ConnectionError: no answer for 2")]
    assert box.send(each_record(note_to(notes), tasks=2), records=10) == 8
    sent = noted(notes)
    assert [r[0] for r in sent] == list(range(10))
    assert [json.loads(r[3])["i"] for r in sent] == list(range(10))
    assert box.pending().count() == 0 and box.failures().count() == 0
    assert box.send(each_record(note_to(notes), tasks=2), records=10) == 0


def test_other_keys_go_on_past_a_failure(spark, tmp_path):
    box, notes = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "notes")
    box.add(spool(spark, 70))
    first = box.send(each_record(note_to(notes, broken={3}), tasks=7), records=35)
    assert 0 < first < 35
    assert not [r for r in noted(notes) if r[2] == "k3"]
    assert box.send(each_record(note_to(notes), tasks=7), records=35) == 70 - first
    sent = noted(notes)
    assert sorted(r[0] for r in sent) == list(range(70))
    for key in {r[2] for r in sent}:
        own = [r[0] for r in sent if r[2] == key]
        assert own == sorted(own)


def test_one_file_of_a_thousand_records_gives_ten_rounds(spark, tmp_path):
    lines = spool(spark, 1000).select(F.to_json(F.struct("*")).alias("value"))
    lines.coalesce(1).write.text(str(tmp_path / "spool"))
    box = Outbox(spark, str(tmp_path / "box"))
    start = lambda: jobs.start_outbox(jobs.stream_spool(spark, str(tmp_path / "spool")), box, str(tmp_path / "cp"))
    start().awaitTermination()
    rounds = []

    def write(rows, first):
        rounds.append((first, rows.count(), rows.agg(F.min("position"), F.max("position")).first()))

    assert box.send(whole_round(write), records=100) == 1000
    assert rounds == [(i, 100, (i, i + 99)) for i in range(0, 1000, 100)]


def test_a_round_that_raises_is_tried_again_whole(spark, tmp_path):
    box, out = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "out")
    box.add(spool(spark, 30))
    state = {"down": True}

    def write(rows, first):
        if first == 10 and state["down"]:
            raise ConnectionError
        rows.write.mode("append").parquet(out)

    with pytest.raises(ConnectionError):
        box.send(whole_round(write), records=10)
    assert {r.outcome: r.n for r in box.counts().collect()} == {"spooled": 30, "replayed": 10}
    state["down"] = False
    assert box.send(whole_round(write), records=10) == 20
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == list(range(30))


def test_batches_count_once_and_empty_or_odd_rows_are_kept(spark, tmp_path):
    box, notes = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "notes")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), ("t", "", "", "", 1.0), ("t", "k", "x" * 100_000, "r", 1.0)] + [("t", "k", "same", "r", 2.0)] * 3,
        SPOOL_SCHEMA,
    )
    assert box.add(odd.withColumns({"position": F.lit(1), "digest": F.lit(2), "at": F.lit(3), "part": F.lit(4)}), "q", 0) == 6
    assert box.add(odd, "q", 0) == 0
    assert box.add(odd.limit(0), "q", 1) == 0
    assert box.add(spool(spark, 2), "q", 2) == 2
    assert box.pending().count() == 8
    assert box.send(each_record(note_to(notes), tasks=3), records=3) == 8
    sent = noted(notes)
    assert sorted(r[0] for r in sent) == list(range(8))
    assert [r[3] for r in sent].count("same") == 3 and len({r[4] for r in sent if r[3] == "same"}) == 1
    assert len({r[4] for r in sent}) == 6


def test_acknowledged_folders_go_and_positions_run_on(spark, tmp_path):
    box, notes = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "notes")
    box.add(spool(spark, 5))
    box.send(each_record(note_to(notes), tasks=1), records=4)
    assert box.clear() >= 1
    box.add(spool(spark, 5))
    assert {r.position for r in box.pending().collect()} == set(range(5, 10))
    assert box.send(each_record(note_to(notes), tasks=1), records=4) == 5
    assert sorted(r[0] for r in noted(notes)) == list(range(10))


def test_an_empty_outbox_sends_nothing(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    assert box.send(each_record(note_to("/nowhere"), tasks=1), records=1) == 0
    assert box.pending().count() == 0 and box.clear() == 0
    with pytest.raises(ValueError):
        box.send(each_record(note_to("/nowhere"), tasks=1), records=0)


def test_a_backlog_goes_many_rounds_at_a_time(spark, tmp_path):
    box, out, calls = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "out"), []
    box.add(spool(spark, 95))

    def write(rows, first):
        calls.append(first)
        if calls == [0, 10]:
            raise ConnectionError
        rows.write.mode("append").parquet(out)

    with pytest.raises(ConnectionError):
        box.send(whole_round(write), records=10)
    assert box.send(whole_round(write), records=10, rounds=4) == 85
    assert calls == [0, 10, 10, 50, 90]
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == list(range(95))
    with pytest.raises(ValueError):
        box.send(whole_round(write), records=10, rounds=0)


def test_a_failure_in_a_backlog_leaves_what_was_acknowledged(spark, tmp_path):
    box, notes = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "notes")
    box.add(spool(spark, 20, key=lambda i: "one"))
    assert box.send(each_record(note_to(notes, broken={7}), tasks=2), records=5, rounds=3) == 7
    assert box.send(each_record(note_to(notes), tasks=2), records=5, rounds=3) == 13
    assert [r[0] for r in noted(notes)] == list(range(20))
