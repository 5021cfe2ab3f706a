import random
from datetime import timedelta

import pytest

from helpers import INGESTED, event, fold, folded_rows, rows_of, silver
from watchlake.functions.playback import history_text
from watchlake.operators.accumulate import STATE_COLUMNS
from watchlake.plans import medallion
from watchlake.plans.incremental import EXACT, PARITY, RefreshMode, refresh_table
from watchlake.schemas import accumulated_schema
from watchlake.sources.tables import read_table

VIEW = ["event_id", "session_id", "event_version", "event_header_reemission", "event_date", *STATE_COLUMNS]


def stored(spark, path, history="array"):
    return read_table(spark, path, accumulated_schema(history))


def messy_rows(n, seed):
    """Long sessions, copies, corrections that move date or session, NULL sessions, bad times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = rng.choice(["big"] * 5 + ["a", "b", "c", None])
        time = rng.choice([f"2024-01-{rng.randint(1, 20):02}T{rng.randint(0, 23):02}:00:00"] * 9 + ["bad", None])
        kind = rng.choice(["play", "pause", "resume", "completed", "abandoned", "odd"])
        base = event(f"e{i:04}", session, kind, time, playback_position=rng.choice([None, i]))
        rows.append(base)
        if rng.random() < 0.3:
            rows.append(base | {"event_header_reemission": 1})
        if rng.random() < 0.3:
            moved = {"session_id": rng.choice(["a", "b", None]), "event_time": f"2024-02-{i % 20 + 1:02}T00:00:00"}
            rows.append(base | {"event_version": 2} | moved)
    return [r | {"ingest_ts": INGESTED + timedelta(seconds=j)} for j, r in enumerate(rows)]


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**9), (2, 25)])
def test_exact_mode_does_not_depend_on_batches(spark, tmp_path, seed, hot_rows):
    """Any cut, any order and a repeated batch give the table of a single batch."""
    rows = messy_rows(120, seed)
    rng = random.Random(seed)
    shuffled = rng.sample(rows, len(rows))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
    batches.append(batches[1])
    path = str(tmp_path / "acc")
    for batch in batches:
        refresh_table(silver(spark, batch), path, EXACT, hot_rows=hot_rows)
    expected = medallion.accumulated(silver(spark, rows), null_sessions="own")
    text = history_text("control_event_history")
    assert rows_of(stored(spark, path), *VIEW, text) == rows_of(expected, *VIEW, text)


def test_exact_mode_with_counted_history(spark, tmp_path):
    rows = messy_rows(60, 5)
    path = str(tmp_path / "acc")
    for part in (rows[40:], rows[:40]):
        refresh_table(silver(spark, part), path, EXACT, history="count")
    expected = medallion.accumulated(silver(spark, rows), history="count", null_sessions="own")
    also = [*VIEW, "control_event_count"]
    assert rows_of(stored(spark, path, "count"), *also) == rows_of(expected, *also)


def test_refresh_by_instant_when_offsets_differ(spark, tmp_path):
    """Batches in any order give the full recompute by instants, whatever the texts sort like."""
    from dataclasses import replace

    from watchlake.functions.ordering import event_instant

    zones = ["Z", "+05:00", "-07:30"]
    rows = [
        event(f"e{i}", "s1", ["play", "pause", "resume"][i % 3], f"2024-01-10T{(7 * i) % 24:02}:00:00{zones[i % 3]}", playback_position=i)
        for i in range(30)
    ]
    rows += [r | {"event_version": 2, "event_time": r["event_time"][:11] + "12:30:00+05:00"} for r in rows[:4]]
    path = str(tmp_path / "acc")
    for part in (rows[20:], rows[:12], rows[12:20]):
        refresh_table(silver(spark, part), path, replace(EXACT, by_instant=True), history="count")
    timed = silver(spark, rows).withColumn("event_ts", event_instant())
    expected = medallion.accumulated(timed, history="count", null_sessions="own", time_column="event_ts")
    also = [*VIEW, "control_event_count"]
    assert rows_of(stored(spark, path, "count"), *also) == rows_of(expected, *also)
    by_text = medallion.accumulated(timed, history="count", null_sessions="own")
    assert rows_of(by_text, *also) != rows_of(expected, *also)


def test_another_history_form_is_refused(spark, tmp_path):
    """The stored histories stay; a rewrite under the other form would drop them."""
    path = str(tmp_path / "acc")
    rows = [event("1", event_type="pause"), event("2", "s2", "pause")]
    for stored_as, other in (("array", "count"), ("count", "array")):
        path = str(tmp_path / stored_as)
        refresh_table(silver(spark, rows), path, history=stored_as)
        before = rows_of(stored(spark, path, stored_as))
        with pytest.raises(ValueError, match="other columns"):
            refresh_table(silver(spark, [event("3")]), path, history=other)
        assert rows_of(stored(spark, path, stored_as)) == before
        refresh_table(silver(spark, [event("3")]), path, history=stored_as)
        assert stored(spark, path, stored_as).count() == 3


def test_invalid_rows_are_not_folded(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "acc")
    flagged = silver(spark, [event("1"), event("2", user_id=None), event(None)]).withColumn(
        "valid", F.expr("event_id is not null and user_id is not null")
    )
    refresh_table(flagged, path)
    assert rows_of(stored(spark, path), "event_id") == [("1",)]


LATE = [
    event("1", event_time="2024-01-10T10:00:00", device_type="tv"),
    event("3", event_type="odd", event_time="2024-01-10T10:00:20"),
]
BETWEEN = event("2", event_type="pause", event_time="2024-01-10T10:00:10")


def test_late_event_refreshes_later_rows_only_in_exact_mode(spark, tmp_path):
    got = {}
    for name, mode in (("exact", EXACT), ("parity", PARITY)):
        path = str(tmp_path / name)
        refresh_table(silver(spark, LATE), path, mode)
        refresh_table(silver(spark, [BETWEEN]), path, mode)
        got[name] = folded_rows(stored(spark, path))
    assert got["exact"] == fold([*LATE, BETWEEN])
    assert got["parity"]["2"] == got["exact"]["2"]
    assert got["parity"]["3"][0] == "PLAYING" and got["exact"]["3"][0] == "PAUSED"


def test_older_version_arriving_last(spark, tmp_path):
    new, old = event("1", event_version=2), event("1", event_version=1)
    for mode, version in ((EXACT, 2), (PARITY, 1)):
        path = str(tmp_path / str(version))
        refresh_table(silver(spark, [new]), path, mode)
        refresh_table(silver(spark, [old]), path, mode)
        assert rows_of(stored(spark, path), "event_version") == [(version,)]


def test_bounded_lookback_sees_only_its_days(spark, tmp_path):
    first = event("1", event_time="2024-01-01T00:00:00", device_type="tv")
    later = event("2", event_type="pause", event_time="2024-01-05T00:00:00")
    for days, device in ((1, None), (4, "tv")):
        path = str(tmp_path / str(days))
        mode = RefreshMode(days, "batch", False, "shared")
        refresh_table(silver(spark, [first]), path, mode)
        refresh_table(silver(spark, [later]), path, mode)
        state = folded_rows(stored(spark, path))["2"]
        assert state[1][0] == device


def test_empty_batch_is_skipped(spark, tmp_path):
    path = tmp_path / "acc"
    refresh_table(silver(spark, []), str(path))
    assert not path.exists()


def test_lookback_reads_only_touched_partitions(spark, tmp_path):
    from watchlake.operators.dedup import latest_events
    from watchlake.plans.incremental import stored_lookback

    path = str(tmp_path / "acc")
    rows = [event(str(d), f"s{d}", event_time=f"2024-01-{d:02}T00:00:00") for d in range(1, 15)]
    refresh_table(silver(spark, rows), path)
    batch = latest_events(silver(spark, [event("x", "s3", event_time="2024-01-04T00:00:00")]))
    found = stored_lookback(stored(spark, path), batch, EXACT)
    assert [str(d) for d in found.dates] == ["2024-01-03"]
    assert rows_of(found.rows, "event_id") == [("3",)]
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan and "19725" not in plan.split("PartitionFilters")[0]
