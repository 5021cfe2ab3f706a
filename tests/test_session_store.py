import random

import pytest
from pyspark.sql import functions as F

from helpers import event, rows_of, silver
from test_incremental import VIEW, messy_rows
from watchlake.operators.snapshot import session_snapshot
from watchlake.plans import medallion, session_store
from watchlake.plans.session_store import SessionStore, store_writer
from watchlake.sinks import versions

ALSO = [*VIEW, "control_event_count"]


def recomputed(spark, rows):
    return medallion.accumulated(silver(spark, rows), history="count", null_sessions="own")


@pytest.mark.parametrize("seed, hot_rows", [(1, None), (2, 25)])
def test_any_cut_order_and_redelivery_give_a_full_recompute(spark, tmp_path, monkeypatch, seed, hot_rows):
    monkeypatch.setattr(session_store, "MAX_DELTAS", 2)
    rows = messy_rows(110, seed)
    rng = random.Random(seed)
    shuffled = rng.sample(rows, len(rows))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
    store = SessionStore(spark, str(tmp_path / "store"), buckets=3, index_parts=2)
    for batch in [*batches, batches[1]]:
        store.refresh(silver(spark, batch), hot_rows=hot_rows)
    expected = recomputed(spark, rows)
    assert rows_of(store.read(), *ALSO) == rows_of(expected, *ALSO)
    assert rows_of(store.snapshot()) == rows_of(session_snapshot(expected))
    assert all(len(p["tokens"]) <= 3 for p in store.manifest().parts["index"].values())


def daily(n):
    return [event(f"e{d:02}", "s1", ["play", "pause", "resume"][d % 3], f"2024-01-{d:02}T10:00:00", device_type="tv" if d == 1 else None) for d in range(1, n + 1)]


def test_rows_before_the_first_change_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    store = SessionStore(spark, str(tmp_path / "store"), buckets=1)
    store.refresh(silver(spark, daily(20)))
    before = store.manifest().parts["events"]
    read = []
    plain = versions.read_parts

    def spy(spark, path, manifest, table, schema, partitions):
        partitions = list(partitions)
        if table == "events" and manifest.version:
            read.extend(partitions)
        return plain(spark, path, manifest, table, schema, partitions)

    monkeypatch.setattr(versions, "read_parts", spy)
    late = event("new", "s1", "pause", "2024-01-18T11:00:00")
    store.refresh(silver(spark, [late]))
    assert {p.split("/")[0] for p in read} == {f"event_date=2024-01-{d}" for d in (18, 19, 20)}
    after = store.manifest().parts["events"]
    assert sum(after[p] != before[p] for p in before) == 3
    monkeypatch.undo()
    # The state carried in comes from a tail: the only device is that of the first day.
    expected = recomputed(spark, [*daily(20), late])
    assert rows_of(store.read(), *ALSO) == rows_of(expected, *ALSO)
    assert {r.current_device_type for r in store.read().collect()} == {"tv"}


def test_every_scan_names_its_folders(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"), buckets=2, index_parts=4)
    store.refresh(silver(spark, [event(str(d), f"s{d}", event_time=f"2024-01-{d:02}T00:00:00") for d in range(1, 15)]))
    manifest = store.manifest()
    part = next(p for p in manifest.parts["events"] if "2024-01-03" in p)
    scan = store._read(manifest, "events", [part])
    assert scan.inputFiles() and all(part in name for name in scan.inputFiles())
    index = next(iter(manifest.parts["index"]))
    assert all(index in name for name in store._read(manifest, "index", [index]).inputFiles())


def test_a_batch_number_counts_once(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    write = store_writer(store, "q")
    rows = daily(5)
    write(silver(spark, rows[:3]), 0)
    write(silver(spark, rows[3:]), 1)
    version, before = store.manifest().version, rows_of(store.read(), *ALSO)

    class Unread:
        """A redelivered batch that fails when anything of it is looked at."""

        def __getattr__(self, name):
            raise AssertionError(name)

    for batch_id in (0, 1):
        write(Unread(), batch_id)
    assert store.manifest().version == version and rows_of(store.read(), *ALSO) == before
    # A batch without a change only leaves its number.
    write(silver(spark, rows), 2)
    assert store.manifest().batches == {"q": 2} and store.manifest().parts == store.manifest(version).parts


@pytest.mark.parametrize("fails", ["_append_index", "commit"])
def test_readers_see_a_whole_version_while_a_writer_fails(spark, tmp_path, monkeypatch, fails):
    store = SessionStore(spark, str(tmp_path / "store"))
    store.refresh(silver(spark, daily(4)))
    before, open_reader = rows_of(store.read(), *ALSO), store.read()

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(versions if fails == "commit" else SessionStore, fails, lost)
        with pytest.raises(RuntimeError):
            store.refresh(silver(spark, [event("x", "s1", "pause", "2024-01-02T00:00:00")]))
    assert rows_of(store.read(), *ALSO) == before
    store.refresh(silver(spark, [event("x", "s1", "pause", "2024-01-02T00:00:00")]))
    # A frame made before keeps its version, until old folders are deleted.
    assert rows_of(open_reader, *ALSO) == before and store.read().count() == 5
    assert rows_of(store.read(1), *ALSO) == before
    assert store.vacuum(1) > 0 and store.read().count() == 5


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    store.refresh(silver(spark, daily(1)))
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, store.path, store.manifest())


def test_a_partition_that_is_left_empty_goes(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    store.refresh(silver(spark, [event("1", event_time="2024-01-01T00:00:00"), event("2", event_time="0-bad"), event("3", event_time=None)]))
    moved = [event(i, event_time="2024-02-01T00:00:00", event_version=2) for i in "12"]
    store.refresh(silver(spark, moved))
    assert {p.split("/")[0] for p in store.manifest().parts["events"]} == {"event_date=2024-02-01", "event_date=__HIVE_DEFAULT_PARTITION__"}
    assert rows_of(store.read(), "event_id", "event_version") == [("1", 2), ("2", 2), ("3", 1)]


def test_empty_and_invalid_batches(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"))
    flagged = silver(spark, [event("1")]).withColumn("valid", F.lit(False))
    assert store.refresh(flagged) is None and store.manifest().version == 0
    assert store.read().count() == 0 and store.snapshot().count() == 0
