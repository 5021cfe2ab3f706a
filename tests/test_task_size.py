"""What a task takes in stays bounded while tables grow."""

import pytest
from pyspark.sql import functions as F

from watchlake import session
from watchlake.plans import catalog

_KEYS = list(session.TASK_SETTINGS)


def test_events_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path):
    rows = 12 * catalog._TASK_EVENTS + 1
    spark.range(0, rows, 1, 1).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    events = catalog._events(spark, str(tmp_path))
    assert events.rdd.getNumPartitions() == 13
    assert events.select(F.count("event_id"), F.sum("event_id")).first() == (rows, rows * (rows - 1) // 2)


def _exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange" in line]


@pytest.mark.parametrize("plain, exchanges", [(200, 1), (5, 2)])
def test_dealing_a_large_row_group_sorts_nothing_and_loses_nothing(spark, tmp_path, monkeypatch, plain, exchanges):
    monkeypatch.setattr(catalog, "_TASK_EVENTS", 1000)
    monkeypatch.setattr(catalog, "_PLAIN_PARTS", plain)
    kept = F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("event_id")
    spark.range(0, 20_000, 1, 1).select(kept).write.parquet(f"{tmp_path}/events.parquet")
    events = catalog._events(spark, str(tmp_path))
    found = _exchanges(events)
    # Dealing in turn sorts a task's whole input, without a step of its own in the plan.
    assert len(found) == exchanges and all("hashpartitioning" in line for line in found)
    sizes = events.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 20 and sum(sizes) == 20_000 and max(sizes) < 1300
    assert sorted(events.groupBy("event_id").count().collect(), key=str) == sorted(
        spark.read.parquet(f"{tmp_path}/events.parquet").groupBy("event_id").count().collect(), key=str
    )


def test_jobs_of_a_query_are_bounded_in_a_session_of_larger_tasks(spark):
    before = {key: spark.conf.get(key) for key in _KEYS}
    try:
        spark.conf.set(_KEYS[0], "128MB")
        spark.conf.set(_KEYS[1], "1m")
        seen = session.in_bounded_tasks(lambda spark: [spark.conf.get(key) for key in _KEYS])(spark)
        assert seen == [f"{session.TASK_BYTES}b", "1m"]
        assert [spark.conf.get(key) for key in _KEYS] == ["128MB", "1m"]
        with pytest.raises(KeyError), session.bounded_tasks(spark):
            raise KeyError
        assert [spark.conf.get(key) for key in _KEYS] == ["128MB", "1m"]
    finally:
        for key, own in before.items():
            spark.conf.set(key, own)


def test_shuffles_of_a_query_grow_with_the_events(spark, tmp_path, monkeypatch):
    spark.range(0, 1001, 1, 1).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    key, initial = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key)
    seen = catalog._in_bounded_tasks(lambda spark, folder: (spark.conf.get(key), spark.conf.get(initial, None)))
    assert seen(spark, str(tmp_path)) == (before, None)
    monkeypatch.setattr(catalog, "_TASK_EVENTS", 10)
    assert seen(spark, str(tmp_path)) == ("101", None)
    try:
        spark.conf.set(initial, "7")
        assert seen(spark, str(tmp_path)) == ("101", "101")
        spark.conf.set(key, "500")
        assert seen(spark, str(tmp_path)) == ("500", "101")
        assert (spark.conf.get(key), spark.conf.get(initial)) == ("500", "7")
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(initial)


@pytest.mark.parametrize("text, size", [("134217728b", 128 << 20), ("64MB", 64 << 20), ("16m", 16 << 20), ("7", 7), ("1 gib", 1 << 30)])
def test_sizes_are_read(text, size):
    assert session._size(text) == size
