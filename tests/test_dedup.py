from datetime import timedelta

from pyspark.sql import functions as F

from helpers import INGESTED, event, silver
from watchlake.operators.dedup import latest_events


def winner(spark, *rows):
    (row,) = latest_events(silver(spark, rows)).collect()
    return row


def test_each_sort_key_decides_in_turn(spark):
    base = event("e", playback_position=1)
    assert winner(spark, base, base | {"event_time": "2024-01-10T10:00:01", "playback_position": 2}).playback_position == 2
    assert winner(spark, base, base | {"event_version": 2, "playback_position": 3}).playback_position == 3
    assert winner(spark, base, base | {"event_header_reemission": 1, "playback_position": 4}).playback_position == 4
    later = base | {"ingest_ts": INGESTED + timedelta(seconds=1), "playback_position": 5}
    assert winner(spark, later, base).playback_position == 5


def test_version_outranks_reemission(spark):
    assert winner(
        spark, event("e", event_header_reemission=9), event("e", event_version=2)
    ).event_version == 2


def test_null_keys_lose(spark):
    assert winner(spark, event("e", event_time=None, event_version=9), event("e")).event_version == 1


def test_identical_copies_leave_one(spark):
    assert winner(spark, *[event("e")] * 5).event_id == "e"


def test_ties_do_not_depend_on_input_order(spark):
    rows = [event("e", raw_value=str(i)) for i in range(20)]
    first = winner(spark, *rows).raw_value
    assert winner(spark, *reversed(rows)).raw_value == first
    assert winner(spark, *rows[10:], *rows[:10]).raw_value == first


def test_event_date_comes_from_text_and_bad_text_gives_none(spark):
    assert str(winner(spark, event("e", event_time="2024-02-29T23:59:59.5")).event_date) == "2024-02-29"
    assert winner(spark, event("e", event_time="yesterday")).event_date is None


def test_copies_are_thinned_before_the_shuffle(spark):
    """An id with a third of all rows reaches the shuffle as one row per map task."""
    copies = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.lit("2024-01-10T10:00:00").alias("event_time"),
        F.col("id").cast("int").alias("event_version"),
        F.lit(0).alias("event_header_reemission"),
        F.lit(INGESTED).alias("ingest_ts"),
    )
    latest = latest_events(copies)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("Final"), plan.index("Partial")
    assert final < plan.index("Exchange hashpartitioning(event_id") < partial
    assert latest.where("event_id = 'hot'").first().event_version == 29_997
    assert latest.count() == 20_001
