"""Counters counted once a batch, and lag sketches that add up over batches."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import INGESTED
from watchlake.operators import lag_sketch, quality
from watchlake.sinks.ledger import CounterLedger, counted

COUNTS = {"rows": "count(1)", "even": "count_if(id % 2 = 0)"}


def counters():
    return {name: F.expr(text) for name, text in COUNTS.items()}


def totals(ledger):
    return {r.outcome: r.n for r in ledger.totals().collect()}


def test_a_batch_counts_once(spark, tmp_path):
    ledger = CounterLedger(spark, str(tmp_path / "ledger"), "q")
    assert totals(ledger) == {}
    write = counted(ledger, counters(), lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / f"t/b={n}")))
    for number, size in [(0, 10), (0, 10), (1, 5), (2, 0), (1, 5)]:
        write(spark.range(size), number)
    assert totals(ledger) == {"rows": 15, "even": 8}
    assert totals(CounterLedger(spark, str(tmp_path / "ledger"), "other")) == {}


def test_a_failing_write_is_not_counted(spark, tmp_path):
    ledger = CounterLedger(spark, str(tmp_path / "ledger"), "q")

    def fail(rows, number):
        raise OSError("disk full")

    with pytest.raises(OSError):
        counted(ledger, counters(), fail)(spark.range(3), 0)
    assert totals(ledger) == {}
    counted(ledger, counters(), lambda rows, n: rows.write.format("noop").mode("overwrite").save())(spark.range(3), 0)
    assert totals(ledger) == {"rows": 3, "even": 2}


def landed(spark, lags):
    rows = [(INGESTED, None if lag is None else INGESTED + timedelta(microseconds=lag), i) for i, lag in enumerate(lags)]
    return spark.createDataFrame(rows, "kafka_timestamp timestamp, ingest_ts timestamp, i long")


def test_any_range_of_batches_is_within_the_sketch_of_the_exact(spark, tmp_path):
    chance = random.Random(5)
    lags = [int(chance.lognormvariate(12, 3)) for _ in range(3000)] + [0] * 500 + [-chance.randrange(10**7) for _ in range(300)] + [None] * 20
    chance.shuffle(lags)
    rows = landed(spark, lags).cache()
    history = lag_sketch.LagHistory(spark, str(tmp_path / "lags"))
    for number in [*range(10), 4]:
        history.record(rows.where(F.col("i") % 10 == number), number)
    for first, last in [(0, 9), (3, 3), (2, 6)]:
        own = rows.where((F.col("i") % 10).between(first, last))
        sketch = history.between(first, last)
        exact = {r.le: r.n for r in quality.ingest_lag(own).collect()}
        assert {r.le: r.n for r in lag_sketch.sketch_histogram(sketch).collect()} == exact
        known = sorted(lag for i, lag in enumerate(lags) if lag is not None and first <= i % 10 <= last)
        for r in lag_sketch.sketch_percentiles(sketch, (0.0, 0.05, 0.5, 0.95, 1.0)).collect():
            wanted = known[max(-(-int(r.share * 100) * len(known) // 100), 1) - 1] / 1e6
            assert abs(wanted) * (127 / 128) <= abs(r.lag_sec) <= abs(wanted), r


def test_no_lags_and_huge_lags(spark):
    empty = lag_sketch.lag_sketch(landed(spark, [None, None]))
    assert empty.count() == 0 and lag_sketch.sketch_percentiles(empty).count() == 0
    assert {r.n for r in lag_sketch.sketch_histogram(empty).collect()} == {0}
    numbers = [0, 1, -1, 255, 256, 257, 2**62, 2**63 - 1, -(2**63 - 1)]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", lag_sketch.bucket_of(F.col("n")).alias("b"))
    for n, b in frame.collect():
        size = max(len(bin(abs(n))) - 2 - 8, 0)
        assert b == (abs(n) >> size << size) * (1 if n >= 0 else -1)
