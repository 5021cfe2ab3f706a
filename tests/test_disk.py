"""What a query leaves on disk: nothing that no later step reads, and that densely."""

import os
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from helpers import event, rows_of, silver
from pyspark.sql import functions as F

from watchlake import session
from watchlake.plans import catalog
from watchlake.plans.incremental import EXACT, PARITY, refresh_table
from watchlake.schemas import accumulated_schema
from watchlake.sinks import upsert
from watchlake.sources.tables import read_table


def _local_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def _shared(spark, name="*"):
    return set(Path(session.shared_folder(spark).removeprefix("file:")).glob(name))


def _codecs(folder):
    files = [pq.ParquetFile(f).metadata for f in Path(folder).rglob("*.parquet")]
    assert files
    return {m.row_group(g).column(0).compression for m in files for g in range(m.num_row_groups)}


def _events(spark, folder, rows=400):
    spark.range(0, rows, 1, 4).selectExpr(
        "id AS event_id",
        "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id * 6000) AS ts",
        "id % 7 AS user_id",
        "element_at(array('view', 'click', 'signup', 'purchase', 'error'), cast(id % 5 AS int) + 1) AS event_type",
        "cast(id AS double) AS value",
        "concat('{\"k\": ', id * 13 % 100, '}') AS props",
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_shuffle_files_go_with_their_job(spark):
    rows = spark.range(0, 1000, 1, 4)

    def shuffled(spark):
        frame = rows.repartition(37, "id").groupBy((F.col("id") % 5).alias("k")).count()
        return sorted(frame.collect()), sorted(frame.collect())

    before = _local_files(spark)
    # Run anew, the same frame makes its files again.
    once, again = session.in_bounded_tasks(shuffled)(spark)
    assert once == again == [(k, 200) for k in range(5)]
    until = time.time() + 20
    while (left := _local_files(spark)) > before and time.time() < until:
        time.sleep(0.2)
    assert left <= before


def test_settings_of_the_session_come_back(spark):
    before = {key: spark.conf.get(key) for key in session.DISK_SETTINGS}
    with pytest.raises(KeyError), session.little_on_disk(spark):
        assert {key: spark.conf.get(key) for key in before} == session.DISK_SETTINGS
        raise KeyError
    assert {key: spark.conf.get(key) for key in before} == before


def test_held_rows_are_computed_once_and_go_at_the_end(spark):
    seen, before = spark.sparkContext.accumulator(0), _shared(spark, "held-*")
    counted = spark.range(0, 50, 1, 2).rdd.map(lambda r: (seen.add(1), (r.id, None))[1]).toDF("id long, gap string")
    with session.rows_held(spark) as hold:
        rows = hold(counted)
        assert rows.columns == ["id", "gap"] and hold(rows.where("false")).count() == 0
        assert rows.count() == 50 == rows.where("gap IS NULL").count() and seen.value == 50
        assert len(_shared(spark, "held-*") - before) == 1
    assert _shared(spark, "held-*") == before
    with pytest.raises(KeyError), session.rows_held(spark) as hold:
        hold(rows.sparkSession.range(3))
        raise KeyError
    assert _shared(spark, "held-*") == before


@pytest.mark.parametrize("mode", [EXACT, PARITY])
def test_refresh_holds_no_rows_once_the_table_has_them(spark, tmp_path, mode):
    path, before = str(tmp_path / "table"), _shared(spark, "held-*")
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size()
    for batch in ([event("a"), event("b", "s2", event_time=None)], [event("c", event_type="pause"), event("b", event_version=2)]):
        refresh_table(silver(spark, batch), path, mode)
        assert not os.path.exists(f"{path}__staged") and _shared(spark, "held-*") == before
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == persisted
    assert _codecs(path) == {"ZSTD"}
    assert rows_of(read_table(spark, path, accumulated_schema()), "event_id", "session_id") == [("a", "s1"), ("b", "s1"), ("c", "s1")]


def test_a_staged_copy_stays_until_the_table_is_marked(spark, tmp_path, monkeypatch):
    path, mark = str(tmp_path / "table"), upsert._write_mark
    refresh_table(silver(spark, [event("a")]), path)

    def crash(spark, at, *rest):
        if at.endswith("__applied_mark"):
            raise OSError("lost")
        mark(spark, at, *rest)

    monkeypatch.setattr(upsert, "_write_mark", crash)
    with pytest.raises(OSError):
        refresh_table(silver(spark, [event("b")]), path)
    assert os.path.exists(f"{path}__staged")
    monkeypatch.setattr(upsert, "_write_mark", mark)
    assert upsert.finish_pending(spark, path, accumulated_schema())
    assert not os.path.exists(f"{path}__staged") and not upsert.finish_pending(spark, path, accumulated_schema())
    assert rows_of(read_table(spark, path, accumulated_schema()), "event_id") == [("a",), ("b",)]


@pytest.mark.parametrize("query, tables", [
    ("accumulated_stream", {"silver", "accumulated"}),
    ("pipeline_stream", {"broker", "bronze", "silver", "accumulated"}),
])
def test_streams_leave_their_tables_only(spark, tmp_path, query, tables):
    folder, before = _events(spark, tmp_path), _shared(spark)
    rows = catalog.QUERIES[query](spark, folder).collect()
    (work,) = [p for p in _shared(spark) - before if p.name.startswith(query.split("_")[0])]
    left = {p.name for p in work.iterdir()}
    assert {n for n in left if not n.startswith(("checkpoint", "accumulated__"))} == tables
    assert "accumulated__staged" not in left and not [p for p in _shared(spark) - before if p.name.startswith("held")]
    for table in tables:
        assert _codecs(work / table) == {"ZSTD"}
    assert len({r.event_id for r in rows}) == len(rows) > 300


def test_the_spool_is_compressed_and_sent_whole(spark, tmp_path):
    folder, before = _events(spark, tmp_path), _shared(spark)
    sent = catalog.replay_resend(spark, folder)
    (work,) = [p for p in _shared(spark) - before if p.name.startswith("resend")]
    spool = [p for p in (work / "spool").iterdir() if p.name.startswith("part-")]
    assert spool and {p.suffix for p in spool} == {".gz"}
    assert spark.read.text(str(work / "spool")).count() == sent.count() == catalog._bronze(spark, folder).count()
