import pytest
from pyspark.errors import AnalysisException

from helpers import event, rows_of, silver
from watchlake.operators.sizing import broadcast_if_small
from watchlake.session import new_work_folder, shared_folder
from watchlake.sources.broker import stream_from_kafka
from watchlake.sources.tables import read_table, stream_table, table_exists
from watchlake.schemas import SILVER_SCHEMA


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    first, second = new_work_folder(spark, "x"), new_work_folder(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))


def test_kafka_reader_asks_for_the_connector(spark):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        stream_from_kafka(spark, "localhost:9092")


def test_tables_read_back_in_the_written_format(spark, tmp_path):
    rows = silver(spark, [event("1"), event("2")])
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        assert not table_exists(spark, path, fmt=fmt)
        rows.write.format(fmt).save(path)
        assert table_exists(spark, path, fmt=fmt)
        assert rows_of(read_table(spark, path, SILVER_SCHEMA, fmt)) == rows_of(rows)
        assert stream_table(spark, path, SILVER_SCHEMA, fmt).isStreaming


def test_broadcast_only_below_the_limit(spark):
    keys = spark.range(1000).selectExpr("cast(id AS string) AS k")
    data = spark.range(1000).selectExpr("cast(id AS string) AS k")

    def plan(limit):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = data.join(broadcast_if_small(keys, limit), "k", "left_semi")
            return joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert "BroadcastHashJoin" in plan(1 << 20)
    assert "BroadcastHashJoin" not in plan(1 << 10)
