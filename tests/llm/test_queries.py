"""The registered queries run over the smallest tables and answer for every row they should."""

import os

import pytest

import __spark_entry__ as contract
from watchlake.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1": ["query_id", "rank", "vec_id", "score"],
    "op2": ["page_id", "host", "path", "rule", "verdict"],
    "op3": ["doc_id", "held_out", "lang_pred", "score"],
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "item_id"],
    "op6": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op9": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, FOLDER)
    operator = name.split("_")[0]
    assert [c for c in result.columns if c in COLUMNS[operator]] == COLUMNS[operator]
    rows = result.count()
    if operator in ("op3", "op4", "op7", "op8", "op9", "op10", "op11"):
        assert rows == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if operator in ("op2", "op13"):
        assert rows == spark.read.parquet(f"{FOLDER}/pages.parquet").count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    database = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = database.sql(ORACLES[name])
    result = QUERIES[name](spark, FOLDER).select(*answer.columns)
    assert sorted(map(tuple, result.collect()), key=str) == sorted(answer.fetchall(), key=str)
