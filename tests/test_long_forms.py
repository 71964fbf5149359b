"""The long forms of answers, next to their SQL, on orders of the test's own."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from __spark_entry__ import oracle_sql, queries
from registry import file_queries
from registry.compare_queries import order_pair_texts

STATES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of every remainder that a fault depends on."""
    path = tmp_path_factory.mktemp("orders")
    day = datetime.datetime(1995, 1, 1)
    rows = [
        (k, 10 + k % 7, STATES[k % 3], 100.0 + k / 4, day + datetime.timedelta(days=k % 400), PRIORITIES[k // 3 % 3])
        for k in range(1, 500)
    ]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.mark.parametrize(
    "name",
    ["db_responses", "pad_grid", "format_by_type", "decode_single", "decode_multi", "checkbox_values", "grid_default",
     "unpack_multi", "format_ui", "unformatted_fields"],
)
def test_long_form(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    got = queries()[name](spark, folder).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert len(got) >= 300
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)


@pytest.mark.parametrize("name", ["flat_result", "db_layout", "read_pairs", "group_sections"])
def test_whole_documents(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    got = queries()[name](spark, folder).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert len(got) == 499
    assert check.rows_of(got) == check.rows_of(want)


def test_db_layout_joins_before_documents_are_made(spark, folder):
    """A join behind the making of documents shuffles their texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()["db_layout"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    shuffles = [n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    made = max(n for n, line in enumerate(lines) if "Clerk notes" in line)
    assert shuffles and min(shuffles) > made


def test_pair_files_are_packed(spark, folder, tmp_path, monkeypatch):
    """The texts of record pairs are much larger than the tables, and lie on disk until they are read."""
    monkeypatch.setattr(file_queries, "shared_folder", lambda spark, name: str(tmp_path / name))
    assert queries()["read_pairs"](spark, folder).count() == 499
    text = order_pair_texts(spark, folder).agg(F.sum(F.octet_length("doc") + 1)).first()[0]
    assert 0 < 2 * sum(f.stat().st_size for f in (tmp_path / "pairs").glob("part-*")) < text
