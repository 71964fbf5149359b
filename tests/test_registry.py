"""A few registered queries next to their SQL; ``check.py`` runs all of them."""

from __future__ import annotations

import sys

import duckdb
import pytest

import check
import registry
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    ["clean_documents", "template_flatten", "flat_template", "doc_flatten", "validate_orders",
     "dedup_concat", "override_errors", "reverse_map", "diff_orders", "reconcile_flow",
     "merge_update", "contract_text", "read_templates", "template_faults", "sound_neighbours", "validate_grid",
     "validate_locked", "mixed_csv", "reconcile_problems", "raising_rule"],
)
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)


def test_every_query_has_its_sql():
    # Those of the training-data operators are tested beside them.
    registry.load_all()
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(queries()) and set(registry.ORACLES) <= set(oracle_sql())


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    # None in the table of modules is what an import finds when a folder is gone.
    monkeypatch.setitem(sys.modules, "fieldloom.llm.queries", None)
    assert set(queries()) == set(registry.QUERIES) and set(oracle_sql()) == set(registry.ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["record_key", "field", "kind", "message"]
