"""The flow from record pairs to differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import record_key
from fieldloom.operators.compare import (
    compare_pairs,
    latest_records,
    record_fields,
    state_filter,
)
from fieldloom.operators.db_layout import db_records
from fieldloom.operators.documents import line_up
from fieldloom.plans.layout import TemplateLayout


def keyed_pairs(pairs: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Pairs in the wanted states with their record key, one per key."""
    keyed = state_filter(pairs, states).withColumn(
        "record_key", record_key(F.col("facility_id"), F.col("patient_id"), F.col("record_id"))
    )
    return latest_records(keyed)


def reconcile(
    pairs: DataFrame,
    contracts: DataFrame,
    layout: TemplateLayout,
    states: Sequence[str] | None = None,
) -> DataFrame:
    """Differences between filled documents and stored records, one row per field.

    Both sides of a pair come in one row and stay there: the document is brought into the
    layout of the record, both are flattened, and the fields are matched within the row. A document
    with an unknown template, or one that cannot be read, is a row of kind ``problem``.
    """
    docs = keyed_pairs(pairs, states).select(
        F.col("record_key").alias("doc_id"),
        F.col("template_id").try_cast("bigint").alias("template_id"),
        F.col("internal").alias("doc"),
        "stored",
    )
    lined = line_up(docs, contracts, layout, keep=("stored",))
    both = db_records(lined, keep=("stored",)).select(
        F.col("doc_id").alias("record_key"), "trouble",
        record_fields(F.struct("sections"), typed_text=True).alias("_left"),
        record_fields(F.col("stored")).alias("_right"),
    )
    return compare_pairs(both, "_left", "_right", ["record_key"], problem="trouble")
