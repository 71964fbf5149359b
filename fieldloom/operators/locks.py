"""Overrides: other descriptions, and fields locked to a value.

Overrides are rows ``key`` (and ``template_id``, optional) with the JSON text of the override:
an object with ``description``, ``description_op`` and ``value`` or ``const``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import blank
from fieldloom.functions.values import answer_text, items
from fieldloom.operators.documents import LOCK_COLUMNS, RULE_COLUMNS
from fieldloom.operators.enrich import _first_of_key, _join_keys
from fieldloom.operators.validate import (
    Rule,
    item_errors,
    scalar_errors,
    second_phase,
    with_value_parts,
)
from fieldloom.plans.joins import lookup_join

OPERATIONS = ("override", "append", "prepend")
_PLAIN = ("string", "integer", "number", "boolean", "null")


def value_type(value: Column) -> Column:
    """Type keyword of a lock value. Unlike the type rule, 5.0 is a number here."""
    name = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    whole = ~text.contains(".") & text.try_cast("bigint").isNull()
    return (
        F.when(name == "STRING", "string")
        .when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL"), F.when(whole, "integer").otherwise("number"))
        .when(name == "DOUBLE", "number")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
    )


def parse_overrides(rows: DataFrame, override: str = "override") -> DataFrame:
    """Split override texts into columns, with a ``problem`` where one cannot be used."""
    keys = F.json_object_keys(F.col(override))
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    body = F.try_parse_json(F.col(override))
    operation = F.coalesce(
        F.try_variant_get(body, "$.description_op", "string"), F.lit("override")
    )
    lock = F.coalesce(
        F.try_variant_get(body, "$.value", "variant"), F.try_variant_get(body, "$.const", "variant")
    )
    return rows.withColumns(
        {
            "has_description": has("description"),
            "new_description": F.try_variant_get(body, "$.description", "string"),
            "operation": operation,
            "has_lock": has("value") | has("const"),
            "lock": lock,
            "problem": F.when(keys.isNull(), "override is no object")
            .when(~operation.isin(*OPERATIONS), "unknown description_op")
            .when(has("value") & has("const"), "both value and const"),
        }
    )


def override_lint(
    index: DataFrame, overrides: DataFrame, rules: Mapping[str, Rule] | None = None
) -> DataFrame:
    """Overrides that cannot be applied: ``<keys>, problem``.

    Covers malformed overrides, keys no field has, lock values that break the rules of their
    field, and list locks that mix objects with plain values.
    """
    on = _join_keys(index, overrides)
    judged = _with_fault(_located(index, overrides, on, "left"), rules)
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("pos").isNull(), "no such field")
        .when(F.col("has_lock"), F.col("_fault"))
    )
    return judged.select(*on, problem.alias("problem")).filter("problem is not null")


def _with_fault(rows: DataFrame, rules: Mapping[str, Rule] | None) -> DataFrame:
    """Rows of fields with a ``lock``, and ``_fault``: why the field can't be locked to it."""
    lock = F.col("lock")
    # The field's own rules, without a lock.
    rule = F.struct(*(F.lit(None).cast(LOCK_COLUMNS[c]).alias(c) if c in LOCK_COLUMNS else F.col(c) for c in RULE_COLUMNS))
    first_error = F.coalesce(
        *scalar_errors(lock, rule), F.get(item_errors(rule), F.lit(0)),
        second_phase(lock, rule, rules),
    )
    kinds = F.transform(F.col("_items"), value_type)
    mixed = F.exists(kinds, lambda k: ~k.isin(*_PLAIN)) & ~(
        (F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "object")
    )
    fault = F.when(first_error.isNotNull(), first_error).when(
        (value_type(lock) == "array") & mixed, "list lock needs plain values or one object")
    parts = with_value_parts(rows, "lock")
    return parts.withColumn("_fault", F.when(lock.isNotNull(), fault)).drop("_kind", "_number", "_text", "_items")


def _located(index: DataFrame, overrides: DataFrame, on: list[str], how: str) -> DataFrame:
    """Overrides with the first field of their key."""
    first = index.withColumn("_first", _first_of_key(index)).filter("_first").drop("_first")
    return overrides.join(first, on, how)


def override_descriptions(index: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace, extend or clear the descriptions of the fields that overrides name."""
    on = _join_keys(index, overrides)
    usable = overrides.filter("problem is null and has_description").select(
        *on, "operation", "new_description", F.lit(True).alias("_hit")
    )
    old, new = F.col("description"), F.col("new_description")
    changed = (
        F.when(new.isNull(), F.lit(None).cast("string"))
        .when(blank(old) | (F.col("operation") == "override"), new)
        .when(F.col("operation") == "append", F.concat(old, F.lit(" "), new))
        .otherwise(F.concat(new, F.lit(" "), old))
    )
    hit = F.col("_hit").isNotNull() & _first_of_key(index)
    return (
        lookup_join(index, usable, on)
        .withColumn("description", F.when(hit, changed).otherwise(old))
        .select(*index.columns)
    )


def lock_fields(
    index: DataFrame, overrides: DataFrame, rules: Mapping[str, Rule] | None = None
) -> DataFrame:
    """Narrow the rules of locked fields to their value.

    Adds ``lock_type``, ``lock_const`` (JSON text of a plain value), and for lists
    ``lock_size``, ``item_types`` and ``item_enum`` (JSON texts). A value that breaks the rules of its
    field doesn't lock it; :func:`override_lint` lists it. Each field is judged by itself, so an
    override without a template id locks the fields that take it in all templates.
    """
    on = _join_keys(index, overrides)
    usable = overrides.filter("problem is null and has_lock").select(*on, "lock")
    lock = F.col("lock")
    kind = value_type(lock)
    parts = items(lock)
    marked = F.array_distinct(
        F.transform(
            parts,
            lambda i: F.struct(
                value_type(i).alias("t"),
                F.when(value_type(i) == "string", F.to_json(i)).otherwise(
                    F.coalesce(F.when(value_type(i) == "boolean", F.to_json(i)),
                               answer_text(i), F.lit("null"))
                ).alias("j"),
            ),
        )
    )
    plain = F.forall(parts, lambda i: value_type(i).isin(*_PLAIN))
    shown = F.when(kind.isin("string", "boolean"), F.to_json(lock)).otherwise(
        F.coalesce(answer_text(lock), F.lit("null"))
    )
    # One join carries lock and field together, and the lock is judged where they meet. Adaptive
    # execution broadcasts the overrides or splits keys that many templates share.
    met = index.withColumn("_first", _first_of_key(index)).join(usable, on, "left")
    judged = _with_fault(met.withColumn("lock", F.when(F.col("_first"), F.col("lock"))), rules)
    return (
        judged.withColumn("lock", F.when(F.col("_fault").isNull(), lock))
        .withColumns(
            {
                "lock_type": kind,
                "lock_const": F.when(kind.isin(*_PLAIN), shown),
                "lock_size": F.when(kind == "array", F.size(parts)),
                "item_types": F.when(
                    (kind == "array") & plain, F.array_distinct(F.transform(marked, lambda m: m["t"]))
                ),
                "item_enum": F.when(
                    (kind == "array") & plain, F.transform(marked, lambda m: m["j"])
                ),
                "json_types": F.when(kind.isNotNull(), F.array(kind)).otherwise(
                    F.col("json_types")
                ),
            }
        )
        .drop("_first", "_fault")
    )


def lock_children(locked: DataFrame) -> DataFrame:
    """Children of object locks, one row each: the object itself or the one item of a list.

    Columns: ``template_id, key, child, child_type, child_const``; every child is required
    and no other is allowed.
    """
    holder = F.when(F.col("lock_type") == "object", F.col("lock")).when(
        (F.col("lock_type") == "array") & (F.col("lock_size") == 1),
        F.try_variant_get("lock", "$[0]", "variant"),
    )
    entries = F.try_variant_get(holder, "$", "map<string,variant>")
    value = F.col("_v")
    return (
        locked.filter("lock is not null")
        .select("template_id", "key", F.explode_outer(entries).alias("child", "_v"))
        .filter("child is not null")
        .select(
            "template_id", "key", "child", value_type(value).alias("child_type"),
            F.when(
                value_type(value).isin("integer", "number"), answer_text(value)
            ).otherwise(F.to_json(value)).alias("child_const"),
        )
    )
