"""Checking documents against their contracts.

One pass over the aligned rows yields every violation, without a shuffle. The verdict puts the errors
of a document together where its rows lie, one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.dates import is_iso_date, is_iso_datetime
from fieldloom.functions.values import answer_text, is_type, items, number_of, type_from_name
from fieldloom.operators.templates import PATH_SEP

#: A rule of the caller: ``(value, rule) -> Column`` giving an error text, or null when fine.
#: ``value`` is the VARIANT, ``rule`` a struct with the columns of the field index.
Rule = Callable[[Column, Column], Column]

#: Label of the errors of the second phase.
LATE = "custom"


def text_rule(check: Callable[[str], str | None]) -> Rule:
    """A rule from a Python function of one text, run in batches; null when it finds nothing.

    What it raises becomes the error of that value, and the others are checked all the same.
    """
    def safe(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return check(text)
        except Exception as error:  # noqa: BLE001  whatever a caller's function raises
            return f"rule failed: {type(error).__name__}: {error}"

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([safe(t) for t in texts], dtype=object)

    return lambda value, rule: run(F.try_variant_get(value, "$", "string"))


def _date_error(value: Column, rule: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(~is_iso_date(text), F.concat(F.lit("no ISO date: "), text))


def _datetime_error(value: Column, rule: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(~is_iso_datetime(text), F.concat(F.lit("no ISO date and time: "), text))


#: Rules that run only on documents whose structure is sound, by target type.
DEFAULT_RULES: dict[str, Rule] = {"date": _date_error, "datetime": _datetime_error}


def grid_errors(rows: Column, enum: Column, max_items: Column) -> Column:
    """Every error of a grid answer, with the number of the row (from 0): too many rows, rows of
    another shape, parts of another type, unknown entries."""
    def row_errors(item: Column, at: Column) -> Column:
        shape = F.try_variant_get(item, "$", "map<string,variant>")
        entry = F.try_variant_get(item, "$.entry", "variant")
        text = F.try_variant_get(item, "$.description", "variant")
        entry_text = F.when(F.schema_of_variant(entry) == "STRING", F.try_variant_get(entry, "$", "string"))
        extra = F.size(shape) > F.when(entry.isNotNull(), 1).otherwise(0) + F.when(text.isNotNull(), 1).otherwise(0)
        unknown = ~F.array_contains(F.coalesce(enum, _none()), F.coalesce(entry_text, F.lit("")))
        errors = F.array(
            F.when(shape.isNull(), "is no object"),
            F.when(shape.isNotNull() & entry.isNull(), "lacks entry"),
            F.when(shape.isNotNull() & text.isNull(), "lacks description"),
            F.when(extra, "has other keys"),
            F.when(entry.isNotNull() & entry_text.isNull(), "entry is no text"),
            F.when(F.schema_of_variant(text) != "STRING", "description is no text"),
            F.when(entry.isNotNull() & unknown,
                   F.concat(F.lit("entry not among the options: "), F.coalesce(entry_text, F.to_json(entry)))),
        )
        return F.transform(F.array_compact(errors), lambda e: F.concat(F.lit("row "), at.cast("string"), F.lit(" "), e))

    too_many = F.when(
        F.size(rows) > max_items, F.concat(F.lit("more rows than "), max_items.cast("string"))
    )
    return F.concat(F.array_compact(F.array(too_many)), F.flatten(F.transform(rows, row_errors)))


def with_value_parts(rows: DataFrame, value: str = "value") -> DataFrame:
    """Take a VARIANT column apart once: ``_kind, _number, _text, _items`` for the checks below."""
    v = F.col(value)
    name = F.col("_name")
    return (
        rows.withColumn("_name", F.schema_of_variant(v))
        .withColumn("_number", number_of(name, v))
        .withColumns(
            {
                "_kind": type_from_name(name, F.col("_number")),
                "_text": F.when(name == "STRING", F.try_variant_get(v, "$", "string")),
                "_items": F.when(name.startswith("ARRAY"), items(v)),
            }
        )
        .drop("_name")
    )


def scalar_errors(value: Column, rule: Column) -> list[Column]:
    """Errors of type, range, option and constant, for rows from :func:`with_value_parts`."""
    kind, number, text = F.col("_kind"), F.col("_number"), F.col("_text")
    sound = is_type(kind, rule["json_types"])
    type_error = F.when(
        ~sound,
        F.concat(F.lit("type: "), kind, F.lit(" is not "), F.array_join(rule["json_types"], "/")),
    )
    shown = F.coalesce(text, F.to_json(value), F.lit("null"))
    numeric = kind.isin("integer", "number") & sound
    low = F.when(numeric & (number < rule["minimum"]), F.concat(F.lit("minimum: "), shown))
    high = F.when(numeric & (number > rule["maximum"]), F.concat(F.lit("maximum: "), shown))
    member = F.when(
        (rule["enum_on"] == "value") & (kind != "null")
        & ~F.array_contains(rule["enum"], F.coalesce(text, F.lit(""))),
        F.concat(F.lit("enum: "), shown),
    )
    const = F.when(
        rule["const"].isNotNull() & ~F.coalesce(text == rule["const"], F.lit(False)),
        F.concat(F.lit("const: "), shown),
    )
    return [type_error, low, high, member, const, _lock_error(value, rule, shown), *_own_errors(rule, sound, shown)]


def _own_errors(rule: Column, sound: Column, shown: Column) -> list[Column]:
    """Errors of the constraints of a caller's own fragment, for values of a sound type."""
    of_own = lambda name, kind: F.get_json_object(rule["own"], f"$.{name}").try_cast(kind)
    number, text, parts = F.col("_number"), F.col("_text"), F.col("_items")
    step = of_own("multipleOf", "double")
    times = number / F.nullif(step, F.lit(0.0))
    broken = {
        "exclusiveMinimum": number <= of_own("exclusiveMinimum", "double"),
        "exclusiveMaximum": number >= of_own("exclusiveMaximum", "double"),
        "multipleOf": times != F.rint(times),
        "minLength": F.length(text) < of_own("minLength", "int"),
        "maxLength": F.length(text) > of_own("maxLength", "int"),
        "pattern": ~F.regexp_like(text, of_own("pattern", "string")),
        "minItems": F.size(parts) < of_own("minItems", "int"),
        "maxItems": F.when(~rule["enum_on"].eqNullSafe("entry"), F.size(parts) > of_own("maxItems", "int")),
    }
    own = rule["own"].isNotNull() & sound
    return [F.when(own & wrong, F.concat(F.lit(f"{name}: "), shown)) for name, wrong in broken.items()]


def _lock_error(value: Column, rule: Column, shown: Column) -> Column:
    """A value that is not what its field is locked to.

    Plain values and objects, with all that is in them, must be equal; numbers count by value. A list
    must have the lock's size and hold only items of it, in any order and number; a list whose lock
    holds lists or objects must be equal.
    """
    text = F.to_json(value)
    item_json = lambda i: F.when(F.schema_of_variant(i) == "STRING", F.to_json(i)).otherwise(
        F.coalesce(F.when(F.schema_of_variant(i) == "BOOLEAN", F.to_json(i)), answer_text(i), F.lit("null")))
    listed = F.coalesce(
        (F.size("_items") == rule["lock_size"])
        & F.forall("_items", lambda i: F.array_contains(rule["item_enum"], item_json(i))), F.lit(False))
    same = F.when((rule["lock_type"] == "array") & rule["item_enum"].isNotNull(), listed).otherwise(
        F.coalesce(text == rule["lock_json"], F.lit(False)))
    return F.when(rule["lock_json"].isNotNull() & ~same,
                  F.concat(F.lit("lock: "), shown, F.lit(" is not "), rule["lock_json"]))


def item_errors(rule: Column) -> Column:
    """Errors of list items and grid rows, for rows from :func:`with_value_parts`."""
    parts, enum = F.col("_items"), rule["enum"]
    def wrong(item: Column, at: Column) -> Column:
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        unknown = enum.isNotNull() & ~F.array_contains(enum, F.coalesce(text, F.lit("")))
        shown = F.coalesce(text, F.to_json(item))
        place = F.concat(F.lit("item: "), at.cast("string"), F.lit(" "))
        return F.array(
            F.when(~F.is_variant_null(item) & text.isNull(), F.concat(place, F.lit("is no text: "), shown)),
            F.when(~F.is_variant_null(item) & unknown, F.concat(place, F.lit("is no option: "), shown)),
        )

    wrong_items = F.array_compact(F.flatten(F.transform(parts, wrong)))
    wrong_rows = F.transform(
        grid_errors(parts, enum, rule["max_items"]), lambda e: F.concat(F.lit("grid: "), e)
    )
    return F.when(parts.isNotNull() & (rule["enum_on"] == "items"), wrong_items).when(
        parts.isNotNull() & (rule["enum_on"] == "entry"), wrong_rows
    )


def structure_error(state: Column, value: Column) -> Column:
    """Error of the shape of a document at one path, null when there is none."""
    return (
        F.when(state == "missing", "required: is missing")
        .when(state == "unexpected", "additional: was unexpected")
        .when(state == "closed", "type: container is no object")
        .when(
            state == "misnamed",
            F.concat(F.lit("const: "), F.coalesce(answer_text(value), F.lit("null"))),
        )
        .when(state == "unreadable", "document: no JSON object")
        .when(state == "unknown template", "template: unknown")
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def second_phase(
    value: Column, rule: Column, rules: Mapping[str, Rule] | None = None
) -> Column:
    """Error of dates and of the rules of the caller, for a value that is there."""
    error = F.lit(None).cast("string")
    for target, check in {**DEFAULT_RULES, **(rules or {})}.items():
        error = F.when(rule["target_type"] == target, check(value, rule)).otherwise(error)
    filled = value.isNotNull() & ~F.is_variant_null(value)
    return F.when(filled, F.concat(F.lit(f"{LATE}: "), error))


def _shown(path: Column) -> Column:
    return F.replace(path, F.lit(PATH_SEP), F.lit("."))


def validate(aligned: DataFrame, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """All violations, from the long form: ``doc_id, template_id, phase, path, rule, message``.

    Phase 1 covers structure, types, options, ranges and constants, phase 2 dates and the
    rules of the caller (by target type, replacing the built-in ones). Extra columns that
    ``align_documents`` kept are passed on. Nothing is shuffled.
    """
    inner = ("rule", "value", "path", "state", "is_first")
    kept = [c for c in aligned.columns if c not in inner]
    return _violations(aligned, kept, rules, F.lit(False)).filter("phase is not null")


def _violations(
    aligned: DataFrame, kept: list[str], rules: Mapping[str, Rule] | None, marker: Column
) -> DataFrame:
    """Violations, and a row without a phase where ``marker`` holds and nothing is wrong."""
    value, rule = F.col("value"), F.col("rule")
    known = F.col("state") == "match"
    # The step behind the explode is one method of compiled code; beyond 8,000 bytes the JVM would
    # interpret it, so what can wait (the error of the shape) is computed later.
    parts = with_value_parts(
        aligned.select(
            *kept, "path", "rule", marker.alias("_marker"),
            F.col("state").alias("_state"), F.when(F.col("state") == "misnamed", value).alias("_given"),
            F.when(known, value).alias("value"), known.alias("_known"),
        )
    )
    known = F.col("_known")
    # Nulls stay in the array and go after the explode: functions that drop them are lambdas
    # inside, and what stands inside a lambda is not compiled.
    everything = F.concat(
        F.array(
            F.when(F.col("_marker"), F.lit("")),
            structure_error(F.col("_state"), F.col("_given")),
            *(F.when(known, e) for e in scalar_errors(value, rule)),
            F.when(known, second_phase(value, rule, rules)),
        ),
        F.coalesce(item_errors(rule), _none()),
    )
    label = F.substring_index("_e", ":", 1)
    # Computed in a step of its own: as the input of the explode it would not be compiled, and
    # a filter in front of the explode would evaluate all rules again.
    return (
        parts.select(*kept, "path", everything.alias("_errors"))
        .select(*kept, "path", F.explode_outer("_errors").alias("_e"))
        .filter("_e is not null")
        .select(
            *kept,
            F.when(label == LATE, 2).when(F.col("_e") != "", 1).alias("phase"),
            _shown(F.col("path")).alias("path"), label.alias("rule"),
            F.expr("substring(_e, instr(_e, ': ') + 2)").alias("message"),
        )
    )


def verdicts(aligned: DataFrame, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """One row per document: ``doc_id, template_id, is_valid, error_count, errors``.

    Phase 2 counts only for documents without an error in phase 1. Takes the long form as
    ``align_documents`` gives it, with the rows of a document one after another and the first one
    marked. Nothing is shuffled: the errors of a document are put together where they are found, so
    documents that repeat an id, or have none, each get a verdict of their own.
    """
    # Each document passes on one row even when nothing is wrong with it: where the next one begins.
    errors = _violations(aligned, ["doc_id", "template_id"], rules, F.col("is_first"))
    line = F.concat_ws(": ", F.nullif("path", F.lit("")), "rule", "message")
    rows = errors.select("doc_id", "template_id", "phase", line.alias("line"))
    kinds = T.StructType([
        *rows.schema.fields[:2], T.StructField("is_valid", T.BooleanType()), T.StructField("error_count", T.LongType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ])
    return rows.mapInArrow(_put_together, kinds)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One verdict for each run of rows that starts with a row without a phase."""
    names = ["doc_id", "template_id", "is_valid", "error_count", "errors"]
    ids: tuple | None = None
    found: dict[int, list[str]] = {1: [], 2: []}
    kinds: list[pa.DataType] = []

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def verdict() -> tuple:
        errors = sorted(found[1] or found[2])
        return (*ids, not errors, len(errors), errors)

    for batch in batches:
        kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.bool_(), pa.int64(), pa.list_(pa.string())]
        done = []
        for doc, template, phase, text in zip(*(c.to_pylist() for c in batch.columns)):
            if phase is None or ids != (doc, template):
                if ids is not None:
                    done.append(verdict())
                ids, found = (doc, template), {1: [], 2: []}
            if phase is not None:
                found[phase].append(text)
        yield shown(done)
    if ids is not None:
        yield shown([verdict()])
