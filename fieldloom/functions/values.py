"""Answers of unknown type: one VARIANT value per field.

Type questions are answered from ``schema_of_variant``. Casts are not used for them because
they coerce (``"7"`` would pass for a number, ``true`` for 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON renderings that count as false.
FALSY_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")


def type_from_name(name: Column, number: Column) -> Column:
    """JSON type from the name ``schema_of_variant`` gives and the value as a double."""
    return (
        F.when(name == "STRING", "string")
        .when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL"), F.when(name.endswith(",0)"), "integer").otherwise("number"))
        .when(name == "DOUBLE", F.when(number == F.rint(number), "integer").otherwise("number"))
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .when(name.isNotNull(), "string")
    )


def number_of(name: Column, value: Column) -> Column:
    """The value as a double if it is a number. Casting texts would raise and catch every time."""
    numeric = name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def json_type(value: Column) -> Column:
    """JSON type of a VARIANT; a number without fraction is ``integer``, null for no value."""
    name = F.schema_of_variant(value)
    return type_from_name(name, number_of(name, value))


def is_type(actual: Column, allowed: Column) -> Column:
    """Is the JSON type among the allowed ones? Every integer is also a number."""
    return F.array_contains(allowed, actual) | (
        (actual == "integer") & F.array_contains(allowed, F.lit("number"))
    )


def is_truthy(value: Column) -> Column:
    return value.isNotNull() & ~F.to_json(value).isin(*FALSY_JSON)


def _float_text(number: Column) -> Column:
    """Shortest decimal form of a double: plain between 1e-4 and 1e16, else with exponent."""
    raw = number.cast("string")
    size = F.abs(number)
    plain = F.regexp_replace(
        F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(power, "^-", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return (
        F.when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, padded))
    )


def answer_text(value: Column) -> Column:
    """Text of a value: ``True``/``False``, floats keep one decimal, lists and objects as JSON."""
    return text_from_name(F.schema_of_variant(value), F.try_variant_get(value, "$", "string"), value)


def text_from_name(name: Column, plain: Column, value: Column) -> Column:
    """:func:`answer_text` from the name ``schema_of_variant`` gives and the value as a string."""
    return (
        F.when(value.isNull() | (name == "VOID"), F.lit(None).cast("string"))
        .when(name.isin("STRING", "BIGINT"), plain)
        .when(name == "BOOLEAN", F.initcap(plain))
        .when(
            name.startswith("DECIMAL"),
            # Whole numbers within 64 bits are integers already, so these had a fraction of zero.
            F.when(plain.contains(".") | plain.try_cast("bigint").isNull(), plain).otherwise(
                F.concat(plain, F.lit(".0"))
            ),
        )
        .when(name == "DOUBLE", _float_text(F.try_variant_get(value, "$", "double")))
        .otherwise(F.to_json(value))
    )


def items(value: Column) -> Column:
    """Items of a VARIANT array; null when it is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def normalize_answer(value: Column) -> Column:
    """Comparable text of an answer; every kind of emptiness becomes ''."""
    kind = json_type(value)
    inner = F.try_variant_get(value, "$.response_value", "variant")
    as_object = (
        F.when(F.to_json(value) == "{}", "")
        .when(inner.isNotNull(), F.when(is_truthy(inner), answer_text(inner)).otherwise(""))
        .otherwise(F.to_json(value))
    )
    as_list = F.array_join(F.transform(F.filter(items(value), is_truthy), answer_text), ",")
    from fieldloom.functions.text import strip_space

    text = (
        F.when(kind.isNull() | (kind == "null"), "")
        .when(kind == "object", as_object)
        .when(kind == "array", as_list)
        .otherwise(strip_space(answer_text(value)))
    )
    return F.coalesce(text, F.lit(""))


def list_answer(value: Column) -> Column:
    """Multi-select answer as a list of texts: a list, or a comma separated string."""
    from fieldloom.functions.text import split_multi

    kind = json_type(value)
    present = F.filter(items(value), lambda item: ~F.is_variant_null(item))
    none = F.array().cast("array<string>")
    return (
        F.when(kind == "array", F.transform(present, answer_text))
        .when(kind == "string", split_multi(F.try_variant_get(value, "$", "string")))
        .otherwise(none)
    )


def option_code(text: Column, texts: Column, values: Column) -> Column:
    """Code of the first option whose text matches, null without a match."""
    return F.get(values, F.array_position(texts, text).cast("int") - 1)


def option_text(code: Column, texts: Column, values: Column) -> Column:
    """Text of the first option whose code matches, null without a match."""
    return F.get(texts, F.array_position(values, code).cast("int") - 1)


def answer_code(text: Column, clean: Column, raw: Column, values: Column) -> Column:
    """Code for an answer text: the cleaned option texts are tried first, then the raw ones."""
    return F.coalesce(option_code(text, clean, values), option_code(text, raw, values))


def map_items(texts: Column, clean: Column, raw: Column, values: Column) -> Column:
    """Codes of a list of answers; an answer without a code stays as it is."""
    return F.transform(texts, lambda t: F.coalesce(answer_code(t, clean, raw, values), t))
