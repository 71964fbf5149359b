"""Answers in the nested record layout of the source system's database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import section_code, split_multi, strip_space
from fieldloom.functions.values import (
    answer_code,
    answer_text,
    is_truthy,
    items,
    map_items,
    text_from_name,
    type_from_name,
)
from fieldloom.operators import batches

RESPONSE = "struct<response_value:string,response_text:string>"
_SINGLE = ("rad", "radh", "cmb", "hck")
_MULTI = ("mcs", "mcsh")
_CHECK = ("chk", "ams")
#: Grids have no place in this layout.
GRIDS = ("gbdy",)


def with_response(rows: DataFrame) -> DataFrame:
    """Add ``response_value`` and ``response_text`` of each answer (``value``); both null when there is none.

    Each step uses what the one before it computed, so that an answer is taken apart once.
    """
    value, text, kind, source = F.col("value"), F.col("_text"), F.col("_kind"), F.col("source_type")
    clean, raw, codes = F.col("option_clean"), F.col("option_texts"), F.col("option_values")
    no_number = F.lit(None).cast("double")
    chosen = F.transform(F.filter(items(value), is_truthy), answer_text)
    listed = F.when(kind == "array", chosen).when(kind == "string", split_multi(text))
    return (
        rows.withColumns({"_name": F.schema_of_variant(value), "_plain": F.try_variant_get(value, "$", "string")})
        .withColumns({
            "_text": text_from_name(F.col("_name"), F.col("_plain"), value),
            "_kind": type_from_name(F.col("_name"), no_number),
        })
        .withColumns({
            "_stripped": F.when(kind == "string", strip_space(text)),
            "_code": F.when(source.isin(*_SINGLE), answer_code(text, clean, raw, codes)),
            "_joined": F.when(source.isin(*_MULTI), F.array_join(map_items(listed, clean, raw, codes), ",")),
        })
        .withColumn("_empty", kind.isNull() | (kind == "null") | ((kind == "string") & (F.col("_stripped") == "")))
        .withColumns({
            "response_value": (
                F.when(F.col("_empty"), F.lit(None).cast("string"))
                .when(source.isin(*_SINGLE), F.coalesce("_code", text))
                .when(source.isin(*_MULTI), F.nullif("_joined", F.lit("")))
                .when(source.isin(*_CHECK), F.when(((kind == "boolean") & (text == "True")) | (F.col("_stripped") == "1"), "1"))
                .otherwise(text)
            ),
            "response_text": F.when(~F.col("_empty") & source.isin(*_SINGLE) & F.col("_code").isNotNull(), text),
        })
    )


def db_responses(fields: DataFrame) -> DataFrame:
    """Long form, from ``field_rows``: one row per question with its response.

    Columns: ``doc_id, template_id, section_code, group_number, group_title, pos, question_key,
    question_number, question_text, response_value, response_text``.
    """
    shown = ("doc_id", "template_id", "section_code", "group_number", "group_title", "pos", "question_key",
             "question_number", "question_text")
    rows = fields.filter(~F.col("is_virtual_child") & ~F.col("source_type").isin(*GRIDS)).select(
        "doc_id", "template_id", section_code(F.col("level_keys")).alias("section_code"),
        F.get("level_keys", F.lit(3)).alias("group_number"), "group_title", "pos",
        F.col("key").alias("question_key"), F.col("id").alias("question_number"),
        F.coalesce("raw_name", F.lit("")).alias("question_text"),
        "value", "source_type", "option_clean", "option_texts", "option_values",
    )
    return with_response(rows).select(*shown, "response_value", "response_text")


def db_records(lined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested records: ``doc_id, template_id, sections``, built within the row of a document, in
    Arrow batches with tables that are made once per template.

    A document in trouble (unknown template, unreadable text) has null sections, and the reason in
    ``trouble``.

    Sections come in document order, groups ordered by their number, a group without any
    question that has a place in this layout is left out.
    """
    make = batches.records(batches.Kinds(frozenset(_SINGLE), frozenset(_MULTI), frozenset(_CHECK), frozenset(GRIDS)))
    shown = ["doc_id", "template_id", "table_title", "trouble", *keep]
    return batches.sent(lined, shown).select(*shown, make(*batches.SENT).alias("sections"))


def with_metadata(
    records: DataFrame, record_id: Column, patient_id: Column, template_name: Column,
    section_extra: dict[str, Column] | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Put records under ``assessments.items.<record id>`` with their metadata."""
    sections = F.col("sections")
    if section_extra:
        sections = F.transform(
            sections,
            lambda s: F.struct(
                s["section_code"].alias("section_code"),
                s["assessment_question_groups"].alias("assessment_question_groups"),
                *(value.alias(name) for name, value in section_extra.items()),
            ),
        )
    item = F.struct(
        F.col("template_id"), template_name.alias("template_name"),
        patient_id.alias("patient_id"), record_id.alias("assessment_id"),
        sections.alias("sections"), *(v.alias(n) for n, v in (extra or {}).items()),
    )
    wrapped = F.struct(
        F.struct(F.create_map(record_id.cast("string"), item).alias("items")).alias("assessments")
    )
    return records.withColumn("record", wrapped).drop("sections")
