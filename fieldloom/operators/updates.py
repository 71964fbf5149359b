"""Partial updates of documents, and the states of their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRIES = "map<string,variant>"


def _top(doc: Column) -> Column:
    """Entries of a JSON object; a repeated key keeps its last value."""
    parsed = F.map_entries(F.from_json(doc, _ENTRIES))
    keys = F.transform(parsed, lambda e: e["key"])
    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), parsed).otherwise(
        F.filter(
            parsed,
            lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]),
        )
    )
    return F.map_from_entries(unique)


def merge_update(current: Column, update: Column, name: str) -> Column:
    """Merge one object of an update document into the current one (both JSON text).

    Keys of the update replace those of the current object, the others stay. An update
    without that object, or with something else in its place, changes nothing; a current
    document without it takes over what the update has.
    """
    if not name:
        raise ValueError("name of the updated object must not be empty")
    now, new = _top(current), _top(update)
    given = F.try_element_at(new, F.lit(name))
    held = F.try_element_at(now, F.lit(name))
    held_map = F.try_variant_get(held, "$", _ENTRIES)
    given_map = F.try_variant_get(given, "$", _ENTRIES)
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    joined = F.to_json(F.map_zip_with(held_map, given_map, lambda k, a, b: F.coalesce(b, a)))
    merged = (
        F.when(held.isNull() | ~is_object(held), given)
        .when(~is_object(given), held)
        .otherwise(F.parse_json(joined))
    )
    replaced = F.map_zip_with(
        now, F.create_map(F.lit(name), merged), lambda k, a, b: F.coalesce(b, a)
    )
    return F.when(given.isNull(), current).otherwise(F.to_json(replaced))


def merge_sections(
    current: DataFrame, update: DataFrame, keys: list[str], value: str = "value"
) -> DataFrame:
    """The same upsert on rows: one per entry, ``keys`` naming the document and the entry."""
    new = update.select(*keys, F.col(value).alias("_new"))
    return current.join(new, keys, "full_outer").select(
        *keys, F.coalesce("_new", value).alias(value)
    )


_SECTIONS = "sections map<string,string>"


def _sections(doc: Column) -> Column:
    return F.from_json(doc, _SECTIONS).getField("sections")


def _state(section: Column) -> Column:
    return F.get_json_object(section, "$.state")


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def section_state(doc: Column, section: str | Column) -> Column:
    """State of one section of a formatted document, null when there is none."""
    name = F.lit(section) if isinstance(section, str) else section
    held = F.try_element_at(_sections(doc), name)
    return F.when(_is_object(held), _state(held))


def section_states(doc: Column) -> Column:
    """States of all sections in the order of their keys; ``draft`` where none is set."""
    objects = F.filter(F.map_entries(_sections(doc)), lambda e: _is_object(e["value"]))
    ordered = F.array_sort(objects)
    states = F.transform(
        ordered,
        lambda e: F.when(
            F.array_contains(F.json_object_keys(e["value"]), "state"), _state(e["value"])
        ).otherwise("draft"),
    )
    return F.coalesce(states, F.array().cast("array<string>"))
