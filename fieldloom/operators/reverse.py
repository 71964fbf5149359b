"""Answers back to the codes and layouts of the source system.

Formatters turn one answer into a list of entries ``storage_key, key, type, html_type, value``
(``value`` is JSON text). They are columns and run on exploded rows, where Spark compiles them.
Whole results are packed without a shuffle, in Arrow batches, by the twins of these formatters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.values import (
    answer_code,
    answer_text,
    is_truthy,
    items,
    json_type,
    option_code,
)
from fieldloom.operators import batches
from fieldloom.operators.contract import json_text

#: ``(value, rule) -> array of entries``; null or an empty array leaves the field out.
Formatter = Callable[[Column, Column], Column]

_ENTRY = "struct<storage_key:string,key:string,type:string,html_type:string,value:string>"
_ENTRIES = f"array<{_ENTRY}>"
NULL_JSON = "null"
OFF = batches.OFF


def entry(
    key: Column, kind: Column, value: Column, html: Column | None = None,
    storage: Column | None = None,
) -> Column:
    return F.struct(
        (storage if storage is not None else key).alias("storage_key"),
        key.alias("key"),
        kind.alias("type"),
        (html if html is not None else F.lit(None).cast("string")).alias("html_type"),
        F.coalesce(value, F.lit(NULL_JSON)).alias("value"),
    )


def _none() -> Column:
    return F.array().cast(_ENTRIES)


def _filled(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _text(value: Column) -> Column:
    """The answer if it is a string."""
    return F.when(json_type(value) == "string", F.try_variant_get(value, "$", "string"))


def _code(value: Column, rule: Column) -> Column:
    """JSON of the code of an answer, or of the answer itself when no option matches."""
    code = answer_code(_text(value), rule["option_clean"], rule["option_texts"],
                       rule["option_values"])
    return F.coalesce(json_text(code), F.to_json(value))


# ------------------------------------------------------------------------------- default set

#: What formats whole batches the way a column formatter does.
TWINS: dict[Formatter, batches.BatchFormatter] = {}


def _twin(formatter: Formatter, batch: batches.BatchFormatter) -> Formatter:
    TWINS[formatter] = batch
    return formatter


def passed(label: str) -> Formatter:
    """The answer as it is."""
    return _twin(lambda value, rule: F.array(entry(rule["key"], F.lit(label), F.to_json(value))), batches.passed(label))


def coded(label: str) -> Formatter:
    """The code of the chosen option, or the answer if no option matches."""
    return _twin(
        lambda value, rule: F.array(entry(rule["key"], F.lit(label), F.when(_filled(value), _code(value, rule)))),
        batches.coded(label),
    )


def code_list(value: Column, rule: Column) -> Column:
    """The codes of all chosen options; answers without an option are left out."""
    texts = F.transform(items(value), _text)
    codes = F.array_compact(
        F.transform(
            texts,
            lambda t: answer_code(t, rule["option_clean"], rule["option_texts"],
                                  rule["option_values"]),
        )
    )
    listed = F.when(F.size(codes) > 0, F.to_json(codes))
    return F.array(entry(rule["key"], F.lit("multi"), listed))


def checked(value: Column, rule: Column) -> Column:
    return F.array(
        entry(rule["key"], F.lit("checkbox"),
              F.when(F.coalesce(is_truthy(value), F.lit(False)), '"1"').otherwise(OFF))
    )


def table_rows(value: Column, rule: Column) -> Column:
    """Grid rows as ``{"a<i>_<key>": code, "b<i>_<key>": description}``; no rows, no field."""
    rows = items(value)

    def row(item: Column, i: Column) -> Column:
        code = _grid_code(item, rule)
        about = F.try_variant_get(item, "$.description", "variant")
        return F.concat(
            F.lit("{"),
            json_text(F.concat(F.lit("a"), i.cast("string"), F.lit("_"), rule["key"])), F.lit(":"),
            F.coalesce(json_text(code), F.lit('""')), F.lit(","),
            json_text(F.concat(F.lit("b"), i.cast("string"), F.lit("_"), rule["key"])), F.lit(":"),
            F.coalesce(F.to_json(about), F.lit('""')), F.lit("}"),
        )

    listed = F.concat(F.lit("["), F.array_join(F.transform(rows, row), ","), F.lit("]"))
    return F.when(
        F.size(rows) > 0, F.array(entry(rule["key"], F.lit("table"), listed))
    ).otherwise(_none())


def _grid_code(item: Column, rule: Column) -> Column:
    chosen = F.try_variant_get(item, "$.entry", "string")
    return answer_code(chosen, rule["option_clean"], rule["option_texts"], rule["option_values"])


def omitted(value: Column, rule: Column) -> Column:
    return _none()


# ------------------------------------------------------------------------------------ ui set

# The widget of each source type. Texts depend on their length.
WIDGETS = {
    "rad": "radio_buttons",
    "radh": "radio_buttons",
    "hck": "horizontal_single_check",
    "cmb": "combobox",
    "chk": "checkbox_single",
    "mcs": "checkbox_multi",
    "mcsh": "checkbox_multi",
    "dte": "text",
    "dttm": "text",
    "num": "textarea_singleline",
    "numde": "textarea_singleline",
    "gbdy_entry": "combobox",
    "gbdy_description": "textarea_singleline",
}
LONG_TEXT = 50


def widget(source_type: Column, length: Column) -> Column:
    """Widget of a source type; texts of up to 50 characters get a single line."""
    lines = F.when(length <= LONG_TEXT, "textarea_singleline").otherwise("textarea_multiline")
    out = F.when(source_type.isin("txt", "diag"), lines)
    for name, html in WIDGETS.items():
        out = out.when(source_type == name, html)
    return out.otherwise("text")


def _ui(rule: Column, value: Column) -> Column:
    return F.array(
        entry(rule["key"], rule["source_type"], value, widget(rule["source_type"], rule["length"]))
    )


def ui_basic(value: Column, rule: Column) -> Column:
    return _ui(rule, F.to_json(value))


def ui_number(value: Column, rule: Column) -> Column:
    """Numbers become strings."""
    return _ui(rule, F.when(_filled(value), json_text(answer_text(value))))


def _clean_code(value: Column, rule: Column) -> Column:
    code = option_code(_text(value), rule["option_clean"], rule["option_values"])
    return F.coalesce(json_text(code), F.to_json(value))


def ui_single(value: Column, rule: Column) -> Column:
    return _ui(rule, F.when(_filled(value), _clean_code(value, rule)))


def ui_multi(value: Column, rule: Column) -> Column:
    """One entry per selection; no list gives one empty entry, an empty list gives none."""
    html = widget(rule["source_type"], rule["length"])
    each = F.transform(
        items(value),
        lambda item, i: entry(
            rule["key"], rule["source_type"], _clean_code(item, rule), html,
            F.concat(rule["key"], F.lit("__"), i.cast("string")),
        ),
    )
    return F.coalesce(each, _ui(rule, F.lit(NULL_JSON)))


def ui_grid(value: Column, rule: Column) -> Column:
    """Always ``max_items`` pairs of cells; unused cells are off."""
    kind = rule["source_type"]

    # Lambdas are not compiled and share nothing, so each row is read once and its parts are passed on.
    def read(item: Column) -> Column:
        return F.struct(
            F.try_variant_get(item, "$.entry", "string").alias("chosen"),
            F.to_json(F.try_variant_get(item, "$.description", "variant")).alias("about"),
        )

    def decoded(row: Column) -> Column:
        code = answer_code(row["chosen"], rule["option_clean"], rule["option_texts"], rule["option_values"])
        return F.struct(json_text(code).alias("code"), row["about"].alias("about"))

    def cell(letter: str, part: str, i: Column, shown: Column) -> Column:
        key = F.concat(F.lit(letter), i.cast("string"), F.lit("_"), rule["key"])
        return entry(key, kind, F.when(~shown.isin("null", '""'), shown).otherwise(OFF), _grid_widget(kind, part))

    def pair(row: Column, i: Column) -> Column:
        return F.array(cell("a", "entry", i, row["code"]), cell("b", "description", i, row["about"]))

    found = F.transform(F.transform(items(value), read), decoded)
    most = F.greatest(F.coalesce(rule["max_items"], F.lit(0)), F.lit(0))
    empty = F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("about"))
    padded = F.slice(F.concat(F.coalesce(found, F.array().cast("array<struct<code:string,about:string>>")), F.array_repeat(empty, most)), F.lit(1), most)
    return F.flatten(F.transform(padded, pair))


def _grid_widget(kind: Column, part: str) -> Column:
    """:func:`widget` of the type that a part of a grid has: the name of the grid's type and that of the part."""
    out = F.lit("text")
    for name, html in WIDGETS.items():
        if name.endswith(f"_{part}"):
            out = F.when(kind == name.removesuffix(f"_{part}"), html).otherwise(out)
    return out


def ui_checkbox(value: Column, rule: Column) -> Column:
    shown = F.to_json(value)
    return _ui(rule, F.when(shown == "true", '"1"').when(shown == "false", OFF).otherwise(shown))


def widget_name(source_type: str | None, length: int | None) -> str:
    """:func:`widget` for one type."""
    if source_type in ("txt", "diag"):
        return "textarea_singleline" if length is not None and length <= LONG_TEXT else "textarea_multiline"
    return WIDGETS.get(source_type, "text")


_UI = batches.ui_formatters(widget_name)
for _column, _batch in (
    (code_list, batches.code_list), (checked, batches.checked), (table_rows, batches.table_rows), (omitted, batches.omitted),
    (ui_basic, _UI["basic"]), (ui_number, _UI["number"]), (ui_single, _UI["single"]), (ui_multi, _UI["multi"]),
    (ui_grid, _UI["grid"]), (ui_checkbox, _UI["checkbox"]),
):
    _twin(_column, _batch)

FORMATTERS: dict[str, dict[str, Formatter]] = {
    "default": {
        "chk": checked,
        "ams": checked,
        "rad": coded("radio"),
        "radh": coded("radio"),
        "cmb": coded("combo"),
        "hck": coded("hck"),
        "mcs": code_list,
        "mcsh": code_list,
        "gbdy": table_rows,
        "inst": omitted,
        "txt": passed("text"),
        "mtxt": passed("text"),
        "diag": passed("text"),
        "dte": passed("date"),
        "dttm": passed("datetime"),
        "num": passed("number"),
        "numde": passed("number"),
        "bs": passed("number"),
    },
    "ui": {
        "txt": ui_basic,
        "mtxt": ui_basic,
        "diag": ui_basic,
        "dte": ui_basic,
        "dttm": ui_basic,
        "num": ui_number,
        "numde": ui_number,
        "bs": ui_number,
        "chk": ui_checkbox,
        "ams": ui_checkbox,
        "hck": ui_single,
        "rad": ui_single,
        "radh": ui_single,
        "cmb": ui_single,
        "mcs": ui_multi,
        "mcsh": ui_multi,
        "gbdy": ui_grid,
        "inst": omitted,
    },
}


def formatter_set(name: str, sets: Mapping[str, Mapping[str, Formatter]] | None = None):
    known = {**FORMATTERS, **(sets or {})}
    if name not in known:
        raise ValueError(f"no formatter set {name!r}, there are {sorted(known)}")
    return known[name]


def entries_of(value: Column, rule: Column, formatters: Mapping[str, Formatter]) -> Column:
    """Entries of one answer by its source type; none for types without a formatter."""
    out = None
    shared: dict[Formatter, list[str]] = {}
    for name, make in formatters.items():
        shared.setdefault(make, []).append(name)
    for make, names in shared.items():
        hit, made = rule["source_type"].isin(*names), make(value, rule)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return _none() if out is None else out.otherwise(_none())


def format_fields(
    fields: DataFrame, name: str = "default",
    sets: Mapping[str, Mapping[str, Formatter]] | None = None,
) -> DataFrame:
    """Formatted entries in long form, from ``field_rows``: one row per entry.

    Columns: ``doc_id, template_id, section_code, key_field, field_key, pos, item,
    storage_key, key, type, html_type, value``.
    """
    rule = F.struct(*(c for c in fields.columns if c not in ("value", "path", "state")))
    made = (
        fields.filter("not is_virtual_child")
        .select("*", rule.alias("_rule"))
        .select("*", entries_of(F.col("value"), F.col("_rule"), formatter_set(name, sets)).alias("_e"))
    )
    return made.select(
        "doc_id", "template_id", "section_code", "key_field", F.col("key").alias("field_key"), "pos",
        F.posexplode_outer("_e").alias("item", "_x"),
    ).filter("_x is not null").select(
        "doc_id", "template_id", "section_code", "key_field", "field_key", "pos", "item", "_x.*"
    )


def unformatted(
    fields: DataFrame, name: str = "default",
    sets: Mapping[str, Mapping[str, Formatter]] | None = None,
) -> DataFrame:
    """Fields whose source type has no formatter in the set."""
    known = list(formatter_set(name, sets))
    return fields.filter(
        ~F.col("is_virtual_child") & ~F.coalesce(F.col("source_type").isin(*known), F.lit(False))
    ).select("doc_id", "template_id", "key", "source_type")


def reverse_map(
    lined: DataFrame,
    name: str = "ui",
    *,
    group_as: str | None = "sections",
    properties_key: str = "fields",
    pack_properties_as: str = "array",
    pack_containers_as: str = "object",
    title_field: str = "assessment_title",
    id_field: str | None = "assessment_std_id",
    type_field: tuple[str, str] | None = ("doc_type", "assessment"),
    state: str | None = "draft",
    sets: Mapping[str, Mapping[str, Formatter]] | None = None,
) -> DataFrame:
    """Documents in the layout of the source system: ``doc_id, template_id, result`` (JSON text) and
    ``trouble``: why a document has no result (unknown template, unreadable text), else null.

    Takes :func:`line_up` and stays within its rows. With ``group_as`` the entries are grouped
    by their top container (entries without one are left out), else they form one list under
    ``data``. Containers become an object by code, or a list of objects that hold their code.

    Built-in formatters work on Arrow batches, with tables that are made once per template. A
    formatter of the caller's own stays a column expression: its entries are made within the row and
    put in their place.
    """
    for given in (pack_properties_as, pack_containers_as):
        if given not in ("object", "array"):
            raise ValueError(f"pack as 'object' or 'array', not {given!r}")
    formatters = formatter_set(name, sets)
    in_batches = {k: TWINS[f] for k, f in formatters.items() if f in TWINS}
    others = {k: f for k, f in formatters.items() if f not in TWINS}
    made = F.lit(None).cast("string")
    if others:
        made = F.to_json(batches.made_in_row(F.col("aligned"), lambda v, r: entries_of(v, r, others)))
    head = f"{batches.quoted(type_field[0])}:{batches.quoted(type_field[1])}" if type_field and all(type_field) else ""
    how = batches.Packing(group_as, properties_key, pack_properties_as == "object", pack_containers_as == "array", head,
                          title_field, id_field, state)
    pack = batches.packed(in_batches, how)
    shown = ["doc_id", "template_id", "table_title", "trouble", "_made"]
    return batches.sent(lined.withColumn("_made", made), shown).select(
        "doc_id", "template_id",
        pack(F.col("template_id").cast("string"), "table_title", "_made", *batches.SENT).alias("result"), "trouble",
    )
