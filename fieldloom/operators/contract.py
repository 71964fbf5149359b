"""Contracts as JSON Schema text, one row per template."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.batches import parsed, quoted, rendered
from fieldloom.operators.documents import TABLE_NAME
from fieldloom.operators.templates import PATH_SEP
from fieldloom.plans.layout import TemplateLayout

_CLOSED = '"additionalProperties":false'


def json_text(text: Column) -> Column:
    """A string as a JSON literal, null for null."""
    # The text is in quotes, so only the brackets around them are trimmed. Written once: lambdas share nothing.
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def _list(texts: Column, nullable: bool) -> Column:
    quoted = F.transform(texts, json_text)
    if nullable:
        quoted = F.array_append(quoted, F.lit("null"))
    return F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))


def _named(name: str, value: Column) -> Column:
    """``"name":value``, null (and so left out) without a value."""
    return F.concat(F.lit(f'"{name}":'), value)


def _object(parts: list[Column]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def locked_object(value: Column) -> list[Column]:
    """Constraints that only the given object (a VARIANT) meets: each of its keys, and no other, down to
    the deepest object in it; null for what is no object."""
    @F.arrow_udf("string")
    def closed(locks: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for lock, text in zip(locks.to_pylist(), texts.to_pylist()):
            held = None if lock is None else T.VariantVal(lock["value"], lock["metadata"]).toPython()
            out.append(_closed_lock(held, parsed(text)) if isinstance(held, dict) else None)
        return pa.array(out, pa.string())

    return [closed(value, F.to_json(value))]


_LOCK_TYPES = ((bool, "boolean"), (int, "integer"), (str, "string"), (list, "array"), (dict, "object"), (type(None), "null"))


def _closed_lock(held: dict, written: dict) -> str:
    """``held`` has the types, ``written`` the JSON as it is rendered."""
    children = []
    for key, value in held.items():
        kind = next((name for t, name in _LOCK_TYPES if isinstance(value, t)), "number")
        inner = _closed_lock(value, written[key]) if kind == "object" else f'"const":{rendered(written[key])}'
        children.append(f'{quoted(key)}:{{"type":"{kind}",{inner}}}')
    return f'"properties":{{{",".join(children)}}},"required":[{",".join(map(quoted, held))}],{_CLOSED}'


def field_fragment(index: DataFrame) -> Column:
    """JSON Schema of one field."""
    types = F.col("json_types")
    shown_type = F.when(F.size(types) == 1, json_text(F.get(types, F.lit(0)))).otherwise(
        _list(types, False)
    )
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    enum, on = F.col("enum"), F.col("enum_on")
    item_list = F.when(
        on == "items",
        _object([_named("type", F.lit('["string","null"]')), _named("enum", _list(enum, True))]),
    ).when(
        on == "entry",
        F.concat(
            F.lit('{"type":"object",' + _CLOSED + ',"properties":{"entry":{"type":"string","enum":'),
            _list(F.coalesce(enum, F.array().cast("array<string>")), False),
            F.lit('},"description":{"type":"string"}},"required":["entry","description"]}'),
        ),
    )
    keys = F.json_object_keys("own")
    # The caller's own keys replace those of the rule.
    named = lambda name, value: F.when(~F.coalesce(F.array_contains(keys, name), F.lit(False)), _named(name, value))
    inside = F.nullif(F.expr("substring(trim(own), 2, length(trim(own)) - 2)"), F.lit(""))
    parts = [
        named("type", shown_type),
        named("description", json_text(F.col("description"))),
        named("enum", F.when(on == "value", _list(enum, True))),
        named("const", F.when(F.col("const").isNotNull(), json_text(F.col("const")))),
        named("minimum", whole("minimum")),
        named("maximum", whole("maximum")),
        named("format", json_text(F.col("format"))),
        named("maxItems", F.col("max_items").cast("string")),
        named("items", item_list),
        inside,
    ]
    if "lock_type" not in index.columns:
        return _object(parts)
    # A lock replaces the constraints and keeps the description.
    const = F.col("lock_const")
    size = F.col("lock_size").cast("string")
    item_types = F.col("item_types")
    locked_items = _object(
        [
            _named(
                "type",
                F.when(F.size(item_types) == 1, json_text(F.get(item_types, F.lit(0)))).otherwise(
                    _list(item_types, False)
                ),
            ),
            _named("enum", F.concat(F.lit("["), F.array_join("item_enum", ","), F.lit("]"))),
        ]
    )
    held = F.try_variant_get("lock", "$[0]", "variant")
    one_object = F.col("lock_type").eqNullSafe("array") & (F.col("lock_size") == 1) & F.col("item_types").isNull()
    whole_lock = F.when(F.col("lock_type") == "object", F.col("lock"))
    locked_items = F.when(F.size("item_types") > 0, locked_items).when(
        one_object, _object([_named("type", F.lit('"object"')), *locked_object(held)]))
    locked = _object(
        [
            _named("type", json_text(F.col("lock_type"))),
            _named("description", json_text(F.col("description"))),
            _named("const", const),
            _named("enum", F.concat(F.lit("["), const, F.lit("]"))),
            _named("minItems", size),
            _named("maxItems", size),
            _named("items", locked_items),
            *locked_object(whole_lock),
        ]
    )
    return F.when(F.col("lock_type").isNotNull(), locked).otherwise(_object(parts))


def closed_object(properties: Column, required: Column) -> Column:
    return F.concat(
        F.lit('{"type":"object",' + _CLOSED + ',"properties":{'), properties,
        F.lit('},"required":['), required, F.lit("]}"),
    )


def build_contracts(index: DataFrame, flat: DataFrame, layout: TemplateLayout) -> DataFrame:
    """``template_id, title, contract``, one row per template id; rows without an id are left out.

    The fragments of fields are compiled columns. The nodes of a template, which is one JSON file,
    are brought together once and folded from the deepest containers upwards.
    """
    parent = F.array_join(F.slice("level_keys", 1, F.size("level_keys") - 1), PATH_SEP)
    none = F.lit(None).cast("string")
    containers = flat.filter("kind = 'container'").select(
        "template_id", F.when(F.col("pos") == 0, F.col("title")).alias("title"),
        F.struct(
            F.col("pos").alias("place"), F.size("level_keys").alias("depth"), F.array_join("level_keys", PATH_SEP).alias("path"),
            parent.alias("parent"), F.element_at("level_keys", -1).alias("name"), none.alias("fragment"),
        ).alias("node"),
    )
    fields = index.filter("not is_virtual_child").select(
        "template_id", none.alias("title"),
        F.struct(
            F.col("pos").alias("place"), F.lit(None).cast("int").alias("depth"), none.alias("path"),
            F.array_join("level_keys", PATH_SEP).alias("parent"), F.col("property_key").alias("name"),
            _virtual_or_plain(index).alias("fragment"),
        ).alias("node"),
    )
    root = layout.root_array
    title = json_text(F.col("title"))
    name_rule = F.concat(F.lit('{"type":"string","const":'), title, F.lit(',"description":"The name of the table"}'))
    return (
        containers.unionByName(fields).filter("template_id is not null")
        .groupBy("template_id").agg(F.max("title").alias("title"), F.collect_list("node").alias("nodes"))
        .filter("title is not null")
        .select("template_id", "title", _folded(F.col("nodes")).alias("fragment"))
        .select(
            "template_id", "title",
            F.concat(
                F.lit('{"type":"object",' + _CLOSED + ',"title":'), title,
                F.lit(f',"properties":{{"{TABLE_NAME}":'), name_rule,
                F.lit(f',"{root}":'), F.col("fragment"),
                F.lit(f'}},"required":["{TABLE_NAME}","{root}"]}}'),
            ).alias("contract"),
        )
    )


def _folded(nodes: Column) -> Column:
    """JSON Schema of the top container of a template.

    A name used twice in a container stands at its first place with its last meaning, and twice in
    ``required``.
    """
    @F.arrow_udf("string")
    def fold(templates: pa.Array) -> pa.Array:
        return pa.array([_fold(t) for t in templates.to_pylist()], pa.string())

    return fold.asNondeterministic()(nodes)


def _fold(nodes: list[dict]) -> str | None:
    inside: dict[str, list[tuple[int, str, str]]] = {}
    containers = []
    for n in nodes:
        if n["depth"] is None:
            inside.setdefault(n["parent"], []).append((n["place"], n["name"], n["fragment"]))
        else:
            containers.append((-n["depth"], n["place"], n["path"], n["parent"], n["name"]))
    text = None
    for _, place, path, parent, name in sorted(containers):
        members = sorted(inside.get(path, ()))
        last = {n: f for _, n, f in members}  # in order of first place
        properties = ",".join(f"{quoted(n)}:{f}" for n, f in last.items())
        required = ",".join(quoted(n) for _, n, _ in members)
        text = f'{{"type":"object",{_CLOSED},"properties":{{{properties}}},"required":[{required}]}}'
        inside.setdefault(parent, []).append((place, name, text))
    return text


def _virtual_or_plain(index: DataFrame) -> Column:
    """A virtual container is a closed object with one nullable text per option."""
    children = F.array_distinct("option_clean")
    nullable = '{"type":["string","null"]}'
    properties = F.array_join(
        F.transform(children, lambda c: F.concat(json_text(c), F.lit(":" + nullable))), ","
    )
    required = F.array_join(F.transform(children, json_text), ",")
    return F.when(F.col("is_virtual"), closed_object(properties, required)).otherwise(
        field_fragment(index)
    )
