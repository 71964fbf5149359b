"""Templates to field rows.

A template is one row with its JSON text. It is walked inside the row (one nested
``transform`` per container level), so the order of the fields comes for free and nothing is
shuffled until a caller asks for a per-template check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import (
    blank,
    clean_text,
    container_label,
    instruction_label,
    instruction_text,
    property_label,
)
from fieldloom.plans.layout import TemplateLayout

#: Stands between the parts of a path. Clean names hold no control characters.
PATH_SEP = "\x1f"

_PROP = "key string, id string, name string, title string, type string, options string, length string"
_EXTRA = "holder_key string, holder_title string"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def path_of(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), PATH_SEP)


def _is_list(text: Column) -> Column:
    return F.ltrim(text).startswith("[")


def _field(item: Column, name: str | None) -> Column:
    return item.getField(name) if name else F.lit(None).cast("string")


def _raw_items(text: Column) -> Column:
    """JSON text of an array -> the texts of its items; null if it is no readable array."""
    return F.from_json(F.when(_is_list(text), text), "array<string>")


def _is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _items(text: Column, names: list[str | None]) -> Column:
    """JSON text of an array -> its objects as structs of raw texts; null if no array.

    Items are read one by one, so that one that is no object leaves the others alone
    (:func:`template_faults` lists it).
    """
    unique = list(dict.fromkeys(n for n in names if n))
    schema = "struct<" + ",".join(f"{_quoted(n)}:string" for n in unique) + ">"
    return F.transform(F.filter(_raw_items(text), _is_object), lambda item: F.from_json(item, schema))


def _walk(layout: TemplateLayout, depth: int, text: Column, path: Column, top: Column,
          holder: Column, title: Column) -> Column:
    """Nodes below one array: containers and fields in document order."""
    no_prop = F.lit(None).cast(f"struct<{_PROP.replace(' string', ':string')}>")

    def node(kind: str, at: Column, prop: Column, holder_: Column, title_: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), prop.alias("prop"), top.alias("top_key"),
            holder_.alias("holder_key"), title_.alias("holder_title"),
        )

    if depth == len(layout.levels):
        p = layout.prop
        names = [p.key, p.id, p.name, p.title, p.type, p.options, p.length]
        other = {n: k.options_field for n, k in layout.types.items() if k.options_field}
        props = _items(text, [*names, *other.values()])
        labels = [part.split(" ")[0] for part in _PROP.split(", ")]

        def options(item: Column) -> Column:
            # Of types that keep their options elsewhere, from there.
            found = _field(item, p.options)
            for kind, name in other.items():
                found = F.when(_field(item, p.type) == kind, _field(item, name)).otherwise(found)
            return found

        def leaf(item: Column) -> Column:
            parts = (options(item) if a == "options" else _field(item, n) for n, a in zip(names, labels))
            prop = F.struct(*(c.alias(a) for c, a in zip(parts, labels)))
            return node("field", path, prop, holder, title)

        return F.transform(props, leaf)

    level = layout.levels[depth]
    deeper = depth + 1 < len(layout.levels)
    child = layout.levels[depth + 1].array if deeper else layout.prop.array
    items = _items(text, [level.key, level.name, level.title, child])
    # Items without a key are left out, so are items whose child is something else than a list.
    usable = F.filter(
        items,
        lambda item: ~blank(_field(item, level.key))
        & (_field(item, child).isNull() | _is_list(_field(item, child))),
    )

    def inside(item: Column) -> Column:
        key = _field(item, level.key)
        name = clean_text(_field(item, level.name)) if level.name else F.lit(None).cast("string")
        own = F.concat(path, F.array(container_label(key, name)))
        below = F.concat(own, F.array(F.lit(child)))
        outer = key if depth == 0 else top
        own_title = _field(item, level.title)
        nodes = _walk(layout, depth + 1, _field(item, child), below, outer, key, own_title)
        # A container knows its own key: take it before descending.
        heads = F.array(
            *(
                F.struct(
                    F.lit("container").alias("kind"), at.alias("at"), no_prop.alias("prop"),
                    outer.alias("top_key"), key.alias("holder_key"), own_title.alias("holder_title"),
                )
                for at in (own, below)
            )
        )
        return F.concat(heads, F.coalesce(nodes, F.array().cast(_node_type())))

    return F.flatten(F.transform(usable, inside))


def _node_type() -> str:
    prop = "struct<" + _PROP.replace(" string", ":string") + ">"
    extra = _EXTRA.replace(" string", ":string")
    return f"array<struct<kind:string,at:array<string>,prop:{prop},top_key:string,{extra}>>"


def read_templates_frame(frame: DataFrame, layout: TemplateLayout, doc: str = "doc") -> DataFrame:
    """Parse the head of each template: id, title, version and the text of the outer array.
    ``is_readable`` tells whether the text is a JSON object.

    ``template_id`` is kept when the frame has one, else it is taken from the template.
    """
    names = [layout.schema_name, layout.schema_id, layout.schema_version, layout.root_array]
    schema = ",".join(f"{_quoted(n)} string" for n in dict.fromkeys(n for n in names if n))
    head = F.from_json(F.col(doc), schema)
    with_head = frame.withColumn("_head", head)

    def at(name: str | None) -> Column:
        return F.col("_head").getField(name) if name else F.lit(None).cast("string")

    out = with_head.withColumn(
        "title", F.coalesce(clean_text(at(layout.schema_name)), F.lit("Unknown Table"))
    )
    if "template_id" not in frame.columns:
        out = out.withColumn("template_id", at(layout.schema_id).try_cast("bigint"))
    return (
        out.withColumn("raw_title", at(layout.schema_name))
        .withColumn("version", at(layout.schema_version))
        .withColumn("body", at(layout.root_array))
        .withColumn("is_readable", F.json_object_keys(doc).isNotNull())
        .drop("_head")
    )


def container_counts(templates: DataFrame, layout: TemplateLayout) -> DataFrame:
    """Items of the top container: all of them, and those with a key that are really used."""
    first = layout.levels[0] if layout.levels else None
    key = first.key if first else layout.prop.key
    items = _raw_items(F.col("body"))
    used = F.filter(_items(F.col("body"), [key]), lambda item: ~blank(item.getField(key)))
    count = lambda arr: F.coalesce(F.size(arr).cast("bigint"), F.lit(0).cast("bigint"))
    return templates.select(
        "template_id",
        F.lit(layout.root_array).alias("container"),
        count(items).alias("raw_count"),
        count(used).alias("used_count"),
    )


def flatten_template(templates: DataFrame, layout: TemplateLayout) -> DataFrame:
    """One row per container and per question, in document order, with the path to it.

    Columns: ``template_id, title, pos, kind, level_keys, top_key, holder_key, holder_title,
    prop``. Works for nested and for flat layouts.
    """
    none = F.lit(None).cast("string")
    root = F.array(F.lit(layout.root_array))
    nodes = F.concat(
        F.array(
            F.struct(
                F.lit("container").alias("kind"), root.alias("at"),
                F.lit(None).cast(f"struct<{_PROP.replace(' string', ':string')}>").alias("prop"),
                none.alias("top_key"), none.alias("holder_key"), none.alias("holder_title"),
            )
        ),
        F.coalesce(
            _walk(layout, 0, F.col("body"), root, none, none, none), F.array().cast(_node_type())
        ),
    )
    return (
        templates.select("template_id", "title", nodes.alias("nodes"))
        # The outer form keeps the planner from repeating the walk in an inferred filter.
        .select("template_id", "title", F.posexplode_outer("nodes").alias("pos", "node"))
        .select(
            "template_id", "title", "pos", F.col("node.kind"), F.col("node.at").alias("level_keys"),
            F.col("node.top_key"), F.col("node.holder_key"), F.col("node.holder_title"),
            F.col("node.prop"),
        )
    )


_FAULT = "array<struct<at:array<string>,item:int,reason:string>>"


def _faults(layout: TemplateLayout, depth: int, text: Column, path: Column) -> Column:
    """What cannot be read in one array and below it."""
    fault = lambda item, reason: F.struct(
        path.alias("at"), item.cast("int").alias("item"), F.lit(reason).alias("reason"))
    raw = _raw_items(text)
    whole = F.when(text.isNotNull() & raw.isNull(), F.array(fault(F.lit(None), "no readable list")))
    odd = F.filter(
        F.transform(raw, lambda item, i: F.when(~_is_object(item), fault(i, "item is no object"))),
        lambda f: f.isNotNull())
    own = F.concat(F.coalesce(whole, F.array().cast(_FAULT)), F.coalesce(odd, F.array().cast(_FAULT)))
    if depth == len(layout.levels):
        return own
    level = layout.levels[depth]
    child = layout.levels[depth + 1].array if depth + 1 < len(layout.levels) else layout.prop.array

    def inside(item: Column) -> Column:
        name = clean_text(_field(item, level.name)) if level.name else F.lit(None).cast("string")
        below = F.concat(path, F.array(container_label(_field(item, level.key), name), F.lit(child)))
        return _faults(layout, depth + 1, _field(item, child), below)

    keyed = F.filter(_items(text, [level.key, level.name, child]), lambda item: ~blank(_field(item, level.key)))
    return F.concat(own, F.coalesce(F.flatten(F.transform(keyed, inside)), F.array().cast(_FAULT)))


def template_faults(templates: DataFrame, layout: TemplateLayout) -> DataFrame:
    """Parts of templates that cannot be read: ``template_id, path, item, reason``.

    Takes :func:`read_templates_frame`. ``item`` counts from 0 in the array at ``path``; null means
    the array, or the whole template. What is around such a part is used all the same.
    """
    head = F.when(~F.col("is_readable"), F.lit("template is no JSON object")).when(
        F.col("body").isNull(), F.lit("template has no fields"))
    none = F.array().cast("array<string>")
    found = F.when(head.isNotNull(), F.array(F.struct(
        none.alias("at"), F.lit(None).cast("int").alias("item"), head.alias("reason")))).otherwise(
        _faults(layout, 0, F.col("body"), F.array(F.lit(layout.root_array))))
    return templates.select("template_id", F.explode(found).alias("_f")).select(
        "template_id", F.array_join("_f.at", ".").alias("path"), "_f.item", "_f.reason")


def _odd_options(options: Column) -> Column:
    """Whether a list of options holds something else than texts and objects."""
    kinds = F.from_json(F.when(_is_list(options), options), "array<variant>")
    return F.exists(kinds, lambda o: F.coalesce(
        ~(F.schema_of_variant(o) == "STRING") & ~F.schema_of_variant(o).startswith("OBJECT"), F.lit(True)))


def _choices(options: Column) -> Column:
    """Option list -> array<struct<text,value>>: plain strings, or objects with text and value."""
    pair = "array<struct<responseText:string,responseValue:string>>"
    return F.when(
        F.regexp_replace(options, r"^\s*\[\s*", "").startswith("{"),
        F.transform(
            F.filter(F.from_json(options, pair), lambda o: ~blank(o["responseText"])),
            lambda o: F.struct(
                o["responseText"].alias("text"), o["responseValue"].alias("value")
            ),
        ),
    ).otherwise(
        F.transform(
            F.from_json(F.when(_is_list(options), options), "array<string>"),
            lambda o: F.struct(o.alias("text"), o.alias("value")),
        )
    )


def _ladder(layout: TemplateLayout, source: Column, pick) -> Column:
    """CASE over the source types of the layout; null where there is nothing to pick."""
    out = None
    for name, kind in layout.types.items():
        value = pick(kind)
        if value is None:
            continue
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return F.lit(None) if out is None else out


def _literal(value) -> str:
    """A Python value as an SQL literal."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"{value}D" if isinstance(value, float) else str(value)
    if isinstance(value, tuple):
        return f"array({', '.join(map(_literal, value))})"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _case(layout: TemplateLayout, source: str, get, kind: str, default: str = "null") -> Column:
    """The same for plain values, as one piece of SQL text."""
    groups: dict[str, list[str]] = {}
    for name, field_type in layout.types.items():
        value = get(field_type)
        if value is not None:
            groups.setdefault(_literal(value), []).append(_literal(name))
    arms = " ".join(
        f"when {source} in ({', '.join(names)}) then {value}" for value, names in groups.items()
    )
    return F.expr(f"cast(case {arms} else {default} end as {kind})" if arms else
                  f"cast({default} as {kind})")


def type_map(layout: TemplateLayout, source: str = "prop.type") -> dict[str, Column]:
    """Columns that a source type fixes: target type and the rule that goes with it."""

    def of_rule(get, kind: str, default: str = "null") -> Column:
        return _case(layout, source, lambda k: get(layout.rules[k.target]), kind, default)

    return {
        "target_type": _case(layout, source, lambda k: k.target, "string"),
        "json_types": of_rule(lambda r: r.json_types, "array<string>"),
        "minimum": of_rule(lambda r: r.minimum, "double"),
        "maximum": of_rule(lambda r: r.maximum, "double"),
        "format": of_rule(lambda r: r.format, "string"),
        "enum_on": of_rule(lambda r: r.enum_on, "string"),
        "default_items": of_rule(lambda r: r.max_items, "int"),
        "is_constant": of_rule(lambda r: r.constant or None, "boolean", "false"),
        "has_children": of_rule(lambda r: r.children or None, "boolean", "false"),
        "is_skipped": of_rule(lambda r: r.skip or None, "boolean", "false"),
        "description": of_rule(lambda r: r.description, "string"),
        "needs_options": _case(layout, source, lambda k: k.needs_options or None, "boolean", "false"),
    }


def template_lint(flat: DataFrame, layout: TemplateLayout) -> DataFrame:
    """Questions that cannot be used, with the reason: ``template_id, pos, path, reason``."""
    return (
        _judged(flat, layout)
        .filter(F.col("reason").isNotNull())
        .select(
            "template_id", "pos", "key",
            F.array_join("level_keys", ".").alias("path"), "reason",
        )
    )


def _judged(flat: DataFrame, layout: TemplateLayout) -> DataFrame:
    """Questions with a cleaned name and a ``reason`` (null when the question is fine)."""
    source = F.col("prop.type")
    questions = flat.filter((F.col("kind") == "field") & ~F.coalesce(
        source.isin(*layout.ignored_types), F.lit(False)
    ))
    mapped = questions.select("*", *(c.alias(n) for n, c in type_map(layout).items()))
    options = F.col("prop.options")
    texts = F.col("choices")
    extracted = _ladder(
        layout, source,
        lambda k: None if k.extract is None else F.transform(
            k.extract(options), lambda t: F.struct(t.alias("text"), t.alias("value"))
        ),
    )
    if any(k.extract is not None for k in layout.types.values()):
        mapped = mapped.withColumn("choices", F.coalesce(extracted, _choices(options)))
    else:
        mapped = mapped.withColumn("choices", _choices(options))
    allowed = (
        source.isin(*layout.allowed_types) if layout.allowed_types else F.lit(True)
    )
    reason = (
        F.when(blank(F.col("prop.key")), "missing key")
        .when(blank(source), "missing type")
        .when(~allowed, "type not allowed")
        .when(F.col("target_type").isNull(), "no mapping for type")
        .when(F.col("needs_options") & options.isNull(), "options required")
        .when(F.col("needs_options") & texts.isNull(), "options unreadable")
        .when(F.col("needs_options") & _no_extractor(layout, source) & _odd_options(options), "option is no text")
    )
    return mapped.withColumn("reason", reason).withColumn("key", F.col("prop.key"))


def _no_extractor(layout: TemplateLayout, source: Column) -> Column:
    own = [n for n, k in layout.types.items() if k.extract is not None]
    return ~source.isin(*own) if own else F.lit(True)


def drop_untyped(flat: DataFrame) -> DataFrame:
    """Leave out placeholder questions without a type."""
    return flat.filter((F.col("kind") != "field") | ~blank(F.col("prop.type")))


def count_untyped(flat: DataFrame) -> DataFrame:
    """How many placeholder questions each template has."""
    lost = (F.col("kind") == "field") & blank(F.col("prop.type"))
    return flat.groupBy("template_id").agg(F.count_if(lost).alias("dropped"))


def build_field_index(flat: DataFrame, layout: TemplateLayout) -> DataFrame:
    """The central table: one row per usable field, with names, rules and options.

    ``pos`` orders fields within a template. Children of virtual containers follow their
    parent (``child_index`` 0, 1, ...; -1 for ordinary fields).
    """
    p = F.col("prop")
    fields = _judged(flat, layout).filter(F.col("reason").isNull() & ~F.col("is_skipped"))
    name = clean_text(F.coalesce(p["name"], p["key"]))
    title = clean_text(F.coalesce(p["title"], F.lit("")))
    ident = F.coalesce(p["id"], F.lit(""))
    fields = fields.withColumns(
        {
            "id": ident,
            "name": name,
            "field_title": title,
        }
    )
    own_label = _ladder(
        layout, p["type"],
        lambda k: layout.rules[k.target].label(F.col("id"), F.col("name"))
        if layout.rules[k.target].label else None,
    ).cast("string")
    override = F.when(F.col("is_constant"), instruction_label(F.col("id"))).otherwise(own_label)
    length = F.coalesce(p["length"].try_cast("int"), F.col("default_items"))
    built = _ladder(
        layout, p["type"],
        lambda k: layout.rules[k.target].fragment(p) if layout.rules[k.target].fragment else None,
    ).cast("string")
    own = F.when(F.json_object_keys(built).isNotNull(), built)
    of_own = lambda name, kind: F.get_json_object(own, f"$.{name}").try_cast(kind)
    texts = F.transform("choices", lambda o: o["text"])
    fields = fields.select(
        "template_id",
        "title",
        "pos",
        F.lit(-1).alias("child_index"),
        "key",
        "id",
        "name",
        F.col("field_title"),
        property_label(F.col("name"), F.col("id"), override, layout.id_in_label).alias(
            "property_key"
        ),
        "level_keys",
        F.col("top_key").alias("section_code"),
        F.col("holder_key").alias("group_key"),
        F.coalesce("holder_title", F.lit("")).alias("group_title"),
        F.lit(layout.key_field).cast("string").alias("key_field"),
        p["type"].alias("source_type"),
        p["name"].alias("raw_name"),
        "target_type",
        "json_types",
        F.coalesce(of_own("minimum", "double"), "minimum").alias("minimum"),
        F.coalesce(of_own("maximum", "double"), "maximum").alias("maximum"),
        "format",
        "enum_on",
        F.coalesce(of_own("maxItems", "int"), F.when(F.col("default_items").isNotNull(), length)).alias("max_items"),
        own.alias("own"),
        F.coalesce(p["length"].try_cast("int"), F.lit(0)).alias("length"),
        F.when(F.col("is_constant"), instruction_text(F.col("field_title"), F.col("name"))).alias(
            "const"
        ),
        F.when(F.col("enum_on").isNotNull() & F.col("needs_options"),
               F.transform(texts, clean_text)).alias("enum"),
        texts.alias("option_texts"),
        F.transform(texts, clean_text).alias("option_clean"),
        F.transform("choices", lambda o: o["value"]).alias("option_values"),
        "description",
        F.col("has_children").alias("is_virtual"),
        F.lit(False).alias("is_virtual_child"),
        F.lit(None).cast("string").alias("virtual_key"),
    )
    fields = fields.withColumn("path", path_of(F.col("level_keys"), F.array("property_key")))
    if any(rule.children for rule in layout.rules.values()):
        fields = fields.unionByName(virtual_children(fields))
    return fields


def virtual_children(fields: DataFrame) -> DataFrame:
    """One child row per option of every virtual container, one level below its parent."""
    numbered = (
        fields.filter("is_virtual")
        .select("*", F.posexplode(F.arrays_zip("option_clean", "option_values")).alias("_i", "_o"))
    )
    none = F.lit(None)
    out = numbered.withColumns(
        {
            "child_index": F.col("_i"),
            "level_keys": F.concat("level_keys", F.array("property_key")),
            "virtual_key": F.col("key"),
            "is_virtual": F.lit(False),
            "is_virtual_child": F.lit(True),
            "name": F.col("_o.option_clean"),
            "target_type": F.lit("string"),
            "json_types": F.array(F.lit("string"), F.lit("null")),
            "minimum": none.cast("double"),
            "maximum": none.cast("double"),
            "format": none.cast("string"),
            "enum_on": none.cast("string"),
            "enum": none.cast("array<string>"),
            "max_items": none.cast("int"),
            "const": none.cast("string"),
            "own": none.cast("string"),
            "description": none.cast("string"),
            # The child keeps the code of its own option only.
            "option_texts": F.array("_o.option_clean"),
            "option_clean": F.array("_o.option_clean"),
            "option_values": F.array("_o.option_values"),
        }
    ).withColumn("property_key", F.col("name"))
    return out.withColumn(
        "path", path_of(F.col("level_keys"), F.array("property_key"))
    ).drop("_i", "_o")


def option_rows(index: DataFrame) -> DataFrame:
    """Options in long form: ``template_id, key, pos, text, text_clean, value``."""
    zipped = F.arrays_zip("option_texts", "option_clean", "option_values")
    return (
        index.filter(~F.col("is_virtual_child"))
        .select("template_id", "key", F.posexplode(zipped).alias("pos", "o"))
        .select(
            "template_id", "key", "pos", F.col("o.option_texts").alias("text"),
            F.col("o.option_clean").alias("text_clean"), F.col("o.option_values").alias("value"),
        )
    )


def duplicate_labels(index: DataFrame) -> DataFrame:
    """Labels used more than once in one container; the last field of each wins."""
    return (
        index.groupBy("template_id", "path")
        .agg(
            F.count("*").alias("uses"),
            F.max("pos").alias("kept_pos"),
            F.max_by("key", "pos").alias("kept_key"),
        )
        .filter("uses > 1")
        .select("template_id", F.replace("path", F.lit(PATH_SEP), F.lit(".")).alias("path"),
                "uses", "kept_pos", "kept_key")
    )


def last_per_path(index: DataFrame) -> DataFrame:
    """Keep the last field of each label."""
    columns = index.columns
    keys = ["template_id", "path"]
    rest = [c for c in columns if c not in keys]
    return (
        index.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("pos", "child_index")).alias("_row"))
        .select(*keys, "_row.*")
        .select(*columns)
    )
