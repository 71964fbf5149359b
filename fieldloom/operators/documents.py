"""Documents to field rows, lined up with the contract of their template.

A document is nested JSON whose keys are display names, so its keys are data. Each document is
parsed once into nested maps with VARIANT leaves (every leaf carries its own small dictionary,
so exploded rows stay small), flattened inside its row, and matched with the rules of its
template by ``map_zip_with``, a hash match within the row. Documents therefore meet templates
while they are still one compact row each: the long form is only made afterwards, and it
already carries the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.batches import rules_text
from fieldloom.operators.templates import PATH_SEP, last_per_path
from fieldloom.plans.joins import lookup_join
from fieldloom.plans.layout import TemplateLayout

_NODES = "array<struct<path:string,value:variant,open:boolean>>"
TABLE_NAME = "table_name"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _document_schema(layout: TemplateLayout, leaf: bool = True) -> str:
    """Well-formed documents: fixed depth, map per level."""
    inner = "map<string,variant>"
    for _ in layout.levels:
        inner = f"map<string,map<string,{inner}>>"
    return f"{TABLE_NAME} variant, {_quoted(layout.root_array)} {inner}"


def _text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _join(path: Column, key: Column) -> Column:
    return F.concat(path, F.lit(PATH_SEP), key)


# The walks below are written as SQL text: one parsed expression instead of hundreds of calls
# into the JVM for every query that reads documents.
_SEP = "char(31)"
_NONE = f"cast(array() as {_NODES})"


def _node(path: str, value: str) -> str:
    """A value at a path."""
    return f"struct({path} as path, {value} as value, cast(null as boolean) as open)"


def _container(path: str, is_object: str) -> str:
    """A container at a path, and whether it really holds an object."""
    return f"struct({path} as path, cast(null as variant) as value, {is_object} as open)"


def _entries(content: str, name: str, node: str) -> str:
    """Nodes of all entries of a map, none for a null map."""
    return f"coalesce(flatten(transform(map_entries({content}), {name} -> {node})), {_NONE})"


def _reparse(text: str, leaf: bool) -> str:
    return f"from_json({text}, 'map<string,{'variant' if leaf else 'string'}>')"


def _walk(layout: TemplateLayout, depth: int, content: str, path: str) -> str:
    """Nodes below a container of a document that is read level by level."""
    if depth == len(layout.levels):
        leaf = _node(f"concat({path}, {_SEP}, p.key)", "p.value")
        return f"coalesce(transform(map_entries({content}), p -> {leaf}), {_NONE})"
    last = depth + 1 == len(layout.levels)
    child = layout.prop.array if last else layout.levels[depth + 1].array
    item, part = f"i{depth}", f"c{depth}"
    own = f"concat({path}, {_SEP}, {item}.key)"
    at = f"concat({own}, {_SEP}, {part}.key)"
    parts = _reparse(f"{item}.value", False)
    inside = _reparse(f"{part}.value", last)
    below = (
        f"case when {part}.key = {_text(child)} then {_walk(layout, depth + 1, inside, at)} "
        f"else {_NONE} end"
    )
    inner = f"concat(array({_container(at, f'{inside} is not null')}), {below})"
    outer = (
        f"concat(array({_container(own, f'{parts} is not null')}), {_entries(parts, part, inner)})"
    )
    return _entries(content, item, outer)


def _flat(layout: TemplateLayout, content: str, stop: int, with_value: bool) -> Column:
    """Walk the nested maps of a well-formed document down to ``stop`` levels of keys.

    Nothing but ``transform`` and ``flatten``: one null map on the way makes the result null.
    """
    keys = [f"{_SEP}, e{d}.key" for d in range(1, stop + 1)]
    path = f"concat({_text(layout.root_array)}, {', '.join(keys)})"
    made = f"struct({path} as path, e{stop}.value as value)" if with_value else path
    for depth in range(stop, 0, -1):
        source = content if depth == 1 else f"e{depth - 1}.value"
        made = f"transform(map_entries({source}), e{depth} -> {made})"
        if depth < stop:
            made = f"flatten({made})"
    return F.expr(made)


def parse_documents(docs: DataFrame, layout: TemplateLayout, doc: str = "doc") -> DataFrame:
    """Take documents apart, one row each.

    Adds ``leaves`` (path and value of every field), ``containers`` (paths of the objects),
    ``closed`` (paths where an object should be but something else is), ``named`` (the value of
    ``table_name``) and ``other_keys`` (further keys at the top). All are null for text that is
    no JSON object.

    A well-formed document is read in one pass. One with a misplaced scalar, list or null is
    read again level by level, so that its sound parts are kept.
    """
    root = F.lit(layout.root_array)
    depth = 2 * len(layout.levels) + 1
    options = {"columnNameOfCorruptRecord": "_bad"}
    schema = f"{_document_schema(layout)}, _bad string"
    content = f"_doc.{_quoted(layout.root_array)}"
    opened = docs.withColumn("_doc", F.from_json(F.col(doc), schema, options)).withColumns(
        {
            "_leaves": _flat(layout, content, depth, True),
        }
    )
    sound = F.col("_doc._bad").isNull() & F.col("_leaves").isNotNull()
    inner = [_flat(layout, content, stop, False) for stop in range(1, depth)]
    paths = F.concat(F.array(root), *inner) if inner else F.array(root)

    head = f"{TABLE_NAME} variant, {_quoted(layout.root_array)} string"
    heads = F.from_json(F.col(doc), head)
    outer = _reparse(
        f"from_json({_quoted(doc)}, {_text(head)}).{_quoted(layout.root_array)}", not layout.levels
    )
    name = _text(layout.root_array)
    # The keys are read where they are needed, which for most callers is in documents that aren't well-formed.
    keys = F.json_object_keys(F.col(doc))
    step_by_step = F.expr(
        f"concat(case when array_contains(json_object_keys({_quoted(doc)}), {name}) then "
        f"array({_container(name, f'{outer} is not null')}) else {_NONE} end, "
        f"{_walk(layout, 0, outer, name)})"
    )
    split = opened.select(
        *docs.columns, keys.alias("_keys"), "_leaves", sound.alias("_sound"),
        F.when(sound, paths).alias("_paths"),
        F.when(~sound & keys.isNotNull(), step_by_step).alias("_nodes"),
        F.when(sound, F.col("_doc").getField(TABLE_NAME))
        .otherwise(heads.getField(TABLE_NAME)).alias("named"),
    )
    nodes = F.col("_nodes")
    found = F.expr(
        "transform(filter(_nodes, n -> n.open is null), n -> struct(n.path as path, n.value as value))"
    )
    chosen = split.select(
        *docs.columns, "named", "_sound",
        F.when(F.col("_sound"), F.col("_leaves")).otherwise(found).alias("_leaves"),
        F.when(F.col("_sound"), F.array_distinct("_paths")).otherwise(
            F.array_distinct(F.transform(F.filter(nodes, lambda n: n["open"]), lambda n: n["path"]))
        ).alias("containers"),
        F.when(~F.col("_sound"), F.array_distinct(
            F.transform(F.filter(nodes, lambda n: ~n["open"]), lambda n: n["path"]))
        ).alias("closed"),
        F.array_except("_keys", F.array(F.lit(TABLE_NAME), root)).alias("other_keys"),
    )
    return chosen.select(
        *docs.columns, "named", _last_wins(F.col("_leaves")).alias("leaves"), "containers",
        "closed", "other_keys",
    )


def _last_wins(nodes: Column) -> Column:
    """JSON objects may repeat a key: the last one counts."""
    paths = F.transform(nodes, lambda n: n["path"])

    def kept(node: Column, i: Column) -> Column:
        later = F.slice(paths, i + 2, F.greatest(F.size(paths) - i - 1, F.lit(0)))
        return ~F.array_contains(later, node["path"])

    return F.when(F.size(F.array_distinct(paths)) == F.size(paths), nodes).otherwise(
        F.filter(nodes, kept)
    )


def flatten_documents(docs: DataFrame, layout: TemplateLayout, doc: str = "doc") -> DataFrame:
    """One row per field value: ``doc_id, template_id, level_keys, property_key, value``."""
    keep = [c for c in ("doc_id", "template_id") if c in docs.columns]
    rows = (
        parse_documents(docs, layout, doc)
        .select(*keep, F.explode_outer("leaves").alias("_leaf"))
        .filter("_leaf is not null")
        .select(*keep, F.split("_leaf.path", PATH_SEP).alias("_parts"), F.col("_leaf.value"))
    )
    return rows.select(
        *keep,
        F.slice("_parts", 1, F.size("_parts") - 1).alias("level_keys"),
        F.element_at("_parts", -1).alias("property_key"),
        "value",
    )


def read_path(doc: Column, path: list[str]) -> Column:
    """Value at a fixed path of a VARIANT document; null when a step is missing."""
    value = doc
    for step in path:
        if "'" in step and '"' in step:
            entries = F.try_variant_get(value, "$", "map<string,variant>")
            value = F.try_element_at(entries, F.lit(step))
        else:
            mark = '"' if "'" in step else "'"
            value = F.try_variant_get(value, f"$[{mark}{step}{mark}]", "variant")
    return value


# ----------------------------------------------------------------------------- contract rows

#: Columns of the field index that travel with each document into the long form.
RULE_COLUMNS = [
    "pos", "child_index", "key", "id", "name", "raw_name", "property_key", "section_code",
    "group_key", "group_title", "key_field", "source_type", "target_type", "json_types", "minimum",
    "maximum", "format", "enum_on", "max_items", "length", "const", "enum", "option_texts",
    "option_clean", "option_values", "is_virtual", "is_virtual_child", "level_keys", "lock_type",
    "lock_json", "lock_size", "item_enum", "own",
]

#: Those that the built-in checks of :mod:`fieldloom.operators.validate` look at.
CHECKED_COLUMNS = [
    "target_type", "json_types", "minimum", "maximum", "enum_on", "max_items", "const", "enum", "lock_type",
    "lock_json", "lock_size", "item_enum", "own",
]

#: Those that the built-in formatters, the record layout and their long forms look at.
FORMATTED_COLUMNS = [
    "pos", "key", "id", "raw_name", "section_code", "key_field", "group_title", "source_type", "length", "max_items",
    "option_texts", "option_clean", "option_values", "level_keys", "is_virtual_child",
]

#: Columns that only an index with locks has.
LOCK_COLUMNS = {"lock_type": "string", "lock_json": "string", "lock_size": "int", "item_enum": "array<string>"}


def with_lock_columns(index: DataFrame) -> DataFrame:
    """Locks as texts that can travel with the rules; nulls for an index without locks."""
    if "lock" in index.columns:
        index = index.withColumn("lock_json", F.to_json("lock")).drop("lock")
    missing = {c: F.lit(None).cast(t) for c, t in LOCK_COLUMNS.items() if c not in index.columns}
    return index.withColumns(missing) if missing else index


def contract_rows(index: DataFrame, flat: DataFrame) -> DataFrame:
    """One row per template with all its rules. This is the lookup table for documents.

    ``rules`` maps the path of each field to its rule, ``holders`` lists the paths of the
    containers. A template is one JSON file, so the size of a row is bounded by it.
    """
    fields = (
        last_per_path(with_lock_columns(index))
        .groupBy("template_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("path", F.struct(*RULE_COLUMNS)))
            ).alias("rules"),
            F.collect_list(F.when(F.col("is_virtual"), F.col("path"))).alias("virtual_paths"),
        )
    )
    containers = (
        flat.filter("kind = 'container'")
        .groupBy("template_id")
        .agg(
            F.max("title").alias("table_title"),
            F.collect_set(F.array_join("level_keys", PATH_SEP)).alias("holders"),
        )
    )
    no_rules = F.from_json(F.lit("{}"), fields.schema["rules"].dataType)
    return containers.join(fields, "template_id", "left").select(
        "template_id", "table_title", F.coalesce("rules", no_rules).alias("rules"), "holders",
        F.coalesce("virtual_paths", F.array().cast("array<string>")).alias("virtual_paths"),
    )


def line_up(
    docs: DataFrame, contracts: DataFrame, layout: TemplateLayout, doc: str = "doc",
    keep: tuple[str, ...] = (), columns: Sequence[str] = RULE_COLUMNS, **join,
) -> DataFrame:
    """Documents against their contracts, still one row per document.

    ``aligned`` maps the path of every field that either side knows, and of every container that
    is not as it should be, to ``state, value, rule``. It is null, with the reason in
    ``trouble``, where a document cannot be compared at all. States:

    * ``match``: a field the contract knows, with its value
    * ``missing``: in the contract only; ``unexpected``: in the document only
    * ``absent``: below a missing, unexpected or closed container, which is reported itself
    * ``closed``: a container that holds no object
    * ``misnamed``: the ``table_name`` is not that of the template

    ``leaves`` (path and value) and ``rules_text`` are for operators that work on whole batches.
    ``columns`` are those of the field index that ``rule`` has: every field of every document carries them.
    """
    kept = ["doc_id", "template_id", *keep]
    parsed = parse_documents(docs.select(*kept, doc), layout, doc).drop(doc)
    # Whether there are rules is a column of its own, so that no document carries rules that nobody reads.
    contracts = contracts.withColumns({"rules_text": rules_text(F.col("rules")), "_known": F.col("rules").isNotNull()})
    if list(columns) != RULE_COLUMNS:
        some = [c for c in RULE_COLUMNS if c in columns or c == "level_keys"]
        contracts = contracts.withColumn(
            "rules", F.transform_values("rules", lambda _, r: F.struct(*(r[c].alias(c) for c in some))))
    joined = lookup_join(parsed, contracts, ["template_id"], "left", **join)
    trouble = F.when(~F.coalesce("_known", F.lit(False)), "unknown template").when(
        F.col("leaves").isNull(), "unreadable"
    )
    usable = joined.select(
        *kept, "table_title", "rules", "rules_text", "holders", "named", "containers", "closed", "other_keys",
        "virtual_paths", trouble.alias("trouble"),
        F.when(
            F.size("virtual_paths") > 0,
            F.concat("leaves", _virtual_leaves(F.col("leaves"), F.col("virtual_paths"))),
        ).otherwise(F.col("leaves")).alias("leaves"),
        F.array_except("holders", F.concat("containers", _list("closed"))).alias("_lost"),
        F.array_except(F.concat("containers", _list("closed")), "holders").alias("_extra"),
    )
    is_open = F.concat(
        F.col("containers"),
        F.transform(
            F.filter("leaves", lambda f: F.array_contains("virtual_paths", f["path"])
                     & _is_object(f["value"])),
            lambda f: f["path"],
        ),
    )
    simple = (
        (F.size("_lost") == 0) & (F.size("_extra") == 0) & F.col("closed").isNull()
        & (F.size("virtual_paths") == 0)
    )
    values = F.map_from_entries(F.when(F.col("trouble").isNull(), F.col("leaves")))

    def zipped(state) -> Column:
        return F.map_zip_with(
            values, F.col("rules"),
            lambda k, v, r: F.struct(state(k, v, r).alias("state"), v.alias("value"), r.alias("rule")),
        )

    def simple_state(k: Column, v: Column, r: Column) -> Column:
        return F.when(v.isNull(), "missing").when(r.isNull(), "unexpected").otherwise("match")

    def full_state(k: Column, v: Column, r: Column) -> Column:
        known = F.array_contains(F.concat("holders", "virtual_paths"), _parent(k))
        shown = F.array_contains("_open", F.array_join(r["level_keys"], PATH_SEP))
        return (
            F.when(v.isNull(), F.when(shown, "missing").otherwise("absent"))
            .when(r.isNull(), F.when(known, "unexpected").otherwise("absent"))
            .otherwise("match")
        )

    staged = usable.select(
        *kept, "table_title", "trouble", "rules", "rules_text", "leaves", "holders", "virtual_paths",
        simple.alias("_simple"), F.when(~simple, is_open).alias("_open"),
        _problems(layout).alias("_problems"),
    )
    both = staged.select(
        *kept, "table_title", "trouble", "rules_text", "leaves", "_problems",
        F.when(F.col("_simple"), zipped(simple_state)).otherwise(zipped(full_state)).alias("aligned"),
    )
    rule_type = contracts.schema["rules"].dataType.valueType
    as_entries = F.transform(
        "_problems",
        lambda p: F.struct(
            p["path"],
            F.struct(p["state"].alias("state"), p["value"].alias("value"),
                     F.lit(None).cast(rule_type).alias("rule")),
        ),
    )
    return both.select(
        *kept, "table_title", "trouble", "rules_text", "leaves",
        F.when(
            F.size("_problems") > 0, F.map_concat("aligned", F.map_from_entries(as_entries))
        ).otherwise(F.col("aligned")).alias("aligned"),
    )


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, f"{PATH_SEP}?[^{PATH_SEP}]*$", "")


def _problems(layout: TemplateLayout) -> Column:
    """Containers that are missing, unexpected or closed, and what is wrong at the top."""
    none = F.lit(None).cast("variant")

    def rows(paths: Column, state: str) -> Column:
        return F.transform(
            paths, lambda p: F.struct(p.alias("path"), F.lit(state).alias("state"), none.alias("value"))
        )

    reached = F.array_union("containers", F.array(F.lit("")))
    lost = F.filter("_lost", lambda p: F.array_contains(reached, _parent(p)))
    extra = F.filter("_extra", lambda p: F.array_contains("holders", _parent(p)))
    closed = F.filter(_list("closed"), lambda p: F.array_contains("holders", p))
    name = F.try_variant_get("named", "$", "string")
    wrong = F.when(
        F.col("named").isNotNull() & ~F.coalesce(name == F.col("table_title"), F.lit(False)),
        F.array(
            F.struct(
                F.lit(TABLE_NAME).alias("path"), F.lit("misnamed").alias("state"),
                F.col("named").alias("value"),
            )
        ),
    ).otherwise(rows(F.array().cast("array<string>"), ""))
    unnamed = F.when(F.col("named").isNull(), F.array(F.lit(TABLE_NAME))).otherwise(
        F.array().cast("array<string>")
    )
    sound = (
        (F.size("_lost") == 0) & (F.size("_extra") == 0) & F.col("closed").isNull()
        & F.col("named").isNotNull() & (F.size("other_keys") == 0)
    )
    full = F.concat(
        rows(F.concat(unnamed, lost), "missing"),
        rows(F.concat(F.col("other_keys"), extra), "unexpected"),
        rows(closed, "closed"),
        wrong,
    )
    return F.when(sound, wrong).otherwise(full)


def align_documents(
    docs: DataFrame, contracts: DataFrame, layout: TemplateLayout, doc: str = "doc",
    keep: tuple[str, ...] = (), columns: Sequence[str] = RULE_COLUMNS, **join,
) -> DataFrame:
    """:func:`line_up` in long form: one row per document and path.

    A document that cannot be compared has one row whose ``state`` is the trouble: ``unreadable``
    (no JSON object) or ``unknown template``. ``is_first`` marks one row of each document.
    """
    kept = ["doc_id", "template_id", *keep]
    return (
        line_up(docs, contracts, layout, doc, keep, columns, **join)
        .select(
            *kept, "trouble",
            F.posexplode_outer(F.map_entries("aligned")).alias("_pos", "_e"),
        )
        .select(*kept, "trouble", "_pos", F.col("_e.key").alias("path"), F.col("_e.value").alias("_n"))
        .select(
            *kept, F.coalesce("path", F.lit("")).alias("path"),
            F.coalesce("_n.state", "trouble").alias("state"),
            F.col("_n.value").alias("value"), F.col("_n.rule").alias("rule"),
            (F.coalesce("_pos", F.lit(0)) == 0).alias("is_first"),
        )
    )


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _virtual_leaves(leaves: Column, virtual_paths: Column) -> Column:
    """Fields of virtual containers, one level below the field that holds the object."""
    holders = F.filter(leaves, lambda n: F.array_contains(virtual_paths, n["path"]))

    def children(n: Column) -> Column:
        inner = F.try_variant_get(n["value"], "$", "map<string,variant>")
        return F.coalesce(
            F.transform(
                F.map_entries(inner),
                lambda e: F.struct(_join(n["path"], e["key"]).alias("path"), e["value"].alias("value")),
            ),
            F.array().cast("array<struct<path:string,value:variant>>"),
        )

    return F.flatten(F.transform(holders, children))


def field_rows(aligned: DataFrame) -> DataFrame:
    """Rows of fields the contract knows, whether the document has them or not.

    A missing value is null; JSON null stays a VARIANT null.
    """
    inner = ("rule", "value", "path", "state", "is_first")
    others = [c for c in aligned.columns if c not in inner]
    return aligned.filter("rule is not null").select(*others, "path", "state", "value", "rule.*")
