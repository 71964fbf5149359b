"""Formatting whole documents in Arrow batches, with tables that are made once per template.

A column expression inside a lambda is not compiled by Spark, and formatting needs many of them
for every answer. Here the rules of a template travel as one text that the join puts beside its
documents; a Python worker parses each such text once, into dictionaries from position to rule and
from option text to code, and formats the answers of a batch of documents with look-ups. Nothing is
shuffled, and columns that aren't formatted stay in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parsed templates that a worker keeps.
KEPT_TEMPLATES = 512

#: Answers that a worker takes out of Arrow at a time, so that large documents need little memory.
TAKEN_ANSWERS = 1 << 16

#: What a formatter needs to know of a field.
_RULE_PARTS = (
    "pos", "key", "id", "raw_name", "section_code", "key_field", "group_title", "source_type", "length", "max_items",
    "option_texts", "option_clean", "option_values", "level_keys", "is_virtual_child",
)
_NULL = "null"
# Fixed value: what an unset checkbox or an unused grid cell is stored as.
OFF = '"null"'
# JSON renderings that count as false.
_FALSY = frozenset(("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"))
# The type of a JSON text by its first sign; what starts otherwise is a number.
_KINDS = {'"': "STRING", "t": "BOOLEAN", "f": "BOOLEAN", "n": "VOID", "{": "OBJECT", "[": "ARRAY"}
_SIGNS = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_SPECIAL = re.compile(r'[\x00-\x1f"\\]').search
_ESCAPES = str.maketrans({**{chr(i): f"\\u{i:04X}" for i in range(32)}, **_SIGNS})


def rules_text(rules: Column) -> Column:
    """The rules of a template (a map of structs by path) as one JSON text."""
    parts = lambda r: [r[c].alias(c) for c in _RULE_PARTS]
    return F.to_json(F.transform(F.map_entries(rules), lambda e: F.struct(e["key"].alias("path"), *parts(e["value"]))))


def sent(lined: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns to ``keep`` of documents (see :func:`fieldloom.operators.documents.line_up`), and ``_sent`` with what
    :func:`documents` takes: the rules of the template, null for a document in trouble, and of its answers the paths, the
    JSON texts, and what a text doesn't tell: the type of a number, and texts and types of the items of a list that has numbers.

    Spark measures its Arrow batches after every row, and each time walks over all null lists since the last one that
    isn't null. So lists are not nested, and empty ones stand for null.
    """
    def part(item: Column) -> Column:
        return F.struct(F.to_json(item).alias("json"), F.schema_of_variant(item).alias("kind"))

    def more(leaf: Column, text: Column) -> Column:
        value = leaf["value"]
        return F.when(F.substring(text, 1, 1).between("-", "9"), F.schema_of_variant(value)).when(
            text.rlike(r"(?s)^\[(.*,)?[-0-9]"), F.to_json(F.transform(F.try_variant_get(value, "$", "array<variant>"), part)))

    none, usable = F.array().cast("array<string>"), F.col("trouble").isNull()
    texts = lined.select(
        *keep, "rules_text", "trouble", "leaves", F.when(usable, F.transform("leaves", lambda n: F.to_json(n["value"]))).alias("_texts"))
    columns = F.struct(
        F.when(usable, F.col("rules_text")).alias("rules"),
        F.coalesce(F.when(usable, F.col("leaves.path")), none).alias("paths"),
        F.coalesce("_texts", none).alias("texts"),
        F.coalesce(F.when(usable, F.zip_with("leaves", "_texts", more)), none).alias("more"),
    )
    # The explode of one item keeps the optimizer from moving lambdas into the arguments.
    return texts.select(*keep, F.explode(F.array(columns)).alias("_sent"))


#: The columns of ``_sent``, as arguments.
SENT = ("_sent.rules", "_sent.paths", "_sent.texts", "_sent.more")


def made_in_row(aligned: Column, entries: Callable[[Column, Column], Column]) -> Column:
    """Entries that a column expression of the caller makes of the known fields, by their position."""
    known = F.filter(F.map_values(aligned), lambda n: n["rule"].isNotNull() & ~n["rule"]["is_virtual_child"])
    made = F.transform(known, lambda n: F.struct(n["rule"]["pos"].alias("pos"), entries(n["value"], n["rule"]).alias("made")))
    return F.filter(made, lambda m: F.size(m["made"]) > 0)


# --- values ----------------------------------------------------------------------------------


def quoted(text: str | None) -> str | None:
    """A text as JSON, as Spark writes it."""
    if text is None:
        return None
    return f'"{text.translate(_ESCAPES)}"' if _SPECIAL(text) else f'"{text}"'


def _string(text: str) -> str:
    return json.loads(text) if "\\" in text else text[1:-1]


class Value(NamedTuple):
    """An answer: its JSON text and its type, as ``schema_of_variant`` names it (lists and objects without what they
    hold); nulls for no answer. ``items`` are the texts and types of a list's items, where it has numbers."""

    json: str | None = None
    kind: str | None = None
    items: str | None = None

    @property
    def filled(self) -> bool:
        return self.kind is not None and self.kind != "VOID"

    @property
    def truthy(self) -> bool:
        return self.json is not None and self.json not in _FALSY

    def string(self) -> str | None:
        return _string(self.json) if self.kind == "STRING" else None

    def text(self) -> str | None:
        """As :func:`fieldloom.functions.values.answer_text` shows it."""
        kind = self.kind
        if not self.filled:
            return None
        if kind == "STRING":
            return _string(self.json)
        if kind == "BOOLEAN":
            return self.json.capitalize()
        if kind.startswith("DECIMAL"):
            # Whole numbers within 64 bits are integers already, so these had a fraction of zero.
            return self.json if "." in self.json or not -(1 << 63) <= int(self.json) < 1 << 63 else self.json + ".0"
        return repr(float(self.json)) if kind == "DOUBLE" else self.json

    def each(self) -> list[Value] | None:
        """The items of a list; null for anything else."""
        if self.kind != "ARRAY":
            return None
        if self.items is None:
            return [_value(rendered(i)) for i in parsed(self.json)]
        return [_value(i.get("json"), i.get("kind")) for i in json.loads(self.items)]

    def strings(self) -> list[str | None]:
        """The texts of a list; null for an item that is none."""
        return [i if type(i) is str else None for i in parsed(self.json)] if self.kind == "ARRAY" else []

    def rows(self) -> list[dict[str, Any]]:
        """The objects of a list; an item that is none has no entries."""
        return [i if isinstance(i, dict) else {} for i in parsed(self.json)] if self.kind == "ARRAY" else []


def _value(text: str | None, more: str | None = None) -> Value:
    """A value from its JSON text, and from what the text doesn't tell (see :func:`sent`)."""
    if text is None:
        return _MISSING
    kind = _KINDS.get(text[0])
    return Value(text, kind, more) if kind is not None else Value(text, more)


_MISSING = Value()


class _Number(str):
    """A number as it is written."""


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number)


def parsed(text: str) -> Any:
    """JSON with its numbers as they are written."""
    return _DECODER.decode(text)


def rendered(value: Any) -> str:
    """The JSON text of what :func:`parsed` gave."""
    if isinstance(value, _Number):
        return value
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}:{rendered(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(rendered, value)) + "]"
    return {None: _NULL, True: "true", False: "false"}[value]


def _grid_row(row: Mapping[str, Any], rule: Rule) -> tuple[str | None, str | None]:
    """Code of the entry of a grid row, and its description as JSON text; nulls where they are missing."""
    chosen = row.get("entry")
    if chosen is not None and not isinstance(chosen, str):
        chosen = rendered(chosen)
    return rule.code(chosen), rendered(row["description"]) if "description" in row else None


# --- templates -------------------------------------------------------------------------------


class Rule:
    """A field of a template, with its options as dictionaries."""

    def __init__(self, parts: Mapping[str, Any]) -> None:
        self.path = parts["path"]
        for name in _RULE_PARTS:
            setattr(self, name, parts.get(name))
        codes = parts.get("option_values") or []
        self.clean, self.raw = _codes(parts.get("option_clean"), codes), _codes(parts.get("option_texts"), codes)

    def code(self, text: str | None) -> str | None:
        """Code of an answer: cleaned option texts are tried first, then the raw ones."""
        found = self.clean.get(text)
        return self.raw.get(text) if found is None else found


def _codes(texts: list | None, codes: list) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for text, code in zip(texts or [], codes):
        if text is not None:
            out.setdefault(text, code)
    return out


@lru_cache(KEPT_TEMPLATES)
def _template(text: str) -> list[Rule]:
    """The fields of a template in order, without those of virtual containers."""
    return sorted((Rule(r) for r in json.loads(text) if not r.get("is_virtual_child")), key=lambda r: r.pos)


def documents(rules: pa.Array, *answers: pa.Array) -> Iterator[tuple[int, list[Rule], list[Value]] | None]:
    """From what :func:`sent` gives, for each document the number of its template in this batch, all fields of the
    template and the value of each; null for one that has none."""
    coded = rules.dictionary_encode()
    templates = [_template(t) for t in coded.dictionary.to_pylist()]
    numbers, lengths = coded.indices.to_pylist(), answers[0].value_lengths().to_pylist()
    first = 0
    while first < len(lengths):
        ends = accumulate(lengths[first:])
        some = max(1, next((n for n, end in enumerate(ends) if end > TAKEN_ANSWERS), len(lengths) - first))
        yield from _documents(templates, numbers[first:first + some], lengths[first:first + some],
                              *(a.slice(first, some).flatten() for a in answers))
        first += some


def _documents(
    templates: list[list[Rule]], numbers: list[int | None], lengths: list[int],
    paths: pa.Array, texts: pa.Array, more: pa.Array,
) -> Iterator[tuple[int, list[Rule], list[Value]] | None]:
    coded = paths.dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    values = [_value(*v) for v in zip(*(column.to_numpy(zero_copy_only=False).tolist() for column in (texts, more)))]
    # Documents with the same paths find their values at the same places.
    places: dict[tuple[int, bytes], list[int]] = {}
    at = 0
    for number, length in zip(numbers, lengths):
        if number is None:
            at += length
            yield None
            continue
        template, own = templates[number], codes[at:at + length]
        layout = number, own.tobytes()
        found = places.get(layout)
        if found is None:
            place = {names[code]: k for k, code in enumerate(own)}
            found = places[layout] = [place.get(rule.path, length) for rule in template]
        given = [*values[at:at + length], _MISSING]
        at += length
        yield number, template, [given[k] for k in found]


# --- entries ---------------------------------------------------------------------------------


class Entry(NamedTuple):
    """What is stored of an answer; ``value`` is JSON text."""

    storage_key: str
    key: str
    type: str | None
    html_type: str | None
    value: str


#: Formatter of one answer: the entries, none to leave the field out.
BatchFormatter = Callable[[Value, Rule], list[Entry]]


def _plain(rule: Rule, kind: str, value: str | None) -> list[Entry]:
    return [Entry(rule.key, rule.key, kind, None, _NULL if value is None else value)]


def _coded(value: Value, code: str | None) -> str:
    return value.json if code is None else quoted(code)


def passed(label: str) -> BatchFormatter:
    return lambda value, rule: _plain(rule, label, value.json)


def coded(label: str) -> BatchFormatter:
    return lambda value, rule: _plain(rule, label, _coded(value, rule.code(value.string())) if value.filled else None)


def code_list(value: Value, rule: Rule) -> list[Entry]:
    codes = [c for c in map(rule.code, value.strings()) if c is not None]
    return _plain(rule, "multi", "[" + ",".join(map(quoted, codes)) + "]" if codes else None)


def checked(value: Value, rule: Rule) -> list[Entry]:
    return _plain(rule, "checkbox", '"1"' if value.truthy else OFF)


def table_rows(value: Value, rule: Rule) -> list[Entry]:
    rows = [_grid_row(r, rule) for r in value.rows()]
    listed = (
        f'{{{_cell("a", n, rule.key)}:{quoted(code or "")},{_cell("b", n, rule.key)}:{_EMPTY if about is None else about}}}'
        for n, (code, about) in enumerate(rows))
    return _plain(rule, "table", "[" + ",".join(listed) + "]") if rows else []


_EMPTY = '""'


@lru_cache(1 << 16)
def _cell(letter: str, place: int, key: str) -> str:
    """The name of a cell of a grid, as JSON."""
    return quoted(f"{letter}{place}_{key}")


def omitted(value: Value, rule: Rule) -> list[Entry]:
    return []


Widget = Callable[[str | None, int | None], str]


def ui_formatters(widget: Widget) -> dict[str, BatchFormatter]:
    """Formatters of the ``ui`` set by name; ``widget`` gives the widget of a source type and a length."""

    def ui(rule: Rule, value: str | None) -> list[Entry]:
        return [Entry(rule.key, rule.key, rule.source_type, widget(rule.source_type, rule.length), _NULL if value is None else value)]

    def clean_code(value: Value, rule: Rule) -> str:
        return _coded(value, rule.clean.get(value.string()))

    def basic(value: Value, rule: Rule) -> list[Entry]:
        return ui(rule, value.json)

    def number(value: Value, rule: Rule) -> list[Entry]:
        return ui(rule, quoted(value.text()))

    def single(value: Value, rule: Rule) -> list[Entry]:
        return ui(rule, clean_code(value, rule) if value.filled else None)

    def multi(value: Value, rule: Rule) -> list[Entry]:
        chosen = value.each()
        if chosen is None:
            return ui(rule, None)
        html = widget(rule.source_type, rule.length)
        return [Entry(f"{rule.key}__{n}", rule.key, rule.source_type, html, clean_code(i, rule)) for n, i in enumerate(chosen)]

    def grid(value: Value, rule: Rule) -> list[Entry]:
        rows, out = value.rows(), []
        for n in range(rule.max_items or 0):
            code, about = _grid_row(rows[n], rule) if n < len(rows) else (None, None)
            for letter, part, shown in (("a", "entry", quoted(code)), ("b", "description", about)):
                key = f"{letter}{n}_{rule.key}"
                out.append(Entry(key, key, rule.source_type, widget(f"{rule.source_type}_{part}", rule.length),
                                 OFF if shown in (None, _EMPTY, _NULL) else shown))
        return out

    def checkbox(value: Value, rule: Rule) -> list[Entry]:
        return ui(rule, {"true": '"1"', "false": OFF}.get(value.json, value.json))

    return {"basic": basic, "number": number, "single": single, "multi": multi, "grid": grid, "checkbox": checkbox}


# --- packing ---------------------------------------------------------------------------------


class Packing(NamedTuple):
    """The layout of a result: see :func:`fieldloom.operators.reverse.reverse_map`."""

    group_as: str | None
    properties_key: str
    as_object: bool
    containers_as_array: bool
    head: str
    title_field: str
    id_field: str | None
    state: str | None


@lru_cache(1 << 16)
def _start(storage_key: str, key: str, kind: str | None, html: str | None, as_object: bool) -> str:
    """An entry up to its value: the same for all documents of a template."""
    parts = [] if as_object else [f'"key":{quoted(key)}']
    parts += [f'"{name}":{quoted(text)}' for name, text in (("type", kind), ("html_type", html)) if text is not None]
    return (f"{quoted(storage_key)}:" if as_object else "") + "{" + "".join(p + "," for p in parts) + '"value":'


def _properties(entries: list[Entry], as_object: bool) -> str:
    shown = ",".join([f"{_start(s, k, t, h, as_object)}{v}}}" for s, k, t, h, v in entries])
    return f"{{{shown}}}" if as_object else f"[{shown}]"


def _body(entries: list[tuple[Rule, Entry]], how: Packing) -> str:
    name = quoted(how.properties_key)
    if how.group_as is None:
        return f'"data":[{{{name}:{_properties([e for _, e in entries], how.as_object)}}}]'
    sections: dict[str, list[Entry]] = {}
    for rule, e in entries:
        if rule.section_code is not None:
            sections.setdefault(rule.section_code, []).append(e)
    shown = []
    for code, key_field in dict.fromkeys((r.section_code, r.key_field) for r, _ in entries if r.section_code is not None):
        inner = f"{name}:{_properties(sections[code], how.as_object)}"
        if how.containers_as_array:
            own = "" if key_field is None else f"{quoted(key_field)}:{quoted(code)},"
            shown.append(f"{{{own}{inner}}}")
        else:
            state = "" if how.state is None else f',"state":{quoted(how.state)}'
            shown.append(f"{quoted(code)}:{{{inner}{state}}}")
    return f"{quoted(how.group_as)}:" + ("[%s]" if how.containers_as_array else "{%s}") % ",".join(shown)


def packed(formatters: Mapping[str, BatchFormatter], how: Packing) -> Callable[..., Column]:
    """Documents in a layout: ``(template_id as text, title, made in row as JSON text, sent) -> JSON text``."""

    @F.arrow_udf("string")
    def pack(
        ids: pa.Array, titles: pa.Array, made: pa.Array,
        rules: pa.Array, paths: pa.Array, texts: pa.Array, more: pa.Array,
    ) -> pa.Array:
        out: list[str | None] = []
        chosen: dict[int, list[BatchFormatter | None]] = {}
        found = documents(rules, paths, texts, more)
        for number, title, extra, document in zip(ids.to_pylist(), titles.to_pylist(), made.to_pylist(), found):
            if document is None:
                out.append(None)
                continue
            own = {m["pos"]: m["made"] for m in json.loads(extra)} if extra else {}
            template, fields, values = document
            if template not in chosen:
                chosen[template] = [formatters.get(r.source_type) for r in fields]
            entries: list[tuple[Rule, Entry]] = []
            for rule, value, formatter in zip(fields, values, chosen[template]):
                if formatter is not None:
                    for e in formatter(value, rule):
                        entries.append((rule, e))
                elif rule.pos in own:
                    entries += [(rule, Entry(*map(e.get, Entry._fields))) for e in own[rule.pos]]
            # Two fields with the same key share one place: the later one counts.
            last = {e.storage_key: n for n, (_, e) in enumerate(entries)}
            if len(last) < len(entries):
                entries = [x for n, x in enumerate(entries) if last[x[1].storage_key] == n]
            head = [how.head] if how.head else []
            if title is not None:
                head.append(f"{quoted(how.title_field)}:{quoted(title)}")
            if how.id_field and number is not None:
                head.append(f"{quoted(how.id_field)}:{number}")
            out.append("{" + ",".join([*head, _body(entries, how)]) + "}")
        return pa.array(out, pa.string())

    return pack.asNondeterministic()  # a border for the optimizer: evaluated once, where it stands


# --- stored records --------------------------------------------------------------------------

SECTIONS = (
    "array<struct<section_code:string,assessment_question_groups:array<struct<group_number:string,group_title:string,"
    "assessment_responses:array<struct<question_key:string,question_number:string,question_text:string,"
    "responses:array<struct<response_value:string,response_text:string>>>>>>>>"
)


class Kinds(NamedTuple):
    """Source types by how a stored record shows them."""

    single: frozenset[str]
    multi: frozenset[str]
    check: frozenset[str]
    grids: frozenset[str]


def _response(value: Value, rule: Rule, kinds: Kinds) -> tuple[str | None, str | None]:
    """Value and text of a response; both null when there is none."""
    text = value.text()
    if text is None or value.kind == "STRING" and not text.strip():
        return None, None
    source = rule.source_type
    if source in kinds.single:
        code = rule.code(text)
        return (text, None) if code is None else (code, text)
    if source in kinds.multi:
        listed = None
        if value.kind == "ARRAY":
            listed = [i.text() for i in value.each() or [] if i.truthy]
        elif value.kind == "STRING":
            listed = [t for t in (part.strip() for part in text.split(",")) if t]
        if listed is None:
            return None, None
        codes = [rule.code(t) for t in listed]
        return ",".join(t if c is None else c for t, c in zip(listed, codes)) or None, None
    if source in kinds.check:
        on = value.kind == "BOOLEAN" and text == "True" or value.kind == "STRING" and text.strip() == "1"
        return "1" if on else None, None
    return text, None


class Skeleton:
    """What the records of a template share: its sections, groups and questions in their order, column by column."""

    def __init__(self, template: list[Rule], kinds: Kinds) -> None:
        sections: dict[str, dict[str, tuple[str | None, list[int]]]] = {}
        for place, rule in enumerate(template):
            if len(rule.level_keys) <= 3:
                continue
            groups = sections.setdefault(rule.level_keys[1].split(".", 1)[0], {})
            if rule.source_type not in kinds.grids:
                groups.setdefault(rule.level_keys[3], (rule.group_title, []))[1].append(place)
        laid = [group for groups in sections.values() for group in sorted(groups.items())]
        self.codes, self.groups_in = [*sections], [len(groups) for groups in sections.values()]
        self.numbers, self.titles = [number for number, _ in laid], [title for _, (title, _) in laid]
        self.questions_in = [len(places) for _, (_, places) in laid]
        #: The places of the questions among the fields of the template.
        self.places = [place for _, (_, places) in laid for place in places]
        asked = [template[place] for place in self.places]
        self.keys, self.ids, self.names = [r.key for r in asked], [r.id for r in asked], [r.raw_name or "" for r in asked]


def _repeated(tables: list[list], which: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The items of one table after the other, as ``which`` names them."""
    start = np.cumsum([0, *map(len, tables)])
    lengths = np.diff(start)[which]
    at = np.repeat(start[:-1][which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return pa.array([item for table in tables for item in table], kind).take(pa.array(at, pa.int64()))


def _lists(lengths: np.ndarray | pa.Array, items: pa.Array, mask: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), items, mask=mask)


def _structs(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([*columns.values()], [*columns])


def records(kinds: Kinds) -> Callable[..., Column]:
    """Nested sections of documents: ``(sent) -> sections``.

    Only responses are made answer by answer; what the records of a template share is copied column by column.
    """
    @F.arrow_udf(SECTIONS)
    def make(rules: pa.Array, paths: pa.Array, texts: pa.Array, more: pa.Array) -> pa.Array:
        skeletons: dict[int, Skeleton] = {}
        used: list[int] = []
        missing: list[bool] = []
        shown: list[tuple[str | None, str | None]] = []
        for document in documents(rules, paths, texts, more):
            missing.append(document is None)
            if document is None:
                continue
            number, template, values = document
            if number not in skeletons:
                skeletons[number] = Skeleton(template, kinds)
            used.append(number)
            shown += [_response(values[place], template[place], kinds) for place in skeletons[number].places]
        order = {number: n for n, number in enumerate(skeletons)}
        which = np.array([order[number] for number in used], np.int64)

        def laid(column: str, kind: pa.DataType = pa.string()) -> pa.Array:
            return _repeated([getattr(s, column) for s in skeletons.values()], which, kind)

        responses = _structs(response_value=pa.array([v for v, _ in shown], pa.string()), response_text=pa.array([t for _, t in shown], pa.string()))
        questions = _structs(question_key=laid("keys"), question_number=laid("ids"), question_text=laid("names"),
                             responses=_lists(np.ones(len(shown), np.int32), responses))
        groups = _structs(group_number=laid("numbers"), group_title=laid("titles"),
                          assessment_responses=_lists(laid("questions_in", pa.int32()), questions))
        sections = _structs(section_code=laid("codes"), assessment_question_groups=_lists(laid("groups_in", pa.int32()), groups))
        lengths = np.zeros(len(missing), np.int32)
        lengths[~np.array(missing, bool)] = [len(skeletons[number].codes) for number in used]
        return _lists(lengths, sections, pa.array(missing, pa.bool_()))

    return make.asNondeterministic()
