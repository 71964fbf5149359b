"""How a family of templates spells its containers, fields and types.

A :class:`TemplateLayout` is read on the driver only, to fix the shape of a plan: the number
of container levels, the JSON field names, the type map.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column


@dataclass(frozen=True)
class Level:
    """One level of containers: the JSON array and the fields of its items."""

    array: str
    key: str
    name: str | None = None
    title: str | None = None


@dataclass(frozen=True)
class PropertyNames:
    """JSON field names of a question."""

    array: str
    key: str
    name: str
    type: str
    id: str | None = None
    title: str | None = None
    options: str | None = None
    length: str | None = "length"


@dataclass(frozen=True)
class FieldType:
    """What one source type of the templates becomes."""

    target: str
    needs_options: bool = False
    #: JSON text of the options -> array<string>; None takes lists of strings or of
    #: text/value objects.
    extract: Callable[[Column], Column] | None = None
    #: JSON field of the question that holds the options, when it is not the layout's own.
    options_field: str | None = None


@dataclass(frozen=True)
class TargetRule:
    """What a value of a target type must look like."""

    json_types: tuple[str, ...]
    minimum: float | None = None
    maximum: float | None = None
    format: str | None = None
    description: str | None = None
    #: where the option texts apply: the value, each list item, or each entry of a grid
    enum_on: str | None = None
    #: an instruction: the value must be the constant text made of title and name
    constant: bool = False
    #: default for the number of grid rows when the field gives no length
    max_items: int | None = None
    #: every option becomes a child field of an object value
    children: bool = False
    #: leave fields of this type out
    skip: bool = False
    #: display label made by the caller from (id, clean name)
    label: Callable[[Column, Column], Column] | None = None
    #: fragment of the caller's own: JSON text of an object with further constraints, made from the
    #: properties of the question (key, id, name, title, type, options, length); null adds nothing.
    #: It is merged into the contract, where its keys replace those of the rule. Checked when documents
    #: are validated: minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
    #: maxLength, pattern, minItems, maxItems
    fragment: Callable[[Column], Column] | None = None


# Target types, their rules and the descriptions that go into contracts.
SELECT_ONE = "Select one of the valid enum options if and only if you are absolutely sure of the answer. If you are not sure, please select null"
SELECT_MORE = "Select one or more of the valid enum options if and only if you are absolutely sure of the answer. If you are not sure, please select null"
TARGET_RULES: dict[str, TargetRule] = {
    "string": TargetRule(("string", "null")),
    "integer": TargetRule(("integer", "null")),
    "number": TargetRule(("number", "null")),
    "positive_number": TargetRule(("number", "null"), minimum=0),
    "positive_integer": TargetRule(("integer", "null"), minimum=0),
    "percent": TargetRule(("number", "null"), minimum=0, maximum=100),
    "boolean": TargetRule(("boolean", "null")),
    "date": TargetRule(
        ("string", "null"), format="date", description="ISO 8601 date (YYYY-MM-DD)"
    ),
    "datetime": TargetRule(
        ("string", "null"),
        format="date-time",
        description="ISO 8601 date-time (YYYY-MM-DDTHH:MM:SSZ)",
    ),
    "single_select": TargetRule(
        ("string", "null"), enum_on="value", description=SELECT_ONE
    ),
    "multiple_select": TargetRule(
        ("array", "null"), enum_on="items", description=SELECT_MORE
    ),
    "currency": TargetRule(
        ("number", "null"),
        description="Currency - must be a number with up to 2 decimal precision",
    ),
    "array": TargetRule(("array", "null")),
    "object": TargetRule(("object", "null")),
    "instructions": TargetRule(
        ("string",),
        constant=True,
        description=(
            "These are instructions that should be used as context for other properties of "
            "the same schema object and adjacent schema objects."
        ),
    ),
    "chk": TargetRule(("boolean", "null")),
    "object_array": TargetRule(
        ("array",),
        enum_on="entry",
        max_items=20,
        description=(
            "An array of objects that describe table entries. The 'entry' property is an enum "
            "selected for that entry, and the 'description' property is the description "
            "relevant for that enum.\nYou must only select enum entries and their descriptions "
            "if you are sure you found a clear reference to them in the provided transcript"
        ),
    ),
}


@dataclass(frozen=True)
class TemplateLayout:
    """Names and types of one template language. No levels means a flat template."""

    schema_name: str
    prop: PropertyNames
    types: Mapping[str, FieldType]
    levels: tuple[Level, ...] = ()
    schema_id: str | None = None
    schema_version: str | None = None
    allowed_types: tuple[str, ...] = ()
    ignored_types: tuple[str, ...] = ()
    id_in_label: bool = False
    rules: Mapping[str, TargetRule] = field(default_factory=lambda: dict(TARGET_RULES))

    def __post_init__(self) -> None:
        if not self.schema_name:
            raise ValueError("a layout needs the field that holds the template name")
        both = set(self.allowed_types) & set(self.ignored_types)
        both |= set(self.types) & set(self.ignored_types)
        if both:
            raise ValueError(f"types both handled and ignored: {sorted(both)}")
        unknown = {t.target for t in self.types.values()} - set(self.rules)
        if unknown:
            raise ValueError(f"no rule for target types {sorted(unknown)}")

    @property
    def key_field(self) -> str | None:
        """JSON field that holds the key of the outermost container."""
        return self.levels[0].key if self.levels else None

    @property
    def root_array(self) -> str:
        return self.levels[0].array if self.levels else self.prop.array

    def with_rule(self, target: str, rule: TargetRule) -> TemplateLayout:
        """Add a target type of the caller's own, or replace a built-in one."""
        return replace(self, rules={**self.rules, target: rule})

    @classmethod
    def from_meta(
        cls,
        meta: Mapping,
        id_in_label: bool = False,
        extractors: Mapping[str, Callable[[Column], Column]] | None = None,
        rules: Mapping[str, TargetRule] | None = None,
    ) -> TemplateLayout:
        """Read a mapping configuration: nested ``container``/``object``/``properties`` parts."""
        if "schema_name" not in meta:
            raise ValueError("the mapping needs 'schema_name'")
        levels: list[Level] = []
        node = meta
        while True:
            if ("container" in node) == ("properties" in node):
                raise ValueError("each level needs either 'container' or 'properties'")
            if "properties" in node:
                break
            container = node["container"]
            try:
                node = container["object"]
                levels.append(
                    Level(
                        container["container_name"], node["key"], node.get("name"), node.get("title")
                    )
                )
            except KeyError as missing:
                raise ValueError(f"container definition needs {missing}") from None
        try:
            array = node["properties"]["properties_name"]
            names = node["properties"]["property"]
            prop = PropertyNames(
                array, names["key"], names["name"], names["type"],
                names.get("id"), names.get("title"), names.get("options"),
            )
        except KeyError as missing:
            raise ValueError(f"properties definition needs {missing}") from None
        checks = names.get("validation") or {"allowed_types": (), "type_constraints": {}}
        if "allowed_types" not in checks or "type_constraints" not in checks:
            raise ValueError("'validation' needs 'allowed_types' and 'type_constraints'")
        types = {}
        for source, rule in checks["type_constraints"].items():
            if "target_type" not in rule or "requires_options" not in rule:
                raise ValueError(f"type {source!r} needs 'target_type' and 'requires_options'")
            types[source] = FieldType(
                rule["target_type"],
                bool(rule["requires_options"]),
                (extractors or {}).get(rule.get("options_extractor")),
                rule.get("options_field"),
            )
        return cls(
            schema_name=meta["schema_name"],
            schema_id=meta.get("schema_id"),
            schema_version=meta.get("schema_version"),
            levels=tuple(levels),
            prop=prop,
            types=types,
            allowed_types=tuple(checks["allowed_types"]),
            ignored_types=tuple(checks.get("ignored_types", ())),
            id_in_label=id_in_label,
            rules={**TARGET_RULES, **(rules or {})},
        )


# Names and types of the questionnaire exports this toolkit is made for.
_SOURCE_TYPES: dict[str, FieldType] = {
    "txt": FieldType("string"),
    "dte": FieldType("date"),
    "dttm": FieldType("datetime"),
    "rad": FieldType("single_select", True),
    "radh": FieldType("single_select", True),
    "chk": FieldType("chk"),
    "mcs": FieldType("multiple_select", True),
    "mcsh": FieldType("multiple_select", True),
    "num": FieldType("positive_integer"),
    "numde": FieldType("positive_number"),
    "hck": FieldType("single_select", True),
    "cmb": FieldType("single_select", True),
    "inst": FieldType("instructions"),
    "diag": FieldType("string"),
    "gbdy": FieldType("object_array", True),
    "mtxt": FieldType("string"),
    "ams": FieldType("chk"),
    "bs": FieldType("positive_integer"),
}
QUESTIONNAIRE = TemplateLayout(
    schema_name="assessmentDescription",
    schema_id="templateId",
    schema_version="templateVersion",
    levels=(
        Level("sections", "sectionCode", "sectionDescription"),
        Level("assessmentQuestionGroups", "groupNumber", "groupText", "groupTitle"),
    ),
    prop=PropertyNames(
        array="questions",
        key="questionKey",
        id="questionNumber",
        name="questionText",
        title="questionTitle",
        type="questionType",
        options="responseOptions",
    ),
    types=_SOURCE_TYPES,
    allowed_types=tuple(_SOURCE_TYPES),
    ignored_types=("bp", "he", "o2", "pnl", "pulse", "resp", "temp", "we", "cp"),
    id_in_label=True,
)
