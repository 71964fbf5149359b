"""Text columns: cleaning, labels and keys.

Everything here is a plain ``Column -> Column`` expression, so it stays inside the JVM
and fuses with the scan it is applied to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the cleaning rule treats specially.
TAG_PATTERN = r"<[^>]+>"
CONTROL_CHARACTERS = "".join(map(chr, [*range(0x00, 0x20), *range(0x7F, 0xA0)]))
DROPPED_CHARACTERS = "\"'[]{}"
# Unicode white space; Java's \s is ASCII only.
SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE_CLASS = r"\s\x0b\x1c-\x1f" + "".join(map(chr, SPACES))


def clean_text(text: Column) -> Column:
    """Drop markup and the characters that break JSON strings, collapse white space."""
    untagged = F.regexp_replace(text, TAG_PATTERN, "")
    blanks = CONTROL_CHARACTERS + "\\"
    # One pass: control characters and backslashes become blanks, quotes and brackets go.
    mapped = F.translate(untagged, blanks + DROPPED_CHARACTERS, " " * len(blanks))
    return F.trim(F.regexp_replace(mapped, f"[{SPACE_CLASS}]+", " "))


def strip_space(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def file_safe_name(name: Column) -> Column:
    """Keep letters, digits, underscores; runs of blanks and dashes become one underscore."""
    kept = F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}\-]", "")
    joined = F.regexp_replace(kept, rf"[\-{SPACE_CLASS}]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def underscored(name: Column) -> Column:
    """Table title to template name: every blank becomes an underscore."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def blank(text: Column) -> Column:
    """Null or empty."""
    return text.isNull() | (text == "")


def with_prefix(key: Column, prefix: str) -> Column:
    """Put ``<prefix>_`` before a key that does not start with it yet."""
    head = f"{prefix}_"
    return F.when(key.startswith(head), key).otherwise(F.concat(F.lit(head), key))


def container_label(key: Column, name: Column) -> Column:
    """``<key>.<name>``, or the key alone when there is no name. The name must be clean."""
    return F.concat_ws(".", key, F.nullif(name, F.lit("")))


def property_label(
    name: Column, ident: Column, override: Column | None = None, use_id: bool = True
) -> Column:
    """Display name of a field: the override, else ``<id>. <name>``, else the name."""
    label = name
    if use_id:
        label = F.when(~blank(ident), F.concat(ident, F.lit(". "), name)).otherwise(name)
    if override is not None:
        label = F.when(~blank(override), override).otherwise(label)
    return label


def section_code(level_keys: Column) -> Column:
    """Code of the top container: what stands before the first dot of its label."""
    return F.substring_index(F.get(level_keys, F.lit(1)), ".", 1)


def instruction_text(title: Column, name: Column) -> Column:
    """Constant text of an instruction field."""
    return F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(name, F.lit("")))


def instruction_label(ident: Column) -> Column:
    return F.when(~blank(ident), F.concat(ident, F.lit(".Instructions"))).otherwise(
        F.lit("Instructions")
    )


def is_instruction_key(key: Column, number: Column) -> Column:
    """Stored rows of instructions: no number, key ends in a letter and an underscore."""
    return (
        blank(number)
        & (F.length(key) > 4)
        & key.endswith("_")
        & key.rlike(r"\p{L}_$")
    )


def lenient_id(text: Column) -> Column:
    """Whole-number ids lose padding and leading zeros; anything else stays as it is."""
    whole = F.when(
        strip_space(text).rlike(r"^[+-]?[0-9]+$"), strip_space(text).try_cast("decimal(38,0)")
    )
    return F.coalesce(whole.cast("string"), text)


def record_key(facility: Column, patient: Column, record: Column) -> Column:
    """``facility:patient:record`` with ``None`` standing in for an absent part."""
    none = F.lit("None")
    return F.concat_ws(":", *(F.coalesce(part, none) for part in (facility, patient, record)))


def split_multi(text: Column) -> Column:
    """Comma list to trimmed, non-blank items; null gives an empty list."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip_space)
    return F.filter(items, lambda item: item != "")
