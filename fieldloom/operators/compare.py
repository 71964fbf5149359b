"""Field by field comparison of two versions of the same record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import blank, is_instruction_key, strip_space
from fieldloom.functions.values import normalize_answer
from fieldloom.plans.joins import lookup_join

# Fixed value: shape of a stored record; response values may be of any JSON type.
STORED_RECORD = (
    "sections array<struct<section_code:string,assessment_question_groups:array<struct<"
    "group_number:string,assessment_responses:array<struct<question_key:string,"
    "question_number:string,question_text:string,responses:array<struct<"
    "response_value:variant,response_text:string>>>>>>>>"
)
_FIELD = "struct<field:string,value:string,text:string>"


def _answers(record: Column) -> Column:
    """All answers of a record in order."""
    sections = record.getField("sections")
    return F.flatten(
        F.transform(
            sections,
            lambda s: F.flatten(
                F.transform(
                    F.coalesce(s["assessment_question_groups"], F.array()),
                    lambda g: F.coalesce(g["assessment_responses"], F.array()),
                )
            ),
        )
    )


def record_fields(record: Column, typed_text: bool = False) -> Column:
    """Fields of a nested record: array of ``field, value, text``, one per question.

    The field is named ``<key>:<text>``; questions without a key and instruction rows are left
    out. ``value`` is the comparable text of the first response. When a field occurs twice
    the last one counts. ``typed_text`` says that response values are strings already.
    """
    def field(a: Column) -> Column:
        first = F.get(a["responses"], F.lit(0))
        value = first["response_value"]
        shown = strip_space(F.coalesce(value, F.lit(""))) if typed_text else normalize_answer(value)
        return F.struct(
            F.concat(a["question_key"], F.lit(":"), F.coalesce(a["question_text"], F.lit(""))).alias(
                "field"
            ),
            shown.alias("value"),
            F.coalesce(first["response_text"], F.lit("")).alias("text"),
        )

    wanted = F.filter(
        _answers(record),
        lambda a: ~blank(a["question_key"])
        & ~is_instruction_key(a["question_key"], a["question_number"]),
    )
    listed = F.coalesce(F.transform(wanted, field), F.array().cast(f"array<{_FIELD}>"))
    return _last_of_field(listed)


def _last_of_field(fields: Column) -> Column:
    def last(listed: Column, names: Column) -> Column:
        return F.when(F.size(F.array_distinct(names)) == F.size(names), listed).otherwise(
            F.filter(listed, lambda f, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), f["field"]))
        )

    # An array of one item, so that the fields are made once: as the argument of an explode they
    # would be made again wherever they are mentioned.
    kept = F.transform(F.array(fields), lambda listed: last(listed, F.transform(listed, lambda f: f["field"])))
    return F.get(kept, F.lit(0))


def flatten_records(records: DataFrame, keys: Sequence[str], record: str = "record",
                    typed_text: bool = False) -> DataFrame:
    """Long form: ``<keys>, field, value, text``."""
    return (
        records.select(*keys, F.explode_outer(record_fields(F.col(record), typed_text)).alias("_f"))
        .filter("_f is not null")
        .select(*keys, "_f.field", "_f.value", "_f.text")
    )


def difference(left: Column, right: Column, left_text: Column, right_text: Column) -> Column:
    """``value`` when the values differ, ``text`` when only their texts do, else null.

    A blank left side never differs. All four are comparable texts ('' for nothing).
    """
    texts = ~blank(left_text) & ~blank(right_text) & (left_text != right_text)
    return F.when(left == "", F.lit(None).cast("string")).when(left != right, "value").when(
        texts, "text"
    )


def difference_message(left: Column, right: Column, left_text: Column, right_text: Column,
                       kind: Column) -> Column:
    """How a difference is written: right side first."""
    q = F.lit('"')
    plain = F.concat(q, right, F.lit('" != "'), left, q)
    with_text = F.concat(
        q, right, F.lit('" (text: "'), right_text, F.lit('") != "'), left,
        F.lit('" (text: "'), left_text, F.lit('")'),
    )
    return F.when(kind == "value", plain).when(kind == "text", with_text)


def _judge(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = [F.col(c) for c in ("left_value", "right_value", "left_text", "right_text")]
    kind, message = difference(*parts), difference_message(*parts, F.col("kind"))
    if "_problem" in rows.columns:
        kind = F.when(F.col("_problem").isNotNull(), "problem").otherwise(kind)
        message = F.coalesce("_problem", message)
    return (
        rows.withColumn("kind", kind)
        .filter("kind is not null")
        .withColumn("message", message)
        .select(
            *keys, "field", "left_value", "right_value", "left_text", "right_text", "kind", "message"
        )
    )


def compare_fields(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences between two long tables ``<keys>, field, value, text``.

    Every field of the left side is looked up on the right; one that is absent there counts as
    blank.
    """
    other = right.select(
        *keys, "field", F.col("value").alias("_rv"), F.col("text").alias("_rt")
    )
    blank_text = F.lit("")
    joined = left.filter("value <> ''").join(other, [*keys, "field"], "left").select(
        *keys, "field", F.col("value").alias("left_value"),
        F.coalesce("_rv", blank_text).alias("right_value"),
        F.coalesce("text", blank_text).alias("left_text"),
        F.coalesce("_rt", blank_text).alias("right_text"),
    )
    return _judge(joined, keys)


def compare_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """The same for records that are plain rows with text columns.

    The rows are joined while they are still wide, and turned into fields afterwards, so the
    shuffle moves each record once instead of once per field.
    """
    other = right.select(*keys, F.struct(*fields).alias("_right"))
    pairs = F.array(
        *(
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(F.col(f), F.lit("")).alias("left_value"),
                F.coalesce(F.col("_right").getField(f), F.lit("")).alias("right_value"),
            )
            for f in fields
        )
    )
    rows = (
        left.select(*keys, *fields)
        .join(other, list(keys), "left")
        .select(*keys, F.explode(pairs).alias("_p"))
        .select(*keys, "_p.*", F.lit("").alias("left_text"), F.lit("").alias("right_text"))
    )
    return _judge(rows, keys)


def _problem(column: str | None) -> Column:
    return (F.col(column) if column else F.lit(None).cast("string")).alias("_problem")


def compare_pairs(
    pairs: DataFrame, left: str, right: str, keep: Sequence[str] = (), problem: str | None = None
) -> DataFrame:
    """Differences of records that come with both sides in one row (arrays of ``record_fields``).

    The two sides are matched by hash inside the row; nothing is shuffled. A pair with a text in
    the column ``problem`` comes out as one row of kind ``problem`` with that message.
    """
    as_map = lambda c: F.map_from_entries(
        F.transform(c, lambda f: F.struct(f["field"], F.struct(f["value"], f["text"])))
    )
    both = F.map_zip_with(
        as_map(left), as_map(right),
        lambda k, a, b: F.struct(
            a["value"].alias("left_value"), F.coalesce(b["value"], F.lit("")).alias("right_value"),
            F.coalesce(a["text"], F.lit("")).alias("left_text"),
            F.coalesce(b["text"], F.lit("")).alias("right_text"),
        ),
    )
    rows = (
        pairs.select(*keep, _problem(problem), F.explode_outer(both).alias("field", "_b"))
        .filter("_b.left_value is not null or _problem is not null")
        .select(*keep, "_problem", "field", "_b.*")
    )
    return _judge(rows, keep)


def latest_records(records: DataFrame, key: str = "record_key", order: str = "file") -> DataFrame:
    """Exactly one row per record key: the file that sorts last wins, then, of rows of one file,
    the one with the greatest hash (rows that are equal in all columns are one).

    Only the keys that occur more than once are looked up again, so the records themselves are
    not shuffled for the sake of a few repeated ones.
    """
    repeated = (
        records.groupBy(key)
        .agg(F.count("*").alias("_uses"), F.max(F.struct(F.col(order), _row_hash(records).alias("_hash"))).alias("_last"))
        .filter("_uses > 1")
        .select(key, "_last")
    )
    joined = lookup_join(records, repeated, [key])
    this = F.struct(F.col(order), _row_hash(records).alias("_hash"))
    last = joined.filter(F.col("_last").isNotNull() & (this == F.col("_last"))).select(*records.columns)
    once = last.groupBy(key).agg(F.first(F.struct(*records.columns)).alias("_r")).select("_r.*")
    return joined.filter("_last is null").select(*records.columns).unionByName(once.select(*records.columns))


def _row_hash(records: DataFrame) -> Column:
    """A hash of the parts of a row that can be hashed."""
    plain = [c for c, kind in records.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain)


def difference_counts(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of differences per record."""
    return differences.groupBy(*keys).agg(
        F.count("*").alias("differences"), F.count_if(F.col("kind") == "text").alias("text_only")
    )


def run_summary(records: DataFrame, differences: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: records compared, records skipped, differences found."""
    names = ("processed", "skipped", "differences")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
              for df, name in zip((records, skipped, differences), names, strict=True)]
    every = counts[0].union(counts[1]).union(counts[2])
    return every.agg(*(F.sum(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names))


def wide_report(
    differences: DataFrame, record_keys: Sequence[str], key: str = "record_key"
) -> DataFrame:
    """One row per field, one column per named record, blank where they agree.

    The columns must be named: the long form is the product for many records.
    """
    wide = differences.groupBy("field").pivot(key, list(record_keys)).agg(F.first("message"))
    return wide.na.fill("", list(record_keys)).orderBy("field")


def state_filter(records: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Records in one of the states; ``draft`` by default, all of them for an empty list."""
    wanted = ["draft"] if states is None else list(states)
    return records.filter(F.col("state").isin(*wanted)) if wanted else records
