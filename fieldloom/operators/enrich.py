"""Key/value texts and what they do to field descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.plans.joins import lookup_join
from fieldloom.functions.text import blank, clean_text, strip_space, with_prefix

POLICIES = ("last", "first", "error", "concat")


def prepare_pairs(
    rows: DataFrame,
    *,
    strip: bool = True,
    skip_blank_keys: bool = True,
    prefix: str | None = None,
    clean: bool = True,
) -> DataFrame:
    """Trim, drop blank keys, add the prefix, clean the values (columns ``key``, ``value``)."""
    key, value = (F.coalesce(c, F.lit("")) for c in ("key", "value"))
    if strip:
        key, value = strip_space(key), strip_space(value)
    out = rows.withColumns({"key": key, "value": value})
    if skip_blank_keys:
        out = out.filter("key <> ''")
    if prefix is not None:
        out = out.withColumn("key", with_prefix(F.col("key"), prefix))
    return out.withColumn("value", clean_text(F.col("value"))) if clean else out


def duplicate_keys(rows: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Keys that occur more than once, with the number of the second row that has them."""
    # Two minima instead of the sorted rows: nothing grows with the size of a key.
    first = rows.groupBy(*by).agg(F.count("*").alias("uses"), F.min("row_no").alias("_first"))
    repeated = first.filter("uses > 1")
    return (
        lookup_join(rows, repeated, list(by), "inner")
        .filter("row_no > _first")
        .groupBy(*by)
        .agg(F.max("uses").alias("uses"), F.min("row_no").alias("repeated_at"))
    )


def merge_duplicates(
    rows: DataFrame,
    policy: str = "last",
    by: tuple[str, ...] = ("key",),
    separator: str = ". ",
    chunk: int = 4096,
) -> DataFrame:
    """One row per key. ``row_no`` (a whole number) gives the order of the rows.

    ``last`` and ``first`` keep one value, ``concat`` joins them, ``error`` raises when a key
    occurs twice. With ``concat`` a blank text is replaced by what follows it, while blanks
    after a text are appended.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, use one of {POLICIES}")
    if policy == "error":
        found = duplicate_keys(rows, by).limit(1).collect()
        if found:
            raise ValueError(f"duplicate key {found[0][by[-1]]!r} at row {found[0]['repeated_at']}")
        return rows.select(*by, "value")
    if policy != "concat":
        pick = F.max_by if policy == "last" else F.min_by
        return rows.groupBy(*by).agg(pick("value", "row_no").alias("value"))
    return _concat(rows, by, separator, chunk)


def _concat(rows: DataFrame, by: tuple[str, ...], separator: str, chunk: int) -> DataFrame:
    """Join in two steps, so that a key with very many rows is sorted and joined in parts by
    many tasks; the last step only strings the parts together."""
    part = F.floor(F.col("row_no") / chunk).alias("_part")
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "value"))), lambda r: r["value"]
    )
    start = F.array_position(F.transform("_values", lambda v: v != ""), True)
    parts = (
        rows.groupBy(*by, part)
        .agg(ordered.alias("_values"))
        .select(
            *by, "_part",
            F.array_join("_values", separator).alias("_all"),
            # Without the leading blanks; null when there is nothing else.
            F.when(
                start > 0,
                F.array_join(F.slice("_values", start.cast("int"), F.size("_values")), separator),
            ).alias("_lead"),
        )
    )
    listed = parts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_all", "_lead"))).alias("_parts")
    )
    at = F.array_position(
        F.transform("_parts", lambda p: p["_lead"].isNotNull()), True
    ).cast("int")
    tail = F.transform(F.slice("_parts", at + 1, F.size("_parts")), lambda p: p["_all"])
    joined = F.array_join(
        F.concat(F.array(F.get("_parts", at - 1)["_lead"]), tail), separator
    )
    return listed.select(*by, F.when(at > 0, joined).otherwise("").alias("value"))


def _first_of_key(index: DataFrame) -> Column:
    """Is this the first field with its key in its template?"""
    place = F.struct("pos", "child_index")
    return place == F.min(place).over(W.partitionBy("template_id", "key"))


def _join_keys(index: DataFrame, other: DataFrame) -> list[str]:
    return ["template_id", "key"] if "template_id" in other.columns else ["key"]


def enrich_fields(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Put guideline texts behind the descriptions: the first field of each key gets its text.

    ``pairs`` has one row per key (and per template, when it has a ``template_id``).
    """
    on = _join_keys(index, pairs)
    text = F.col("_text")
    added = F.when(blank(F.col("description")), text).otherwise(
        F.concat("description", F.lit("\n\n"), text)
    )
    return (
        lookup_join(index, pairs.select(*on, F.col("value").alias("_text")), on)
        .withColumn(
            "description",
            F.when(text.isNotNull() & _first_of_key(index), added).otherwise(F.col("description")),
        )
        .select(*index.columns)
    )


def unmatched_keys(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of the pairs that no field has."""
    on = _join_keys(index, pairs)
    return pairs.join(index.select(*on), on, "left_anti").select(*on)


def enrich_from_rows(
    index: DataFrame, rows: DataFrame, policy: str = "concat", **options
) -> tuple[DataFrame, DataFrame]:
    """Guideline rows (``key, value, row_no``) all the way: prepared, merged and applied.

    Returns the enriched index and the keys that no field has.
    """
    pairs = merge_duplicates(prepare_pairs(rows, **options), policy)
    return enrich_fields(index, pairs), unmatched_keys(index, pairs)
