"""The table of templates: registration, lookup, removal.

A catalog is a DataFrame ``template_id, title, loaded_at, ...``; each function returns a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.joins import lookup_join


def _order(templates: DataFrame, order: str) -> Column:
    """The order of registrations; of those at the same time, the file that sorts last wins, then
    the title, so that the order of rows never decides."""
    ties = [c for c in ("file", "title", "doc") if c in templates.columns and c != order]
    return F.struct(order, *ties)


def latest_registration(templates: DataFrame, order: str = "loaded_at") -> DataFrame:
    """One row per id: what was registered last replaces what came before (:func:`_order`).

    A ``max_by`` keeps one candidate per id and partition before the shuffle, so an id that was
    registered very often does not pile up in one task.
    """
    rest = [c for c in templates.columns if c != "template_id"]
    return (
        templates.groupBy("template_id")
        .agg(F.max_by(F.struct(*rest), _order(templates, order)).alias("_row"))
        .select("template_id", "_row.*")
        .select(*templates.columns)
    )


def list_templates(templates: DataFrame) -> DataFrame:
    return templates.select("template_id", "title")


def resolve(requests: DataFrame, templates: DataFrame, order: str = "loaded_at") -> DataFrame:
    """Find templates by id or by title.

    ``requests`` has ``template_id`` and ``title``, one of them null. A title used by several
    templates means the one registered last. Columns of requests are kept, with
    ``resolved_id``, ``resolved_title`` and ``is_known``.
    """
    ids = templates.select(
        F.col("template_id").alias("_id"), F.col("title").alias("_id_title"), F.lit(True).alias("_known")
    )
    titles = templates.groupBy(F.col("title").alias("_title")).agg(
        F.max_by("template_id", F.struct(_order(templates, order), "template_id")).alias("_title_id")
    )
    # Requests by title and by id go different ways, so that no join gets a heap of null keys.
    by_id = lookup_join(
        requests.filter("template_id is not null").withColumn("_id", F.col("template_id")), ids, ["_id"], "left")
    by_id = by_id.withColumn("_id", F.when(F.col("_known"), F.col("_id"))).drop("_known")
    by_title = requests.filter("template_id is null and title is not null").withColumn("_title", F.col("title"))
    by_title = lookup_join(by_title, titles, ["_title"], "left")
    neither = requests.filter("template_id is null and title is null")
    found = by_id.unionByName(by_title, allowMissingColumns=True).unionByName(neither, allowMissingColumns=True)
    return found.select(
        *requests.columns,
        F.coalesce("_id", "_title_id").alias("resolved_id"),
        F.coalesce("_id_title", F.when(F.col("_title_id").isNotNull(), F.col("_title"))).alias("resolved_title"),
        F.coalesce("_id", "_title_id").isNotNull().alias("is_known"),
    )


def unknown_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Requested ids that are not registered."""
    return lookup_join(requests, templates.select("template_id").distinct(), ["template_id"], "leftanti")


def unregister(templates: DataFrame, removed: DataFrame) -> DataFrame:
    return templates.join(removed.select("template_id"), "template_id", "left_anti")


def template_names(requests: DataFrame, files: DataFrame, templates: DataFrame) -> DataFrame:
    """Name for each requested id: the stem of its file, else its title, else the id."""
    stem = F.replace("file", F.lit(".json"), F.lit(""))
    known = files.select("template_id", stem.alias("_stem"))
    titles = templates.select("template_id", F.col("title").alias("_title"))
    return (
        lookup_join(lookup_join(requests, known, ["template_id"]), titles, ["template_id"]).select(
            *requests.columns,
            F.coalesce("_stem", "_title", F.col("template_id").cast("string")).alias(
                "template_name"
            ),
        )
    )


def field_metadata(index: DataFrame, template_id: int) -> DataFrame:
    """Fields of one template, in order."""
    return index.filter(F.col("template_id") == template_id).orderBy("pos", "child_index")
