"""Partial updates, section states and the table of templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import catalog as C
from fieldloom.operators import updates as U
from registry import query
from registry.inputs import spread, table

@query(
    "merge_sections",
    """with e as (select user_id, event_type, min(event_id) as a, max(event_id) as b from events
        group by 1, 2)
    select user_id, event_type, cast(case when user_id % 3 = 0 then a when a < b then b else a end
      as varchar) as value from e""",
)
def merge_sections(spark, sf):
    ends = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("a"), F.max("event_id").alias("b")
    )
    current = ends.select("user_id", "event_type", F.col("a").cast("string").alias("value"))
    update = ends.filter("user_id % 3 <> 0 and a < b").select(
        "user_id", "event_type", F.col("b").cast("string").alias("value")
    )
    return U.merge_sections(current, update, ["user_id", "event_type"])


@query(
    "merge_update",
    """select event_id, case event_id % 6
      when 0 then concat('{"id":', event_id, ',"sections":{"A":"', event_type, '","B":2,"C":3}}')
      when 1 then concat('{"id":', event_id, ',"sections":{"A":1,"B":2}}')
      when 2 then concat('{"id":', event_id, ',"sections":{"C":"', event_type, '"}}')
      when 3 then concat('{"id":', event_id, ',"sections":{"A":1,"B":2}}')
      when 4 then concat('{"id":', event_id, ',"sections":{"C":', user_id, '}}')
      else concat('{"id":', event_id, ',"sections":{"A":null,"B":2}}') end as merged from events""",
)
def merge_update(spark, sf):
    key = F.col("event_id")
    current = F.concat(
        F.lit('{"id":'), key,
        F.when(key % 6 == 2, ',"sections":[1]}').when(key % 6 == 4, "}")
        .otherwise(',"sections":{"A":1,"B":2}}'),
    )
    kind = F.col("event_type")
    update = (
        F.when(key % 6 == 0, F.concat(F.lit('{"sections":{"A":"'), kind, F.lit('","C":3},"x":1}')))
        .when(key % 6 == 1, '{"other":{"A":5}}')
        .when(key % 6 == 2, F.concat(F.lit('{"sections":{"C":"'), kind, F.lit('"}}')))
        .when(key % 6 == 3, '{"sections":[5]}')
        .when(key % 6 == 4, F.concat(F.lit('{"sections":{"C":'), "user_id", F.lit("}}")))
        .otherwise('{"sections":{"A":null}}')
    )
    events = spread(table(spark, sf, "events").select("event_id", "event_type", "user_id"))
    return events.select("event_id", U.merge_update(current, update, "sections").alias("merged"))


def _stateful(spark, sf):
    key = F.col("o_orderkey")
    doc = F.when(key % 9 == 0, '{"sections":[1]}').otherwise(
        F.concat(
            F.lit('{"sections":{"Z":{"state":"'), "o_orderstatus", F.lit('"},"B":5,"A":{"fields":[]'),
            F.when(key % 2 == 0, ',"state":"signed"').otherwise(""), F.lit("}}}"),
        )
    )
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")).select(
        "o_orderkey", doc.alias("doc")
    )


@query(
    "section_states",
    """select o_orderkey, case when o_orderkey % 9 = 0 then '' else concat(
      case when o_orderkey % 2 = 0 then 'signed' else 'draft' end, ',', o_orderstatus) end as states
    from orders""",
)
def section_states(spark, sf):
    return _stateful(spark, sf).select(
        "o_orderkey", F.array_join(U.section_states(F.col("doc")), ",").alias("states")
    )


@query(
    "section_state",
    """select o_orderkey, case when o_orderkey % 9 > 0 then o_orderstatus end as z,
      case when o_orderkey % 9 > 0 and o_orderkey % 2 = 0 then 'signed' end as a,
      cast(null as varchar) as b from orders""",
)
def section_state(spark, sf):
    doc = F.col("doc")
    return _stateful(spark, sf).select(
        "o_orderkey",
        U.section_state(doc, "Z").alias("z"),
        U.section_state(doc, "A").alias("a"),
        U.section_state(doc, "B").alias("b"),
    )


def _registrations(spark, sf):
    """Documents as registrations: the source number is the id, later documents replace earlier ones."""
    return table(spark, sf, "documents").select(
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("template_id"),
        F.concat(F.col("lang"), F.lit(" "), (F.col("doc_id") % 7).cast("string")).alias("title"),
        F.col("doc_id").alias("loaded_at"),
    )


_REGISTERED = """(select cast(regexp_extract(source, '([0-9]+)', 1) as bigint) as template_id,
    arg_max(concat(lang, ' ', doc_id % 7), doc_id) as title, max(doc_id) as loaded_at
  from documents group by 1)"""


@query("latest_template", f"select * from {_REGISTERED}")
def latest_template(spark, sf):
    return C.latest_registration(_registrations(spark, sf))


@query(
    "latest_of_ties",
    """select cast(regexp_extract(source, '([0-9]+)', 1) as bigint) as template_id, max(concat(lang, ' ', doc_id % 7)) as title
    from documents group by 1""",
)
def latest_of_ties(spark, sf):
    """All registered at one moment: the title decides, not the order of rows."""
    together = _registrations(spark, sf).withColumn("loaded_at", F.lit(1))
    return C.latest_registration(together).select("template_id", "title")


@query("list_templates", f"select template_id, title from {_REGISTERED}")
def list_templates(spark, sf):
    return C.list_templates(C.latest_registration(_registrations(spark, sf)))


@query(
    "resolve_names",
    f"""with r as (select doc_id, case when doc_id % 2 = 0 then doc_id % 30 end as template_id,
        case when doc_id % 2 = 1 then concat(lang, ' ', doc_id % 9) end as title from documents),
      t as (select title, arg_max(template_id, loaded_at) as id from {_REGISTERED} group by 1)
    select r.doc_id, cast(coalesce(g.template_id, t.id) as varchar) as resolved_id,
      coalesce(g.title, t.title) as resolved_title, coalesce(g.template_id, t.id) is not null as is_known
    from r left join {_REGISTERED} g on g.template_id = r.template_id
      left join t on t.title = r.title and r.template_id is null""",
)
def resolve_names(spark, sf):
    templates = C.latest_registration(_registrations(spark, sf))
    key = F.col("doc_id")
    requests = table(spark, sf, "documents").select(
        "doc_id",
        F.when(key % 2 == 0, key % 30).alias("template_id"),
        F.when(key % 2 == 1, F.concat("lang", F.lit(" "), (key % 9).cast("string"))).alias("title"),
    )
    found = C.resolve(requests, templates).drop("template_id", "title")
    return found.withColumn("resolved_id", F.col("resolved_id").cast("string"))


@query(
    "unknown_templates",
    f"""select doc_id, doc_id % 30 as template_id from documents
    where doc_id % 30 not in (select template_id from {_REGISTERED})""",
)
def unknown_templates(spark, sf):
    requests = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 30).alias("template_id")
    )
    return C.unknown_templates(
        requests, C.latest_registration(_registrations(spark, sf))
    ).select("doc_id", "template_id")


@query(
    "unregister",
    f"""select * from {_REGISTERED} where template_id not in (select cast(regexp_extract(source,
      '([0-9]+)', 1) as bigint) from documents where doc_id % 3 = 0 and doc_id % 20 < 7)""",
)
def unregister(spark, sf):
    removed = table(spark, sf, "documents").filter("doc_id % 3 = 0 and doc_id % 20 < 7").select(
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("template_id")
    )
    return C.unregister(C.latest_registration(_registrations(spark, sf)), removed)
