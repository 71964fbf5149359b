"""Sources and sinks, over files that Spark writes from the tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators.contract import build_contracts
from fieldloom.operators.enrich import enrich_from_rows, merge_duplicates, prepare_pairs
from fieldloom.operators.templates import build_field_index, drop_untyped, flatten_template
from fieldloom.plans.layout import QUESTIONNAIRE, TARGET_RULES
from fieldloom.session import shared_folder
from fieldloom.sources.files import read_json_texts, read_key_values, read_pairs, read_templates
from fieldloom.sources.sinks import (
    export_contracts,
    write_long_report,
    write_record_report,
    write_wide_report,
)
from registry import query
from registry.compare_queries import DIFFERENCES, order_differences, order_pair_texts
from registry.inputs import order_flat, order_index, order_templates, table
from registry.reverse_queries import contract_sql
from registry.text_queries import clean_sql, strip_sql


@query(
    "guidelines_csv",
    f"""select cast(conv_id as varchar) as key, cast(turn as varchar) as turn,
      {clean_sql(strip_sql('text'))} as value from conversations""",
)
def guidelines_csv(spark, sf):
    """Conversations written as one CSV per role and read back, texts with their line breaks."""
    path = shared_folder(spark, "guidelines")
    table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("Key"), F.lit("").alias("Unused"),
        F.col("text").alias("Guidelines"),
    ).write.csv(path, header=True, escape='"', quoteAll=True)
    rows = read_key_values(spark, path, "KEY", "guidelines", case_insensitive=True)
    pairs = merge_duplicates(prepare_pairs(rows), "last")
    parts = F.split("key", "/")
    return pairs.select(
        F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("turn"), "value"
    )


def _described() -> str:
    """Keys of a questionnaire with their descriptions, as SQL rows."""
    kinds = {"A_1": "single_select", "A_3": "date", "A_": "instructions", "A_7": "multiple_select", "A_8": "object_array", "B_2": "datetime"}
    rows = [(f"Cust_{k}", TARGET_RULES[t].description) for k, t in kinds.items()]
    rows += [(f"Cust_{k}", None) for k in ("A_2", "A_4", "A_5", "A_6", "B_1")]
    quoted = lambda text: "null" if text is None else "'" + text.replace("'", "''") + "'"
    return ", ".join(f"('{key}', {quoted(text)})" for key, text in rows)


@query(
    "guidelines_enrich",
    f"""with o as (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id, count(*) as n
      from orders group by 1),
    k(key, description) as (values {_described()})
    select template_id, key, case when key = 'Cust_A_6' then concat('first ', (select count(*) from orders), '. second ',
      (select count(*) from orders)) else description end as description from o, k""",
)
def guidelines_enrich(spark, sf):
    """A guideline file with a repeated key, applied to all fields of all questionnaires."""
    path = shared_folder(spark, "guidelines")
    counted = table(spark, sf, "orders").agg(F.count("*").cast("string").alias("n"))
    counted.select(
        F.explode(F.array(F.lit("first "), F.lit("second "), F.lit(""))).alias("which"), "n"
    ).select(
        F.when(F.col("which") == "", " ").otherwise("A_6").alias("Key"),
        F.concat("which", "n").alias("Guidelines"),
    ).coalesce(1).write.csv(path, header=True)
    rows = read_key_values(spark, path, "Key", "Guidelines")
    index, _ = enrich_from_rows(order_index(spark, sf), rows, "concat", prefix="Cust")
    return index.select("template_id", "key", "description")


@query(
    "read_templates",
    """with t as (select distinct cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
      concat('Order ', o_orderpriority) as title from orders)
    select template_id, title, '3' as version, cast(11 as bigint) as fields from t""",
)
def read_templates_query(spark, sf):
    """Questionnaires written one per file and read back."""
    path = shared_folder(spark, "templates")
    order_templates(spark, sf).select(
        "template_id", F.col("doc").alias("value")
    ).repartition("template_id").write.partitionBy("template_id").text(path)
    templates = read_templates(spark, f"{path}/*/", QUESTIONNAIRE, glob="*.txt")
    index = build_field_index(
        drop_untyped(flatten_template(templates, QUESTIONNAIRE)), QUESTIONNAIRE
    )
    counts = index.groupBy("template_id").agg(F.count("*").alias("fields"))
    return templates.select("template_id", "title", "version").join(counts, "template_id")


@query(
    "read_pairs",
    """select case when o_orderkey % 47 = 0 then 'no JSON object' when o_orderkey % 43 = 0 then 'no filled document'
        when o_orderkey % 53 = 0 then 'stored record has no items' end as problem,
      cast(null as varchar) as template_id, cast(null as varchar) as record_id, cast(null as varchar) as patient_id,
      cast(null as varchar) as facility_id, cast(null as varchar) as state, cast(null as varchar) as title,
      cast(null as varchar) as answers
    from orders where o_orderkey % 47 = 0 or o_orderkey % 43 = 0 or o_orderkey % 53 = 0
    union all
    select null, substr(o_orderpriority, 1, 1), cast(case when o_orderkey % 50 = 1 then o_orderkey - 1 else o_orderkey end as varchar),
      cast(o_custkey as varchar), cast(case when o_orderkey % 2 = 0 then o_custkey % 7 + 1 else o_custkey % 10 end as varchar),
      case when o_orderstatus = 'P' then 'signed' else 'draft' end,
      concat('Order ', case when o_orderkey % 19 = 0 then '' else o_orderpriority end),
      concat('Cust_A_1=', case o_orderkey % 3 when 0 then concat('"', o_orderstatus, '"') when 1 then '"Z"' else '' end,
        ';Cust_A_5=', o_custkey, ';Cust_A_6="Clerk ', o_orderkey % 1000, ' ";Cust_B_1=')
    from orders where o_orderkey % 47 > 0 and o_orderkey % 43 > 0 and o_orderkey % 53 > 0""",
)
def read_pairs_query(spark, sf):
    """Record pairs written one per line and read back, good ones with what they hold and others with the reason."""
    path = shared_folder(spark, "pairs")
    order_pair_texts(spark, sf).select(F.col("doc").alias("value")).write.text(path, compression="gzip")
    usable, left_out = read_pairs(spark, path, glob="*.txt.gz", one_per_line=True)
    responses = F.flatten(F.flatten(F.transform(
        "stored.sections", lambda s: F.transform(s["assessment_question_groups"], lambda g: g["assessment_responses"]))))
    answers = F.transform(responses, lambda r: F.concat(
        r["question_key"], F.lit("="), F.coalesce(F.to_json(F.get(r["responses"], F.lit(0))["response_value"]), F.lit(""))))
    good = usable.select(
        F.lit(None).cast("string").alias("problem"), "template_id", "record_id", "patient_id", "facility_id", "state",
        F.get_json_object("internal", "$.table_name").alias("title"), F.array_join(answers, ";").alias("answers"))
    return good.unionByName(left_out.select("problem"), allowMissingColumns=True)


@query(
    "write_report",
    f"""select cast(o_orderkey as varchar) as o_orderkey, field, message from ({DIFFERENCES})""",
)
def write_report(spark, sf):
    """The long report written as CSV and read back."""
    path = shared_folder(spark, "report")
    found = order_differences(spark, sf)
    write_long_report(found.select("o_orderkey", "field", "message"), path)
    return spark.read.csv(path, header=True, escape='"')


@query(
    "record_report",
    f"""select field as fields, message from ({DIFFERENCES})
    where o_orderkey = (select max(o_orderkey) from orders where o_orderkey % 7 = 0)""",
)
def record_report(spark, sf):
    """The report of one record: the last order whose state was changed."""
    path = shared_folder(spark, "report")
    newest = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").agg(F.max("o_orderkey")).first()[0]
    found = order_differences(spark, sf).withColumn("record_key", F.col("o_orderkey").cast("string"))
    write_record_report(found, str(newest), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.withColumnRenamed(str(newest), "message")


@query(
    "wide_csv",
    f"""with d as ({DIFFERENCES}), k as (select max(o_orderkey) as a,
        max(o_orderkey) filter (where o_orderkey % 2 = 0) as b from orders where o_orderkey % 7 = 0)
    select field as fields, max(case when o_orderkey = k.a then message end) as one,
      max(case when o_orderkey = k.b then message end) as two
    from d, k where o_orderkey in (k.a, k.b) group by field""",
)
def wide_csv(spark, sf):
    """The wide report of two records, written as CSV and read back."""
    path = shared_folder(spark, "report")
    keys = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").agg(
        F.max("o_orderkey").alias("a"),
        F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))).alias("b"),
    ).first()
    names = [str(keys["a"]), str(keys["b"])]
    found = order_differences(spark, sf).withColumn("record_key", F.col("o_orderkey").cast("string"))
    chosen = found.filter(F.col("record_key").isin(*names))
    write_wide_report(chosen, sorted(set(names)), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.select("fields", F.col(names[0]).alias("one"), F.col(names[1]).alias("two"))


@query(
    "export_contracts",
    f"""select concat(template_id, '_', replace(replace(title, '-', '_'), ' ', '_'), '_schema.json') as file, contract
      from ({contract_sql()})""",
)
def export_contracts_query(spark, sf):
    """Contracts written as single files; their names and whole texts are read back."""
    path = shared_folder(spark, "contracts")
    export_contracts(
        build_contracts(order_index(spark, sf), order_flat(spark, sf), QUESTIONNAIRE), path
    )
    return read_json_texts(spark, path).select("file", F.rtrim(F.col("doc"), F.lit("\n")).alias("contract"))


@query(
    "mixed_csv",
    """with c as (select role, string_agg(concat(conv_id, '/', turn), '. ' order by conv_id % 3, conv_id, turn) as every
      from conversations group by role),
    o as (select role, conv_id, turn, row_number() over (partition by role order by conv_id % 3, conv_id, turn) as n,
      count(*) over (partition by role) as uses from conversations)
    select c.role as key, concat(a.conv_id, '/', a.turn) as first, concat(z.conv_id, '/', z.turn) as last, c.every as concat
    from c join o a on a.role = c.role and a.n = 1 join o z on z.role = c.role and z.n = z.uses""",
)
def mixed_csv(spark, sf):
    """Three files of different sizes, each with its columns in an order of its own, merged in file order."""
    path = shared_folder(spark, "guidelines")
    rows = table(spark, sf, "conversations").withColumn("part", F.col("conv_id") % 3)
    text = F.concat_ws("/", "conv_id", "turn").alias("Guidelines")
    orders = (["Key", "Guidelines"], ["Guidelines", "Other", "Key"], ["Other", "Key", "More", "Guidelines"])
    for i, names in enumerate(orders):
        own = rows.filter(F.col("part") == i).orderBy("conv_id", "turn").select(
            F.col("role").alias("Key"), text, F.lit("x\ny").alias("Other"), F.lit("").alias("More"))
        own.select(*names).coalesce(1).write.csv(f"{path}/part={i}", header=True, quoteAll=True, escape='"')
    pairs = prepare_pairs(read_key_values(spark, f"{path}/*", "Key", "Guidelines"))
    merged = [merge_duplicates(pairs, p).withColumnRenamed("value", p) for p in ("first", "last", "concat")]
    return merged[0].join(merged[1], "key").join(merged[2], "key")
