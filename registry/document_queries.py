"""Documents: flattening, checking, verdicts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fieldloom.functions.dates import is_iso_date, is_iso_datetime
from fieldloom.operators.compare import flatten_records
from fieldloom.operators.contract import field_fragment, json_text
from fieldloom.operators.documents import (
    CHECKED_COLUMNS,
    align_documents,
    contract_rows,
    flatten_documents,
    read_path,
)
from fieldloom.operators.templates import (
    build_field_index,
    flatten_template,
    read_templates_frame,
)
from fieldloom.operators.validate import text_rule, validate, verdicts
from fieldloom.plans.layout import QUESTIONNAIRE, FieldType, PropertyNames, TemplateLayout
from registry import query
from registry.inputs import order_contracts, order_docs, order_flat, spread, stored_once, table

# ------------------------------------------------------------------------------ flat event forms

EVENT = TemplateLayout(
    schema_name="table_name",
    schema_id="table_id",
    prop=PropertyNames("fields", "field_id", "field_name", "field_type", options="field_options"),
    types={
        "text": FieldType("string"),
        "whole": FieldType("integer"),
        "real": FieldType("number"),
        "pick": FieldType("single_select", True),
        "many": FieldType("multiple_select", True),
        "grid": FieldType("object_array", True),
        "percent": FieldType("percent"),
        "note": FieldType("string"),
    },
)


def one_template(frame, doc):
    """A template made from a table that was reduced to one row."""
    return frame.select(F.lit(1).cast("bigint").alias("template_id"), doc.alias("doc"))


def contracts_of(templates, layout):
    flat = flatten_template(read_templates_frame(templates, layout), layout)
    return contract_rows(build_field_index(flat, layout), flat)


def event_contracts(spark, sf):
    """One form for all events; the choices are the event types there are."""
    return stored_once(spark, sf, "event_contracts", lambda: _event_contracts(spark, sf))


def _event_contracts(spark, sf):
    kinds = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    listed = kinds.agg(F.array_sort(F.collect_list("event_type")).alias("kinds"))
    known = F.to_json(F.filter("kinds", lambda k: k != "error"))
    field = lambda name, kind, extra="": (
        f'{{"field_id":"{name}","field_name":"{name}","field_type":"{kind}"{extra}'
    )
    doc = F.concat(
        F.lit('{"table_name":"events","fields":['),
        F.lit(field("type", "pick", ',"field_options":')), known, F.lit("},"),
        F.lit(field("value", "real") + "}," + field("user", "whole") + "}," + field("k", "whole") + "},"),
        F.lit(field("tags", "many", ',"field_options":')), known, F.lit("},"),
        F.lit(field("rows", "grid", ',"length":2,"field_options":')), known, F.lit("},"),
        F.lit(field("share", "percent") + "}]}"),
    )
    return contracts_of(one_template(listed, doc), EVENT)


def event_docs(spark, sf):
    """Every event as a filled form; values are quoted, fractional or odd by key."""
    key = F.col("event_id")
    value = F.col("value").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.col("event_type")
    tags = F.when(key % 6 == 0, "null").when(
        key % 4 == 0, F.concat(F.lit('["view",null,7,"'), kind, F.lit('"]'))
    ).otherwise(F.concat(F.lit('["view","'), kind, F.lit('"]')))
    row = lambda entry, text: F.concat(
        F.lit('{"entry":"'), entry, F.lit(f'","description":{text}}}')
    )
    rows = (
        F.when(key % 10 == 0, "null")
        .when(key % 10 == 1, F.concat(F.lit("["), row(kind, '"a"'), F.lit(","), row(kind, '"b"'),
                                      F.lit(","), row(F.lit("view"), '"c"'), F.lit("]")))
        .when(key % 10 == 2, '[{"entry":"view"}]')
        .when(key % 10 == 3, '[{"entry":"view","description":"x","more":1}]')
        .when(key % 10 == 4, '[{"entry":"view","description":5,"more":2},3,{"entry":9}]')
        .otherwise(F.concat(F.lit("["), row(kind, '"d"'), F.lit("]")))
    )
    doc = F.concat(
        F.lit('{"table_name":"events","fields":{"type":'), quoted(kind),
        F.lit(',"value":'), F.when(key % 5 == 0, quoted(value)).otherwise(value),
        F.lit(',"user":'),
        F.when(key % 3 == 0, F.concat("user_id", F.lit(".0"))).when(key % 7 == 0, "true")
        .otherwise(F.col("user_id").cast("string")),
        F.lit(',"k":'), F.get_json_object("props", "$.k"),
        F.when(key % 8 == 0, F.lit(".25")).otherwise(""),
        F.lit(',"tags":'), tags, F.lit(',"rows":'), rows,
        F.lit(',"share":'), value, F.lit("}}"),
    )
    events = spread(table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", "value", "props"))
    return events.select(
        key.alias("doc_id"), F.lit(1).cast("bigint").alias("template_id"), doc.alias("doc")
    )


def event_errors(spark, sf):
    return validate(align_documents(event_docs(spark, sf), event_contracts(spark, sf), EVENT, columns=CHECKED_COLUMNS))


@query(
    "doc_flatten",
    """select event_id as doc_id, 'fields' as path, label, text from (
      select event_id, 'type' as label, concat('"', event_type, '"') as text from events
      union all select event_id, 'k',
        concat(json_extract_string(props, '$.k'), case when event_id % 8 = 0 then '.25' else '' end)
        from events
      union all select event_id, 'user', case when event_id % 3 = 0 then cast(user_id as varchar)
        when event_id % 7 = 0 then 'true' else cast(user_id as varchar) end from events
      union all select event_id, 'tags', case when event_id % 6 = 0 then 'null'
        when event_id % 4 = 0 then concat('["view",null,7,"', event_type, '"]')
        else concat('["view","', event_type, '"]') end from events
      union all select event_id, 'value', case when event_id % 5 = 0 then concat('"', value, '"')
        else regexp_replace(cast(value as varchar), '\\.0$', '') end from events
      union all select event_id, 'share', regexp_replace(cast(value as varchar), '\\.0$', '') from events
      union all select event_id, 'rows', case event_id % 10 when 0 then 'null'
        when 1 then concat('[{"description":"a","entry":"', event_type, '"},{"description":"b","entry":"', event_type,
          '"},{"description":"c","entry":"view"}]')
        when 2 then '[{"entry":"view"}]'
        when 3 then '[{"description":"x","entry":"view","more":1}]'
        when 4 then '[{"description":5,"entry":"view","more":2},3,{"entry":9}]'
        else concat('[{"description":"d","entry":"', event_type, '"}]') end from events)""",
)
def doc_flatten(spark, sf):
    rows = flatten_documents(event_docs(spark, sf), EVENT)
    return rows.select(
        "doc_id", F.array_join("level_keys", "/").alias("path"),
        F.col("property_key").alias("label"), F.to_json("value").alias("text"),
    )


@query(
    "path_values",
    """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
      case when event_id % 2 = 0 then event_type end as deep, cast(null as varchar) as absent
    from events""",
)
def path_values(spark, sf):
    inner = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit('{"it\'s":{"a.b":"'), "event_type", F.lit('"}}')),
    ).otherwise("7")
    doc = F.parse_json(F.concat(F.lit('{"p":'), "props", F.lit(',"x":'), inner, F.lit("}")))
    events = spread(table(spark, sf, "events").select("event_id", "event_type", "props"))
    return events.select("event_id", doc.alias("doc")).select(
        "event_id",
        read_path(F.col("doc"), ["p", "k"]).cast("bigint").alias("k"),
        read_path(F.col("doc"), ["x", "it's", "a.b"]).cast("string").alias("deep"),
        read_path(F.col("doc"), ["x", "nowhere"]).cast("string").alias("absent"),
    )


@query(
    "db_flatten",
    """select o_orderkey, field, value, text from (
      select o_orderkey, 'Cust_A_1:Status' as field, o_orderstatus as value,
        case when o_orderkey % 2 = 0 then 'x' else '' end as text from orders
      union all select o_orderkey, 'Cust_A_2:',
        case when o_orderkey % 3 = 0 then '' else o_orderpriority end, '' from orders
      union all select o_orderkey, 'Cust_B_1:Customer', cast(o_custkey as varchar), '' from orders)""",
)
def db_flatten(spark, sf):
    from fieldloom.operators.compare import STORED_RECORD

    even = F.when(F.col("o_orderkey") % 2 == 0, ',"response_text":"x"').otherwise("")
    body = F.concat(
        F.lit('{"sections":[{"section_code":"A","assessment_question_groups":[{"group_number":"1",'
              '"assessment_responses":[{"question_key":"Cust_A_1","question_number":"1",'
              '"question_text":"Status","responses":[{"response_value":"'), "o_orderstatus",
        F.lit('"'), even, F.lit('},{"response_value":"second"}]},{"question_key":"Cust_A_",'
              '"question_text":"Read","responses":[{}]},{"question_key":"Cust_A_2","responses":'),
        F.when(F.col("o_orderkey") % 3 == 0, "[]").otherwise(
            F.concat(F.lit('[{"response_value":" '), "o_orderpriority", F.lit(' "}]'))),
        F.lit('}]}]},{"section_code":"B","assessment_question_groups":[{"assessment_responses":['
              '{"question_key":"","responses":[]},{"question_key":"Cust_B_1","question_text":'
              '"Customer","responses":[{"response_value":'), "o_custkey", F.lit("}]}]}]}]}"),
    )
    orders = spread(table(spark, sf, "orders"))
    records = orders.select("o_orderkey", F.from_json(body, STORED_RECORD).alias("record"))
    return flatten_records(records, ["o_orderkey"])


# ------------------------------------------------------------------------------------- validation

_HEAD = "sections.A.Order facts.assessmentQuestionGroups.1.Header.questions."
_BODY = "sections.A.Order facts.assessmentQuestionGroups.2.questions."
_TAIL = "sections.B.assessmentQuestionGroups.1.Remarks.questions."
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

ORDER_VIOLATIONS = f"""
  select o_orderkey as doc_id, cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
    cast(phase as int) as phase, path, rule, message from (
  select *, 1 as phase, 'table_name' as path, 'const' as rule, 'Order ' as message from orders
    where o_orderkey % 19 = 0
  union all select *, 1, '{_HEAD}1. Status', 'enum', 'Status P' from orders where o_orderstatus = 'P'
  union all select *, 1, '{_HEAD}2. Total price', 'type', 'string is not number/null' from orders
    where o_orderkey % 5 = 0
  union all select *, 1, '{_HEAD}2. Total price', 'minimum',
      concat('-', regexp_replace(cast(o_totalprice as varchar), '\\.0$', ''))
    from orders where o_orderkey % 13 = 0 and o_orderkey % 5 <> 0
  union all select *, 2, '{_HEAD}3. Order date', 'custom',
      concat('no ISO date: ', replace({_DAY}, '-', '/'))
    from orders where o_orderkey % 17 = 0 and o_orderkey % 23 <> 0
  union all select *, 1, '{_HEAD}Instructions', 'const', 'Note. Read the order!' from orders
    where o_orderkey % 29 = 0
  union all select *, 1, '{_BODY}5. Customer', 'type', 'number is not integer/null' from orders
    where o_orderkey % 31 = 0
  union all select *, 1, '{_BODY}6. Clerk notes', 'required', 'is missing' from orders
    where o_orderkey % 11 = 0
  union all select *, 1, '{_BODY}7. Flags', 'item', concat('1 is no option: Flag ', o_orderkey % 7) from orders
    where o_orderkey % 7 >= 5
  union all select *, 1, '{_BODY}8. Checks', 'grid', 'more rows than 3' from orders
    where o_orderkey % 5 = 4
  union all select *, 2, '{_TAIL}2. Placed at', 'custom',
      concat('no ISO date and time: ', {_DAY}, ' 25:00')
    from orders where o_orderkey % 41 = 0
  union all select *, 1, '{_TAIL}surplus', 'additional', 'was unexpected' from orders
    where o_orderkey % 37 = 0)"""


def aligned_orders(spark, sf):
    return align_documents(order_docs(spark, sf), order_contracts(spark, sf), QUESTIONNAIRE, columns=CHECKED_COLUMNS)


@query("validate_orders", ORDER_VIOLATIONS)
def validate_orders(spark, sf):
    return validate(aligned_orders(spark, sf))


# Fragments of the caller's own, made from the length of a question or fixed.
_OWN_RULES = {
    "string": replace(QUESTIONNAIRE.rules["string"], fragment=lambda p: F.when(
        p["length"].try_cast("int") > 0, F.concat(F.lit('{"maxLength":'), (p["length"].try_cast("int") / 10).cast("int"), F.lit("}")))),
    "positive_integer": replace(QUESTIONNAIRE.rules["positive_integer"], fragment=lambda p: F.lit('{"multipleOf":7,"minimum":100,"unit":"no."}')),
    "multiple_select": replace(QUESTIONNAIRE.rules["multiple_select"], fragment=lambda p: F.lit('{ "minItems" : 3 }')),
    "datetime": replace(QUESTIONNAIRE.rules["datetime"], fragment=lambda p: F.lit('{"pattern":"T0[0-9]:.*Z$"}')),
}
OWN_FRAGMENTS = replace(QUESTIONNAIRE, rules={**QUESTIONNAIRE.rules, **_OWN_RULES})


def _own_index(spark, sf):
    flat = order_flat(spark, sf)
    return build_field_index(flat, OWN_FRAGMENTS), flat


@query(
    "own_fragments",
    """with o as (select distinct cast(substr(o_orderpriority, 1, 1) as bigint) as template_id from orders)
    select template_id, key, fragment from o, (values
      ('Cust_A_5', '{"type":["integer","null"],"multipleOf":7,"minimum":100,"unit":"no."}'),
      ('Cust_A_6', '{"type":["string","null"],"maxLength":8}'),
      ('Cust_B_1', '{"type":["string","null"]}'),
      ('Cust_B_2', '{"type":["string","null"],"description":"ISO 8601 date-time (YYYY-MM-DDTHH:MM:SSZ)","format":"date-time","pattern":"T0[0-9]:.*Z$"}')
    ) f(key, fragment)""",
)
def own_fragments(spark, sf):
    """Contract fragments of the fields whose type has a builder, less those with options."""
    index, _ = _own_index(spark, sf)
    built = index.filter(F.col("target_type").isin(*_OWN_RULES) & F.col("enum_on").isNull())
    return built.select("template_id", "key", field_fragment(built).alias("fragment"))


_OWN = "select o_orderkey, cast(substr(o_orderpriority, 1, 1) as bigint), cast(1 as int)"


@query(
    "validate_own",
    f"""select * from ({ORDER_VIOLATIONS})
    union all {_OWN}, '{_BODY}5. Customer', 'multipleOf', cast(o_custkey as varchar) from orders
      where o_custkey % 7 <> 0 and o_orderkey % 31 <> 0
    union all {_OWN}, '{_BODY}5. Customer', 'minimum', cast(o_custkey as varchar) from orders
      where o_custkey < 100 and o_orderkey % 31 <> 0
    union all {_OWN}, '{_BODY}6. Clerk notes', 'maxLength', concat('Clerk ', o_orderkey % 1000) from orders
      where o_orderkey % 11 <> 0 and o_orderkey % 1000 >= 100
    union all {_OWN}, '{_BODY}7. Flags', 'minItems', concat('["Flag ', o_orderkey % 5, '","Flag ', o_orderkey % 7, '"]') from orders
    union all {_OWN}, '{_TAIL}2. Placed at', 'pattern', concat({_DAY}, ' 25:00') from orders where o_orderkey % 41 = 0""",
)
def validate_own(spark, sf):
    """All violations of orders when types have fragments of the caller's own."""
    contracts = contract_rows(*_own_index(spark, sf))
    return validate(align_documents(order_docs(spark, sf), contracts, OWN_FRAGMENTS, columns=CHECKED_COLUMNS))


@query(
    "validate_verdict",
    f"""with v as ({ORDER_VIOLATIONS}), g as (
      select doc_id, phase, count(*) as n, string_agg(concat(path, ': ', rule, ': ', message), '|'
        order by concat(path, ': ', rule, ': ', message)) as errors from v group by 1, 2)
    select o.o_orderkey as doc_id, cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
      a.n is null and b.n is null as is_valid, coalesce(a.n, b.n, 0) as error_count,
      coalesce(a.errors, b.errors, '') as errors
    from orders o left join (select * from g where phase = 1) a on a.doc_id = o_orderkey
      left join (select * from g where phase = 2) b on b.doc_id = o_orderkey""",
)
def validate_verdict(spark, sf):
    rows = verdicts(aligned_orders(spark, sf))
    return rows.withColumn("errors", F.array_join("errors", "|"))


@query(
    "missing_fields",
    f"select doc_id, path from ({ORDER_VIOLATIONS}) where rule = 'required'",
)
def missing_fields(spark, sf):
    return validate_orders(spark, sf).filter("rule = 'required'").select("doc_id", "path")


@query(
    "extra_fields",
    f"select doc_id, path from ({ORDER_VIOLATIONS}) where rule = 'additional'",
)
def extra_fields(spark, sf):
    return validate_orders(spark, sf).filter("rule = 'additional'").select("doc_id", "path")


@query(
    "validate_const",
    f"select doc_id, path, message from ({ORDER_VIOLATIONS}) where rule = 'const'",
)
def validate_const(spark, sf):
    return validate_orders(spark, sf).filter("rule = 'const'").select("doc_id", "path", "message")


@query(
    "validate_types",
    """select event_id as doc_id, 'fields.value' as path, 'string is not number/null' as message
      from events where event_id % 5 = 0
    union all select event_id, 'fields.user', 'boolean is not integer/null' from events
      where event_id % 7 = 0 and event_id % 3 <> 0
    union all select event_id, 'fields.k', 'number is not integer/null' from events
      where event_id % 8 = 0
    union all select event_id, 'fields.rows', 'null is not array' from events
      where event_id % 10 = 0""",
)
def validate_types(spark, sf):
    errors = event_errors(spark, sf).filter("rule = 'type'")
    return errors.select("doc_id", "path", "message")


@query(
    "validate_ranges",
    """select event_id as doc_id, 'fields.share' as path, 'maximum' as rule,
      regexp_replace(cast(value as varchar), '\\.0$', '') as message from events where value > 100
    union all select event_id, 'fields.share', 'minimum',
      regexp_replace(cast(value as varchar), '\\.0$', '') from events where value < 0""",
)
def validate_ranges(spark, sf):
    errors = event_errors(spark, sf).filter("rule in ('minimum', 'maximum')")
    return errors.select("doc_id", "path", "rule", "message")


@query(
    "validate_choice",
    """select event_id as doc_id, 'fields.type' as path, event_type as message from events
    where event_type = 'error'""",
)
def validate_choice(spark, sf):
    errors = event_errors(spark, sf).filter("rule = 'enum'")
    return errors.select("doc_id", "path", "message")


@query(
    "validate_multi",
    """select event_id as doc_id, 'fields.tags' as path, unnest(['2 is no text: 7', '2 is no option: 7']) as message
      from events where event_id % 4 = 0 and event_id % 6 <> 0
    union all select event_id, 'fields.tags',
      concat(case when event_id % 4 = 0 then '3' else '1' end, ' is no option: ', event_type) from events
      where event_id % 6 <> 0 and event_type = 'error'""",
)
def validate_multi(spark, sf):
    errors = event_errors(spark, sf).filter("rule = 'item'")
    return errors.select("doc_id", "path", "message")


@query(
    "validate_grid",
    """select event_id as doc_id, 'more rows than 2' as message from events where event_id % 10 = 1
    union all select event_id, concat('row 0 entry not among the options: ', event_type) from events
      where event_id % 10 not in (0, 2, 3, 4) and event_type = 'error'
    union all select event_id, concat('row 1 entry not among the options: ', event_type) from events
      where event_id % 10 = 1 and event_type = 'error'
    union all select event_id, 'row 0 lacks description' from events where event_id % 10 = 2
    union all select event_id, 'row 0 has other keys' from events where event_id % 10 = 3
    union all select event_id, unnest(['row 0 description is no text', 'row 0 has other keys', 'row 1 is no object',
      'row 2 entry is no text', 'row 2 entry not among the options: 9', 'row 2 lacks description'])
      from events where event_id % 10 = 4
    union all select event_id, 'more rows than 2' from events where event_id % 10 = 4""",
)
def validate_grid(spark, sf):
    errors = event_errors(spark, sf).filter("rule = 'grid'")
    return errors.select("doc_id", "message")


_ODD_DAY = """case o_orderkey % 12 when 0 then concat(day, 'T10:20:30Z') when 1 then day
  when 2 then replace(day, '-', '') when 3 then concat(day, 'T10:20') when 4 then concat(day, 'T')
  when 5 then concat(substr(day, 1, 5), '13-01') when 6 then concat(day, ' 23:59:59.5+02:00')
  when 8 then concat(substr(day, 1, 4), '-W', substr(day, 6, 2), '-7') when 9 then concat(substr(day, 1, 4), 'W09')
  when 10 then concat(replace(day, '-', ''), 'T102030Z') when 11 then concat(substr(day, 1, 4), '-W54')
  else concat(day, 'T24:61') end"""


@query(
    "validate_dates",
    """with d as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
    t as (select o_orderkey, """ + _ODD_DAY + """ as text from d)
    select o_orderkey, text, o_orderkey % 12 in (0, 1, 2, 3, 6, 8, 9, 10) as is_date,
      o_orderkey % 12 in (0, 1, 2, 3, 6, 8, 9, 10) as is_datetime from t""",
)
def validate_dates(spark, sf):
    days = spread(table(spark, sf, "orders")).select(
        "o_orderkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day")
    )
    texts = days.select("o_orderkey", F.expr(_ODD_DAY).alias("text"))
    return texts.select(
        "o_orderkey", "text", is_iso_date(F.col("text")).alias("is_date"),
        is_iso_datetime(F.col("text")).alias("is_datetime"),
    )


TEXT_FORM = TemplateLayout(
    schema_name="table_name",
    prop=PropertyNames("fields", "field_id", "field_name", "field_type"),
    types={"note": FieldType("string"), "count": FieldType("integer")},
)


@query(
    "custom_rule",
    """select doc_id, cast(2 as int) as phase, 'fields.text' as path,
      concat('text of ', length(text), ' characters') as message from documents where length(text) > 500
    union all select doc_id, 2, 'fields.size', concat('odd size ', n_chars) from documents
      where n_chars % 2 = 1""",
)
def custom_rule(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "n_chars", "source"))
    # A form of its own for each source.
    number = F.regexp_extract("source", r"(\d+)", 1).cast("bigint")
    templates = docs.select(number.alias("template_id"), "source").distinct().select(
        "template_id",
        F.concat(
            F.lit('{"table_name":"'), "source",
            F.lit('","fields":[{"field_id":"t","field_name":"text","field_type":"note"},'
                  '{"field_id":"s","field_name":"size","field_type":"count"}]}'),
        ).alias("doc"),
    )
    filled = docs.select(
        "doc_id", number.alias("template_id"),
        F.concat(
            F.lit('{"table_name":"'), "source", F.lit('","fields":{"text":'), json_text(F.col("text")),
            F.lit(',"size":'), "n_chars", F.lit("}}"),
        ).alias("doc"),
    )

    def long_text(value, rule):
        length = F.length(F.try_variant_get(value, "$", "string"))
        return F.when(
            length > 500, F.concat(F.lit("text of "), length.cast("string"), F.lit(" characters"))
        )

    def odd(value, rule):
        number = F.try_variant_get(value, "$", "bigint")
        return F.when(number % 2 == 1, F.concat(F.lit("odd size "), number.cast("string")))

    aligned = align_documents(filled, contracts_of(templates, TEXT_FORM), TEXT_FORM)
    errors = validate(aligned, {"string": long_text, "integer": odd})
    return errors.select("doc_id", "phase", "path", "message")


@query(
    "raising_rule",
    """select doc_id, 'fields.text' as path, concat('rule failed: ValueError: ', lang) as message from documents
      where lang in ('de', 'fr')
    union all select doc_id, 'fields.text', 'Spanish' from documents where lang = 'es'""",
)
def raising_rule(spark, sf):
    """A caller's function that fails for some values: those are errors, the rest is checked."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")

    def judge(text: str) -> str | None:
        if text in ("de", "fr"):
            raise ValueError(text)
        return "Spanish" if text == "es" else None

    forms = docs.groupBy(F.lit(1).cast("bigint").alias("template_id")).agg(F.lit(
        '{"table_name":"form","fields":[{"field_id":"t","field_name":"text","field_type":"note"}]}').alias("doc"))
    filled = docs.select("doc_id", F.lit(1).cast("bigint").alias("template_id"), F.concat(
        F.lit('{"table_name":"form","fields":{"text":"'), "lang", F.lit('"}}')).alias("doc"))
    aligned = align_documents(filled, contracts_of(forms, TEXT_FORM), TEXT_FORM)
    return validate(aligned, {"string": text_rule(judge)}).select("doc_id", "path", "message")
