"""Answers back to codes and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import reverse as R
from fieldloom.operators.catalog import template_names
from fieldloom.operators.contract import build_contracts
from fieldloom.operators.db_layout import db_records, db_responses, with_metadata
from fieldloom.operators.documents import FORMATTED_COLUMNS, align_documents, field_rows, line_up
from fieldloom.plans.layout import QUESTIONNAIRE, SELECT_MORE, SELECT_ONE, TARGET_RULES
from registry import query
from registry.inputs import lined_orders, order_contracts, order_docs, order_flat, order_index, table, with_records

_ID = "cast(substr(o_orderpriority, 1, 1) as bigint)"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
# Answers of an order as they stand in its document, as JSON.
_PRICE = """case when o_orderkey % 5 = 0 then concat('"', o_totalprice, '"')
  when o_orderkey % 13 = 0 then concat('-', regexp_replace(cast(o_totalprice as varchar), '\\.0$', ''))
  else regexp_replace(cast(o_totalprice as varchar), '\\.0$', '') end"""
_PRICE_TEXT = """case when o_orderkey % 5 = 0 then cast(o_totalprice as varchar)
  when o_orderkey % 13 = 0 then concat('-', o_totalprice) else cast(o_totalprice as varchar) end"""
_DATE = f"""case when o_orderkey % 23 = 0 then 'null'
  when o_orderkey % 17 = 0 then concat('"', replace({_DAY}, '-', '/'), '"')
  else concat('"', {_DAY}, '"') end"""
_CUSTOMER = "concat(o_custkey, case when o_orderkey % 31 = 0 then '.5' else '' end)"
_PLACED = f"""concat('"', {_DAY}, case when o_orderkey % 41 = 0 then ' 25:00' else 'T08:30:00Z' end, '"')"""
_NOTES = """case when o_orderkey % 11 = 0 then 'null'
  else concat('"Clerk ', o_orderkey % 1000, '"') end"""
_STATUS = """case when o_orderstatus = 'P' then '"Status P"' else concat('"', o_orderstatus, '"') end"""
_URGENT = """case when o_orderpriority = '1-URGENT' then '"1"' else '"null"' end"""


def fields(spark, sf):
    return field_rows(align_documents(
        order_docs(spark, sf), order_contracts(spark, sf), QUESTIONNAIRE, columns=FORMATTED_COLUMNS))


def _entries(spark, sf, name, *keys):
    made = R.format_fields(fields(spark, sf), name).filter(F.col("field_key").isin(*keys))
    return made.select("doc_id", "storage_key", "key", "type", "html_type", "value")


def _default_sql(key, kind, value):
    return f"""select o_orderkey as doc_id, '{key}' as storage_key, '{key}' as key, '{kind}' as type,
      cast(null as varchar) as html_type, {value} as value from orders"""


@query(
    "format_by_type",
    " union all ".join(
        [
            _default_sql("Cust_A_2", "number", _PRICE),
            _default_sql("Cust_A_3", "date", _DATE),
            _default_sql("Cust_A_5", "number", _CUSTOMER),
            _default_sql("Cust_A_6", "text", _NOTES),
            _default_sql("Cust_B_1", "text", """concat('"remark ', o_orderkey % 10, '"')"""),
            _default_sql("Cust_B_2", "datetime", _PLACED),
        ]
    ),
)
def format_by_type(spark, sf):
    return _entries(
        spark, sf, "default", "Cust_A_2", "Cust_A_3", "Cust_A_5", "Cust_A_6", "Cust_B_1", "Cust_B_2"
    )


@query("decode_single", _default_sql("Cust_A_1", "radio", _STATUS))
def decode_single(spark, sf):
    return _entries(spark, sf, "default", "Cust_A_1")


@query(
    "decode_multi",
    _default_sql("Cust_A_7", "multi", """concat('["f', o_orderkey % 5, '"',
      case when o_orderkey % 7 < 5 then concat(',"f', o_orderkey % 7, '"') else '' end, ']')"""),
)
def decode_multi(spark, sf):
    return _entries(spark, sf, "default", "Cust_A_7")


@query("checkbox_values", _default_sql("Cust_A_4", "checkbox", _URGENT))
def checkbox_values(spark, sf):
    return _entries(spark, sf, "default", "Cust_A_4")


@query(
    "grid_default",
    """select o_orderkey as doc_id, 'Cust_A_8' as storage_key, 'Cust_A_8' as key, 'table' as type,
      cast(null as varchar) as html_type,
      concat('[', (select string_agg(concat('{"a', i, '_Cust_A_8":"', o_orderstatus, '","b', i,
        '_Cust_A_8":"check ', i, '"}'), ',' order by i) from range(o_orderkey % 5) r(i)), ']') as value
    from orders where o_orderkey % 5 > 0""",
)
def grid_default(spark, sf):
    return _entries(spark, sf, "default", "Cust_A_8")


@query(
    "unpack_multi",
    """select o_orderkey as doc_id, concat('Cust_A_7__', i) as storage_key, 'Cust_A_7' as key,
      'mcs' as type, 'checkbox_multi' as html_type,
      case when i = 0 then concat('"f', o_orderkey % 5, '"')
        when o_orderkey % 7 < 5 then concat('"f', o_orderkey % 7, '"')
        else concat('"Flag ', o_orderkey % 7, '"') end as value
    from orders, unnest([0, 1]) as u(i)""",
)
def unpack_multi(spark, sf):
    return _entries(spark, sf, "ui", "Cust_A_7")


@query(
    "pad_grid",
    """select o_orderkey as doc_id, concat(side, i, '_Cust_A_8') as storage_key,
      concat(side, i, '_Cust_A_8') as key, 'gbdy' as type,
      case side when 'a' then 'combobox' else 'textarea_singleline' end as html_type,
      case when i >= o_orderkey % 5 then '"null"' when side = 'a' then concat('"', o_orderstatus, '"')
        else concat('"check ', i, '"') end as value
    from orders, unnest([0, 1, 2]) as u(i), unnest(['a', 'b']) as s(side)""",
)
def pad_grid(spark, sf):
    return _entries(spark, sf, "ui", "Cust_A_8")


def _ui_sql(key, kind, html, value):
    return f"""select o_orderkey as doc_id, '{key}' as storage_key, '{key}' as key, '{kind}' as type,
      '{html}' as html_type, {value} as value from orders"""


_UI = [
    ("Cust_A_1", "rad", "radio_buttons", _STATUS),
    ("Cust_A_2", "numde", "textarea_singleline", f"""concat('"', {_PRICE_TEXT}, '"')"""),
    ("Cust_A_3", "dte", "text", _DATE),
    ("Cust_A_4", "chk", "checkbox_single", _URGENT),
    ("Cust_A_5", "num", "textarea_singleline", f"""concat('"', {_CUSTOMER}, '"')"""),
    ("Cust_A_6", "txt", "textarea_multiline", _NOTES),
    ("Cust_B_1", "mtxt", "text", """concat('"remark ', o_orderkey % 10, '"')"""),
    ("Cust_B_2", "dttm", "text", _PLACED),
]


@query("format_ui", " union all ".join(_ui_sql(*row) for row in _UI))
def format_ui(spark, sf):
    return _entries(spark, sf, "ui", *(row[0] for row in _UI))


@query(
    "unformatted_fields",
    """select o_orderkey as doc_id, key, kind as source_type from orders,
      (values ('Cust_A_7', 'mcs'), ('Cust_A_8', 'gbdy'), ('Cust_A_', 'inst')) as f(key, kind)""",
)
def unformatted_fields(spark, sf):
    known = {k: v for k, v in R.FORMATTERS["default"].items() if k not in ("mcs", "gbdy", "inst")}
    return R.unformatted(fields(spark, sf), "short", {"short": known}).select(
        "doc_id", "key", "source_type"
    )


def _item(key, kind, html, value):
    return f"""concat('{{"key":"{key}","type":"{kind}","html_type":"{html}","value":', {value}, '}}')"""


_FLAGS = """concat('{"key":"Cust_A_7","type":"mcs","html_type":"checkbox_multi","value":"f',
  o_orderkey % 5, '"},{"key":"Cust_A_7","type":"mcs","html_type":"checkbox_multi","value":"',
  case when o_orderkey % 7 < 5 then 'f' else 'Flag ' end, o_orderkey % 7, '"}')"""
_CELLS = """(select string_agg(concat('{"key":"', side, i, '_Cust_A_8","type":"gbdy","html_type":"',
  case side when 'a' then 'combobox' else 'textarea_singleline' end, '","value":',
  case when i >= o_orderkey % 5 then '"null"' when side = 'a' then concat('"', o_orderstatus, '"')
    else concat('"check ', i, '"') end, '}'), ',' order by i, side)
  from unnest([0, 1, 2]) as u(i), unnest(['a', 'b']) as s(side))"""


@query(
    "reverse_map",
    f"""select o_orderkey as doc_id, {_ID} as template_id,
      concat('{{"doc_type":"assessment","assessment_title":"Order ', o_orderpriority,
        '","assessment_std_id":', {_ID}, ',"sections":{{"A":{{"fields":[', concat_ws(',',
        {", ".join(_item(*row) for row in _UI[:6])}, {_FLAGS}, {_CELLS}),
        '],"state":"draft"}},"B":{{"fields":[', concat_ws(',', {", ".join(_item(*r) for r in _UI[6:])}),
        '],"state":"draft"}}}}}}') as result, cast(null as varchar) as trouble
    from orders""",
)
def reverse_map(spark, sf):
    return R.reverse_map(lined_orders(spark, sf))


def _pair(key, kind, value):
    return f"""concat('"{key}":{{"type":"{kind}","value":', {value}, '}}')"""


_MULTI = """concat('["f', o_orderkey % 5, '"', case when o_orderkey % 7 < 5
  then concat(',"f', o_orderkey % 7, '"') else '' end, ']')"""
_TABLE = """case when o_orderkey % 5 > 0 then concat('"Cust_A_8":{"type":"table","value":[',
  (select string_agg(concat('{"a', i, '_Cust_A_8":"', o_orderstatus, '","b', i,
  '_Cust_A_8":"check ', i, '"}'), ',' order by i) from range(o_orderkey % 5) r(i)), ']}') end"""
_PAIRS_A = ", ".join(
    [
        _pair("Cust_A_1", "radio", _STATUS), _pair("Cust_A_2", "number", _PRICE),
        _pair("Cust_A_3", "date", _DATE), _pair("Cust_A_4", "checkbox", _URGENT),
        _pair("Cust_A_5", "number", _CUSTOMER), _pair("Cust_A_6", "text", _NOTES),
        _pair("Cust_A_7", "multi", _MULTI), _TABLE,
    ]
)
_PAIRS_B = ", ".join(
    [
        _pair("Cust_B_1", "text", """concat('"remark ', o_orderkey % 10, '"')"""),
        _pair("Cust_B_2", "datetime", _PLACED),
    ]
)


@query(
    "group_sections",
    f"""select o_orderkey as doc_id, {_ID} as template_id,
      concat('{{"assessmentDescription":"Order ', o_orderpriority, '","templateId":', {_ID},
        ',"groups":[{{"sectionCode":"A","properties":{{', concat_ws(',', {_PAIRS_A}),
        '}}}},{{"sectionCode":"B","properties":{{', concat_ws(',', {_PAIRS_B}), '}}}}]}}') as result, cast(null as varchar) as trouble
    from orders""",
)
def group_sections(spark, sf):
    return R.reverse_map(
        lined_orders(spark, sf), "default", group_as="groups", properties_key="properties",
        pack_properties_as="object", pack_containers_as="array", title_field="assessmentDescription",
        id_field="templateId", type_field=None,
    )


@query(
    "flat_result",
    f"""select o_orderkey as doc_id, {_ID} as template_id,
      concat('{{"title":"Order ', o_orderpriority, '","data":[{{"properties":{{',
        concat_ws(',', {_PAIRS_A}, {_PAIRS_B}), '}}}}]}}') as result, cast(null as varchar) as trouble
    from orders""",
)
def flat_result(spark, sf):
    return R.reverse_map(
        lined_orders(spark, sf), "default", group_as=None, properties_key="properties",
        pack_properties_as="object", title_field="title", id_field=None, type_field=None,
    )


# ----------------------------------------------------------------------------------- record layout

_UNQUOTED_DATE = f"""case when o_orderkey % 23 = 0 then null
  when o_orderkey % 17 = 0 then replace({_DAY}, '-', '/') else {_DAY} end"""
_RESPONSES = [
    ("A", "1.Header", "Header of the order", "Cust_A_1", "1", "Status",
     "case when o_orderstatus = 'P' then 'Status P' else o_orderstatus end",
     "case when o_orderstatus <> 'P' then concat('Status ', o_orderstatus) end"),
    ("A", "1.Header", "Header of the order", "Cust_A_2", "2", "Total price", _PRICE_TEXT, "null"),
    ("A", "1.Header", "Header of the order", "Cust_A_3", "3", "Order date", _UNQUOTED_DATE, "null"),
    ("A", "1.Header", "Header of the order", "Cust_A_4", "4", "Urgent",
     "case when o_orderpriority = '1-URGENT' then '1' end", "null"),
    ("A", "1.Header", "Header of the order", "Cust_A_", "", "Read the order",
     "concat('Note. Read the order', case when o_orderkey % 29 = 0 then '!' else '' end)", "null"),
    ("A", "2", "Details", "Cust_A_5", "5", "Customer", _CUSTOMER, "null"),
    ("A", "2", "Details", "Cust_A_6", "6", "Clerk notes",
     "case when o_orderkey % 11 > 0 then concat('Clerk ', o_orderkey % 1000) end", "null"),
    ("A", "2", "Details", "Cust_A_7", "7", "Flags",
     "concat('f', o_orderkey % 5, ',', case when o_orderkey % 7 < 5 then 'f' else 'Flag ' end, "
     "o_orderkey % 7)", "null"),
    ("B", "1.Remarks", "Closing", "Cust_B_1", "1", "Remark",
     "concat('remark ', o_orderkey % 10)", "null"),
    ("B", "1.Remarks", "Closing", "Cust_B_2", "2", "Placed at",
     f"concat({_DAY}, case when o_orderkey % 41 = 0 then ' 25:00' else 'T08:30:00Z' end)", "null"),
]


@query(
    "db_responses",
    " union all ".join(
        f"""select o_orderkey as doc_id, {_ID} as template_id, '{s}' as section_code,
          '{g}' as group_number, '{t}' as group_title, '{k}' as question_key, '{n}' as question_number,
          '{q}' as question_text, cast({v} as varchar) as response_value,
          cast({x} as varchar) as response_text from orders"""
        for s, g, t, k, n, q, v, x in _RESPONSES
    ),
)
def db_responses_query(spark, sf):
    return db_responses(fields(spark, sf)).drop("pos")


def _response_sql(k, n, q, v, x):
    return f"""concat('{{"question_key":"{k}","question_number":"{n}","question_text":"{q}","responses":[{{',
      concat_ws(',', '"response_value":"' || ({v}) || '"', '"response_text":"' || ({x}) || '"'), '}}]}}')"""


def _group_sql(section, number, title):
    rows = ", ".join(_response_sql(*r[3:]) for r in _RESPONSES if r[:2] == (section, number))
    return f"""concat('{{"group_number":"{number}","group_title":"{title}","assessment_responses":[',
      concat_ws(',', {rows}), ']}}')"""


@query(
    "db_layout",
    f"""select o_orderkey as doc_id, concat('{{"assessments":{{"items":{{"', o_orderkey,
      '":{{"template_id":', {_ID}, ',"template_name":"Order_', replace(o_orderpriority, ' ', '_'),
      '","patient_id":', o_custkey, ',"assessment_id":', o_orderkey,
      ',"sections":[{{"section_code":"A","assessment_question_groups":[',
      {_group_sql("A", "1.Header", "Header of the order")}, ',', {_group_sql("A", "2", "Details")},
      '],"section_status":"', o_orderstatus, '"}},{{"section_code":"B","assessment_question_groups":[',
      {_group_sql("B", "1.Remarks", "Closing")}, '],"section_status":"', o_orderstatus,
      '"}}],"fac_id":', o_custkey % 10, '}}}}}}}}') as record
    from orders""",
)
def db_layout(spark, sf):
    kept = ("o_custkey", "o_orderstatus")
    docs = order_docs(spark, sf, with_records(spark, sf), keep=tuple(f"_other.{c}" for c in kept))
    lined = line_up(docs, order_contracts(spark, sf), QUESTIONNAIRE, keep=kept)
    records = with_metadata(
        db_records(lined, kept), F.col("doc_id"), F.col("o_custkey"),
        F.replace("table_title", F.lit(" "), F.lit("_")),
        {"section_status": F.col("o_orderstatus")}, {"fac_id": F.col("o_custkey") % 10},
    )
    return records.select("doc_id", F.to_json("record").alias("record"))


@query(
    "template_names",
    """with used as (select source, count(*) as n, min(doc_id) as id from documents group by 1)
    select d.doc_id as template_id, case when u.id is not null then replace(u.source, '.json', '')
      when d.doc_id % 2 = 0 then concat('title of ', d.doc_id) else cast(d.doc_id as varchar) end
      as template_name
    from documents d left join used u on u.id = d.doc_id""",
)
def template_names_query(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("template_id"), "source")
    files = docs.groupBy("source").agg(F.min("template_id").alias("template_id")).select(
        "template_id", F.concat("source", F.lit(".json")).alias("file")
    )
    titles = docs.filter("template_id % 2 = 0").select(
        "template_id", F.concat(F.lit("title of "), "template_id").alias("title")
    )
    return template_names(docs.select("template_id"), files, titles)


# ---------------------------------------------------------------------------------------- contracts

_C = '"additionalProperties":false'
def _closed(properties: str, required: str) -> str:
    return f'{{"type":"object",{_C},"properties":{{{properties}}},"required":[{required}]}}'


def contract_sql() -> str:

    guide = TARGET_RULES["instructions"].description
    grid = TARGET_RULES["object_array"].description.replace("\n", "\\n").replace("'", "''")
    nullable = lambda kind, more="": f'{{"type":["{kind}","null"]{more}}}'
    head = [
        ("1. Status", nullable(
            "string", f',"description":"{SELECT_ONE}","enum":[\', open_states, \',null]')),
        ("2. Total price", nullable("number", ',"minimum":0')),
        ("3. Order date", nullable(
            "string", ',"description":"ISO 8601 date (YYYY-MM-DD)","format":"date"')),
        ("4. Urgent", nullable("boolean")),
        ("Instructions", f'{{"type":"string","description":"{guide}","const":"Note. Read the order"}}'),
    ]
    flags = ",".join(f'"Flag {i}"' for i in range(5))
    body = [
        ("5. Customer", nullable("integer", ',"minimum":0')),
        ("6. Clerk notes", nullable("string")),
        ("7. Flags", nullable(
            "array", f',"description":"{SELECT_MORE}","items":{{"type":["string","null"],'
            f'"enum":[{flags},null]}}')),
        ("8. Checks", f'{{"type":"array","description":"{grid}","maxItems":3,"items":{{"type":"object",'
         f'{_C},"properties":{{"entry":{{"type":"string","enum":[\', states, \']}},"description":'
         '{"type":"string"}},"required":["entry","description"]}}'),
    ]
    tail = [
        ("1. Remark", nullable("string")),
        ("2. Placed at", nullable("string", ',"description":"ISO 8601 date-time '
                                  '(YYYY-MM-DDTHH:MM:SSZ)","format":"date-time"')),
    ]
    inner = lambda rows: _closed(
        ",".join(f'"{n}":{f}' for n, f in rows), ",".join(f'"{n}"' for n, _ in rows))
    under = lambda name, text: _closed(f'"{name}":{text}', f'"{name}"')
    groups = lambda pairs: _closed(
        ",".join(f'"{n}":{under("questions", inner(r))}' for n, r in pairs),
        ",".join(f'"{n}"' for n, _ in pairs))
    area = [
        ("A.Order facts", under("assessmentQuestionGroups", groups([("1.Header", head), ("2", body)]))),
        ("B", under("assessmentQuestionGroups", groups([("1.Remarks", tail)]))),
    ]
    sections = inner(area)
    text = (
        f'{{"type":"object",{_C},"title":"\', title, \'","properties":{{"table_name":{{"type":"string",'
        '"const":"\', title, \'","description":"The name of the table"},"sections":'
        + sections + '},"required":["table_name","sections"]}'
    )
    return f"""with s as (select distinct o_orderpriority, concat('"Status ', o_orderstatus, '"') as q,
        o_orderstatus from orders),
      t as (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
        concat('Order ', o_orderpriority) as title, string_agg(q, ',' order by q) as states,
        string_agg(q, ',' order by q) filter (where o_orderstatus <> 'P') as open_states
        from s group by o_orderpriority)
      select template_id, title, concat('{text}') as contract from t"""


@query("contract_text", contract_sql())
def contract_text(spark, sf):
    return build_contracts(order_index(spark, sf), order_flat(spark, sf), QUESTIONNAIRE)
