"""Cleaning, labels, keys and single answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.functions import values as V
from registry import query
from registry.inputs import spread, table

# RE2 spells the Unicode blanks differently from Java; the set is the same.
_BLANKS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)


def clean_sql(column: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({column},
      '<[^>]+>', '', 'g'), '[\\x{{00}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\\\]', ' ', 'g'),
      '["''\\[\\]{{}}]', '', 'g'), '{_BLANKS}+', ' ', 'g'))"""


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


@query(
    "clean_documents",
    f"select doc_id, {clean_sql('text')} as clean from documents",
)
def clean_documents(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("clean_pages", f"select page_id, {clean_sql('html')} as clean from pages")
def clean_pages(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", T.clean_text(F.col("html")).alias("clean"))


_ODD_NAME = "concat('__ -', p_name, ' (', p_type, ') / ', p_brand, ' é- ')"


@query(
    "clean_names",
    f"""select p_partkey,
      trim(regexp_replace(regexp_replace({_ODD_NAME}, '[^\\pL\\pN_\\s\\-]', '', 'g'),
           '[\\-\\s]+', '_', 'g'), '_') as file_name,
      replace(p_name, ' ', '_') as template_name
    from part""",
)
def clean_names(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        T.file_safe_name(F.expr(_ODD_NAME)).alias("file_name"),
        T.underscored(F.col("p_name")).alias("template_name"),
    )


@query(
    "display_labels",
    """select p_partkey,
      case when p_size % 4 = 0 then p_brand else concat(p_brand, '.', p_type) end as container,
      case when p_size % 7 = 0 then 'Fixed'
           when p_size % 3 = 0 then p_name else concat(p_size, 'a. ', p_name) end as label,
      split_part(case when p_size % 4 = 0 then p_brand else concat(p_brand, '.', p_type) end, '.', 1)
        as section_code
    from part""",
)
def display_labels(spark, sf):
    container = T.container_label(
        F.col("p_brand"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type"))
    )
    ident = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat("p_size", F.lit("a")))
    override = F.when(F.col("p_size") % 7 == 0, "Fixed")
    return table(spark, sf, "part").select(
        "p_partkey",
        container.alias("container"),
        T.property_label(F.col("p_name"), ident, override).alias("label"),
        T.section_code(F.array(F.lit("sections"), container)).alias("section_code"),
    )


@query(
    "split_multi",
    """with lists as (
      select p_partkey, case when p_size % 10 = 0 then null
        else concat(' ', p_type, ' ,, ', p_brand, ',', p_name, ' , ') end as listed from part)
    select p_partkey,
      coalesce(array_to_string(list_filter(list_transform(string_split(listed, ','),
        lambda x: trim(x)), lambda x: x <> ''), '|'), '') as parts,
      cast(coalesce(len(list_filter(list_transform(string_split(listed, ','),
        lambda x: trim(x)), lambda x: x <> '')), 0) as bigint) as n
    from lists""",
)
def split_multi(spark, sf):
    listed = F.when(F.col("p_size") % 10 == 0, None).otherwise(
        F.concat(F.lit(" "), "p_type", F.lit(" ,, "), "p_brand", F.lit(","), "p_name", F.lit(" , "))
    )
    parts = T.split_multi(listed)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("bigint").alias("n")
    )


@query(
    "record_keys",
    """select o_orderkey,
      case when o_orderkey % 9 = 0 then concat('x', o_custkey) else cast(o_custkey as varchar) end
        as patient,
      concat(case when o_orderkey % 7 = 0 then 'None' else cast(o_custkey % 10 as varchar) end, ':',
        case when o_orderkey % 9 = 0 then concat('x', o_custkey) else cast(o_custkey as varchar) end,
        ':', o_orderkey) as record_key
    from orders""",
)
def record_keys(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    patient = T.lenient_id(
        F.when(key % 9 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise(
            F.concat(F.lit(" 00"), "o_custkey")
        )
    )
    facility = F.when(key % 7 != 0, (F.col("o_custkey") % 10).cast("string"))
    return orders.select(
        "o_orderkey",
        patient.alias("patient"),
        T.record_key(T.lenient_id(facility), patient, key.cast("string")).alias("record_key"),
    )


@query(
    "instruction_rows",
    """select p_partkey, key, case when p_size % 2 = 0 then concat(p_type, '. ', p_name)
        else p_name end as const_text,
      case when p_size % 3 = 0 then 'Instructions' else concat(p_size, '.Instructions') end as label
    from (select *, case p_partkey % 4 when 0 then 'Cust_D_' when 1 then 'Cust_D_1_'
        when 2 then 'a_' else 'Cust_D_1' end as key from part)
    where not (p_size % 5 = 0 and key = 'Cust_D_')""",
)
def instruction_rows(spark, sf):
    key = F.expr(
        "case p_partkey % 4 when 0 then 'Cust_D_' when 1 then 'Cust_D_1_' when 2 then 'a_' "
        "else 'Cust_D_1' end"
    )
    number = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string"))
    title = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    ident = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").withColumn("key", key)
    return rows.filter(~T.is_instruction_key(F.col("key"), number)).select(
        "p_partkey",
        "key",
        T.instruction_text(title, F.col("p_name")).alias("const_text"),
        T.instruction_label(ident).alias("label"),
    )


_ANSWER = """case event_id % 9
  when 0 then 'null'
  when 1 then concat('{"response_value":', value, '}')
  when 2 then '{"response_value":0,"response_text":"x"}'
  when 3 then '{}'
  when 4 then concat('["', event_type, '","",null,', value, ',0,true]')
  when 5 then concat('"  ', event_type, ' "')
  when 6 then 'true'
  when 7 then concat('', value)
  else concat('', user_id) end"""


@query(
    "normalize_answers",
    """with shown as (select event_id, case event_id % 9
      when 0 then '' when 1 then case when value = 0 then '' else cast(value as varchar) end
      when 2 then '' when 3 then ''
      when 4 then concat(event_type, case when value = 0 then '' else concat(',', value) end, ',True')
      when 5 then event_type when 6 then 'True' when 7 then cast(value as varchar)
      else cast(user_id as varchar) end as answer from events)
    select event_id, answer, answer = '' as is_empty from shown""",
)
def normalize_answers(spark, sf):
    answer = F.parse_json(F.expr(_ANSWER))
    events = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))
    return events.select("event_id", V.normalize_answer(answer).alias("answer")).select(
        "event_id", "answer", (F.col("answer") == "").alias("is_empty")
    )


_PRIORITY_TEXTS = "array('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED')"
_PRIORITY_CODES = "array('u','h','m','n')"


@query(
    "option_lookup",
    """select o_orderkey,
      case o_orderpriority when '1-URGENT' then 'u' when '2-HIGH' then 'h' when '3-MEDIUM' then 'm'
        when '4-NOT SPECIFIED' then 'n' end as code,
      case o_orderstatus when 'O' then 'open' when 'F' then 'filled' end as text,
      concat(case o_orderpriority when '1-URGENT' then 'u' when '2-HIGH' then 'h'
        when '3-MEDIUM' then 'm' when '4-NOT SPECIFIED' then 'n' else o_orderpriority end, ',',
        case when o_orderkey % 2 = 0 then 'u' else 'other' end) as mapped
    from orders""",
)
def option_lookup(spark, sf):
    texts, codes = F.expr(_PRIORITY_TEXTS), F.expr(_PRIORITY_CODES)
    second = F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT").otherwise("other")
    mapped = V.map_items(F.array(F.col("o_orderpriority"), second), texts, texts, codes)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        V.option_code(F.col("o_orderpriority"), texts, codes).alias("code"),
        V.option_text(
            F.col("o_orderstatus"),
            F.array(F.lit("open"), F.lit("filled")), F.array(F.lit("O"), F.lit("F")),
        ).alias("text"),
        F.array_join(mapped, ",").alias("mapped"),
    )
