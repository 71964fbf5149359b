"""Two versions of the same records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import compare as C
from fieldloom.plans.reconcile import keyed_pairs, reconcile
from fieldloom.sources.files import parse_pairs
from fieldloom.plans.layout import QUESTIONNAIRE
from registry import query
from registry.inputs import order_contracts, order_docs, table, with_records

_FIELDS = ("status", "price", "priority")


def order_versions(spark, sf):
    """Orders as text, and a second version: other states and blank prices by key."""
    left = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_totalprice").cast("string"))
        .alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    key = F.col("o_orderkey")
    right = left.filter(key % 17 != 0).select(
        "o_orderkey",
        F.when(key % 7 == 0, "X").otherwise(F.col("status")).alias("status"),
        F.when(key % 11 == 0, None).otherwise(F.col("price")).alias("price"),
        "priority",
    )
    return left, right


DIFFERENCES = """select o_orderkey, field, left_value, right_value, 'value' as kind,
    concat('"', right_value, '" != "', left_value, '"') as message from (
  select o_orderkey, 'status' as field, o_orderstatus as left_value,
    case when o_orderkey % 17 = 0 then '' when o_orderkey % 7 = 0 then 'X' else o_orderstatus end
      as right_value from orders
  union all select o_orderkey, 'price', case when o_orderkey % 13 = 0 then ''
      else cast(o_totalprice as varchar) end,
    case when o_orderkey % 17 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then ''
      else cast(o_totalprice as varchar) end from orders
  union all select o_orderkey, 'priority', o_orderpriority,
    case when o_orderkey % 17 = 0 then '' else o_orderpriority end from orders)
  where left_value <> '' and left_value <> right_value"""


def order_differences(spark, sf):
    return C.compare_rows(*order_versions(spark, sf), ["o_orderkey"], _FIELDS)


@query("diff_orders", DIFFERENCES)
def diff_orders(spark, sf):
    return order_differences(spark, sf).drop("left_text", "right_text")


@query(
    "diff_summary",
    f"""select o_orderkey, count(*) as differences, cast(0 as bigint) as text_only
    from ({DIFFERENCES}) group by 1""",
)
def diff_summary(spark, sf):
    return C.difference_counts(order_differences(spark, sf), ["o_orderkey"])


@query(
    "run_summary",
    f"""select (select count(*) from orders where o_orderstatus <> 'P') as processed,
      (select count(*) from orders where o_orderstatus = 'P') as skipped,
      (select count(*) from ({DIFFERENCES}) join orders using (o_orderkey)
        where o_orderstatus <> 'P') as differences""",
)
def run_summary(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    kept = C.state_filter(orders, ["O", "F"])
    left, right = order_versions(spark, sf)
    compared = C.compare_rows(
        left.filter("status in ('O', 'F')"), right, ["o_orderkey"], _FIELDS
    )
    return C.run_summary(kept, compared, orders.filter("state = 'P'"))


@query(
    "diff_long",
    """select o_orderkey, 'code' as field, o_orderstatus as left_value,
      case when o_orderkey % 7 = 0 then 'X' when o_orderkey % 17 = 0 then '' else o_orderstatus end
        as right_value, 'left' as left_text,
      case when o_orderkey % 17 = 0 and o_orderkey % 7 <> 0 then '' when o_orderkey % 3 = 0 then 'left'
        when o_orderkey % 3 = 1 then '' else 'right' end as right_text,
      case when o_orderkey % 7 = 0 or o_orderkey % 17 = 0 then 'value' else 'text' end as kind
    from orders where o_orderkey % 7 = 0 or o_orderkey % 17 = 0 or o_orderkey % 3 = 2""",
)
def diff_long(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    left = orders.select(
        "o_orderkey", F.lit("code").alias("field"), F.col("o_orderstatus").alias("value"),
        F.lit("left").alias("text"),
    )
    right = orders.filter((key % 17 != 0) | (key % 7 == 0)).select(
        "o_orderkey", F.lit("code").alias("field"),
        F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("value"),
        F.when(key % 3 == 0, "left").when(key % 3 == 1, "").otherwise("right").alias("text"),
    )
    return C.compare_fields(left, right, ["o_orderkey"]).drop("message")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "diff_wide",
    f"""select cast(c_nationkey as varchar) as field, """
    + ", ".join(
        f"""coalesce(max(case when o_orderpriority = '{p}' then concat('"', n + 1, '" != "', n, '"')
          end), '') as "{p}" """
        for p in _PRIORITIES
    )
    + """ from (select c_nationkey, o_orderpriority, count(*) as n from orders
        join customer on c_custkey = o_custkey group by 1, 2) where n % 2 = 0 group by 1""",
)
def diff_wide(spark, sf):
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    counts = joined.groupBy(
        F.col("o_orderpriority").alias("record_key"), F.col("c_nationkey").cast("string").alias("field")
    ).agg(F.count("*").alias("n"))
    left = counts.select("record_key", "field", F.col("n").cast("string").alias("value"),
                         F.lit("").alias("text"))
    right = counts.select(
        "record_key", "field",
        F.when(F.col("n") % 2 == 0, F.col("n") + 1).otherwise(F.col("n")).cast("string").alias("value"),
        F.lit("").alias("text"),
    )
    return C.wide_report(C.compare_fields(left, right, ["record_key"]), _PRIORITIES)


@query(
    "state_filter",
    "select o_orderkey, o_orderstatus as state from orders where o_orderstatus in ('O', 'F')",
)
def state_filter(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return C.state_filter(orders, ["O", "F"])


# ---------------------------------------------------------------------------------- whole flow


def order_pair_texts(spark, sf):
    """Every order as a pair file: its filled document and a stored record with other values.

    Two files in a row share their record now and then; some lack a part.
    """
    docs = order_docs(spark, sf, with_records(spark, sf), keep=("_other.o_custkey", "_other.o_orderstatus"))
    key = F.col("doc_id")
    record = F.when(key % 50 == 1, key - 1).otherwise(key)
    status = F.when(key % 3 == 0, F.concat(
        F.lit('{"response_value":"'), "o_orderstatus", F.lit('","response_text":"Other"}')
    )).when(key % 3 == 1, '{"response_value":"Z"}').otherwise("{}")
    row = lambda code, number, text, body: F.concat(
        F.lit(f'{{"question_key":"{code}","question_number":"{number}","question_text":"{text}",'
              '"responses":['), body, F.lit("]}")
    )
    answers = F.concat_ws(
        ",",
        row("Cust_A_1", "1", "Status", status),
        row("Cust_A_5", "5", "Customer", F.concat(F.lit('{"response_value":'), "o_custkey", F.lit("}"))),
        row("Cust_A_6", "6", "Clerk notes", F.concat(
            F.lit('{"response_value":"Clerk '), key % 1000, F.lit(' "}'))),
        row("Cust_B_1", "1", "Remark", F.lit("")),
    )
    stored = F.concat(
        F.lit('{"sections":[{"assessment_question_groups":[{"assessment_responses":['), answers,
        F.lit(']}]}],"fac_id":'), F.col("o_custkey") % 10, F.lit("}"),
    )
    filled = F.when(key % 43 == 0, "[]").otherwise(
        F.concat(F.lit('[{"internal_json":'), "doc", F.lit("}]"))
    )
    facility = F.when(key % 2 == 0, F.concat(F.lit('"facility_id":"0'), F.col("o_custkey") % 7 + 1,
                                             F.lit('",'))).otherwise("")
    text = F.when(key % 47 == 0, "{broken").otherwise(
        F.concat(
            F.lit('{"chart":{"schema_id":"'), "template_id", F.lit('","table_name":"Order",'),
            F.lit('"state":"'), F.when(F.col("o_orderstatus") == "P", "signed").otherwise("draft"),
            F.lit('","json_internal_filled":'), filled, F.lit('},"stored":{'), facility,
            F.lit('"ehr_patient_id":"'), "o_custkey", F.lit('","assessments":{"items":'),
            F.when(key % 53 == 0, "{}").otherwise(
                F.concat(F.lit('{"'), record, F.lit('":'), stored, F.lit("}"))),
            F.lit("}}}"),
        )
    )
    return docs.select(
        F.concat(F.lit("f"), F.lpad(key.cast("string"), 12, "0")).alias("file"), text.alias("doc")
    )


_PAIR_SQL = """
  p as (select *, o_orderkey as k,
    case when o_orderkey % 50 = 1 then o_orderkey - 1 else o_orderkey end as record_id,
    case when o_orderkey % 2 = 0 then o_custkey % 7 + 1 else o_custkey % 10 end as facility
    from orders),
  keyed as (select *, concat(case when k % 2 = 1 and facility = 0 then '0'
      else cast(facility as varchar) end, ':', o_custkey, ':', record_id) as record_key from p
    where k % 47 <> 0 and k % 43 <> 0 and k % 53 <> 0)"""


@query(
    "pair_problems",
    """select concat('f', lpad(cast(o_orderkey as varchar), 12, '0')) as file,
      case when o_orderkey % 47 = 0 then 'no JSON object' when o_orderkey % 43 = 0
        then 'no filled document' else 'stored record has no items' end as problem
    from orders where o_orderkey % 47 = 0 or o_orderkey % 43 = 0 or o_orderkey % 53 = 0""",
)
def pair_problems(spark, sf):
    return parse_pairs(order_pair_texts(spark, sf)).filter("problem is not null").select(
        "file", "problem"
    )


@query(
    "pair_heads",
    f"""with {_PAIR_SQL} select concat('f', lpad(cast(k as varchar), 12, '0')) as file,
      substr(o_orderpriority, 1, 1) as template_id,
      case when o_orderstatus = 'P' then 'signed' else 'draft' end as state,
      cast(record_id as varchar) as record_id, cast(o_custkey as varchar) as patient_id,
      cast(facility as varchar) as facility_id from keyed""",
)
def pair_heads(spark, sf):
    parsed = parse_pairs(order_pair_texts(spark, sf)).filter("problem is null")
    return parsed.select("file", "template_id", "state", "record_id", "patient_id", "facility_id")


def _usable(spark, sf):
    return parse_pairs(order_pair_texts(spark, sf)).filter("problem is null").drop("problem")


@query(
    "latest_pairs",
    f"""with {_PAIR_SQL}, r as (select record_key, k, row_number() over (partition by record_key
        order by k desc) as rn from keyed where o_orderstatus <> 'P')
    select record_key, concat('f', lpad(cast(k as varchar), 12, '0')) as file from r where rn = 1""",
)
def latest_pairs(spark, sf):
    return keyed_pairs(_usable(spark, sf)).select("record_key", "file")


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    "reconcile_flow",
    f"""with {_PAIR_SQL},
      r as (select *, row_number() over (partition by record_key order by k desc) as rn
        from keyed where o_orderstatus <> 'P'),
      f as (
        select record_key, 'Cust_A_1:Status' as field, o_orderstatus as l,
          case k % 3 when 0 then o_orderstatus when 1 then 'Z' else '' end as r,
          concat('Status ', o_orderstatus) as lt, case when k % 3 = 0 then 'Other' else '' end as rt
          from r where rn = 1
        union all select record_key, 'Cust_A_2:Total price',
          concat(case when k % 13 = 0 and k % 5 <> 0 then '-' else '' end, o_totalprice), '', '', ''
          from r where rn = 1
        union all select record_key, 'Cust_A_3:Order date', case when k % 23 = 0 then ''
            when k % 17 = 0 then replace({_DAY}, '-', '/') else {_DAY} end, '', '', ''
          from r where rn = 1
        union all select record_key, 'Cust_A_4:Urgent',
          case when o_orderpriority = '1-URGENT' then '1' else '' end, '', '', '' from r where rn = 1
        union all select record_key, 'Cust_A_5:Customer',
          concat(o_custkey, case when k % 31 = 0 then '.5' else '' end), cast(o_custkey as varchar),
          '', '' from r where rn = 1
        union all select record_key, 'Cust_A_6:Clerk notes', case when k % 11 = 0 then ''
            else concat('Clerk ', k % 1000) end, concat('Clerk ', k % 1000), '', '' from r where rn = 1
        union all select record_key, 'Cust_A_7:Flags', concat('f', k % 5, ',',
            case when k % 7 < 5 then 'f' else 'Flag ' end, k % 7), '', '', '' from r where rn = 1
        union all select record_key, 'Cust_B_1:Remark', concat('remark ', k % 10), '', '', ''
          from r where rn = 1
        union all select record_key, 'Cust_B_2:Placed at', concat({_DAY},
            case when k % 41 = 0 then ' 25:00' else 'T08:30:00Z' end), '', '', ''
          from r where rn = 1)
    select record_key, field, case when l <> r then 'value' else 'text' end as kind,
      case when l <> r then concat('"', r, '" != "', l, '"') else
        concat('"', r, '" (text: "', rt, '") != "', l, '" (text: "', lt, '")') end as message
    from f where l <> '' and (l <> r or (lt <> '' and rt <> '' and lt <> rt))""",
)
def reconcile_flow(spark, sf):
    found = reconcile(_usable(spark, sf), order_contracts(spark, sf), QUESTIONNAIRE)
    return found.select("record_key", "field", "kind", "message")


@query(
    "reconcile_problems",
    """select cast(o_orderkey as varchar) as record_key, case o_orderkey % 4 when 0 then 'unknown template'
      when 1 then 'unreadable' else 'unknown template' end as message
    from orders where o_orderkey % 4 < 3""",
)
def reconcile_problems(spark, sf):
    """Pairs whose documents have a template that nobody knows, or no template number, or no object as text."""
    kind = F.col("o_orderkey") % 4
    pairs = table(spark, sf, "orders").filter(kind < 3).select(
        F.col("o_orderkey").cast("string").alias("file"), F.lit("draft").alias("state"),
        F.lit("f").alias("facility_id"), F.lit("p").alias("patient_id"), F.col("o_orderkey").cast("string").alias("record_id"),
        F.when(kind == 0, "99").when(kind == 2, "abc").otherwise(F.substring("o_orderpriority", 1, 1)).alias("template_id"),
        F.when(kind == 1, '["a list"]').otherwise('{"table_name":"x"}').alias("internal"),
        F.lit(None).cast(f"struct<{C.STORED_RECORD}>").alias("stored"),
    )
    found = reconcile(pairs, order_contracts(spark, sf), QUESTIONNAIRE).filter("kind = 'problem'")
    return found.select(F.get(F.split("record_key", ":"), F.lit(2)).alias("record_key"), "message")
