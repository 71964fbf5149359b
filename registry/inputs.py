"""Templates and documents made from the given tables.

Every row of ``orders``, ``part`` and so on becomes a document or a template, with faults put
in by key, so that the work of a query grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.documents import contract_rows, line_up
from fieldloom.operators.templates import (
    build_field_index,
    drop_untyped,
    flatten_template,
    read_templates_frame,
)
from fieldloom.plans.layout import QUESTIONNAIRE
from fieldloom.session import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table that a task works on at most, about: documents made of them are much larger than they are.
TASK_ROWS = 10_000


def tasks_for(frame: DataFrame) -> int:
    """How many tasks the rows of a table need: a multiple of the cores, so that none idles while the
    last tasks run. Counting reads footers only."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-frame.count() // (TASK_ROWS * cores))) * cores


def spread(frame: DataFrame) -> DataFrame:
    """Deal the rows of a table evenly over tasks: one for each core at least, and as many as its rows need.

    Splits won't do: they are cut by bytes of columns that are small and well packed, and whole row groups
    fall to one of them, so that a task gets millions of rows while others get none.
    """
    return frame.repartition(tasks_for(frame))


def with_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every order next to customer and state of each order with its key, as ``_other``.

    Joined while rows are narrow: the texts made of them are much larger, and need no shuffle of their own.
    """
    orders = table(spark, sf, "orders")
    record_of = orders.select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("_other"))
    return orders.repartition(tasks_for(orders), "o_orderkey").join(record_of, "o_orderkey")


# ------------------------------------------------------------------ one template per priority

_QUESTION = (
    "struct<questionKey:string,questionNumber:string,questionText:string,questionTitle:string,"
    "questionType:string,length:int,responseOptions:array<struct<responseText:string,"
    "responseValue:string>>>"
)


def question(key, number, text, kind, title=None, length=None, options=None):
    lit = lambda v: F.lit(v)
    none = F.lit(None)
    return F.struct(
        lit(key).alias("questionKey"), lit(number).alias("questionNumber"),
        lit(text).alias("questionText"), lit(title).alias("questionTitle"),
        lit(kind).alias("questionType"), lit(length).alias("length"),
        (none if options is None else options).alias("responseOptions"),
    ).cast(_QUESTION)


def group(number, text, title, *questions):
    return F.struct(
        F.lit(number).cast("string").alias("groupNumber"), F.lit(text).cast("string").alias("groupText"),
        F.lit(title).cast("string").alias("groupTitle"), F.array(*questions).alias("questions"),
    )


def section(code, description, *groups):
    return F.struct(
        F.lit(code).cast("string").alias("sectionCode"),
        F.lit(description).cast("string").alias("sectionDescription"),
        F.array(*groups).alias("assessmentQuestionGroups"),
    )


def order_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template per order priority; the options are the states its orders have."""
    states = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", "o_orderstatus")
        .agg(F.count("*").alias("n"))
        .groupBy("o_orderpriority")
        .agg(F.array_sort(F.collect_list("o_orderstatus")).alias("states"))
    )
    option = lambda s: F.struct(
        F.concat(F.lit("Status <b>"), s, F.lit("</b>")).alias("responseText"),
        s.alias("responseValue"),
    )
    all_states = F.transform("states", option)
    open_states = F.transform(F.filter("states", lambda s: s != "P"), option)
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda i: F.struct(
            F.concat(F.lit("Flag "), i.cast("string")).alias("responseText"),
            F.concat(F.lit("f"), i.cast("string")).alias("responseValue"),
        ),
    )
    sections = F.array(
        section(
            "A", "Order <i>facts</i>",
            group(
                "1", "Header", "Header of the order",
                question("Cust_A_1", "1", "Status", "rad", options=open_states),
                question("Cust_A_2", "2", "Total price", "numde"),
                question("Cust_A_3", "3", "Order date", "dte"),
                question("Cust_A_4", "4", "Urgent", "chk"),
                question("Cust_A_", "", "Read the order", "inst", title="Note"),
            ),
            group(
                "2", None, "Details",
                question("Cust_A_5", "5", "Customer", "num"),
                question("Cust_A_6", "6", "Clerk notes", "txt", length=80),
                question("Cust_A_7", "7", "Flags", "mcs", options=flags),
                question("Cust_A_8", "8", "Checks", "gbdy", length=3, options=all_states),
                question("Cust_A_9", "9", "", None),
                question("Cust_A_10", "10", "Pressure", "bp"),
            ),
            group("", "Nameless", None, question("Cust_A_11", "11", "Lost", "txt")),
        ),
        section(
            "B", None,
            group(
                "1", "Remarks", "Closing",
                question("Cust_B_1", "1", "Remark", "mtxt"),
                question("Cust_B_2", "2", "Placed at", "dttm"),
            ),
        ),
        section(None, "No code", group("1", None, None, question("Cust_C_1", "1", "Gone", "txt"))),
    )
    return states.select(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("template_id"),
        F.to_json(
            F.struct(
                F.concat(F.lit("Order <b>"), "o_orderpriority", F.lit("</b>")).alias(
                    "assessmentDescription"
                ),
                F.substring("o_orderpriority", 1, 1).cast("bigint").alias("templateId"),
                F.lit("3").alias("templateVersion"),
                sections.alias("sections"),
            )
        ).alias("doc"),
    )


def order_flat(spark: SparkSession, sf: str) -> DataFrame:
    templates = read_templates_frame(order_templates(spark, sf), QUESTIONNAIRE)
    return drop_untyped(flatten_template(templates, QUESTIONNAIRE))


def order_index(spark: SparkSession, sf: str) -> DataFrame:
    return build_field_index(order_flat(spark, sf), QUESTIONNAIRE)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored_once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """Contracts are made once per session and kept as a table in the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = stored(make(), name)
    return _STORED[key]


def order_contracts(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        flat = order_flat(spark, sf)
        return contract_rows(build_field_index(flat, QUESTIONNAIRE), flat)

    return stored_once(spark, sf, "order_contracts", make)


# ------------------------------------------------------------------------ one document per order

# Faults by key, as (column name, condition). The checking SQL repeats them.
ORDER_DOC_SQL = """
concat(
  '{"table_name":"Order ', case when o_orderkey % 19 = 0 then '' else o_orderpriority end,
  '","sections":{"A.Order facts":{"assessmentQuestionGroups":{"1.Header":{"questions":{',
  '"1. Status":"Status ', o_orderstatus, '",',
  '"2. Total price":', case when o_orderkey % 5 = 0 then concat('"', price, '"')
                            when o_orderkey % 13 = 0 then concat('-', price) else price end, ',',
  '"3. Order date":', case when o_orderkey % 23 = 0 then 'null'
                           when o_orderkey % 17 = 0 then concat('"', replace(day, '-', '/'), '"')
                           else concat('"', day, '"') end, ',',
  '"4. Urgent":', case when o_orderpriority = '1-URGENT' then 'true' else 'false' end, ',',
  '"Instructions":"Note. Read the order', case when o_orderkey % 29 = 0 then '!' else '' end, '"',
  '}},"2":{"questions":{',
  '"5. Customer":', o_custkey, case when o_orderkey % 31 = 0 then '.5' else '' end, ',',
  case when o_orderkey % 11 = 0 then ''
       else concat('"6. Clerk notes":"Clerk ', o_orderkey % 1000, '",') end,
  '"7. Flags":["Flag ', o_orderkey % 5, '","Flag ', o_orderkey % 7, '"],',
  '"8. Checks":[', array_join(transform(
      slice(array(0, 1, 2, 3), 1, cast(o_orderkey % 5 as int)),
      i -> concat('{"entry":"Status ', o_orderstatus, '","description":"check ', i, '"}')), ','),
  ']}}}},"B":{"assessmentQuestionGroups":{"1.Remarks":{"questions":{',
  '"1. Remark":"remark ', o_orderkey % 10, '",',
  '"2. Placed at":"', day, case when o_orderkey % 41 = 0 then ' 25:00' else 'T08:30:00Z' end, '"',
  case when o_orderkey % 37 = 0 then ',"surplus":1' else '' end,
  '}}}}}}')
"""


def order_docs(spark: SparkSession, sf: str, orders: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, template_id, doc``: every order as a filled document. ``orders`` are the rows of the table,
    dealt over tasks already, with columns to ``keep``."""
    return (
        (spread(table(spark, sf, "orders")) if orders is None else orders)
        .withColumn("price", F.col("o_totalprice").cast("string"))
        .withColumn("day", F.substring(F.col("o_orderdate").cast("string"), 1, 10))
        .select(
            F.col("o_orderkey").alias("doc_id"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("template_id"),
            F.expr(ORDER_DOC_SQL).alias("doc"), *keep,
        )
    )


def lined_orders(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return line_up(order_docs(spark, sf), order_contracts(spark, sf), QUESTIONNAIRE, keep=keep)
