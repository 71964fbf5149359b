"""Key/value texts, enriched descriptions, overrides and locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import enrich as E
from fieldloom.operators import locks as L
from fieldloom.operators.contract import field_fragment, json_text
from fieldloom.operators.documents import CHECKED_COLUMNS, align_documents, contract_rows
from fieldloom.operators.validate import validate
from fieldloom.plans.layout import QUESTIONNAIRE, SELECT_ONE, TARGET_RULES
from registry import query
from registry.inputs import order_docs, order_flat, order_index, spread, table
from registry.template_queries import part_index
from registry.text_queries import clean_sql, strip_sql


def _turns(spark, sf, blanks=False):
    """Turns of conversations as key/value rows; some are blank."""
    value = F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")) if blanks else F.col("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("row_no"),
        value.alias("value"),
    )


@query(
    "dedup_last",
    "select cast(conv_id as varchar) as key, arg_max(text, turn) as value from conversations group by 1",
)
def dedup_last(spark, sf):
    return E.merge_duplicates(_turns(spark, sf), "last")


@query(
    "dedup_first",
    "select cast(conv_id as varchar) as key, arg_min(text, turn) as value from conversations group by 1",
)
def dedup_first(spark, sf):
    return E.merge_duplicates(_turns(spark, sf), "first")


@query(
    "dedup_concat",
    """with t as (select cast(conv_id as varchar) as key, turn,
        case when turn % 3 = 1 then '' else text end as value from conversations),
      s as (select key, min(turn) filter (where value <> '') as first from t group by 1)
    select t.key, coalesce(string_agg(value, '. ' order by turn) filter (where turn >= first), '')
      as value from t join s using (key) group by 1""",
)
def dedup_concat(spark, sf):
    return E.merge_duplicates(_turns(spark, sf, blanks=True), "concat", chunk=2)


@query(
    "dedup_errors",
    """with n as (select conv_id, turn, count(*) over (partition by conv_id) as uses,
        row_number() over (partition by conv_id order by turn) as rn from conversations)
    select cast(conv_id as varchar) as key, uses, turn as repeated_at from n
    where rn = 2""",
)
def dedup_errors(spark, sf):
    return E.duplicate_keys(_turns(spark, sf))


_RAW_KEY = """case when turn % 5 = 4 then concat(' ', chr(9), ' ')
  when conv_id % 2 = 0 then concat('Cust_', conv_id, ' ') else concat(' ', conv_id) end"""


@query(
    "guideline_pipeline",
    f"""with p as (select {strip_sql(_RAW_KEY)} as k, turn, {strip_sql('text')} as v from conversations),
      c as (select case when starts_with(k, 'Cust_') then k else concat('Cust_', k) end as key, turn,
        {clean_sql('v')} as value from p where k <> '')
    select key, string_agg(value, '. ' order by turn) as value from c group by 1""",
)
def guideline_pipeline(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.expr(_RAW_KEY.replace("chr(9)", "char(9)")).alias("key"), F.col("turn").alias("row_no"),
        F.col("text").alias("value"),
    )
    return E.merge_duplicates(E.prepare_pairs(rows, prefix="Cust"), "concat")


def _brand_notes(spark, sf):
    """A note per brand, reduced from all parts; half of the keys do not belong to a field."""
    notes = table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_partkey").alias("low"), F.count("*").alias("n")
    )
    return notes.select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("P"), "low").alias("key"), F.concat(
                    "p_brand", F.lit(" has "), "n").alias("value")),
                F.struct(F.concat(F.lit("none-"), "p_brand").alias("key"), F.lit("x").alias("value")),
            )
        ).alias("e")
    ).select("e.*")


_PART_FIELDS = f"""(select p_partkey as template_id, concat('P', p_partkey) as key, p_brand, p_size, p_type,
    case p_type when 'PROMO' then '{SELECT_ONE}' when 'SMALL' then 'ISO 8601 date (YYYY-MM-DD)' end
      as description
  from part where p_size % 11 <> 0 and p_size % 13 <> 0 and p_size % 17 <> 0 and p_type <> 'STANDARD'
    and not (p_type = 'PROMO' and p_size % 3 = 0))"""
# Further fields of every part, which no note and no override is for.
_OTHER_FIELDS = f"""select p_partkey as template_id, 'Q' as key, case when p_size % 4 = 0 then 'Main' else 'Other' end as label,
    cast(null as varchar) as description from part
  union all select p_partkey, 'G', 'Instructions', '{TARGET_RULES["instructions"].description}' from part
  union all select p_partkey, 'B', unnest(['Box', 'left', p_brand]), null from part"""
_NOTES = """(select concat('P', min(p_partkey)) as key, concat(p_brand, ' has ', count(*)) as note
  from part group by p_brand)"""


@query(
    "enrich",
    f"""select f.template_id, f.key, 'Main' as label, case when note is null then description
        when description is null then note else concat(description, chr(10), chr(10), note) end
        as description
    from {_PART_FIELDS} f left join {_NOTES} n using (key)
    union all {_OTHER_FIELDS}""",
)
def enrich(spark, sf):
    fields = E.enrich_fields(part_index(spark, sf), _brand_notes(spark, sf))
    return fields.select("template_id", "key", F.col("property_key").alias("label"), "description")


@query(
    "enrich_unmatched",
    f"""select key from {_NOTES} where key not in (select key from {_PART_FIELDS})
    union all select distinct concat('none-', p_brand) from part""",
)
def enrich_unmatched(spark, sf):
    return E.unmatched_keys(part_index(spark, sf), _brand_notes(spark, sf))


# ---------------------------------------------------------------------------------- overrides

def _part_overrides(spark, sf):
    """An override per part: descriptions changed in each way, values locked, some of it wrong."""
    size = F.col("p_size")
    text = (
        F.when(size % 9 == 0, '{"description":"New","description_op":"append"}')
        .when(size % 9 == 1, '{"description":"New","description_op":"prepend"}')
        .when(size % 9 == 2, '{"description":"New"}')
        .when(size % 9 == 3, '{"description":null}')
        .when(size % 9 == 4, '{"description":"New","description_op":"swap"}')
        .when(size % 9 == 5, '{"value":1,"const":2}')
        .when(size % 9 == 6, '"text"')
        .when(size % 9 == 7, F.concat(F.lit('{"value":'), size, F.lit("}")))
        .otherwise(F.concat(F.lit('{"const":"'), "p_brand", F.lit('","description":"Locked"}')))
    )
    rows = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("template_id"), F.concat(F.lit("P"), "p_partkey").alias("key"),
        text.alias("override"),
    )
    return L.parse_overrides(rows)


@query(
    "override_descriptions",
    f"""select template_id, key, 'Main' as label, case when p_size % 9 = 3 then null when p_size % 9 = 2 then 'New'
        when p_size % 9 = 8 then 'Locked'
        when p_size % 9 > 2 or description is null then
          case when p_size % 9 < 2 then 'New' else description end
        when p_size % 9 = 0 then concat(description, ' New') else concat('New ', description) end
        as description
    from {_PART_FIELDS}
    union all {_OTHER_FIELDS}""",
)
def override_descriptions(spark, sf):
    fields = L.override_descriptions(part_index(spark, sf), _part_overrides(spark, sf))
    return fields.select("template_id", "key", F.col("property_key").alias("label"), "description")


_LOCK_ERROR = """case when p_size % 9 = 7 then
    case when p_type in ('LARGE', 'PROMO', 'SMALL') then 'type: integer is not string/null' end
  when p_type in ('MEDIUM', 'ECONOMY') then 'type: string is not number/null'
  when p_type = 'SMALL' then concat('custom: no ISO date: ', p_brand) end"""


@query(
    "override_errors",
    f"""select p.p_partkey as template_id, concat('P', p.p_partkey) as key,
        case p_size % 9 when 4 then 'unknown description_op' when 5 then 'both value and const'
          when 6 then 'override is no object' else 'no such field' end as problem
      from part p where p_size % 9 in (4, 5, 6) or not exists
        (select 1 from {_PART_FIELDS} f where f.template_id = p.p_partkey)
    union all select template_id, key, {_LOCK_ERROR} from {_PART_FIELDS}
      where p_size % 9 in (7, 8) and {_LOCK_ERROR} is not null""",
)
def override_errors(spark, sf):
    lint = L.override_lint(part_index(spark, sf), _part_overrides(spark, sf))
    return lint.select("template_id", "key", "problem")


@query(
    "lock_check",
    f"""select template_id, key, case when p_size % 9 = 7 then 'integer' else 'string' end as types,
      case when p_size % 9 = 7 then cast(p_size as varchar) else concat('"', p_brand, '"') end
        as const_value,
      case when p_size % 9 = 7 then concat('{{"type":"integer",', '"const":', p_size, ',"enum":[',
          p_size, ']}}')
        else concat('{{"type":"string",', case when description is null then '' else
          concat('"description":"', description, '",') end, '"const":"', p_brand, '","enum":["',
          p_brand, '"]}}') end as fragment
    from {_PART_FIELDS} where p_size % 9 in (7, 8) and {_LOCK_ERROR} is null""",
)
def lock_check(spark, sf):
    locked = L.lock_fields(part_index(spark, sf), _part_overrides(spark, sf))
    return locked.filter("lock is not null").select(
        "template_id", "key", F.array_join("json_types", "/").alias("types"),
        F.col("lock_const").alias("const_value"), field_fragment(locked).alias("fragment"),
    )


def _order_locks(spark, sf, *locks):
    """The given locks for every questionnaire, with a value taken from its orders."""
    newest = table(spark, sf, "orders").groupBy(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("template_id")
    ).agg(F.max("o_orderkey").alias("k"))
    made = F.array(
        *(F.struct(F.lit(key).alias("key"), text.alias("override")) for key, text in locks)
    )
    rows = newest.select("template_id", F.explode(made).alias("e")).select("template_id", "e.*")
    return L.parse_overrides(rows)


@query(
    "lock_lists",
    """with t as (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
      max(o_orderkey) as k from orders group by 1)
    select template_id, 'Cust_A_7' as key, cast(3 as int) as size, 'string/null' as item_types,
      case when k % 2 = 0 then '"Flag 0",null' else '"Flag 1",null' end as item_enum from t
    union all select template_id, 'Cust_A_8', 1, null, null from t""",
)
def lock_lists(spark, sf):
    flag = F.concat(F.lit('"Flag '), F.col("k") % 2, F.lit('"'))
    locks = _order_locks(
        spark, sf,
        ("Cust_A_7", F.concat(F.lit('{"value":['), flag, F.lit(",null,"), flag, F.lit("]}"))),
        ("Cust_A_8", F.lit('{"value":[{"entry":"Status O","description":"d"}]}')),
        ("Cust_A_1", F.lit('{"value":["Status O"]}')),
    )
    locked = L.lock_fields(order_index(spark, sf), locks)
    return locked.filter("lock_type = 'array'").select(
        "template_id", "key", F.col("lock_size").alias("size"),
        F.array_join("item_types", "/").alias("item_types"),
        F.array_join("item_enum", ",").alias("item_enum"),
    )


@query(
    "lock_objects",
    """with t as (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
      max(o_orderkey) as k from orders group by 1)
    select template_id, 'Cust_A_8' as key, child, 'string' as child_type,
      case child when 'entry' then '"Status O"' else concat('"order ', k, '"') end as child_const
    from t, unnest(['entry', 'description']) as u(child)""",
)
def lock_objects(spark, sf):
    locks = _order_locks(
        spark, sf,
        ("Cust_A_8", F.concat(
            F.lit('{"value":[{"entry":"Status O","description":'),
            json_text(F.concat(F.lit("order "), "k")), F.lit("}]}"))),
    )
    return L.lock_children(L.lock_fields(order_index(spark, sf), locks))


@query(
    "validate_locked",
    """select o_orderkey as doc_id, '1. Status' as field, concat('Status ', o_orderstatus, ' is not "Status O"') as message
      from orders where o_orderstatus <> 'O'
    union all select o_orderkey, '1. Remark', concat('remark ', o_orderkey % 10, ' is not "remark 3"') from orders
      where o_orderkey % 10 <> 3""",
)
def validate_locked(spark, sf):
    """Orders against contracts whose status and remark are locked: every other value is an error."""
    locks = _order_locks(
        spark, sf, ("Cust_A_1", F.lit('{"value":"Status O"}')), ("Cust_B_1", F.lit('{"value":"remark 3"}')))
    index = L.lock_fields(order_index(spark, sf), locks)
    contracts = contract_rows(index, order_flat(spark, sf))
    found = validate(align_documents(order_docs(spark, sf), contracts, QUESTIONNAIRE, columns=CHECKED_COLUMNS)).filter("rule = 'lock'")
    return found.select("doc_id", F.regexp_extract("path", r"questions\.(.*)$", 1).alias("field"), "message")


@query(
    "lock_contract",
    """with t as (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id, max(o_orderkey) as k from orders group by 1),
    f as (select template_id, concat('"properties":{"a":{"type":"integer","const":', k, '},"b":{"type":"object",',
      '"properties":{"c":{"type":"string","const":"x"}},"required":["c"],"additionalProperties":false}},"required":["a","b"],"additionalProperties":false}') as inside from t)
    select template_id, 'Cust_A_8' as key, concat('{"type":"array","minItems":1,"maxItems":1,"items":{"type":"object",', inside, '}') as fragment from f
    union all select template_id, 'Cust_B_1', concat('{"type":"object",', inside) from f""",
)
def lock_contract(spark, sf):
    """Contract texts of fields that are locked to an object, and to a list of one."""
    held = F.concat(F.lit('{"b":{"c":"x"},"a":'), "k", F.lit("}"))
    locks = _order_locks(
        spark, sf, ("Cust_A_8", F.concat(F.lit('{"value":['), held, F.lit("]}"))),
        ("Cust_B_1", F.concat(F.lit('{"value":'), held, F.lit("}"))))
    # The fields take any object here, so that only the lock speaks.
    free = order_index(spark, sf).filter("key in ('Cust_A_8', 'Cust_B_1')").withColumns({
        "json_types": F.array(F.lit("object"), F.lit("array")), "enum_on": F.lit(None).cast("string"),
        "description": F.lit(None).cast("string")})
    locked = L.lock_fields(free, locks)
    return locked.select("template_id", "key", field_fragment(locked).alias("fragment"))
