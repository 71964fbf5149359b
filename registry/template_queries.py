"""Templates to fields, types, options and lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import catalog as C
from fieldloom.operators import templates as T
from fieldloom.plans.layout import (
    TARGET_RULES,
    FieldType,
    Level,
    PropertyNames,
    TargetRule,
    TemplateLayout,
)
from registry import query
from registry.inputs import order_index, spread, table

# ------------------------------------------------------------------- nested template per customer

CUSTOMER = TemplateLayout(
    schema_name="title",
    schema_id="id",
    levels=(Level("areas", "code", "label"), Level("blocks", "no", "caption", "heading")),
    prop=PropertyNames("items", "key", "text", "kind", id="no"),
    types={"t": FieldType("string"), "n": FieldType("number")},
    id_in_label=True,
)


def customer_templates(spark, sf):
    """Every customer is a template: an area per segment, and one whose code is at times blank."""
    c = spread(table(spark, sf, "customer"))
    item = lambda i, kind: F.struct(
        F.concat(F.lit(f"k{i}_"), "c_custkey").alias("key"), F.lit(str(i)).alias("no"),
        F.concat(F.lit(f"<i>Item {i}</i> of "), "c_name").alias("text"), F.lit(kind).alias("kind"),
    )
    block = lambda no, caption, *items: F.struct(
        F.lit(no).alias("no"), F.lit(caption).alias("caption"), F.lit(f"H{no}").alias("heading"),
        F.array(*items).alias("items"),
    )
    blank_code = F.when(F.col("c_custkey") % 5 != 0, "Z")
    areas = F.array(
        F.struct(
            F.concat(F.lit("N"), "c_nationkey").alias("code"), F.col("c_mktsegment").alias("label"),
            F.array(block("1", "First", item(1, "t"), item(2, "n")), block("2", "", item(3, "t")))
            .alias("blocks"),
        ),
        F.struct(
            blank_code.alias("code"), F.lit(None).cast("string").alias("label"),
            F.array(block("1", "Last", item(4, "n")), block("", "Lost", item(5, "n"))).alias("blocks"),
        ),
    )
    return c.select(
        F.to_json(
            F.struct(F.col("c_name").alias("title"), F.col("c_custkey").alias("id"), areas.alias("areas"))
        ).alias("doc")
    )


def _customer_flat(spark, sf):
    head = T.read_templates_frame(customer_templates(spark, sf), CUSTOMER)
    return T.flatten_template(head, CUSTOMER)


@query(
    "template_flatten",
    """with c as (select c_custkey as template_id, c_name, concat('N', c_nationkey) as code,
        concat('N', c_nationkey, '.', c_mktsegment) as area from customer),
    f as (
      select template_id, 5 as pos, 1 as i, code, area, '1.First' as block, c_name from c
      union all select template_id, 6, 2, code, area, '1.First', c_name from c
      union all select template_id, 9, 3, code, area, '2', c_name from c
      union all select template_id, 14, 4, 'Z', 'Z', '1.Last', c_name from c
        where template_id % 5 <> 0)
    select template_id, cast(pos as int) as pos, concat('k', i, '_', template_id) as key,
      concat('areas/', area, '/blocks/', block, '/items') as path,
      concat(i, '. Item ', i, ' of ', c_name) as label, code as section_code,
      case when i <= 2 then 'H1' when i = 3 then 'H2' else 'H1' end as group_title,
      'code' as key_field
    from f""",
)
def template_flatten(spark, sf):
    index = T.build_field_index(_customer_flat(spark, sf), CUSTOMER)
    return index.select(
        "template_id", "pos", "key", F.array_join("level_keys", "/").alias("path"),
        F.col("property_key").alias("label"), "section_code", "group_title", "key_field",
    )


@query(
    "container_count",
    """select c_custkey as template_id, 'areas' as container, cast(2 as bigint) as raw_count,
      cast(case when c_custkey % 5 = 0 then 1 else 2 end as bigint) as used_count from customer""",
)
def container_count(spark, sf):
    head = T.read_templates_frame(customer_templates(spark, sf), CUSTOMER)
    return T.container_counts(head, CUSTOMER)


# ----------------------------------------------------------------------------- flat template per part

PART = TemplateLayout(
    schema_name="table_name",
    schema_id="table_id",
    prop=PropertyNames(
        "fields", "field_id", "field_name", "field_type", id="field_number", title="field_title",
        options="field_options",
    ),
    types={
        "LARGE": FieldType("string"),
        "MEDIUM": FieldType("positive_number"),
        "ECONOMY": FieldType("percent"),
        "PROMO": FieldType("single_select", True),
        "SMALL": FieldType("date"),
        "guide": FieldType("instructions"),
        "box": FieldType("option_box", True),
        "hidden": FieldType("hidden"),
    },
    allowed_types=("LARGE", "MEDIUM", "ECONOMY", "PROMO", "SMALL", "guide", "box", "hidden"),
    ignored_types=("STANDARD",),
    rules={
        **TARGET_RULES,
        "option_box": TargetRule(("object",), children=True),
        "hidden": TargetRule(("string", "null"), skip=True),
    },
)


def part_templates(spark, sf):
    """Every part is a flat template; its type stands in for the type of its first field."""
    p = spread(table(spark, sf, "part"))
    plain = F.to_json(F.array(F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")), F.col("p_name")))
    field = lambda key, no, name, kind, title="", options=None: F.concat(
        F.lit('{"field_id":'), key, F.lit(f',"field_number":"{no}","field_title":"{title}"'),
        F.lit(',"field_name":"'), name, F.lit('","field_type":'), kind,
        F.lit("") if options is None else F.concat(F.lit(',"field_options":'), options), F.lit("}"),
    )
    size = F.col("p_size")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = (
        F.when(size % 11 == 0, "null").when(size % 13 == 0, '"odd"').otherwise(quote(F.col("p_type")))
    )
    key = F.when(size % 17 == 0, "null").otherwise(
        quote(F.concat(F.lit("P"), "p_partkey"))
    )
    options = F.when(size % 3 == 0, "null").otherwise(plain)
    second_name = F.when(size % 4 == 0, F.lit("Main")).otherwise(F.lit("Other"))
    fields = F.concat_ws(
        ",",
        field(key, 1, F.lit("Main"), kind, options=options),
        field(F.lit('"Q"'), 2, second_name, F.lit('"LARGE"')),
        field(F.lit('"G"'), "", F.col("p_name"), F.lit('"guide"'), title="Note"),
        field(F.lit('"B"'), 4, F.lit("Box"), F.lit('"box"'),
              options=F.concat(F.lit('["left","'), "p_brand", F.lit('"]'))),
        field(F.lit('"H"'), 5, F.lit("Secret"), F.lit('"hidden"')),
    )
    return p.select(
        F.concat(
            F.lit('{"table_name":"'), "p_brand", F.lit('","table_id":'), "p_partkey",
            F.lit(',"fields":['), fields, F.lit("]}"),
        ).alias("doc")
    )


def part_flat(spark, sf):
    return T.flatten_template(T.read_templates_frame(part_templates(spark, sf), PART), PART)


def part_index(spark, sf):
    return T.build_field_index(T.drop_untyped(part_flat(spark, sf)), PART)


_FINE = """p_size % 11 <> 0 and p_size % 13 <> 0 and p_size % 17 <> 0 and p_type <> 'STANDARD'
  and not (p_type = 'PROMO' and p_size % 3 = 0)"""


@query(
    "flat_template",
    f"""select p_partkey as template_id, p_brand as title, concat('P', p_partkey) as key,
        'Main' as label, 'fields' as path,
        case p_type when 'LARGE' then 'string' when 'MEDIUM' then 'positive_number'
          when 'ECONOMY' then 'percent' when 'PROMO' then 'single_select' else 'date' end as target,
        case when p_type in ('MEDIUM', 'ECONOMY') then 'number/null' else 'string/null' end as types,
        cast(case when p_type in ('MEDIUM', 'ECONOMY') then 0 end as double) as low,
        cast(case when p_type = 'ECONOMY' then 100 end as double) as high,
        case when p_type = 'SMALL' then 'date' end as format,
        case when p_type = 'PROMO' then concat(p_brand, '|', p_name) end as choices
      from part where {_FINE}
    union all
    select p_partkey, p_brand, 'Q', case when p_size % 4 = 0 then 'Main' else 'Other' end, 'fields',
      'string', 'string/null', null, null, null, null from part
    union all select p_partkey, p_brand, 'G', 'Instructions', 'fields', 'instructions', 'string', null, null, null, null from part
    union all select p_partkey, p_brand, 'B', 'Box', 'fields', 'option_box', 'object', null, null, null, null from part
    union all select p_partkey, p_brand, 'B', 'left', 'fields/Box', 'string', 'string/null', null, null, null, null from part
    union all select p_partkey, p_brand, 'B', p_brand, 'fields/Box', 'string', 'string/null', null, null, null, null from part""",
)
def flat_template(spark, sf):
    return part_index(spark, sf).select(
        "template_id", "title", "key", F.col("property_key").alias("label"),
        F.array_join("level_keys", "/").alias("path"), F.col("target_type").alias("target"),
        F.array_join("json_types", "/").alias("types"), F.col("minimum").alias("low"),
        F.col("maximum").alias("high"), "format",
        F.when(F.col("enum").isNotNull(), F.array_join("enum", "|")).alias("choices"),
    )


@query(
    "filter_types",
    """select p_partkey as template_id, cast(1 as int) as pos,
      case when p_size % 17 = 0 then 'missing key'
           when p_size % 13 = 0 then 'type not allowed'
           else 'options required' end as reason
    from part where p_size % 11 <> 0 and (p_size % 13 = 0 or p_type <> 'STANDARD')
      and (p_size % 17 = 0 or p_size % 13 = 0 or (p_type = 'PROMO' and p_size % 3 = 0))""",
)
def filter_types(spark, sf):
    lint = T.template_lint(T.drop_untyped(part_flat(spark, sf)), PART)
    return lint.select("template_id", "pos", "reason")


@query(
    "missing_types",
    """select p_partkey as template_id, cast(1 as int) as pos,
      case when p_size % 17 = 0 then 'missing key' else 'missing type' end as reason
    from part where p_size % 11 = 0""",
)
def missing_types(spark, sf):
    lint = T.template_lint(part_flat(spark, sf), PART)
    return lint.join(
        T.count_untyped(part_flat(spark, sf)).filter("dropped > 0"), "template_id", "left_semi"
    ).select("template_id", "pos", "reason")


@query(
    "untyped_counts",
    """select p_partkey as template_id, cast(case when p_size % 11 = 0 then 1 else 0 end as bigint)
      as dropped from part""",
)
def untyped_counts(spark, sf):
    return T.count_untyped(part_flat(spark, sf))


@query(
    "dup_keys",
    f"""select p_partkey as template_id, 'fields.Main' as path, cast(2 as bigint) as uses,
      cast(2 as int) as kept_pos, 'Q' as kept_key from part where p_size % 4 = 0 and {_FINE}""",
)
def dup_keys(spark, sf):
    return T.duplicate_labels(part_index(spark, sf))


@query(
    "options_extract",
    f"""select p_partkey as template_id, key, cast(pos as int) as pos, text, clean as text_clean
    from (
      select p_partkey, concat('P', p_partkey) as key, 0 as pos,
        concat('<b>', p_brand, '</b>') as text, p_brand as clean from part
        where {_FINE} and p_size % 3 <> 0
      union all select p_partkey, concat('P', p_partkey), 1, p_name, p_name from part
        where {_FINE} and p_size % 3 <> 0
      union all select p_partkey, 'B', 0, 'left', 'left' from part
      union all select p_partkey, 'B', 1, p_brand, p_brand from part)""",
)
def options_extract(spark, sf):
    return T.option_rows(part_index(spark, sf)).select(
        "template_id", "key", "pos", "text", "text_clean"
    )


@query(
    "expand_children",
    """select p_partkey as template_id, cast(i as int) as child_index, 'fields/Box' as path,
      case i when 0 then 'left' else p_brand end as label, 'B' as virtual_key, true as is_child
    from part, unnest([0, 1]) as u(i)""",
)
def expand_children(spark, sf):
    children = part_index(spark, sf).filter("is_virtual_child")
    return children.select(
        "template_id", "child_index", F.array_join("level_keys", "/").alias("path"),
        F.col("property_key").alias("label"), "virtual_key",
        F.col("is_virtual_child").alias("is_child"),
    )


@query(
    "instruction_text",
    """select p_partkey as template_id, 'Instructions' as label, concat('Note. ', p_name) as const_text,
      'string' as types from part""",
)
def instruction_text(spark, sf):
    guides = part_index(spark, sf).filter("source_type = 'guide'")
    return guides.select(
        "template_id", F.col("property_key").alias("label"), F.col("const").alias("const_text"),
        F.array_join("json_types", "/").alias("types"),
    )


# ------------------------------------------------------------- one questionnaire per order priority

_ORDER_FIELDS = """(values
  (5, 'Cust_A_1', 'A', '1.Header', '1. Status', 'single_select'),
  (6, 'Cust_A_2', 'A', '1.Header', '2. Total price', 'positive_number'),
  (7, 'Cust_A_3', 'A', '1.Header', '3. Order date', 'date'),
  (8, 'Cust_A_4', 'A', '1.Header', '4. Urgent', 'chk'),
  (9, 'Cust_A_', 'A', '1.Header', 'Instructions', 'instructions'),
  (12, 'Cust_A_5', 'A', '2', '5. Customer', 'positive_integer'),
  (13, 'Cust_A_6', 'A', '2', '6. Clerk notes', 'string'),
  (14, 'Cust_A_7', 'A', '2', '7. Flags', 'multiple_select'),
  (15, 'Cust_A_8', 'A', '2', '8. Checks', 'object_array'),
  (22, 'Cust_B_1', 'B', '1.Remarks', '1. Remark', 'string'),
  (23, 'Cust_B_2', 'B', '1.Remarks', '2. Placed at', 'datetime'))
  as f(pos, key, section_code, block, label, target_type)"""


@query(
    "field_index",
    f"""select t.template_id, cast(pos as int) as pos, key, section_code, block, label, target_type,
      t.title, case when target_type = 'single_select' then t.open_states
        when target_type = 'object_array' then t.states
        when target_type = 'multiple_select' then 'Flag 0|Flag 1|Flag 2|Flag 3|Flag 4' end as choices
    from (select cast(substr(o_orderpriority, 1, 1) as bigint) as template_id,
        concat('Order ', o_orderpriority) as title,
        string_agg(distinct concat('Status ', o_orderstatus), '|'
          order by concat('Status ', o_orderstatus)) as states,
        string_agg(distinct concat('Status ', o_orderstatus), '|'
          order by concat('Status ', o_orderstatus)) filter (where o_orderstatus <> 'P')
          as open_states
      from orders group by all) t, {_ORDER_FIELDS}""",
)
def field_index(spark, sf):
    return order_index(spark, sf).select(
        "template_id", "pos", "key", "section_code", F.get("level_keys", F.lit(3)).alias("block"),
        F.col("property_key").alias("label"), "target_type", "title",
        F.when(F.col("enum").isNotNull(), F.array_join("enum", "|")).alias("choices"),
    )


@query(
    "field_metadata",
    f"""select t.template_id, cast(pos as int) as pos, key, target_type
    from (select distinct cast(substr(o_orderpriority, 1, 1) as bigint) as template_id from orders
      where o_orderpriority = '2-HIGH') t, {_ORDER_FIELDS}""",
)
def field_metadata(spark, sf):
    return C.field_metadata(order_index(spark, sf), 2).select(
        "template_id", "pos", "key", "target_type"
    )


# Faults of a template, by its number: what stands in the text, what is read all the same.
_FAULTY = TemplateLayout(
    schema_name="table_name",
    schema_id="table_id",
    prop=PropertyNames("fields", "field_id", "field_name", "field_type", options="field_options"),
    types={
        "text": FieldType("string"),
        "pick": FieldType("single_select", True),
        "listed": FieldType("single_select", True, options_field="choices"),
        "split": FieldType("single_select", True, extract=lambda o: F.split(o, "/")),
    },
)


def faulty_templates(spark, sf):
    """Every part is a template with a fault of its own between two sound fields."""
    sound = lambda key: f'{{"field_id":"{key}","field_name":"{key}","field_type":"text"}}'
    kind = F.col("p_partkey") % 8
    middle = (
        F.when(kind == 1, F.lit("7"))
        .when(kind == 2, F.lit("null"))
        .when(kind == 3, F.lit('{"field_id":"m","field_name":"m","field_type":"pick","field_options":["x",5]}'))
        .when(kind == 4, F.lit('{"field_id":"m","field_name":"m","field_type":"listed","field_options":[1],"choices":["l","r"]}'))
        .when(kind == 5, F.lit('{"field_id":"m","field_name":"m","field_type":"split","field_options":"u/v/w"}'))
        .otherwise(F.lit(sound("m")))
    )
    body = F.concat(F.lit("[" + sound("a") + ","), middle, F.lit("," + sound("z") + "]"))
    head = F.concat(F.lit('{"table_name":"'), "p_brand", F.lit('","table_id":'), "p_partkey", F.lit(',"fields":'))
    doc = F.when(kind == 6, F.concat(head, F.lit('{"a":1}}'))).when(kind == 7, F.concat(F.lit("{broken "), "p_brand")).otherwise(
        F.concat(head, body, F.lit("}")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), doc.alias("doc"))


@query(
    "template_faults",
    """select p_partkey as template_id, case when p_partkey % 8 = 7 then '' else 'fields' end as path,
      case when p_partkey % 8 in (1, 2) then '1' end as item,
      case when p_partkey % 8 in (1, 2) then 'item is no object' when p_partkey % 8 = 6 then 'no readable list'
        else 'template is no JSON object' end as reason
    from part where p_partkey % 8 in (1, 2, 6, 7)
    union all select p_partkey, 'fields', '1', 'option is no text' from part where p_partkey % 8 = 3""",
)
def template_faults(spark, sf):
    """What cannot be read, of whole templates, of their arrays and of single questions."""
    loaded = T.read_templates_frame(faulty_templates(spark, sf), _FAULTY)
    lint = T.template_lint(T.flatten_template(loaded, _FAULTY), _FAULTY)
    # The first node is the outer container.
    questions = lint.select("template_id", "path", (F.col("pos") - 1).alias("item"), "reason")
    found = T.template_faults(loaded, _FAULTY).union(questions)
    return found.withColumn("item", F.col("item").cast("string"))


@query(
    "sound_neighbours",
    """select p_partkey as template_id, key, case when key = 'm' and p_partkey % 8 = 4 then 'l|r'
        when key = 'm' and p_partkey % 8 = 5 then 'u|v|w' end as choices
    from part, unnest(['a', 'm', 'z']) as u(key)
    where p_partkey % 8 < 6 and not (key = 'm' and p_partkey % 8 in (1, 2, 3))""",
)
def sound_neighbours(spark, sf):
    """The fields around the faults, with options from the places and by the extractor of their types."""
    loaded = T.read_templates_frame(faulty_templates(spark, sf), _FAULTY)
    index = T.build_field_index(T.flatten_template(loaded, _FAULTY), _FAULTY)
    return index.select("template_id", "key", F.when(F.col("enum").isNotNull(), F.array_join("enum", "|")).alias("choices"))
