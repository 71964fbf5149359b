from __future__ import annotations

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.dates import is_iso_date
from fieldloom.operators import documents as D
from fieldloom.operators import reverse as R
from fieldloom.operators import templates as T
from fieldloom.operators import validate as V
from fieldloom.plans.joins import fits_broadcast, hot_keys, salted_join
from fieldloom.plans.layout import (
    QUESTIONNAIRE,
    FieldType,
    PropertyNames,
    TargetRule,
    TemplateLayout,
)
from registry import inputs

TEMPLATE = {
    "assessmentDescription": "My <b>form</b>",
    "templateId": 7,
    "sections": [
        {
            "sectionCode": "A",
            "sectionDescription": "Order <i>facts</i>",
            "assessmentQuestionGroups": [
                {"groupNumber": "", "questions": [{"questionKey": "lost", "questionType": "txt"}]},
                {
                    "groupNumber": "1",
                    "groupText": "Head",
                    "groupTitle": "Title",
                    "questions": [
                        {"questionKey": "A_1", "questionNumber": "1", "questionText": "Pick",
                         "questionType": "rad", "responseOptions": [
                             {"responseText": "<b>x</b> y", "responseValue": "X"},
                             {"responseText": "z", "responseValue": "Z"}]},
                        {"questionKey": "A_2", "questionNumber": "2", "questionText": "Total",
                         "questionType": "numde"},
                        {"questionKey": "A_3", "questionText": "Read", "questionTitle": "Note",
                         "questionType": "inst"},
                        {"questionKey": "A_4", "questionText": "no type", "questionType": None},
                        {"questionKey": "A_5", "questionText": "ignored", "questionType": "bp"},
                        {"questionKey": "A_6", "questionText": "odd", "questionType": "odd"},
                        {"questionKey": "A_7", "questionNumber": "7", "questionText": "Grid",
                         "questionType": "gbdy", "length": 3, "responseOptions": ["p", "q"]},
                    ],
                },
                {"groupNumber": "2", "questions": []},
                {"groupNumber": "3", "questions": "no list"},
            ],
        },
        {"sectionCode": "B", "assessmentQuestionGroups": [
            {"groupNumber": "1", "questions": [
                {"questionKey": "B_1", "questionText": "Free", "questionType": "txt"}]}]},
    ],
}
GOOD = {
    "table_name": "My form",
    "sections": {
        "A.Order facts": {"assessmentQuestionGroups": {
            "1.Head": {"questions": {"1. Pick": "z", "2. Total": 5, "Instructions": "Note. Read",
                                     "7. Grid": []}},
            "2": {"questions": {}}}},
        "B": {"assessmentQuestionGroups": {"1": {"questions": {"Free": None}}}},
    },
}


@pytest.fixture(scope="module")
def flat(spark):
    frame = spark.createDataFrame([(json.dumps(TEMPLATE),)], "doc string")
    return T.flatten_template(T.read_templates_frame(frame, QUESTIONNAIRE), QUESTIONNAIRE)


@pytest.fixture(scope="module")
def contracts(flat):
    return D.contract_rows(T.build_field_index(flat, QUESTIONNAIRE), flat)


def docs_of(spark, *texts):
    rows = [(i, 7, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, template_id long, doc string")


def errors_of(spark, contracts, *texts, rules=None):
    aligned = D.align_documents(docs_of(spark, *texts), contracts, QUESTIONNAIRE)
    return {
        (r["doc_id"], r["phase"], r["path"].split(".questions.")[-1], r["rule"], r["message"])
        for r in V.validate(aligned, rules).collect()
    }


def changed(path, value):
    doc = json.loads(json.dumps(GOOD))
    at = doc
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return doc


HEAD = ("sections", "A.Order facts", "assessmentQuestionGroups", "1.Head", "questions")


def test_index_and_lint(flat):
    index = T.build_field_index(flat, QUESTIONNAIRE).orderBy("pos").collect()
    assert [r["key"] for r in index] == ["A_1", "A_2", "A_3", "A_7", "B_1"]
    assert index[0]["enum"] == ["x y", "z"] and index[0]["option_texts"][0] == "<b>x</b> y"
    assert index[2]["property_key"] == "Instructions" and index[2]["const"] == "Note. Read"
    assert index[3]["max_items"] == 3 and index[0]["title"] == "My form"
    reasons = {(r["key"], r["reason"]) for r in T.template_lint(flat, QUESTIONNAIRE).collect()}
    assert reasons == {("A_4", "missing type"), ("A_6", "type not allowed")}


def test_good_document(spark, contracts):
    assert errors_of(spark, contracts, GOOD) == set()


def test_structure_errors(spark, contracts):
    no_section = {k: v for k, v in GOOD["sections"].items() if k != "B"}
    found = errors_of(
        spark, contracts,
        changed(("sections",), {**no_section, "C": {}}),
        changed(HEAD, 3),
        changed((*HEAD, "more"), 1),
        {**GOOD, "table_name": "x", "extra": {}},
        "[1]", "not json",
        {"table_name": "My form"},
    )
    assert found == {
        (0, 1, "sections.B", "required", "is missing"),
        (0, 1, "sections.C", "additional", "was unexpected"),
        (1, 1, "sections.A.Order facts.assessmentQuestionGroups.1.Head.questions", "type",
         "container is no object"),
        (2, 1, "more", "additional", "was unexpected"),
        (3, 1, "table_name", "const", "x"),
        (3, 1, "extra", "additional", "was unexpected"),
        (4, 1, "", "document", "no JSON object"),
        (5, 1, "", "document", "no JSON object"),
        (6, 1, "sections", "required", "is missing"),
    }


def test_value_errors(spark, contracts):
    grid = [{"entry": "p", "description": "d"}, {"entry": "r", "description": "d"},
            {"entry": "q"}, 3]
    found = errors_of(
        spark, contracts,
        changed((*HEAD, "1. Pick"), "nope"),
        changed((*HEAD, "2. Total"), -5.5),
        changed((*HEAD, "2. Total"), "7"),
        changed((*HEAD, "7. Grid"), grid),
        changed((*HEAD, "Instructions"), None),
        changed((*HEAD, "1. Pick"), 7),
    )
    assert found == {
        (5, 1, "1. Pick", "type", "integer is not string/null"),
        (5, 1, "1. Pick", "enum", "7"),
        (0, 1, "1. Pick", "enum", "nope"),
        (1, 1, "2. Total", "minimum", "-5.5"),
        (2, 1, "2. Total", "type", "string is not number/null"),
        (3, 1, "7. Grid", "grid", "more rows than 3"),
        (3, 1, "7. Grid", "grid", "row 1 entry not among the options: r"),
        (3, 1, "7. Grid", "grid", "row 2 lacks description"),
        (3, 1, "7. Grid", "grid", "row 3 is no object"),
        (4, 1, "Instructions", "type", "null is not string"),
        (4, 1, "Instructions", "const", "null"),
    }


def test_repeated_keys_keep_the_last(spark, contracts):
    text = json.dumps(GOOD).replace('"1. Pick": "z"', '"1. Pick": "nope", "1. Pick": "z"')
    assert errors_of(spark, contracts, text) == set()


def test_unknown_template(spark, contracts):
    docs = docs_of(spark, GOOD).withColumn("template_id", F.lit(99).cast("long"))
    aligned = D.align_documents(docs, contracts, QUESTIONNAIRE)
    assert [r["rule"] for r in V.validate(aligned).collect()] == ["template"]


def test_caller_rule_as_pandas_udf(spark, contracts):
    @F.pandas_udf("string")
    def shout(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or t.islower() else "not lower case")

    def rule(value, about):
        return shout(F.try_variant_get(value, "$", "string"))

    path = ("sections", "B", "assessmentQuestionGroups", "1", "questions", "Free")
    found = errors_of(spark, contracts, changed(path, "ABC"), changed(path, "abc"),
                      rules={"string": rule})
    assert found == {(0, 2, "Free", "custom", "not lower case")}


def test_verdict_gate(spark, contracts):
    rule = {"string": lambda v, r: F.lit("always")}
    path = ("sections", "B", "assessmentQuestionGroups", "1", "questions", "Free")
    both = changed(path, "t")
    both["table_name"] = "x"
    docs = docs_of(spark, GOOD, changed(path, "t"), both)
    rows = V.verdicts(D.align_documents(docs, contracts, QUESTIONNAIRE), rule).orderBy("doc_id")
    got = [(r["is_valid"], r["errors"]) for r in rows.collect()]
    assert got[0] == (True, [])
    assert not got[1][0] and got[1][1][0].endswith("custom: always")
    assert got[2] == (False, ["table_name: const: x"])


def test_every_row_has_a_verdict_of_its_own(spark, contracts):
    bad = changed((*HEAD, "1. Pick"), "nope")
    worse = changed((*HEAD, "2. Total"), "x")
    rows = [(None, 7, GOOD), (None, 7, bad), (None, 7, worse), (5, 7, GOOD), (5, 7, bad), (5, 7, bad), (None, None, GOOD), (5, 8, GOOD)]
    rows = [(i, t, json.dumps(d)) for i, t, d in rows] + [(None, 7, None), (None, 7, "[1]"), (6, 7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, template_id long, doc string")
    found = V.verdicts(D.align_documents(docs.repartition(3), contracts, QUESTIONNAIRE))
    got = sorted((str(r["doc_id"]), str(r["template_id"]), r["is_valid"], r["error_count"]) for r in found.collect())
    assert got == sorted([
        ("None", "7", True, 0), ("None", "7", False, 1), ("None", "7", False, 1), ("5", "7", True, 0), ("5", "7", False, 1),
        ("5", "7", False, 1), ("None", "None", False, 1), ("5", "8", False, 1), ("None", "7", False, 1), ("None", "7", False, 1),
        ("6", "7", False, 1)])
    plan = V.verdicts(D.align_documents(docs, contracts, QUESTIONNAIRE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    assert V.verdicts(D.align_documents(docs.limit(0), contracts, QUESTIONNAIRE)).collect() == []


def test_a_date_ends_where_the_text_ends(spark):
    texts = ["2024-01-05", "2024-01-05\n", "2024-01-05T10:00\n", "2024-01-05T10:00", "2024-W01\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(is_iso_date(F.col("t")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, True, False]


def test_shuffled_lookup_gives_the_same(spark, contracts):
    docs = docs_of(spark, GOOD, changed((*HEAD, "1. Pick"), "nope"), "[1]")
    small = D.align_documents(docs, contracts, QUESTIONNAIRE)
    large = D.align_documents(docs, contracts, QUESTIONNAIRE, limit=0, salts=3)
    key = lambda frame: sorted(map(str, V.validate(frame).collect()))
    assert key(small) == key(large)
    assert not fits_broadcast(contracts, 10)


def test_salted_join_keeps_a_hot_key_whole(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    lookup = facts.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = salted_join(facts, lookup, ["k"], salts=8)
    assert joined.count() == 1000 and joined.filter("v = k * 2").count() == 1000


def test_only_hot_keys_are_copied(spark):
    ids = F.col("id")
    key = F.when(ids < 500_000, 7).when(ids < 700_000, F.lit(None)).otherwise(ids)
    facts = spark.range(1_700_000).select("id", key.alias("k"))
    lookup = spark.range(1_700_000).select(ids.cast("int").alias("k"), (ids * 2).alias("v"))  # another type of key
    hot = hot_keys(facts, ["k"])
    assert len(hot) == 2  # the key 7, and rows without a key
    joined = salted_join(facts, lookup, ["k"], salts=16, hot=hot)
    found = joined.agg(F.count("*").alias("n"), F.count_if(F.expr("v = k * 2")).alias("right"), F.count("v").alias("met")).first()
    assert (found["n"], found["right"], found["met"]) == (1_700_000, 1_500_000, 1_500_000)
    copies = [m["rows"] for m in joined_rows(joined)]
    assert copies == [1_700_000 + 15]
    assert hot_keys(spark.range(10_000).select("id"), ["id"]) == [] and hot_keys(facts.limit(0), ["k"]) == []


def joined_rows(joined):
    """Rows that the lookup side of a salted join has after its explode."""
    plan = joined._jdf.queryExecution().analyzed()
    from pyspark.sql import DataFrame

    join = plan.children().apply(0)
    while "Join" not in join.nodeName():
        join = join.children().apply(0)
    right = join.children().apply(1)
    spark = joined.sparkSession
    return [{"rows": DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, right), spark).count()}]


def test_documents_are_not_shuffled(spark, contracts):
    frame = V.validate(D.align_documents(docs_of(spark, GOOD), contracts, QUESTIONNAIRE))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    facts = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in facts and "CartesianProduct" not in plan


def test_virtual_container(spark):
    layout = TemplateLayout(
        schema_name="t", schema_id="i",
        prop=PropertyNames("fields", "k", "n", "y", options="o"),
        types={"box": FieldType("box", True)},
        rules={"box": TargetRule(("object",), children=True)},
    )
    template = {"t": "T", "i": 7, "fields": [{"k": "f", "n": "F", "y": "box", "o": ["a", "b"]}]}
    frame = spark.createDataFrame([(json.dumps(template),)], "doc string")
    flat = T.flatten_template(T.read_templates_frame(frame, layout), layout)
    contracts = D.contract_rows(T.build_field_index(flat, layout), flat)
    docs = docs_of(
        spark,
        {"table_name": "T", "fields": {"F": {"a": "1", "b": None}}},
        {"table_name": "T", "fields": {"F": {"a": 1, "c": "x"}}},
        {"table_name": "T", "fields": {"F": "no"}},
    )
    rows = V.validate(D.align_documents(docs, contracts, layout)).collect()
    assert {(r["doc_id"], r["path"], r["rule"]) for r in rows} == {
        (1, "fields.F.a", "type"), (1, "fields.F.b", "required"), (1, "fields.F.c", "additional"),
        (2, "fields.F", "type"),
    }


def test_reverse_map_round_trip(spark, contracts):
    doc = changed((*HEAD, "7. Grid"), [{"entry": "q", "description": ""}])
    lined = D.line_up(docs_of(spark, doc), contracts, QUESTIONNAIRE)
    result = json.loads(R.reverse_map(lined).first()["result"])
    fields = result["sections"]["A"]["fields"]
    assert result["assessment_std_id"] == 7 and result["sections"]["B"]["state"] == "draft"
    assert fields[0] == {"key": "A_1", "type": "rad", "html_type": "radio_buttons", "value": "Z"}
    cells = {f["key"]: f["value"] for f in fields if f["type"] == "gbdy"}
    assert cells == {"a0_A_7": "q", "b0_A_7": "null", "a1_A_7": "null", "b1_A_7": "null",
                     "a2_A_7": "null", "b2_A_7": "null"}
    with pytest.raises(ValueError):
        R.reverse_map(lined, "unheard of")


def test_streamed_documents(spark, contracts, tmp_path):
    docs_of(spark, GOOD, changed((*HEAD, "1. Pick"), "nope")).write.parquet(str(tmp_path / "in"))
    stored = tmp_path / "contracts"
    contracts.write.parquet(str(stored))
    stream = spark.readStream.schema("doc_id long, template_id long, doc string").parquet(
        str(tmp_path / "in"))
    found = V.validate(
        D.align_documents(stream, spark.read.parquet(str(stored)), QUESTIONNAIRE))
    run = (
        found.writeStream.format("memory").queryName("found").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    run.processAllAvailable()
    run.stop()
    assert [r["rule"] for r in spark.table("found").collect()] == ["enum"]


def test_spread_deals_rows_by_their_number(spark, monkeypatch):
    """A table with more splits than cores, whose rows all lie in one of them."""
    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    frame = spark.range(100_000, numPartitions=40).filter("id < 2500")
    sizes = inputs.spread(frame).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 2500 and max(r["count"] for r in sizes) <= 400


def test_checks_are_compiled(spark, contracts, capsys):
    """The JVM interprets methods beyond 8,000 bytes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = V.validate(D.align_documents(docs_of(spark, GOOD), contracts, QUESTIONNAIRE, columns=D.CHECKED_COLUMNS))
        rows.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_checked_columns_give_the_same_violations(spark, contracts):
    docs = docs_of(spark, GOOD, "{}", "[]", {"table_name": "other", "sections": {}})
    plain = V.validate(D.align_documents(docs, contracts, QUESTIONNAIRE))
    fewer = V.validate(D.align_documents(docs, contracts, QUESTIONNAIRE, columns=D.CHECKED_COLUMNS))
    assert sorted(map(str, fewer.collect())) == sorted(map(str, plain.collect())) != []


def test_spread_fills_the_cores_with_small_tasks(spark):
    """Tasks have as many rows of a large table as of a small one, and come in whole rounds of the cores."""
    sizes = [r["count"] for r in inputs.spread(spark.range(200_000)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 10_100
    assert len(sizes) % spark.sparkContext.defaultParallelism == 0


def test_pair_texts_are_made_behind_the_join(spark, tmp_path):
    """Orders are joined while their rows are narrow; repeated keys meet each other, rows without a key go."""
    from registry.compare_queries import order_pair_texts

    spark.sql("""select * from values (1L, 5L, 'P', 10.5D, timestamp'1995-01-02 00:00:00', '1-URGENT'), (2L, 6L, 'O', 7D, timestamp'1995-01-03 00:00:00', '2-HIGH'),
      (2L, 7L, 'F', 8D, timestamp'1995-01-04 00:00:00', '2-HIGH'), (null, 8L, 'F', 8D, timestamp'1995-01-04 00:00:00', '2-HIGH')
      as t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)""").write.parquet(str(tmp_path / "orders.parquet"))
    made = order_pair_texts(spark, str(tmp_path))
    assert [r["file"] for r in made.orderBy("file").collect()] == ["f000000000001"] + ["f000000000002"] * 4
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert '{"table_name":"Order ' in plan and '{"table_name":"Order ' not in plan[plan.index("Join"):]


def test_fields_of_records_are_made_once(spark):
    from fieldloom.operators import compare as C

    rows = spark.sql("select '{}' as r").select(F.from_json("r", C.STORED_RECORD).alias("record"))
    shown = C.flatten_records(rows, [])._jdf.queryExecution().analyzed().toString()
    assert 0 < shown.count("response_text") <= 4
