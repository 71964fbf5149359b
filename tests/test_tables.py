from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import catalog as C
from fieldloom.operators import compare as K
from fieldloom.operators import enrich as E
from fieldloom.operators import locks as L
from fieldloom.operators import reverse as R
from fieldloom.operators import updates as U
from fieldloom.operators.contract import build_contracts
from fieldloom.operators.templates import build_field_index, flatten_template, read_templates_frame
from fieldloom.plans.layout import QUESTIONNAIRE, FieldType, Level, PropertyNames, TargetRule, TemplateLayout
from fieldloom.operators import documents as D
from fieldloom.operators import validate as V
from fieldloom.sources import files as S
from fieldloom.sources import sinks
from tests.test_documents import TEMPLATE


@pytest.fixture(scope="module")
def flat(spark):
    frame = spark.createDataFrame([(json.dumps(TEMPLATE),)], "doc string")
    return flatten_template(read_templates_frame(frame, QUESTIONNAIRE), QUESTIONNAIRE)


@pytest.fixture(scope="module")
def index(flat):
    return build_field_index(flat, QUESTIONNAIRE)


def rows(spark, *pairs):
    data = [(k, i, v) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(data, "key string, row_no long, value string")


def merged(frame, policy, **options):
    return {r["key"]: r["value"] for r in E.merge_duplicates(frame, policy, **options).collect()}


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_concat_replaces_leading_blanks_only(spark, chunk):
    frame = rows(spark, ("a", ""), ("a", "x"), ("b", ""), ("a", ""), ("a", "y"), ("b", ""), ("c", "z"))
    assert merged(frame, "concat", chunk=chunk) == {"a": "x. . y", "b": "", "c": "z"}


def test_other_policies(spark):
    frame = rows(spark, ("a", "1"), ("b", "2"), ("a", "3"))
    assert merged(frame, "last") == {"a": "3", "b": "2"}
    assert merged(frame, "first") == {"a": "1", "b": "2"}
    with pytest.raises(ValueError, match="'a' at row 2"):
        E.merge_duplicates(frame, "error")
    with pytest.raises(ValueError):
        E.merge_duplicates(frame, "other")


def test_enrich_appends_and_reports(spark, index):
    pairs = rows(spark, ("1", "Say <b>it</b>"), (" ", "x"), ("none", "y"))
    found, lost = E.enrich_from_rows(index, pairs, prefix="A")
    texts = {r["key"]: r["description"] for r in found.collect()}
    assert texts["A_1"].endswith("null\n\nSay it") and texts["B_1"] is None
    assert [r["key"] for r in lost.collect()] == ["A_none"]


def contract_of(index, flat):
    return json.loads(build_contracts(index, flat, QUESTIONNAIRE).first()["contract"])


def test_contract(index, flat):
    contract = contract_of(index, flat)
    groups = contract["properties"]["sections"]["properties"]["A.Order facts"]["properties"][
        "assessmentQuestionGroups"]
    assert contract["title"] == "My form" and groups["required"] == ["1.Head", "2"]
    questions = groups["properties"]["1.Head"]["properties"]["questions"]
    assert questions["required"] == ["1. Pick", "2. Total", "Instructions", "7. Grid"]
    assert questions["properties"]["1. Pick"]["enum"] == ["x y", "z", None]
    assert questions["properties"]["Instructions"]["const"] == "Note. Read"
    assert groups["properties"]["2"]["properties"]["questions"]["properties"] == {}


def test_locks(spark, index, flat):
    raw = [
        ("A_1", '{"value":"z","description":"Fixed"}'),
        ("A_7", '{"const":[{"entry":"p","description":"d"}]}'),
        ("A_2", '{"value":-1}'),
        ("B_1", '{"description":"more","description_op":"append"}'),
        ("gone", '{"value":1}'),
        ("A_3", "[1]"),
    ]
    overrides = L.parse_overrides(spark.createDataFrame(raw, "key string, override string"))
    problems = {r["key"]: r["problem"] for r in L.override_lint(index, overrides).collect()}
    assert problems == {"A_2": "minimum: -1", "gone": "no such field", "A_3": "override is no object"}
    locked = L.lock_fields(L.override_descriptions(index, overrides), overrides)
    questions = contract_of(locked, flat)["properties"]["sections"]["properties"]["A.Order facts"][
        "properties"]["assessmentQuestionGroups"]["properties"]["1.Head"]["properties"]["questions"]
    assert questions["properties"]["1. Pick"] == {
        "type": "string", "description": "Fixed", "const": "z", "enum": ["z"]}
    assert questions["properties"]["2. Total"]["minimum"] == 0
    children = {(r["child"], r["child_type"], r["child_const"]) for r in L.lock_children(locked).collect()}
    assert children == {("entry", "string", '"p"'), ("description", "string", '"d"')}


def test_object_locks_close_every_level(spark):
    layout = TemplateLayout(
        schema_name="t", schema_id="i", prop=PropertyNames("fields", "k", "n", "y"),
        types={"any": FieldType("any")}, rules={"any": TargetRule(("object", "null"))})
    template = {"t": "T", "i": 7, "fields": [{"k": "f", "n": "F", "y": "any"}]}
    frame = spark.createDataFrame([(json.dumps(template),)], "doc string")
    flat = flatten_template(read_templates_frame(frame, layout), layout)
    lock: dict = {"last": [1, {"free": 2}], "number": 2.0, "big": 1e20, "whole": 7, "none": None, "yes": True, 'q"uo': ""}
    for depth in range(8):
        lock = {f"level {depth}": lock, "x": depth}
    overrides = L.parse_overrides(spark.createDataFrame([("f", json.dumps({"value": lock}))], "key string, override string"))
    locked = L.lock_fields(build_field_index(flat, layout), overrides)
    contract = json.loads(build_contracts(locked, flat, layout).first()["contract"])
    at = contract["properties"]["fields"]["properties"]["F"]
    for depth in range(7, -1, -1):
        assert at["type"] == "object" and at["additionalProperties"] is False
        assert at["required"] == [f"level {depth}", "x"] and at["properties"]["x"] == {"type": "integer", "const": depth}
        at = at["properties"][f"level {depth}"]
    kinds = {k: v["type"] for k, v in at["properties"].items()}
    assert kinds == {"last": "array", "number": "number", "big": "number", "whole": "integer", "none": "null", "yes": "boolean", 'q"uo': "string"}
    assert at["properties"]["last"]["const"] == [1, {"free": 2}] and at["additionalProperties"] is False

    contracts = D.contract_rows(locked, flat)
    deep = json.dumps(lock)
    texts = [deep, deep.replace('"free": 2', '"free": 3'), deep.replace('"whole": 7', '"whole": 7, "more": 1'), deep.replace('"none": null, ', "")]
    docs = spark.createDataFrame(
        [(i, 7, '{"table_name":"T","fields":{"F":%s}}' % t) for i, t in enumerate(texts)], "doc_id long, template_id long, doc string")
    found = V.validate(D.align_documents(docs, contracts, layout)).collect()
    assert {(r["doc_id"], r["rule"]) for r in found} == {(1, "lock"), (2, "lock"), (3, "lock")}


def test_contract_is_folded_with_one_shuffle(index, flat):
    plan = build_contracts(index, flat, QUESTIONNAIRE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(template_id") == 1 and "Join" not in plan


def test_merge_update(spark):
    cases = [
        ('{"s":{"a":1,"b":2}}', '{"s":{"b":null,"c":[3]}}', {"s": {"a": 1, "b": None, "c": [3]}}),
        ('{"x":1}', '{"s":{"a":1}}', {"x": 1, "s": {"a": 1}}),
        ('{"s":5}', '{"s":6}', {"s": 6}),
        ('{"s":{"a":1}}', '{"s":6}', {"s": {"a": 1}}),
        ('{"s":{"a":1}}', '{"t":1}', {"s": {"a": 1}}),
    ]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = frame.select("i", U.merge_update(F.col("a"), F.col("b"), "s").alias("m")).orderBy("i").collect()
    assert [json.loads(r["m"]) for r in got] == [c[2] for c in cases]
    with pytest.raises(ValueError):
        U.merge_update(F.col("a"), F.col("b"), "")


def test_section_states(spark):
    doc = '{"sections":{"b":{"state":"signed"},"a":{},"c":5,"d":{"state":null}}}'
    frame = spark.createDataFrame([(doc,), ("{}",)], "d string")
    got = [r[0] for r in frame.select(U.section_states(F.col("d"))).collect()]
    assert got == [["draft", "signed", None], []]


def test_catalog(spark):
    frame = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (2, "b", 1)], "template_id long, title string, loaded_at long")
    latest = C.latest_registration(frame)
    assert {(r["template_id"], r["title"]) for r in latest.collect()} == {(1, "b"), (2, "b")}
    requests = spark.createDataFrame(
        [(1, None), (None, "b"), (9, None)], "template_id long, title string")
    got = [r["resolved_id"] for r in C.resolve(requests, latest).collect()]
    assert sorted(map(str, got)) == ["1", "1", "None"]


def test_differences(spark):
    side = "id int, field string, value string, text string"
    left = spark.createDataFrame([(1, "a", "1", "x"), (1, "b", "", ""), (1, "c", "3", ""), (1, "d", "4", "")], side)
    right = spark.createDataFrame([(1, "a", "1", "y"), (1, "b", "2", ""), (1, "d", "4", "z")], side)
    got = {r["field"]: r["message"] for r in K.compare_fields(left, right, ["id"]).collect()}
    assert got == {"a": '"1" (text: "y") != "1" (text: "x")', "c": '"" != "3"'}


def test_latest_records(spark):
    frame = spark.createDataFrame([("k", "f1", 1), ("k", "f2", 2), ("m", "f0", 3)], "record_key string, file string, v int")
    assert {r["v"] for r in K.latest_records(frame).collect()} == {2, 3}


def test_widgets(spark):
    frame = spark.createDataFrame([("txt", 50), ("txt", 51), ("rad", 0), ("zz", 0)], "t string, n int")
    got = [r[0] for r in frame.select(R.widget(F.col("t"), F.col("n"))).collect()]
    assert got == ["textarea_singleline", "textarea_multiline", "radio_buttons", "text"]


def test_csv_reader(spark, tmp_path):
    text = '﻿Key,,Guidelines\n1,x,"two\nlines, ""quoted"""\n,y,none\n2,,\n'
    (tmp_path / "g.csv").write_text(text, encoding="utf-8")
    got = S.read_key_values(spark, str(tmp_path / "g.csv"), "key", "guidelines", case_insensitive=True)
    assert [(r["key"], r["value"]) for r in got.orderBy("row_no").collect()] == [
        ("1", 'two\nlines, "quoted"'), (None, "none"), ("2", None)]
    with pytest.raises(KeyError):
        S.read_key_values(spark, str(tmp_path / "g.csv"), "key", "Guidelines")


def test_csv_headers_with_line_breaks(spark, tmp_path):
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / "b 1.csv").write_text('Key,"Guide\nlines","No ""te"""\r\n1,"a\n\nb",n1\r\n\r\n2\r\n3,x,"n,3",more\r\n')
    (folder / "a.csv").write_text('\n"No ""te""",Key,Key\nfirst,k,l\n')
    (folder / "c.csv").write_text("")
    got = S.read_key_values(spark, str(folder), "Key", 'No "te"').orderBy("row_no").collect()
    assert [(r["key"], r["value"]) for r in got] == [("k", "first"), ("1", "n1"), ("2", None), ("3", "n,3")]
    assert [r["file"].rsplit("/", 1)[1] for r in got] == ["a.csv"] + ["b%201.csv"] * 3
    got = S.read_key_values(spark, str(folder / "b 1.csv"), "key", "guide\nLINES", case_insensitive=True).orderBy("row_no").collect()
    assert [(r["key"], r["value"]) for r in got] == [("1", "a\n\nb"), ("2", None), ("3", "x")]
    with pytest.raises(KeyError, match="Note.*Key"):
        S.read_key_values(spark, str(folder), "Key", "Note")
    with pytest.raises(ValueError):
        S.read_key_values(spark, str(folder / "c.csv"), "Key", "Note")
    bulk = tmp_path / "bulk.csv"
    bulk.write_text("Key,Note\n1,x\n2,y\n")
    got = S.read_key_values(spark, str(bulk), "Key", "Note", multi_line=False).orderBy("row_no").collect()
    assert [(r["key"], r["value"]) for r in got] == [("1", "x"), ("2", "y")]


def test_single_files(spark, index, flat, tmp_path):
    contracts = build_contracts(index, flat, QUESTIONNAIRE)
    for _ in range(2):  # a second export replaces the files of the first
        sinks.export_contracts(contracts, str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")]
    assert [f.name for f in files] == ["7_My_form_schema.json"]
    assert files[0].read_text().rstrip("\n") == contracts.first()["contract"]
    rows = spark.createDataFrame(
        [("r1", "b", "x, \"y\""), ("r1", "a", "z"), ("r2", "a", "w")], "record_key string, field string, message string")
    sinks.write_record_report(rows.repartition(3), "r1", str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_text() == 'fields,r1\na,z\nb,"x, ""y"""\n'
    sinks.write_record_report(rows, "none", str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == "fields,none\n"
    sinks.write_wide_report(rows, ["r2", "r1"], str(tmp_path / "wide.csv"))
    assert (tmp_path / "wide.csv").read_text() == 'fields,r1,r2\na,z,w\nb,"x, ""y""",\n'


def test_pair_files(spark, tmp_path):
    good = {
        "chart": {"schema_id": "007", "state": "draft", "json_internal_filled": [{"internal_json": {"a": 1}}]},
        "stored": {"ehr_patient_id": "12", "assessments": {"items": {"5": {"fac_id": 3, "sections": []}}}},
    }
    texts = {"a.json": json.dumps(good), "b.json": "{", "c.json": json.dumps({**good, "stored": {}}),
             "d.json": json.dumps({**good, "chart": {}}), "e.txt": "{}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    usable, left_out = S.read_pairs(spark, str(tmp_path))
    row = usable.first()
    assert (row["template_id"], row["record_id"], row["facility_id"]) == ("7", "5", "3")
    assert {r["file"] for r in left_out.collect()} == {"b.json", "c.json", "d.json"}


def test_layout_checks():
    with pytest.raises(ValueError):
        TemplateLayout.from_meta({"schema_name": "t"})
    with pytest.raises(ValueError):
        TemplateLayout.from_meta({"schema_name": "t", "properties": {"properties_name": "f", "property": {"key": "k"}}})
    prop = {"key": "k", "name": "n", "type": "y", "validation": {
        "allowed_types": ["a"], "ignored_types": ["a"], "type_constraints": {}}}
    with pytest.raises(ValueError):
        TemplateLayout.from_meta({"schema_name": "t", "properties": {"properties_name": "f", "property": prop}})
    prop["validation"] = {"allowed_types": ["a"], "type_constraints": {
        "a": {"target_type": "string", "requires_options": False}}}
    made = TemplateLayout.from_meta({
        "schema_name": "t",
        "container": {"container_name": "c", "object": {"key": "i", "properties": {
            "properties_name": "f", "property": prop}}}})
    assert made.levels == (Level("c", "i"),) and made.key_field == "i"
