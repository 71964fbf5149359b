"""Formatting in Arrow batches gives what the compiled columns give, for every type and odd answers."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import batches
from fieldloom.operators import db_layout as L
from fieldloom.operators import documents as D
from fieldloom.operators import reverse as R
from fieldloom.operators import templates as T
from fieldloom.plans.layout import QUESTIONNAIRE

KINDS = ["txt", "diag", "mtxt", "dte", "dttm", "num", "numde", "chk", "rad", "radh", "cmb", "hck", "mcs", "mcsh", "gbdy", "inst"]
ANSWERS = [
    "null", "true", "false", "0", "5", "5.0", "-0.0", "5.50", "1e20", "1.5e-7", "123456789012345678901234567890", "12345678901234567890.0",
    '"z"', '"x y"', '"<b>x</b> y"', '""', '" \\u00a0 "', '" 1 "', '"q\\"uo\\\\te"', '"é\\n\\u0001\\u001f/"', '"z, x y,,w"', "[]", '["z"]',
    '["z", 1, null, true, 2.50, {"b": 1.50, "a": "\\u0002"}, "", "x y"]', '[{"entry": "z", "description": "d"}]',
    '[{"entry": 5, "description": null}, "no", {"entry": "<b>x</b> y"}, {"description": [1, 2.0, "\\"\\u001f"]}, {"entry": null, "description": ""}]',
    '{"a": [1, 2.0, {"b": null}]}', "{}",
]


@pytest.fixture(scope="module")
def lined(spark):
    return _lined(spark, ANSWERS)


def _lined(spark, answers):
    options = [{"responseText": "<b>x</b> y", "responseValue": "X"}, {"responseText": "z", "responseValue": "Z\"1"},
               {"responseText": "z", "responseValue": "second"}, {"responseText": "w", "responseValue": None}]
    questions = [
        {"questionKey": f"K{i}", "questionNumber": str(i), "questionText": f"Q {k}", "questionType": k, "length": 3 + 60 * (i % 2),
         "responseOptions": options}
        for i, k in enumerate(KINDS)
    ]
    group = lambda n, qs: {"groupNumber": n, "groupText": f"G{n}", "groupTitle": f"T{n}", "questions": qs}
    template = {
        "assessmentDescription": "All \"types\"", "templateId": 7,
        "sections": [{"sectionCode": "B.1", "sectionDescription": "x", "assessmentQuestionGroups": [group("2", questions[:7]), group("10", questions[7:12])]},
                     {"sectionCode": "A", "assessmentQuestionGroups": [group("1", questions[12:])]}],
    }
    frame = spark.createDataFrame([(json.dumps(template),)], "doc string")
    flat = T.flatten_template(T.read_templates_frame(frame, QUESTIONNAIRE), QUESTIONNAIRE)
    index = T.build_field_index(flat, QUESTIONNAIRE)
    contracts = D.contract_rows(index, flat)
    fields = [(r["level_keys"], r["property_key"]) for r in index.orderBy("pos").collect()]
    assert len(fields) == len(KINDS)

    def filled(answer: str) -> str:
        tree: dict = {}
        for levels, name in fields:
            at = tree
            for step in levels:
                at = at.setdefault(step, {})
            at[name] = "@"
        return json.dumps({"table_name": "All types", **tree}).replace('"@"', answer)

    docs = [(i, 7, filled(a)) for i, a in enumerate(answers)]
    docs += [(100, 7, '{"table_name": "All types", "sections": {}}'), (101, 8, filled("5")), (102, 7, "no JSON"), (103, 7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, template_id long, doc string")
    return D.line_up(frame, contracts, QUESTIONNAIRE), D.align_documents(frame, contracts, QUESTIONNAIRE)


def listed(rows: list) -> str:
    def shown(e) -> str:
        parts = [("key", e["key"]), ("type", e["type"]), ("html_type", e["html_type"])]
        head = ",".join(f'"{n}":{json.dumps(v, ensure_ascii=False)}' for n, v in parts if v is not None)
        return "{" + head + f',"value":{e["value"]}}}'

    return "[" + ",".join(shown(e) for e in rows) + "]"


def by_document(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("name", ["ui", "default", "mixed"])
def test_batches_equal_columns(lined, name):
    lines, aligned = lined
    own = {"mixed": {**R.FORMATTERS["ui"], "num": lambda value, rule: F.array(
        R.entry(rule["key"], F.lit("own"), F.to_json(value)), R.entry(F.concat(rule["key"], F.lit("_2")), F.lit("own"), F.lit("2")))}}
    long = R.format_fields(D.field_rows(aligned), name, own).orderBy("doc_id", "pos", "item").collect()
    want = {k: listed(v) for k, v in by_document(long).items()}
    got = R.reverse_map(lines, name, group_as=None, properties_key="p", id_field=None, type_field=None, sets=own).collect()
    assert {r["doc_id"]: r["trouble"] for r in got if r["result"] is None} == {101: "unknown template", 102: "unreadable", 103: "unreadable"}
    for r in got:
        if r["result"] is not None:
            start = '{"assessment_title":"All types","data":[{"p":'
            assert r["result"] == start + want.get(r["doc_id"], "[]") + "}]}", ANSWERS[min(r["doc_id"], len(ANSWERS) - 1)]
            json.loads(r["result"])
    assert len(long) > 300


def test_records_equal_responses(lined):
    lines, aligned = lined
    long = L.db_responses(D.field_rows(aligned)).orderBy("doc_id", "pos").collect()
    want = {
        (r["doc_id"], r["section_code"], r["group_number"], r["group_title"], r["question_key"], r["question_number"], r["question_text"],
         r["response_value"], r["response_text"])
        for r in long
    }
    got, order = set(), {}
    for r in L.db_records(lines).collect():
        assert (r["sections"] is None) == (r["trouble"] is not None)
        for s in r["sections"] or []:
            for g in s["assessment_question_groups"]:
                order.setdefault(r["doc_id"], []).append((s["section_code"], g["group_number"]))
                for a in g["assessment_responses"]:
                    assert len(a["responses"]) == 1
                    got.add((r["doc_id"], s["section_code"], g["group_number"], g["group_title"], a["question_key"], a["question_number"],
                             a["question_text"], *a["responses"][0]))
    assert got == want and len(want) == len(long)
    groups = [("B", "10.G10"), ("B", "2.G2"), ("A", "1.G1")]
    assert set(map(tuple, order.values())) == {tuple(groups)}


def test_no_lambda_formats_and_nothing_is_shuffled(lined):
    plan = R.reverse_map(lined[0])._jdf.queryExecution().executedPlan().toString()
    facts = plan.split("BroadcastExchange")[0]
    assert "ArrowEvalPython" in facts and "Exchange hashpartitioning" not in facts and "array_position" not in facts


LISTS = [
    '["z", null]', "[null]", "[true, null, false]", "[[1], null, []]", '[{"entry": "z", "description": 5.50}, null]', "[5.0, 5]", "[-1, null]",
    '["z", -1.50, "x y"]', '["a\u2028,1", 2.0]', '["[1", "x,-2", "z"]', '[{"entry": 5.0}, 2]', '[{"entry": [1.50, "z"]}]', "[1e20, true]",
]


def test_lists_equal_columns(spark):
    """Items of lists whose JSON text tells their types, and of those that need the types beside it."""
    lines, aligned = _lined(spark, LISTS)
    for name in ("ui", "default"):
        long = R.format_fields(D.field_rows(aligned), name).orderBy("doc_id", "pos", "item").collect()
        want = {k: listed(v) for k, v in by_document(long).items()}
        got = {r["doc_id"]: r["result"] for r in R.reverse_map(lines, name, group_as=None, properties_key="p", id_field=None, type_field=None).collect()}
        for k, text in enumerate(LISTS):
            assert got[k] == '{"assessment_title":"All types","data":[{"p":' + want[k] + "}]}", text
    shown = {(r["doc_id"], r["question_key"], r["response_value"], r["response_text"]) for r in L.db_responses(D.field_rows(aligned)).collect()}
    made = {(r["doc_id"], a["question_key"], *a["responses"][0]) for r in L.db_records(lines).collect() for s in r["sections"] or []
            for g in s["assessment_question_groups"] for a in g["assessment_responses"]}
    assert made == shown


def test_what_is_sent_has_no_nested_and_no_null_lists(lined):
    """Spark walks over null lists, and over those within lists, after every row of an Arrow batch."""
    sent = batches.sent(lined[0], ["doc_id"])
    assert {f.dataType.simpleString() for f in sent.schema["_sent"].dataType} == {"string", "array<string>"}
    rows = {r["doc_id"]: r["_sent"] for r in sent.collect()}
    assert {k for k, r in rows.items() if r["rules"] is None} == {101, 102, 103}
    for r in rows.values():
        assert len(r["paths"]) == len(r["texts"]) == len(r["more"])
    assert rows[101]["paths"] == [] and len(rows[0]["paths"]) == len(KINDS)
    facts = L.db_records(lined[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "rules_text" in facts and "map_zip_with" not in facts


def test_documents_of_several_templates_in_small_parts(lined, monkeypatch):
    """Documents of several templates, some without a record, in parts that Arrow hands out one by one."""
    rows = batches.sent(lined[0], ["doc_id"]).orderBy("doc_id").select("_sent.*").toArrow().combine_chunks()
    columns = [rows.column(c).chunk(0) for c in ("rules", "paths", "texts", "more")]
    rules = [None if t is None else t if i % 3 else t.replace('"B.1', '"C.1') for i, t in enumerate(columns[0].to_pylist())]
    columns[0] = pa.array(rules, pa.string())
    whole = list(batches.documents(*columns))
    monkeypatch.setattr(batches, "TAKEN_ANSWERS", 20)
    parts = list(batches.documents(*columns))
    shown = lambda found: [d and (d[0], [r.path for r in d[1]], d[2]) for d in found]
    assert shown(parts) == shown(whole) and len({d[0] for d in whole if d}) == 2 and None in whole


def test_values_are_written_as_spark_writes_them(spark):
    texts = ['a"b\\c', "\x01\x1f\x7f\b\f\n\r\t/é ", "", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.to_json(F.array("t")).alias("j")).collect()
    assert [f'[{batches.quoted(r["t"])}]' for r in rows] == [r["j"] for r in rows]
    assert batches.quoted(None) is None
