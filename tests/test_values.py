from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates as D
from fieldloom.functions import values as V


def shown(spark, make, text):
    frame = spark.createDataFrame([(text,)], "t string")
    return frame.select(make(F.parse_json("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("5.0", "5.0"), ("5.10", "5.1"), ("true", "True"), ("1e16", "1e+16"), ("1e7", "10000000.0"),
        ("1.5e-5", "1.5e-05"), ("12345678901234567890", "12345678901234567890"), ("7", "7"),
        ('"x"', "x"), ("null", None), ("0.1e0", "0.1"),
    ],
)
def test_answer_text(spark, text, want):
    assert shown(spark, V.answer_text, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("5.0", "integer"), ("5.5", "number"), ("1e2", "integer"), ("true", "boolean"),
        ('"7"', "string"), ("null", "null"), ("[1]", "array"), ("{}", "object"),
    ],
)
def test_json_type(spark, text, want):
    assert shown(spark, V.json_type, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("null", ""), ("{}", ""), ('{"response_value":"a"}', "a"), ('{"response_value":0}', ""),
        ('{"response_value":null}', ""), ("0", "0"), ('["a","",null,"b"]', "a,b"), ("[]", ""),
        ('"  x "', "x"), ("false", "False"),
    ],
)
def test_normalize_answer(spark, text, want):
    assert shown(spark, V.normalize_answer, text) == want


@pytest.mark.parametrize(
    "text, want", [('["a",null,1]', ["a", "1"]), ('"a, b,,"', ["a", "b"]), ("null", []), ("5", [])]
)
def test_list_answer(spark, text, want):
    assert shown(spark, V.list_answer, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("20240105", True), ("20240132", False), ("2024-W53-1", False), ("2020-W53-7", True), ("2024W01", True),
        ("20240105T102030Z", True), ("2024-W00", False), ("2024-02-29", True), ("2023-02-29", False), ("2024-1-5", False), ("2024-01-05T", False),
        ("2024-01-05T10:00:00Z", True), ("2024-01-05 10:00", True), ("2024-01-05T10:00+02:00", True),
        ("2024-01-05Z", False), ("0000-01-01", False), ("x", False),
    ],
)
def test_iso(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(D.is_iso_date(F.col("t")).alias("o")).first()["o"] is want
