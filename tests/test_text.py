from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import text as T

CASES = [
    ("<b>Bold</b> text", "Bold text"),
    ('say "yes" or \'no\'', "say yes or no"),
    ("a\\b", "a b"),
    ("line\r\nbreak\ttab", "line break tab"),
    ("[x] {y}", "x y"),
    ("5 < 6 and 7", "5 < 6 and 7"),
    ("a < b > c", "a c"),
    ("<<b>>x", ">x"),
    ("  wide gap　", "wide gap"),
    ("\x85\x7fx", "x"),
    ("", ""),
    (None, None),
]


def model(text: str) -> str:
    """What the cleaning rule says, in plain Python."""
    out = re.sub(r"<[^>]+>", "", text)
    out = "".join(" " if c == "\\" or ord(c) < 32 or 127 <= ord(c) < 160 else c for c in out)
    return " ".join("".join(c for c in out if c not in "\"'[]{}").split())


def clean_all(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", T.clean_text(F.col("t")).alias("c")).collect()
    return [r["c"] for r in sorted(rows, key=lambda r: r["i"])]


def test_clean_text(spark):
    assert clean_all(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")), min_size=50, max_size=80))
def test_clean_text_matches_model(spark, texts):
    assert clean_all(spark, texts) == [model(t) for t in texts]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (T.file_safe_name, "Daily Note - V 5 (new)", "Daily_Note_V_5_new"),
        (T.file_safe_name, "__é²x!", "é²x"),
        (T.underscored, "a b  c", "a_b__c"),
        (T.lenient_id, " 007 ", "7"),
        (T.lenient_id, "x1", "x1"),
        (T.lenient_id, "", ""),
    ],
)
def test_names(spark, make, value, want):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(make(F.col("v")).alias("o")).first()["o"] == want


def test_prefix_and_instruction_keys(spark):
    frame = spark.createDataFrame(
        [("Cust_1", ""), ("1", None), ("Cust_D_", ""), ("Cust_D_", "3"), ("Cust_4_", ""), ("aD_", "")],
        "k string, n string",
    )
    rows = frame.select(
        T.with_prefix(F.col("k"), "Cust").alias("p"),
        T.is_instruction_key(F.col("k"), F.col("n")).alias("i"),
    ).collect()
    assert [r["p"] for r in rows][:2] == ["Cust_1", "Cust_1"]
    assert [r["i"] for r in rows] == [False, False, True, False, False, False]
