"""Scalar expressions against plain-Python statements of the same rules."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.functions import text as X
from tickwise.functions.guardrail import (MSG_DEFAULT, MSG_HATE, MSG_PRIVACY, MSG_SPECIALIZED_ADVICE,
                                          guardrail_category, guardrail_message, is_guardrail)

EDGE = ["BG US Equity", "", " BG", "BP LN Equity", "a..b", ".bashrc", "..b", "a.", ".a.b", "x/y.tar.gz",
        "  padded\t\n", "It costs $5 ", "$$", " x　", "a__b__c", "no_sep", "tab\tsep", "a.b.c",
        "x\x1fy\x1c", "multi  space  words", " nbsp "]


def _eval(spark, values, expr_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = df.select("i", expr_fn(F.col("s")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


@pytest.mark.parametrize("expr_fn,py_fn", [
    (X.first_token, lambda s: s.split(" ")[0]),
    (X.normalise_ticker, lambda s: s.partition(" ")[0] + "-US"),
    (lambda c: X.last_part(c, "__"), lambda s: s.split("__")[-1]),
    (lambda c: X.last_part(c, "."), lambda s: s.split(".")[-1]),
    (lambda c: X.last_part(c, "/"), lambda s: s.split("/")[-1]),
    (X.after_first_space, lambda s: s.split(" ", 1)[-1]),
    (X.file_stem, lambda s: os.path.splitext(s)[0]),
    (X.clean_text, lambda s: s.replace("$", r"\$").strip()),
    (X.py_strip, lambda s: s.strip()),
    (X.capitalise, lambda s: s.capitalize()),
    (X.words, lambda s: s.split()),
    (X.base_identifier, lambda s: s.split(".")[0]),
    (X.media_type, lambda s: s.split(";")[0]),
])
def test_rules_match_python_on_edges(spark, expr_fn, py_fn):
    assert _eval(spark, EDGE, expr_fn) == [py_fn(s) for s in EDGE]


@settings(max_examples=10, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab. /_$\t\n  xY")), max_size=12),
                min_size=1, max_size=20))
def test_rules_match_python_random(spark, values):
    checks = [(X.file_stem, lambda s: os.path.splitext(s)[0]),
              (X.clean_text, lambda s: s.replace("$", r"\$").strip()),
              (X.words, lambda s: s.split()),
              (X.after_first_space, lambda s: s.split(" ", 1)[-1]),
              (lambda c: X.last_part(c, "/"), lambda s: s.split("/")[-1])]
    for expr_fn, py_fn in checks:
        assert _eval(spark, values, expr_fn) == [py_fn(s) for s in values]


def test_null_identifier_stays_null(spark):
    assert _eval(spark, [None], X.normalise_ticker) == [None]


def test_citation_label(spark):
    df = spark.createDataFrame([
        ("a/b/report.pdf", "10-K", "2"), ("a/b/report.pdf", " ", "2"), (".hidden", "10-K", ""),
        ("x/a..b", "10-Q", " 3 ")], "n string, t string, s string")
    got = [r[0] for r in df.select(X.citation_label("n", "t", "s")).collect()]
    assert got == ["report (10-K, section 2)", "report", ".hidden", "a. (10-Q, section 3)"]


def test_reference_label_and_policy_error(spark):
    df = spark.createDataFrame([(2, "m")], "n long, msg string")
    r = df.select(X.reference_label("n").alias("a"), X.policy_error("msg").alias("b")).first()
    assert r["a"] == "2 reference(s)"
    assert r["b"] == "[ERROR] Content policy violation detected.\nm"


def test_digest_and_request_id(spark):
    df = spark.createDataFrame([("md5=abc==", "k1"), ("sha256", "k2")], "d string, k string")
    r = df.select(X.digest_algorithm("d").alias("alg"), X.digest_value("d").alias("v"),
                  X.request_id(F.lit("2024-02-01 12:00:00").cast("timestamp"), F.col("k")).alias("id")).collect()
    assert (r[0]["alg"], r[0]["v"]) == ("MD5", "abc")
    assert (r[1]["alg"], r[1]["v"]) == ("SHA256", None)
    assert all(re.fullmatch(r"r\d{14}[0-9a-f]{6}", x["id"]) and len(x["id"]) == 21 for x in r)
    assert r[0]["id"].startswith("r20240201120000")


def test_minutes_between(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:45:00")], "a string, b string")
    r = df.select(X.minutes_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).first()[0]
    assert r == 45.0


# Fixed cases of the guardrail rule (message nested as string / object / absent).
GUARDRAIL_CASES = [
    ('{"message": "{\\"output_guardrail\\":[{\\"categories\\":{\\"privacy\\":true}}]}"}', True, MSG_PRIVACY),
    ('{"message": {"a":1}, "output_guardrail":[{"categories":{"hate":true}}]}', True, MSG_HATE),
    ('{"output_guardrail":[{"categories":{"hate":true,"specialized-advice":true}}]}', True, MSG_SPECIALIZED_ADVICE),
    ('{"output_guardrail":[]}', True, MSG_DEFAULT),
    ('{"message":"not json"}', False, None),
    ('{}', False, None),
    ('not json at all', False, None),
]


def test_guardrail_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(GUARDRAIL_CASES)], "i int, body string")
    rows = df.select("i", is_guardrail("body").alias("g"), guardrail_message("body").alias("m"),
                     guardrail_category("body").alias("c")).orderBy("i").collect()
    for (body, g, msg), r in zip(GUARDRAIL_CASES, rows):
        assert r["g"] == g, body
        if g:
            assert r["m"] == msg, body


def test_lookup_with_default(spark):
    df = spark.createDataFrame([({"chunk_id": "c1"},), ({},)], "m map<string,string>")
    got = [r[0] for r in df.select(X.lookup("m", "chunk_id", "none")).collect()]
    assert got == ["c1", "none"]


def test_ticker_root_with_overrides(spark):
    vals = ["BG US Equity", "BG-US", "BG LN Equity", "BRK-B US Equity", "BRK-B"]
    assert _eval(spark, vals, X.ticker_root) == ["BG", "BG", "BG", "BRK", "BRK"]
    over = {"BRK-B US Equity": "BRK-B", "BRK-B": "BRK-B"}
    assert _eval(spark, vals, lambda c: X.ticker_root(c, over)) == ["BG", "BG", "BG", "BRK-B", "BRK-B"]
