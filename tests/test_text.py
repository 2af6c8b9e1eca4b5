"""Literal cases of the string rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bookwright.functions import payload as P
from bookwright.functions import text as T


def values(spark, cases, rule):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("c"))).collect()]


def test_campaign(spark):
    cases = {
        "Foo ,": "Foo ",
        "Foo,,": "Foo,",
        ",": "",
        "  a \t b\n": "a b",
        " x\u001c": "x",
        "a, ,": "a, ",
        "a b": "a b",
        "": "",
        None: "",
        " x , ": "x ",
    }
    assert values(spark, cases, T.normalize_campaign) == list(cases.values())


def test_job(spark):
    cases = {"12.0": "12", "1.2.0": "1.2.0", ".0": "", "0.0": "0", "007": "007", " 7.0 ": "7", "7.00": "7.00", None: "", "a.0": "a.0"}
    assert values(spark, cases, T.normalize_job) == list(cases.values())


def test_strip_matches_python(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(T.WHITESPACE) == sorted(blanks)
    cases = [b + "x" + b for b in blanks] + ["".join(blanks), "​x", "x﻿"]
    assert values(spark, cases, T.py_strip) == [c.strip() for c in cases]


def test_missing_tokens_match_whole_cells_only(spark):
    cases = {"NA": "", "None": "", " NA": " NA", "na": "na", None: "", "n/a": "", "x": "x"}
    assert values(spark, cases, T.fill_na) == list(cases.values())


def test_child_title_is_stripped_at_the_end(spark):
    row = spark.range(1).select(T.child_title(F.lit("1"), F.lit("p"), F.lit("l"), F.lit("")).alias("t")).first()
    assert row.t == "(1) p - l:"


def test_flags(spark):
    cases = {"": True, " ": True, "YES": True, " 1 ": True, "off": False, "on": True, "2": False, None: True}
    assert values(spark, cases, lambda c: T.as_flag(c, True)) == list(cases.values())


def test_numbers(spark):
    cases = {"x": 30, "-5": 1, "40": 40, "": 30, "1.5": 30, " 7 ": 7, None: 30, "9" * 30: 30}
    assert values(spark, cases, lambda c: T.as_positive_int(c, 30)) == list(cases.values())


def test_lists_and_ids(spark):
    assert values(spark, ["100, ,101", "", None, "a,1 "], T.split_list) == [["100", "101"], [], [], ["a", "1"]]
    assert values(spark, ["100,a1,2x"], lambda c: T.invalid_ids(T.split_list(c))) == [["a1", "2x"]]


@pytest.mark.parametrize(
    ("millis", "iso"),
    [
        ("1704067207179", "2024-01-01T00:00:07.179000+00:00"),
        ("1704067207000", "2024-01-01T00:00:07+00:00"),
        ("0", "1970-01-01T00:00:00+00:00"),
        ("-1", "1969-12-31T23:59:59.999000+00:00"),
        ("", ""),
        ("soon", ""),
        (None, ""),
        ("999999999999999999", ""),
        ("99999999999999999999", ""),
    ],
)
def test_received_at(spark, millis, iso):
    assert values(spark, [millis], P.received_at) == [iso]


def test_received_at_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, ["1704067207179"], P.received_at) == ["2024-01-01T00:00:07.179000+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_payload_padding(spark):
    texts = ["a", "ab", "abc", "ÿþ??>>", ""]
    import base64

    encoded = [base64.urlsafe_b64encode(t.encode()).decode().rstrip("=") for t in texts]
    assert values(spark, encoded, lambda c: P.decode_payload(c).cast("string")) == texts
    padded = [base64.urlsafe_b64encode(t.encode()).decode() for t in texts]
    assert values(spark, padded, lambda c: P.decode_payload(c).cast("string")) == texts
    assert values(spark, ["!!"], P.decode_payload) == [None]


def test_error_text(spark):
    cases = {
        '{"errors":[{"message":"quota"}]}': "API error 429: quota",
        '{"errors":[]}': 'API error 429: {"errors":[]}',
        '{"errors":[{"message":""}]}': 'API error 429: {"errors":[{"message":""}]}',
        "<html>": "API error 429: <html>",
    }
    assert values(spark, cases, lambda c: P.ack_error_text(F.lit(429), c)) == list(cases.values())
    bodies = ['{"data":{"gid":"1"}}', '{"gid":"2"}', "oops"]
    assert values(spark, bodies, P.ack_data) == ['{"gid":"1"}', '{"gid":"2"}', "oops"]
