"""Date rules: literal cases, a differential test, and the weekday closed form against a loop."""

from __future__ import annotations

import datetime as dt
import itertools
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookwright.functions import dates as D

PIVOT = dt.date.today().year

# raw, batch, interactive
CASES = [
    ("2025-01-02", "2025-01-02", "2025-02-01"),
    ("2025-13-01", "", "2025-01-13"),
    ("2025-02-30", "", ""),
    ("02/01/2025", "2025-01-02", "2025-01-02"),
    ("13/02/2025", "2025-02-13", "2025-02-13"),
    ("02/13/2025", "2025-02-13", "2025-02-13"),
    ("30/02/2025", "", ""),
    ("2/1/25", "2025-01-02", "2025-01-02"),
    ("2 Sept 2025", "2025-09-02", "2025-09-02"),
    ("2nd Jan 2025", "2025-01-02", "2025-01-02"),
    ("Mon 6 Jan 2025", "2025-01-06", "2025-01-06"),
    ("Jan 2, 2025", "2025-01-02", "2025-01-02"),
    ("02-Jan-25", "2025-01-02", "2025-01-02"),
    ("20250102", "2025-01-02", "2025-01-02"),
    ("2025/01/02", "2025-02-01", "2025-02-01"),
    ("2025-01-02 00:00:00", "2025-02-01", "2025-02-01"),
    ("2025-01-02T10:00:00Z", "2025-02-01", "2025-02-01"),
    ("02/01/2025 14:30", "2025-01-02", "2025-01-02"),
    ("02/01/2025 25:00", "", ""),
    ("2025", "2025-01-01", "2025-01-01"),
    ("Jan 2025", "2025-01-01", "2025-01-01"),
    ("1/2025", "2025-01-01", "2025-01-01"),
    ("TBC", "", ""),
    ("5", "", ""),
    ("45678", "", ""),
    ("1735776000", "", ""),
    ("02012025", "", ""),
    ("", "", ""),
    (None, "", ""),
    ("21/09/1677", "", ""),
    ("22/09/1677", "1677-09-22", "1677-09-22"),
    ("11/04/2262", "2262-04-11", "2262-04-11"),
    ("12/04/2262", "", ""),
    ("  03/02/2025 ", "2025-02-03", "2025-02-03"),
]


@pytest.mark.parametrize("policy", ["batch", "interactive"])
def test_literal_cases(spark, policy):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(D.due_on(F.col("raw"), policy, 2026)).collect()]
    assert got == [c[1 if policy == "batch" else 2] for c in CASES]


def test_two_digit_years_turn_at_the_pivot(spark):
    df = spark.createDataFrame([("2/1/75",), ("2/1/76",)], "raw string")
    assert [r[0] for r in df.select(D.due_on(F.col("raw"), "batch", 2026)).collect()] == ["2075-01-02", "1976-01-02"]


def test_iso_first_trusts_iso_with_a_time(spark):
    df = spark.createDataFrame([("2025-01-02 00:00:00",), ("2025-01-02T10:00:00Z",), ("02/01/2025",)], "raw string")
    assert {r[0] for r in df.select(D.due_on(F.col("raw"), "iso_first")).collect()} == {"2025-01-02"}


def _day_first(raw: str) -> str:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = pd.to_datetime(raw, dayfirst=True, errors="coerce")
    return "" if pd.isna(parsed) else parsed.strftime("%Y-%m-%d")


def test_agrees_with_pandas_day_first(spark):
    numbers = ["1", "05", "12", "13", "31", "32", "75", "2025", "1999"]
    raws = [sep.join(t) for t in itertools.product(numbers, repeat=3) for sep in "/-. "]
    names = ["Jan", "march", "Sept"]
    mixed = itertools.product(["1", "05", "13", "31", "75", "2025", *names], repeat=3)
    raws += [sep.join(t) for t in mixed if sum(x in names for x in t) == 1 for sep in ("/", "-", " ")]
    raws += [sep.join(t) for t in itertools.product([*numbers, "Jan"], repeat=2) for sep in "/- "]
    df = spark.createDataFrame([(r,) for r in dict.fromkeys(raws)], "raw string")
    rows = df.select("raw", D.due_on(F.col("raw"), "interactive", PIVOT).alias("due")).collect()
    assert len(rows) > 3000
    assert {r.raw: r.due for r in rows} == {r.raw: _day_first(r.raw) for r in rows}


def test_iso_to_date(spark):
    df = spark.createDataFrame([("2025-01-02",), ("2025-02-30",), ("x",), ("",)], "raw string")
    assert [r[0] for r in df.select(D.iso_to_date(F.col("raw"))).collect()] == [dt.date(2025, 1, 2), None, None, None]


def test_weekdays_match_the_loop(spark):
    def loop(day: dt.date, n: int) -> dt.date:
        while n > 0:
            day -= dt.timedelta(days=1)
            n -= day.weekday() < 5
        return day

    days = [dt.date(2024, 12, 20) + dt.timedelta(days=i) for i in range(60)]
    counts = range(0, 30)
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for row in df.select("d", *(D.subtract_weekdays(F.col("d"), n).alias(f"n{n}") for n in counts)).collect():
        assert [row[f"n{n}"] for n in counts] == [loop(row.d, n) for n in counts]


def test_unknown_policy():
    with pytest.raises(ValueError):
        D.due_date(None, "other")


@pytest.mark.parametrize("policy", D.POLICIES)
def test_compiled_steps_equal_the_one_expression(spark, policy):
    """Over rows in which texts repeat, with nulls, and without an interpreted function in the plan."""
    texts = [
        None, "", " ", "TBC", "2025-01-02", "2025-13-02", "2025-01-02T10:00", "02/01/2025", "13.02.2025", "02-13-2025", "1 Jan 25",
        "January 5, 2025", "Fri 3rd of Jan 2025 at 10 am", "20250102", "20251302", "250102", "Jan 2025", "2025", "25", "5/2025", "1/2/3/4",
        "99999999", "0001-01-01", "3000-01-01", "x1y2", "1.2.25 23:59:59Z",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "i int, raw string")
    want = {r.i: r.due for r in df.select("i", D.due_date(F.col("raw"), policy, 2026).alias("due")).collect()}
    for dated in (D.with_due_date(df, "raw", "due", policy, 2026), D.lookup_due_date(df, "raw", "due", policy, 2026)):
        assert dated.columns == ["i", "raw", "due"]
        assert {r.i: r.due for r in dated.collect()} == want
        assert "lambda" not in dated._jdf.queryExecution().toString()
