"""Date rules as column expressions.

``due_date`` reads the free-form start dates of a report day-first. The two usual shapes take
fixed-position branches; everything else is cut into at most three tokens, and the tokens
are told apart by size, the way people write dates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.functions.text import py_strip
from bookwright.session import materialise

# The range of a nanosecond timestamp, in whole days.
FIRST_DATE = "1677-09-22"
LAST_DATE = "2262-04-11"

# Month names.
MONTHS = (
    ("jan", "january"),
    ("feb", "february"),
    ("mar", "march"),
    ("apr", "april"),
    ("may",),
    ("jun", "june"),
    ("jul", "july"),
    ("aug", "august"),
    ("sep", "sept", "september"),
    ("oct", "october"),
    ("nov", "november"),
    ("dec", "december"),
)

POLICIES = ("batch", "interactive", "iso_first")

_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.]\d+)?)?\s*(?:am|pm)?"
_ZONE = r"\s*(?:z|utc|gmt|[+-]\d\d:?\d\d)?"
_TIME_AT_END = rf"(?:(?<=\d)t|\s+(?:at\s+)?)(?:{_CLOCK}|(?:0?[1-9]|1[0-2])\s*(?:am|pm)){_ZONE}\z|(?<=\d)t(?:[01]\d|2[0-3])(?:[0-5]\d)?\z"
_TIME_AT_START = rf"^{_CLOCK}\s+"
_WEEKDAY = r"\b(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
_ORDINAL = r"(?<=\d)(?:st|nd|rd|th)\b|\bof\b"
_SAFE_YEAR = r"(?:1[7-9]|2[01])\d\d"
_TOKEN_GAP = r"[\s,./'-]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)"

# A token becomes a number: one or two digits as they are, four digits lifted by _FOUR so that
# they cannot be a day, a month name as its negated number. Anything else becomes NULL.
_FOUR = 10000


def _make(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the calendar has no such day."""
    parts = (F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string"))
    return F.concat_ws("-", *parts).try_cast("date")


def _token_number(token: Column) -> Column:
    names = F.split(F.lit(",".join(name for month in MONTHS for name in month)), ",")
    short = F.split(F.lit(",".join(month[0] for month in MONTHS)), ",")
    month = F.array_position(short, F.left(token, F.lit(3))).cast("int")
    return (
        F.when(token.rlike(r"^\d{1,2}\z"), token.try_cast("int"))
        .when(token.rlike(r"^\d{4}\z"), token.try_cast("int") + _FOUR)
        .when(F.array_contains(names, token), -month)
    )


def _full_year(token: Column, pivot_year: int) -> Column:
    """Two digits mean the year within fifty years of the pivot."""
    near = token + (pivot_year // 100) * 100
    near = F.when(near >= pivot_year + 50, near - 100).when(near < pivot_year - 50, near + 100).otherwise(near)
    return F.when(token >= _FOUR, token - _FOUR).otherwise(near)


def _year_month_day(n: Column) -> Column:
    """Which of the numbers is the year, the month and the day, as an array in that order."""
    a, b, c, size = n["a"], n["b"], n["c"], n["size"]
    first = F.lit(1)
    three = (
        F.when((a < 0) & (b > 31), F.array(b, a, c))
        .when(a < 0, F.array(c, a, b))
        .when((b < 0) & (a > 31), F.array(a, b, c))
        .when(b < 0, F.array(c, b, a))
        .when((c < 0) & (b > 31), F.array(b, c, a))
        .when(c < 0, F.array(a, c, b))
        .when((a > 31) & (c <= 12), F.array(a, c, b))
        .when(a > 31, F.array(a, b, c))
        .when((a > 12) | (b <= 12), F.array(c, b, a))
        .otherwise(F.array(c, a, b))
    )
    two = F.when((a > 31) & (b <= 12), F.array(a, b, first)).when((b > 31) & (a <= 12), F.array(b, a, first))
    one = F.when((size == 1) & (a >= _FOUR), F.array(a, first, first))
    return F.when((size == 3) & n["known"], three).when((size == 2) & n["known"], two).when(n["known"], one)


def _cleaned(text: Column) -> Column:
    """The tokens of a text that is in no fixed shape, with one space between them."""
    timeless = F.regexp_replace(F.lower(text), f"{_TIME_AT_END}|{_TIME_AT_START}", "")
    words = F.regexp_replace(F.regexp_replace(timeless, _WEEKDAY, " "), _ORDINAL, "")
    spaced = F.regexp_replace(words, r"^(\d\d)(\d\d)(\d\d)\z", "$1 $2 $3")
    return F.trim(F.regexp_replace(spaced, _TOKEN_GAP, " "))


def _numbers(parts: Column) -> Column:
    """Up to three tokens as numbers; ``known`` if each of them is one."""
    tokens = [F.get(parts, F.lit(i)) for i in range(3)]
    a, b, c = (_token_number(t) for t in tokens)
    size = F.size(parts)
    known = a.isNotNull() & (b.isNotNull() | (size < 2)) & (c.isNotNull() | (size < 3)) & (size <= 3)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), size.alias("size"), known.alias("known"))


def _fixed(text: Column, policy: str) -> Column:
    """Dates in fixed positions as ``date``; ``free`` if the text has another shape.

    These branches take years that are in range whatever the day.
    """

    def shaped(found: Column) -> Column:
        return F.struct(found.cast("date").alias("date"), F.lit(False).alias("free"))

    parsed = F.when(text == "", shaped(F.lit(None)))
    if policy == "interactive":
        year, second, third = (F.substring(text, i, n) for i, n in ((1, 4), (6, 2), (9, 2)))
        swapped = F.when(third <= "12", _make(year, third, second)).otherwise(_make(year, second, third))
        parsed = parsed.when(text.rlike(rf"^{_SAFE_YEAR}-\d\d-\d\d\z"), shaped(swapped))
    else:
        in_range = text.between(FIRST_DATE, LAST_DATE)
        parsed = parsed.when(text.rlike(r"^\d{4}-\d\d-\d\d\z"), shaped(F.when(in_range, text.try_cast("date"))))
    if policy == "iso_first":
        head = F.substring(text, 1, 10)
        in_range = head.between(FIRST_DATE, LAST_DATE)
        parsed = parsed.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), shaped(F.when(in_range, head.try_cast("date"))))
    first, second, year = (F.substring(text, i, n) for i, n in ((1, 2), (4, 2), (7, 4)))
    day_first = (second <= "12") | (first > "12")
    slashed = F.when(day_first, _make(year, second, first)).otherwise(_make(year, first, second))
    parsed = parsed.when(text.rlike(rf"^\d\d[/.-]\d\d[/.-]{_SAFE_YEAR}\z"), shaped(slashed))
    # A text without a digit is no date, whatever it says.
    parsed = parsed.when(~text.rlike("[0-9]"), shaped(F.lit(None)))
    return parsed.otherwise(F.struct(F.lit(None).cast("date").alias("date"), F.lit(True).alias("free")))


def _free(cleaned: Column, order: Column, pivot_year: int) -> Column:
    # Eight digits are year, month, day, or year, day, month where that is no date.
    y, m, d = (F.substring(cleaned, i, n) for i, n in ((1, 4), (5, 2), (7, 2)))
    packed = cleaned.rlike(r"^\d{8}(?:\d{4}|\d{6})?\z")
    year, month, day = (F.get(order, F.lit(i)) for i in range(3))
    spread = _make(_full_year(year, pivot_year), F.abs(month), day)
    return F.when(packed, F.coalesce(_make(y, m, d), _make(y, d, m))).otherwise(spread)


def _in_range(d: Column) -> Column:
    return F.when(d.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")), d)


Values = dict[str, Column]


def _stages(policy: str, pivot_year: int | None) -> list[tuple[str, Callable[[Values], Column]]]:
    """The steps from ``text`` to ``due``, each of which uses the values of those before it."""
    if policy not in POLICIES:
        raise ValueError(f"unknown date policy {policy!r}, expected one of {POLICIES}")
    pivot = dt.date.today().year if pivot_year is None else pivot_year
    return [
        ("fixed", lambda v: _fixed(v["text"], policy)),
        ("cleaned", lambda v: F.when(v["fixed"]["free"], _cleaned(v["text"]))),
        ("parts", lambda v: F.split(v["cleaned"], " ")),
        ("numbers", lambda v: _numbers(v["parts"])),
        ("order", lambda v: _year_month_day(v["numbers"])),
        ("found", lambda v: _free(v["cleaned"], v["order"], pivot)),
        ("due", lambda v: F.when(v["fixed"]["free"], _in_range(v["found"])).otherwise(v["fixed"]["date"])),
    ]


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work a value out once and name it in ``use``, by way of an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def due_date(c: Column, policy: str = "batch", pivot_year: int | None = None, stripped: bool = False) -> Column:
    """Free-form text to DATE, NULL where it is no date, as one expression.

    ``batch`` reads ``yyyy-MM-dd`` strictly and all else day-first; ``interactive`` reads that
    shape day-first too; ``iso_first`` also trusts an ISO date that a time follows. For whole tables
    ``with_due_date`` gives the same by way of compiled projections.
    """
    stages = _stages(policy, pivot_year)

    def walk(at: int, values: Values) -> Column:
        name, step = stages[at]
        if at == len(stages) - 1:
            return step(values)
        return _bind(step(values), lambda x: walk(at + 1, values | {name: x}))

    text = c if stripped else py_strip(F.coalesce(c, F.lit("")))
    return _bind(text, lambda x: walk(0, {"text": x}))


def with_due_date(
    df: DataFrame, column: str, out: str, policy: str = "batch", pivot_year: int | None = None, stripped: bool = False
) -> DataFrame:
    """``df`` with the date of ``column`` as ``out``: one projection per step, all of them compiled."""
    c = F.col(column)
    names = {"text": "_due_text"} | {name: f"_due_{name}" for name, _ in _stages(policy, pivot_year)}
    values = {name: F.col(inner) for name, inner in names.items()}
    staged = df.withColumn(names["text"], c if stripped else py_strip(F.coalesce(c, F.lit(""))))
    for name, step in _stages(policy, pivot_year):
        staged = staged.withColumn(names[name], step(values))
    kept = [c for c in df.columns if c != out]
    return staged.select(*kept, F.col(names["due"]).alias(out))


def lookup_due_date(
    df: DataFrame, column: str, out: str, policy: str = "batch", pivot_year: int | None = None
) -> DataFrame:
    """As ``with_due_date``, by way of a dictionary of the different texts, for tables in which texts repeat.

    A text is read once however many rows have it. The dictionary is a written table, so that its measured size decides how
    it is joined; a text that very many rows share is split by AQE where it is not broadcast.
    """
    texts = df.select(F.col(column).alias("_text")).distinct()
    known = materialise(with_due_date(texts, "_text", "_due", policy, pivot_year), "dates")
    kept = [F.col(c) for c in df.columns if c != out]
    return df.join(known, F.col(column).eqNullSafe(F.col("_text")), "left").select(*kept, F.col("_due").alias(out))


def iso_text(d: Column) -> Column:
    """DATE to ``yyyy-MM-dd``, NULL to ``""``."""
    return F.coalesce(d.cast("string"), F.lit(""))


def due_on(c: Column, policy: str = "batch", pivot_year: int | None = None) -> Column:
    return iso_text(due_date(c, policy, pivot_year))


def iso_to_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text to DATE; NULL for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), c.try_cast("date"))


def subtract_weekdays(d: Column, n: int) -> Column:
    """The date ``n`` weekdays before ``d``, in closed form.

    A weekend counts back from the Monday after it; every five weekdays span a weekend.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return d
    weekday = F.weekday(d)
    to_monday = F.when(weekday < 5, F.lit(0)).otherwise(F.lit(7) - weekday)
    base_weekday = F.when(weekday < 5, weekday).otherwise(F.lit(0))
    weekends = F.floor((F.lit(n + 4) - base_weekday) / 5).cast("int")
    return F.date_add(d, to_monday - (F.lit(n) + 2 * weekends))
