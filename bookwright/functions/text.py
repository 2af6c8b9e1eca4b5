"""String rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookwright.schema import NA_TOKENS, REPORT_SUFFIXES

# The code points that count as whitespace.
_SPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(c) for low, high in _SPACE_RANGES for c in range(low, high + 1))
_SPACE_RUN = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _SPACE_RANGES) + "]+"

# Texts of a setting that mean "on".
TRUE_WORDS = ("1", "true", "yes", "y", "on")


# The rules below name their input as few times as they can: a filter on a rule's result is
# pushed down as an expression, and every mention copies the whole input into it.


def py_strip(c: Column) -> Column:
    """Remove whitespace of every kind from both ends (``trim`` knows only U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def fill_na(c: Column) -> Column:
    """Null, and cells that are a missing-value token as a whole, become ``""``."""
    return F.coalesce(F.when(~c.isin(*NA_TOKENS), c), F.lit(""))


def normalize_campaign(c: Column, stripped: bool = False) -> Column:
    """Strip, drop one closing comma, then collapse whitespace runs, in that order."""
    text = c if stripped else py_strip(F.coalesce(c, F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, r",\z", ""), _SPACE_RUN, " ")


def normalize_job(c: Column, stripped: bool = False) -> Column:
    """Strip, and undo the ``.0`` a whole number gains when read as a float."""
    text = c if stripped else py_strip(F.coalesce(c, F.lit("")))
    return F.regexp_replace(text, r"^([0-9]*)[.]0\z", "$1")


def parent_title(campaign: Column, job: Column) -> Column:
    return F.concat(campaign, F.lit(" ("), job, F.lit(")"))


def child_title(ref: Column, prop: Column, location: Column, spec: Column) -> Column:
    """``(ref) property - location: spec``, stripped because the spec may be empty."""
    return py_strip(F.concat(F.lit("("), ref, F.lit(") "), prop, F.lit(" - "), location, F.lit(": "), spec))


def split_list(c: Column) -> Column:
    """Comma list to array; entries are stripped, blank ones dropped."""
    entries = F.transform(F.split(F.coalesce(c, F.lit("")), ","), py_strip)
    return F.filter(entries, lambda x: x != "")


def as_flag(c: Column, default: bool) -> Column:
    text = F.lower(py_strip(F.coalesce(c, F.lit(""))))
    return F.when(text == "", F.lit(default)).otherwise(text.isin(*TRUE_WORDS))


def invalid_ids(ids: Column) -> Column:
    """The entries of an array that are not all digits."""
    return F.filter(ids, lambda x: ~x.rlike(r"^[0-9]+\z"))


def as_positive_int(c: Column, default: int) -> Column:
    """Whole number, at least 1; the default where the text is not a number."""
    text = py_strip(F.coalesce(c, F.lit("")))
    number = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.when(number.isNull(), F.lit(default).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), number))


def is_report_attachment(
    filename: Column, attachment_id: Column, data: Column | None = None, suffixes: Sequence[str] = REPORT_SUFFIXES
) -> Column:
    """Named file of an allowed kind that has an attachment id and, where given, content."""
    name = F.lower(py_strip(F.coalesce(filename, F.lit(""))))
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | name.endswith(suffix.lower())
    keep = wanted & (F.coalesce(attachment_id, F.lit("")) != "")
    return keep if data is None else keep & (F.coalesce(F.length(data), F.lit(0)) > 0)
