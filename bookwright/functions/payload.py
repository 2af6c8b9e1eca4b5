"""Expressions over message headers, encoded content and acknowledgement bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_value(headers: Column, key: str) -> Column:
    """Value of the first header with that name, in any case; ``""`` without one."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == key.lower())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def received_at(millis: Column) -> Column:
    """Epoch milliseconds to ISO-8601 in UTC; ``""`` for blank or bad input.

    Worked out from whole days and a rest, so the session time zone does not matter.
    """
    text = F.trim(F.coalesce(millis.cast("string"), F.lit("")))
    ms = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    in_range = ms.between(-62135596800000, 253402300799999)  # years 1 to 9999
    rest = F.pmod(ms, F.lit(86400000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((ms - rest) / 86400000).cast("int"))

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    seconds = F.floor(rest / 1000)
    clock = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    fraction = F.when(rest % 1000 == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("000"))
    )
    iso = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, fraction, F.lit("+00:00"))
    return F.when(in_range, iso).otherwise(F.lit(""))


def decode_payload(data: Column) -> Column:
    """base64url text, padded or not, to bytes; NULL where it is not base64."""
    plain = F.translate(data, "-_=", "+/")
    padding = F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))
    return F.try_to_binary(F.concat(plain, padding), F.lit("base64"))


def ack_error_text(code: Column, body: Column, prefix: str = "API error") -> Column:
    """``prefix code: message`` of a failed call; the whole body where it names no message."""
    message = F.get_json_object(body, "$.errors[0].message")
    text = F.when(F.coalesce(message, F.lit("")) != "", message).otherwise(F.coalesce(body, F.lit("")))
    return F.concat(F.lit(prefix + " "), code.cast("string"), F.lit(": "), text)


def ack_data(body: Column) -> Column:
    """The ``data`` member of a response body, or the body where it has none."""
    return F.coalesce(F.get_json_object(body, "$.data"), body)
