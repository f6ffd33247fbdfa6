"""ISO-8601 reading without dependence on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewarden.functions.text import strip

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?$"
OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)$"


def iso_timestamp(c: Column) -> Column:
    """Timestamp of an ISO-8601 text; no offset means UTC; null if unreadable.

    Read: date with ``T`` or a space before the time, optional seconds and fraction, ``Z`` or an
    offset with or without a colon. Null, blank and any other text give null.
    """
    text = F.regexp_replace(F.upper(strip(c)), ",", ".")
    ok = text.rlike(ISO)
    tail = F.regexp_extract(F.substring(text, 11, 100), OFFSET, 1)
    body = F.when(tail == "", text).otherwise(F.rtrim(F.regexp_replace(text, OFFSET, "")))
    digits = F.regexp_replace(tail, ":", "")
    zone = (
        F.when(tail.isin("", "Z"), F.lit("Z"))
        .when(F.length(digits) == 3, F.concat(digits, F.lit(":00")))
        .otherwise(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2)))
    )
    whole = F.when(F.length(body) == 10, F.concat(body, F.lit("T00:00:00"))).otherwise(F.regexp_replace(body, " ", "T"))
    return F.when(ok, F.concat(whole, zone).try_cast("timestamp"))


def iso_text(c: Column, default: str = "2023-01-01T00:00:00+00:00") -> Column:
    """ISO text of a time in UTC; the default for a text that cannot be read."""
    return F.coalesce(F.date_format(iso_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(default))


def assigned_ms(c: Column) -> Column:
    """Event time in milliseconds that a stream is ordered by; 0 for a text that cannot be read."""
    return F.coalesce(F.unix_millis(iso_timestamp(c)), F.lit(0).cast("bigint"))


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def iso_hour(hours: Column) -> Column:
    """Hours since the epoch as ``2024-03-01T05:00:00Z``."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(hours / 24).cast("int"))
    return F.format_string("%sT%02d:00:00Z", day.cast("string"), F.pmod(hours, F.lit(24)).cast("int"))
