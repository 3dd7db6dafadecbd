"""Times as numbers, mixed timestamp values, and date keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC_3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds(ts: Column | str) -> Column:
    return F.floor(micros(ts) / 1_000_000)


def parse_ts(value: Column | str) -> Column:
    """Epoch seconds (double) of an RFC 3339 text, cut to whole seconds, or of a number in text; else null.

    The text needs an offset. The instant is worked out from its parts, so the session's time zone
    doesn't matter.
    """
    value = F.col(value) if isinstance(value, str) else value
    is_rfc = value.rlike(RFC_3339)
    local = F.try_to_timestamp(F.concat(F.substring(value, 1, 10), F.lit(" "), F.substring(value, 12, 8), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    zone = F.regexp_extract(value, RFC_3339, 2)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    offset = F.when(F.upper(zone) == "Z", F.lit(0)).otherwise(F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (hours * 3600 + minutes * 60))
    return F.when(is_rfc, (F.unix_seconds(local) - offset).cast("double")).otherwise(value.try_cast("double"))


def date_key(ts: Column | str) -> Column:
    """The first ten characters if they look like 2024-05-06 (4, 2 and 2 digits); else null, an error."""
    head = F.substring(F.col(ts) if isinstance(ts, str) else ts, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head)
