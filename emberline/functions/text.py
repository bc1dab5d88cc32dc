"""Column functions for numbers, times and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the class of characters that messages escape. It holds the range + to =.
ESCAPED = r"[_*\[\]()~`>#+-=|{}.!]"

#: Patterns of secrets and what stands in their place.
SECRETS = {
    r"\b\d{6,}:[A-Za-z0-9_-]{20,}\b": "[REDACTED_TOKEN]",
    r"chat_id=\d+": "chat_id=[REDACTED]",
    r"(redis://[^@]+@)": "redis://[REDACTED]",
}


def money(x: Column) -> Column:
    """Two places, as in 12.34."""
    return F.round(x.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")


def grouped_money(x: Column) -> Column:
    """Two places with thousands, as in 1,234.56."""
    return F.format_number(F.round(x.cast("decimal(28,10)"), 2), 2)


def ist_time(t: Column, form: str = "dd-MM-yyyy HH:mm 'IST'") -> Column:
    """Text of an epoch time in India's zone; milliseconds are recognised."""
    seconds = F.when(t > 1_000_000_000_000, F.floor(t / 1000)).otherwise(t)
    local = F.to_timestamp_ntz(F.lit("1970-01-01 05:30:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.date_format(local, form)


def md_escape(s: Column) -> Column:
    return F.regexp_replace(s, ESCAPED, r"\\$0")


def redact(s: Column) -> Column:
    """Bot tokens, chat identifiers and the credentials of store addresses taken out."""
    for pattern, instead in SECRETS.items():
        s = F.regexp_replace(s, pattern, instead)
    return s


def safe_double(s: Column, default: float = 0.0) -> Column:
    """Number of a text, the default if there is none or it isn't finite."""
    x = s.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def sanitize(x: Column, default: float) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def clamp(x: Column, bound: float) -> Column:
    """Within ±bound; missing stays missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))).otherwise(x)
