"""Time expressions. Instants are time stamps without zone in UTC; calendar days are IST.

Nothing depends on the session's time zone, and ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"


def to_ist(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz"))


def ist_date(ts: Column) -> Column:
    return F.to_date(to_ist(ts))


def parse_datetime(text: Column) -> Column:
    """An ISO string with Z, an offset or neither (then IST) as an instant; bad or empty is null."""
    t = F.trim(text)
    offset = F.regexp_extract(t, r"(Z|z|[+-]\d{2}:?\d{2})$", 1)
    local = F.regexp_replace(F.regexp_replace(t, r"\s*(Z|z|[+-]\d{2}:?\d{2})$", ""), "T", " ").try_cast("timestamp_ntz")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    signed = F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)
    zoned = t.rlike(r"\d:\d{2}.*(Z|z|[+-]\d{2}:?\d{2})$")
    naive = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), t.try_cast("timestamp_ntz"))
    return F.when(zoned & offset.isin("Z", "z"), local).when(zoned, local - F.make_dt_interval(F.lit(0), F.lit(0), signed)).otherwise(naive)


def ist_iso(ts: Column) -> Column:
    """IST in seconds with its offset."""
    return F.concat(F.date_format(to_ist(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))


def is_fresh(ts: Column, now: Column, hours: float) -> Column:
    """Not older than ``hours``; an absent time is not fresh."""
    return F.coalesce(now - ts <= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60))), F.lit(False))


def is_old(ts: Column, now: Column, hours: float) -> Column:
    """Older than ``hours``; an absent time is not old."""
    return F.coalesce(now - ts > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60))), F.lit(False))


def valid_date(text: Column) -> Column:
    """A real calendar day written YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def relative_label(ts: Column, now: Column) -> Column:
    """Just now, minutes, hours or days ago; from seven days on the IST date."""
    seconds = F.timestamp_diff("SECOND", ts.cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    minutes, hours, days = (F.floor(seconds / x) for x in (60, 3600, 86400))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "Just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d")).otherwise(F.date_format(to_ist(ts), "d MMM yyyy"))


def from_epoch_ms(ms: Column) -> Column:
    """Epoch milliseconds as an instant; null beyond the years 1 to 9999."""
    inside = ms.between(-62135596800000, 253402300799999)
    return F.when(inside, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(20,3)")))
