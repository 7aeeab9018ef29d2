"""Time parsing, formatting and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WINDOW_TIME_FORMATS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A time of day followed by a zone: Z, UTC or an offset.
ZONED = r"\d:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?)$"


def generic_timestamp(c) -> Column:
    """ISO text -> UTC wall clock; text with a zone or offset is converted to UTC."""
    s = F.trim(_c(c))
    zoned = F.regexp_replace(s, r"\s+([+-]\d|Z|UTC)", "$1")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(s.rlike(ZONED), utc).otherwise(s.try_cast("timestamp_ntz"))


def parse_window_time(c) -> Column:
    """First matching window-table format, then a generic ISO parse
    (offsets are converted to UTC); null if none."""
    s = F.trim(_c(c))
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in WINDOW_TIME_FORMATS]
    return F.coalesce(*tries, generic_timestamp(s))


def coerce_timestamp(c) -> Column:
    """Bad timestamps become null (rows are then dropped by the caller);
    offsets in the text are converted to UTC."""
    return generic_timestamp(c)


def local_to_utc(c, tz: str) -> Column:
    """Inverse of B20: wall clock of zone ``tz`` -> UTC wall clock."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(c).cast("timestamp_ntz"))


#: Metadata key of a date column that holds, row by row, the UTC day of the time column it names.
DAY_OF = "day_of"


def within(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows with ``start <= ts <= end`` (a missing bound is open).

    A date column marked as the day of ``ts`` (``DAY_OF``, as the readings table's
    partition column is by its reader) gets the same bounds, so that only the
    folders of these days are listed and read.  Other date columns mean
    something else, whatever their name, and are left alone."""
    def lit(t):
        return F.lit(str(t)).cast("timestamp_ntz")

    days = [f.name for f in df.schema.fields if f.dataType.typeName() == "date" and f.metadata.get(DAY_OF) == ts]
    for bound, op in ((start, "ge"), (end, "le")):
        if bound is None:
            continue
        at = bound if isinstance(bound, Column) else lit(bound)
        df = df.where(F.col(ts) >= at if op == "ge" else F.col(ts) <= at)
        for name in days:
            day = at.cast("date")
            df = df.where(F.col(name) >= day if op == "ge" else F.col(name) <= day)
    return df


def epoch_to_ts(c) -> Column:
    """Epoch seconds -> timestamp (UTC wall clock)."""
    return F.timestamp_seconds(_c(c)).cast("timestamp_ntz")


def epoch_micros(c) -> Column:
    """Microseconds since the epoch of a UTC wall-clock timestamp."""
    return F.unix_micros(_c(c).cast("timestamp"))


def render_local_time(c, tz: str) -> Column:
    """UTC timestamp -> 'yyyy-MM-dd HH:mm:ss+HH' in zone ``tz``."""
    ts = _c(c).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
    # whole hours of the offset, truncated toward zero (-03:30 -> -03)
    off = ((epoch_micros(local) - epoch_micros(ts)) / 3_600_000_000).cast("int")
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.format_string("%+03d", off.cast("int")))
