"""Time scalars on TIMESTAMP_NTZ.

All arithmetic uses ``timestampadd``/``timestampdiff`` on NTZ values, which is
exact and independent of the session time zone. (``date_trunc`` would cast to
a zoned timestamp and move wall-clock values inside DST gaps.)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrun.sources import registry as R

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
FILETIME_EPOCH = "TIMESTAMP_NTZ'1601-01-01 00:00:00'"

US_PER_MS = 1000
US_PER_MINUTE = 60_000_000
MS_PER_DAY = 86_400_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from ``datetime`` or plant-local text.

    Built from ISO text: a string -> NTZ cast never consults a time zone,
    whereas ``lit(datetime)`` would pass through the Python and session zones.
    """
    if isinstance(value, str):
        value = parse_local(value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros_since_epoch(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), _c(ts))


def millis_since_epoch(ts) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), _c(ts))


def floor_to(ts, unit_us: int) -> Column:
    """Truncate an NTZ timestamp to a multiple of ``unit_us`` microseconds."""
    c = _c(ts)
    return F.timestamp_add("MICROSECOND", -F.pmod(micros_since_epoch(c), F.lit(unit_us)), c)


def trunc_ms(ts) -> Column:
    """Millisecond grain, as the historian service sees its timestamps."""
    return floor_to(ts, US_PER_MS)


def trunc_minute(ts) -> Column:
    return floor_to(ts, US_PER_MINUTE)


def add_millis(ts, ms) -> Column:
    return F.timestamp_add("MILLISECOND", _c(ms).cast("long"), _c(ts))


def diff_millis(a, b) -> Column:
    """``b - a`` in whole milliseconds."""
    return F.timestamp_diff("MILLISECOND", _c(a), _c(b))


def shift_hours(ts, hours: int = R.PLANT_TZ_OFFSET_HOURS) -> Column:
    """UTC -> plant wall clock (no DST in the plant zone)."""
    return F.timestamp_add("HOUR", F.lit(hours), _c(ts))


def local_date(ts, hours: int = R.PLANT_TZ_OFFSET_HOURS) -> Column:
    """The plant-local calendar day of a UTC instant."""
    return F.to_date(shift_hours(ts, hours))


def file_ticks(ts) -> Column:
    """100-ns ticks since 1601-01-01 of an NTZ instant holding UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr(FILETIME_EPOCH), _c(ts)) * F.lit(10)


def file_ticks_py(value: dt.datetime) -> int:
    """X6 for a bound computed on the driver (exact integer arithmetic)."""
    ms = (value - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    return (ms + R.FILETIME_EPOCH_OFFSET_MS) * R.TICKS_PER_MS


def ticks_range(from_utc: dt.datetime | None, to_utc: dt.datetime | None):
    """inclusive ticks bounds for ms-aligned instants; None stays open."""
    lo = file_ticks_py(from_utc) if from_utc is not None else None
    hi = file_ticks_py(to_utc) + R.TICKS_UPPER_PAD if to_utc is not None else None
    return lo, hi


def minutes_between(a, b) -> Column:
    """Minute boundaries crossed from ``a`` to ``b`` (00:00:59 -> 00:01:01 is 1)."""
    return F.timestamp_diff("MINUTE", trunc_minute(a), trunc_minute(b))


def seconds_of_day(ts) -> Column:
    """X1 at seconds grain (milliseconds ignored), as an integer."""
    c = _c(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("int")


#: Accepted layouts by the length of the text before a fraction of a second.
_LOCAL_LAYOUTS = {16: "%Y-%m-%d %H:%M", 19: "%Y-%m-%d %H:%M:%S"}


def parse_local(text: str) -> dt.datetime:
    """Strict plant wall-clock text -> datetime: ``YYYY-MM-DD HH:mm``, with optional
    seconds and, after these, a fraction of up to three digits; ``T`` may stand for
    the space. Everything else raises ``ValueError``."""
    whole, point, fraction = text.partition(".")
    layout = _LOCAL_LAYOUTS.get(len(whole))
    if layout is None or not text.isascii() or whole[10] not in " T":
        raise ValueError(f"not a plant local time: {text!r}")
    if point:
        if len(whole) != 19 or not 1 <= len(fraction) <= 3:
            raise ValueError(f"not a plant local time: {text!r}")
        layout += ".%f"
    plain = f"{whole[:10]} {whole[11:]}"
    value = dt.datetime.strptime(plain + point + fraction, layout)
    if value.isoformat(sep=" ", timespec="seconds")[:len(plain)] != plain:  # fields without leading zeros
        raise ValueError(f"not a plant local time: {text!r}")
    return value


def local_to_utc(text: str, hours: int = R.PLANT_TZ_OFFSET_HOURS) -> dt.datetime:
    """A plant-local bound expressed as the UTC instant it denotes."""
    return parse_local(text) - dt.timedelta(hours=hours)


def with_offset_minutes(col, offset_minutes: int = 0) -> Column:
    """X4 option: move a normalised timestamp by a fixed number of minutes."""
    return F.timestamp_add("MINUTE", F.lit(offset_minutes), _c(col))


def epoch_millis_to_ntz(col) -> Column:
    return F.timestamp_add("MILLISECOND", _c(col).cast("long"), F.expr(EPOCH))


def iso_text_to_ntz(col) -> Column:
    """ISO-8601 text; a trailing ``Z``/offset is honoured (result is the UTC
    wall clock), naive text is taken as is. Invalid text raises (ANSI cast)."""
    c = _c(col)
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    as_utc = F.timestamp_add("MICROSECOND", F.unix_micros(F.to_timestamp(c)), F.expr(EPOCH))
    naive = F.to_timestamp_ntz(F.regexp_replace(c, " ", "T"))
    return F.when(zoned, as_utc).otherwise(naive)
