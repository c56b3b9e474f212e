"""Exchange-local time from UTC epochs, and predicates on local labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
#: First and last clock that bound regular hours: labels after the first, up to the last.
RTH_OPEN, RTH_CLOSE = "09:30", "16:00"


def local(utc: Column, zone: str = NEW_YORK) -> Column:
    """A naive UTC timestamp as a naive local one, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_of(local_ts: Column, zone: str = NEW_YORK) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local_ts)


def from_epoch_micros(micros: Column) -> Column:
    """Naive UTC of an epoch in microseconds: whole seconds and the rest are added as intervals, so no session zone enters."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", micros.cast("long"), epoch)


def close_label(window_start_ns: Column, zone: str = NEW_YORK) -> Column:
    """Local label of a bar by its close, from its start in nanoseconds: one minute later. Whole numbers throughout."""
    return local(from_epoch_micros(F.call_function("div", window_start_ns, F.lit(1000)) + 60_000_000), zone)


def close_label_ms(start_ms: Column, zone: str = NEW_YORK) -> Column:
    return local(from_epoch_micros((start_ms + 60_000) * 1000), zone)


def trade_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def is_regular(label: Column) -> Column:
    """True for minute labels in regular hours: the first is 09:31, the last 16:00."""
    return (label > RTH_OPEN) & (label <= RTH_CLOSE)
