"""Trading calendar of the US exchanges, minute grid, and gaps in data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.functions.timeconv import minute, trade_date, utc_of
from tapegrid.sources.landing import file_day

# Closures that no rule gives (fixed values).
SPECIAL_CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)
SCHEDULE = "trade_date string, open_et timestamp_ntz, close_et timestamp_ntz"


def easter(year: int) -> dt.date:
    """Easter Sunday in the Gregorian calendar."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon = epact - (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    day = moon - weekday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; -1: the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def _observed(day: dt.date) -> dt.date:
    """Sunday's holiday is kept on Monday, Saturday's on Friday."""
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> list[dt.date]:
    new_year = dt.date(year, 1, 1)
    days = [
        _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1),
        _observed(dt.date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(dt.date(year, 12, 25)),
    ]
    if new_year.weekday() != 5:  # on a Saturday it isn't kept: the Friday is in the old year
        days.append(_observed(new_year))
    if year >= 2022:
        days.append(_observed(dt.date(year, 6, 19)))
    return sorted(days)


def early_closes(year: int) -> list[dt.date]:
    """Days that end at 13:00: before Independence Day and Christmas, if a trading day before a weekday's, and after Thanksgiving."""
    days = [_nth(year, 11, 3, 4) + dt.timedelta(1)]
    days += [d for d in (dt.date(year, 7, 3), dt.date(year, 12, 24)) if d.weekday() < 4]
    return sorted(set(days) - set(holidays(year)))


def trading_calendar(spark: SparkSession, start: str, end: str, closed: list[str] | None = None, early: list[str] | None = None) -> DataFrame:
    """trade_date, open_et, close_et of the trading days from start to end, both included.

    closed, early: other lists of closed and of 13:00 days than the rules'.
    """
    years = range(int(start[:4]), int(end[:4]) + 1)
    closed = [d.isoformat() for y in years for d in holidays(y)] + list(SPECIAL_CLOSURES) if closed is None else closed
    early = [d.isoformat() for y in years for d in early_closes(y)] if early is None else early
    days = spark.sql("SELECT explode(sequence(:start, :end, INTERVAL 1 DAY)) AS day WHERE :start <= :end", args={"start": dt.date.fromisoformat(start), "end": dt.date.fromisoformat(end)}) if start <= end else spark.createDataFrame([], "day date")
    name = F.date_format("day", "yyyy-MM-dd")
    open_days = days.where(F.weekday("day") < 5).withColumn("trade_date", name).where(~F.col("trade_date").isin(closed))
    close = F.when(F.col("trade_date").isin(early), " 13:00:00").otherwise(" 16:00:00")
    return open_days.select("trade_date", F.concat("trade_date", F.lit(" 09:30:00")).cast("timestamp_ntz").alias("open_et"), F.concat("trade_date", close).cast("timestamp_ntz").alias("close_et"))


def trading_days(calendar: DataFrame) -> DataFrame:
    return calendar.select("trade_date").distinct()


def minute_grid(calendar: DataFrame) -> DataFrame:
    """trade_date, minute, ts for each minute of each day, open and close included."""
    rows = calendar.select("trade_date", F.explode(F.sequence("open_et", "close_et", F.expr("INTERVAL 1 MINUTE"))).alias("ts"))
    return rows.select("trade_date", minute(F.col("ts")).alias("minute"), "ts")


def in_utc(calendar: DataFrame) -> DataFrame:
    """calendar with open_utc and close_utc; neither clock is ever ambiguous."""
    return calendar.withColumns({"open_utc": utc_of(F.col("open_et")), "close_utc": utc_of(F.col("close_et"))})


def each_day(spans: DataFrame) -> DataFrame:
    """spans with a row for each trade_date from first_day to last_day, so that calendars are joined on equal days."""
    days = F.explode(F.sequence(F.to_date("first_day"), F.to_date("last_day")))
    return spans.withColumn("day", days).withColumn("trade_date", F.date_format("day", "yyyy-MM-dd")).drop("day", "first_day", "last_day")


def missing_days(calendar: DataFrame, bars: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """symbol, trade_date of calendar days without a bar, between each symbol's first and last day."""
    rows = bars if symbols is None else bars.where(F.col("symbol").isin(symbols))
    if "trade_date" not in rows.columns:
        rows = rows.withColumn("trade_date", trade_date(F.col("ts")))
    days = rows.select("symbol", "trade_date").distinct()
    spans = days.groupBy("symbol").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    # A calendar has some 250 rows a year.
    wanted = each_day(spans).join(F.broadcast(trading_days(calendar)), "trade_date").select("symbol", "trade_date")
    return wanted.join(days, ["symbol", "trade_date"], "left_anti")


#: Bytes of a compressed file that holds nothing, at most.
EMPTY_BYTES = 60


def file_audit(calendar: DataFrame, listing: DataFrame, least_bytes: int = EMPTY_BYTES + 1) -> DataFrame:
    """day, state, n_files of days whose landed files don't match the calendar: missing (none), empty (none of least_bytes), surplus (files on a closed day).

    listing: file_path, file_size, as landing.landed_files gives them. A file of no
    bytes at all counts as none: Spark's listing passes it over. So do files without
    a date in their path.
    """
    landed = listing.withColumn("day", file_day(F.col("file_path"))).where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n_files"), F.max("file_size").alias("largest"))
    days = trading_days(calendar).select(F.col("trade_date").alias("day"), F.lit(True).alias("open"))
    state = F.when(F.col("n_files").isNull(), "missing").when(F.col("open").isNull(), "surplus").when(F.col("largest") < least_bytes, "empty")
    joined = days.join(landed, "day", "full_outer").withColumn("state", state)
    return joined.where("state IS NOT NULL").select("day", "state", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def files_of_days(calendar: DataFrame, listing: DataFrame, least_bytes: int = EMPTY_BYTES + 1) -> DataFrame:
    """The landed files of trading days that have any content."""
    # A calendar has some 250 rows a year.
    return listing.where(F.col("file_size") >= least_bytes).join(F.broadcast(trading_days(calendar)), file_day(F.col("file_path")) == F.col("trade_date"), "left_semi")
