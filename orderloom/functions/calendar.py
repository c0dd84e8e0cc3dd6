"""Chicago session time, done in integer micro/nanoseconds.

``from_utc_timestamp`` / ``to_utc_timestamp`` shift an instant by the zone
offset; reading the result back with ``unix_micros`` makes every expression
independent of the Spark session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import PERIOD_NS

ZONE = "America/Chicago"
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _idiv(a: Column, b: int) -> Column:
    """Exact floor division for 64-bit values (``/`` would go through double)."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def ntz_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp read as UTC."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def local_micros(ts_ns: Column) -> Column:
    """Chicago wall-clock microseconds of an event time."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(_idiv(ts_ns, 1000)), ZONE))


def trade_date(ts_ns: Column) -> Column:
    """Trade date: from 17:00 Chicago on, the next civil day."""
    return F.date_from_unix_date(_idiv(local_micros(ts_ns) + F.lit(7 * HOUR_US), DAY_US).cast("int"))


def wall_ns(day: Column, hour_offset_us: int) -> Column:
    """UTC nanoseconds of ``day`` 00:00 Chicago wall clock plus an offset."""
    wall = F.unix_date(day).cast("long") * F.lit(DAY_US) + F.lit(hour_offset_us)
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), ZONE)) * F.lit(1000)


def session_open_ns(day: Column) -> Column:
    return wall_ns(day, -7 * HOUR_US)


def eth_end_ns(day: Column) -> Column:
    return wall_ns(day, 16 * HOUR_US)


def session_clock(day: Column) -> dict[str, Column]:
    """Clock columns for a trade date: open 17:00 prior day, RTH 08:30-15:00,
    lettering end 16:00, admission end 17:00."""
    open_ns = session_open_ns(day)
    rth_open = wall_ns(day, 8 * HOUR_US + HOUR_US // 2)
    rth_close = wall_ns(day, 15 * HOUR_US)
    end = eth_end_ns(day)
    return {
        "session_open_ns": open_ns,
        "rth_open_ns": rth_open,
        "rth_close_ns": rth_close,
        "eth_end_ns": end,
        "session_end_ns": wall_ns(day, 17 * HOUR_US),
        "rth_offset": _idiv(rth_open - open_ns, PERIOD_NS).cast("int"),
        "eth_periods": _idiv(end - open_ns, PERIOD_NS).cast("int"),
        "rth_periods": _idiv(rth_close - rth_open, PERIOD_NS).cast("int"),
    }


def session_calendar(days: DataFrame) -> DataFrame:
    """One clock row per distinct ``trade_date`` of ``days``; sessions that do
    not have 46 lettering periods (DST Sundays) are flagged, not refused."""
    cal = days.select("trade_date").distinct()
    cal = cal.select("trade_date", *[c.alias(n) for n, c in session_clock(F.col("trade_date")).items()])
    return cal.withColumn("irregular", (F.col("eth_periods") != 46) | (F.col("rth_periods") != 13))


def with_clock(events: DataFrame, *names: str) -> DataFrame:
    """Attach clock columns by expression: no join, no shuffle."""
    clock = session_clock(F.col("trade_date"))
    return events.withColumns({n: clock[n] for n in names})


def eth_period(ts_ns: Column, open_ns: Column, end_ns: Column) -> Column:
    """Half-hour number from the session open; null outside the lettering window."""
    return F.when((ts_ns >= open_ns) & (ts_ns < end_ns), _idiv(ts_ns - open_ns, PERIOD_NS).cast("int"))


def rth_period(ts_ns: Column, rth_open: Column, rth_close: Column) -> Column:
    return F.when((ts_ns >= rth_open) & (ts_ns < rth_close), _idiv(ts_ns - rth_open, PERIOD_NS).cast("int"))
