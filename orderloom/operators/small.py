"""Checked broadcast of per-session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal

MAX_ROWS = 50_000
MAX_BYTES = 64 << 20


def sized(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Evaluate a table that should be small, once, and broadcast it only if it is.

    At most ``max_rows + 1`` rows are fetched.  Within both bounds the result is
    a local relation with a broadcast hint; beyond either, ``df`` comes back
    unchanged and joins shuffle (AQE splits a hot session's partition).
    Streaming frames pass through."""
    if df.isStreaming:
        return df
    got = df.limit(max_rows + 1).toArrow()
    if got.num_rows > max_rows or got.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema))


def calendar_of(events: DataFrame) -> DataFrame:
    """Session clocks of the trade dates present (reads the partition column only)."""
    return sized(cal.session_calendar(events.select("trade_date")))


def clocked(events: DataFrame, *names: str, calendar: DataFrame | None = None) -> DataFrame:
    """Attach clock columns.  Zone arithmetic runs once per trade date and is
    joined on, instead of once per row; streams compute it per row."""
    if events.isStreaming:
        return cal.with_clock(events, *names)
    dim = calendar if calendar is not None else calendar_of(events)
    return events.join(dim.select("trade_date", *names), "trade_date")


def bucket_by_calendar(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trade date by looking the time up in the calendar.  The range predicate is
    narrowed to an equality on the UTC day: a session touches two UTC days, so a
    calendar entry is two rows of the (size-checked) broadcast side."""
    day_ns = F.lit(86_400_000_000_000)
    spans = sized(calendar.select(
        F.col("trade_date").alias("bucket_date"), "session_open_ns", "session_end_ns",
        F.explode(F.sequence(F.call_function("div", F.col("session_open_ns"), day_ns),
                             F.call_function("div", F.col("session_end_ns") - 1, day_ns))).alias("_utc_day")))
    ev = events.withColumn("_utc_day", F.call_function("div", F.col("ts_ns"), day_ns))
    hit = (F.col("ts_ns") >= F.col("session_open_ns")) & (F.col("ts_ns") < F.col("session_end_ns"))
    return ev.join(spans, "_utc_day").filter(hit).drop("_utc_day", "session_open_ns", "session_end_ns")
