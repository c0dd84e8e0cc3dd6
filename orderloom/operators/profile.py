"""Session Market Profile: everything that is built from trades.

The only order-dependent scalar, the developing half-hour, is not scanned for:
the first ordinal of each half-hour is one tiny aggregate per session (48 rows
at most), and the running maximum at any ordinal is the highest half-hour whose
first ordinal has passed.  While that per-session table passes the size check
(``small.sized``), trades go straight from the scan into map-side-combined
aggregates without a shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.schema import KEY, MAX_LONG, RTH_PERIODS, VALUE_AREA_PERCENT
from .orders import with_ticks
from .prefix import Scan, prefix_scan
from .small import calendar_of, clocked, sized


def session_events(events: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Non-snapshot events inside admission, with clock columns and the lettering flag."""
    ev = clocked(events.filter(~F.col("is_snapshot")), "session_open_ns", "eth_end_ns", "session_end_ns", "rth_offset",
                 calendar=calendar)
    ev = ev.filter((F.col("ts_ns") >= F.col("session_open_ns")) & (F.col("ts_ns") < F.col("session_end_ns")))
    return ev.withColumns({
        "in_lettering": F.col("ts_ns") < F.col("eth_end_ns"),
        "eth_period": cal.eth_period(F.col("ts_ns"), F.col("session_open_ns"), F.col("eth_end_ns"))})


def period_starts(session: DataFrame) -> DataFrame:
    """Per session: the first ordinal of each half-hour (``starts``), the latest
    half-hour, and ``later_ord``: per half-hour number, the first ordinal at
    which any later half-hour was reached."""
    first = session.filter("in_lettering").groupBy(*KEY, "eth_period").agg(F.min("ordinal").alias("first_ord"))
    out = first.groupBy(*KEY).agg(
        F.collect_list(F.struct("eth_period", "first_ord")).alias("starts"), F.max("eth_period").alias("current_period"))
    never = F.lit(MAX_LONG)
    later = F.transform(F.sequence(F.lit(0), F.col("current_period")), lambda p: F.aggregate(
        "starts", never, lambda acc, s: F.when(s["eth_period"] > p, F.least(acc, s["first_ord"])).otherwise(acc)))
    return out.withColumn("later_ord", later)


def developing_period(starts: Column, later_ord: Column, period: Column, ordinal: Column) -> Column:
    """Running maximum half-hour at ``ordinal``: the row's own unless a later one
    was reached before it; only such late rows search the list."""
    seen = F.filter(starts, lambda s: s["first_ord"] <= ordinal)
    highest = F.aggregate(seen, F.lit(0), lambda acc, s: F.greatest(acc, s["eth_period"]))
    return F.when(F.get(later_ord, period) > ordinal, period).otherwise(highest)


def with_period(events: DataFrame) -> DataFrame:
    """Session events with ``dev_period``, ``rth_period`` and ``backward``."""
    calendar = None if events.isStreaming else calendar_of(events)
    session = session_events(events, calendar)
    ev = session.join(sized(period_starts(session)), KEY, "left")
    dev = developing_period(F.col("starts"), F.col("later_ord"), F.col("eth_period"), F.col("ordinal"))
    return _half_hours(ev, dev).drop("starts", "later_ord")


def _half_hours(ev: DataFrame, dev: Column) -> DataFrame:
    ev = ev.withColumn("dev_period", F.when(F.col("in_lettering"), dev))
    r = F.col("dev_period") - F.col("rth_offset")
    return ev.withColumns({
        "rth_period": F.when((r >= 0) & (r < RTH_PERIODS), r),
        "backward": F.coalesce(F.col("eth_period") < F.col("dev_period"), F.lit(False))})


def continue_period(periods: DataFrame, carried: Column) -> DataFrame:
    """``with_period`` of later rows, given the highest half-hour of the rows before them (null: none)."""
    return _half_hours(periods, F.greatest("dev_period", carried))


def trades(events: DataFrame, ticks: DataFrame | int) -> DataFrame:
    """On-grid trades of positive size with their session columns."""
    return _trades(with_period(events), ticks)


def _trades(periods: DataFrame, ticks: DataFrame | int) -> DataFrame:
    t = periods.filter((F.col("kind") == "Trade") & (F.col("size") > 0))
    return with_ticks(t, ticks).filter(F.col("tick").isNotNull())


def _bit(period: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), period.cast("int"))


def _vol(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))


def profile_rows(tr: DataFrame) -> DataFrame:
    """One row per traded price: volumes, spectrum, developing-period volume,
    TPO bitsets, and what the session figures need (first and last ordinal,
    lettered spectrum, traded in the initial balance)."""
    lettered = F.col("in_lettering")
    buy, sell = F.col("side") == "B", F.col("side") == "A"
    out = tr.groupBy(*KEY, "tick").agg(
        F.sum("size").alias("volume"), _vol(buy).alias("buy_volume"), _vol(sell).alias("sell_volume"),
        _vol(lettered & (F.col("dev_period") == F.col("current_period"))).alias("period_volume"),
        F.coalesce(F.bit_or(F.when(lettered, _bit(F.col("dev_period")))), F.lit(0)).alias("eth_bits"),
        F.coalesce(F.bit_or(F.when(F.col("rth_period").isNotNull(), _bit(F.col("rth_period")))), F.lit(0)).alias("rth_bits"),
        F.min("ordinal").alias("first_ord"), F.max("ordinal").alias("last_ord"),
        (_vol(lettered & buy) - _vol(lettered & sell)).alias("delta"),
        F.coalesce(F.max(F.col("rth_period").isin(0, 1)), F.lit(False)).alias("in_ib"))
    n = F.bit_count("eth_bits").cast("int")
    return out.withColumns({"tpo_count": n, "single_print": n == 1})


PARTIALS = ("instrument_id bigint, trade_date date, tick bigint, in_lettering boolean, dev_period int, rth_period int, "
            "volume bigint, buy_volume bigint, sell_volume bigint, first_ord bigint, last_ord bigint")


def partials(periods: DataFrame, ticks: DataFrame | int) -> DataFrame:
    """Trades of ``with_period`` or ``continue_period`` as one row per price and half-hour: what ``merge_partials`` adds up."""
    return _trades(periods, ticks).groupBy(*KEY, "tick", "in_lettering", F.col("dev_period").cast("int").alias("dev_period"),
                                           F.col("rth_period").cast("int").alias("rth_period")).agg(
        F.sum("size").alias("volume"), _vol(F.col("side") == "B").alias("buy_volume"), _vol(F.col("side") == "A").alias("sell_volume"),
        F.min("ordinal").alias("first_ord"), F.max("ordinal").alias("last_ord"))


def merge_partials(parts: DataFrame) -> DataFrame:
    sums = [F.sum(n).alias(n) for n in ("volume", "buy_volume", "sell_volume")]
    return parts.groupBy(*KEY, "tick", "in_lettering", "dev_period", "rth_period").agg(
        *sums, F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"))


def rows_of_partials(parts: DataFrame, current: DataFrame) -> DataFrame:
    """``profile_rows`` from partials and the ``current_period`` of their sessions."""
    lettered = F.col("in_lettering")

    def vol(name: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0))

    out = parts.join(current, KEY).groupBy(*KEY, "tick").agg(
        F.sum("volume").alias("volume"), F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"),
        vol("volume", lettered & (F.col("dev_period") == F.col("current_period"))).alias("period_volume"),
        F.coalesce(F.bit_or(F.when(lettered, _bit(F.col("dev_period")))), F.lit(0)).alias("eth_bits"),
        F.coalesce(F.bit_or(F.when(F.col("rth_period").isNotNull(), _bit(F.col("rth_period")))), F.lit(0)).alias("rth_bits"),
        F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"),
        (vol("buy_volume", lettered) - vol("sell_volume", lettered)).alias("delta"),
        F.coalesce(F.max(F.col("rth_period").isin(0, 1)), F.lit(False)).alias("in_ib"))
    n = F.bit_count("eth_bits").cast("int")
    return out.withColumns({"tpo_count": n, "single_print": n == 1})


def period_matrix(tr: DataFrame) -> DataFrame:
    """Volume by price and half-hour."""
    return tr.filter("in_lettering").groupBy(*KEY, "tick", F.col("dev_period").alias("period")).agg(
        F.sum("size").alias("volume"))


def vpoc(rows: DataFrame) -> DataFrame:
    """Price of largest volume; among equals the one that got there first."""
    best = F.max_by("tick", F.struct(F.col("volume"), -F.col("last_ord")))
    return rows.groupBy(*KEY).agg(best.alias("vpoc"), F.max("volume").alias("vpoc_volume"))


ROW_NUMBERS = ["volume", "buy_volume", "sell_volume", "period_volume", "eth_bits", "rth_bits", "tpo_count"]


def dense_rows(rows: DataFrame) -> DataFrame:
    """Every tick between session low and high; untraded ones are zero rows."""
    span = rows.groupBy(*KEY).agg(F.min("tick").alias("_lo"), F.max("tick").alias("_hi"))
    grid = span.select(*KEY, F.explode(F.sequence("_lo", "_hi")).alias("tick"))
    out = grid.join(rows.select(*KEY, "tick", *ROW_NUMBERS, "single_print"), [*KEY, "tick"], "left")
    return out.withColumns({**{c: F.coalesce(F.col(c), F.lit(0)) for c in ROW_NUMBERS},
                            "single_print": F.coalesce("single_print", F.lit(False))})


def session_figures(rows: DataFrame) -> DataFrame:
    """Range, open, balance, delta, point of control and 70 % value area of each
    session, from its price rows in one aggregate.

    The area grows from the point of control two rows at a time towards the
    heavier pair (ties up; a missing side loses; whole pairs are added), over one
    volume array per session.  That array is as long as the traded price span -
    it does not grow with the number of trades."""
    ib = F.when(F.col("in_ib"), F.col("tick"))
    p = rows.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("tick", "volume"))).alias("_r"),
        F.max_by("tick", F.struct(F.col("volume"), -F.col("last_ord"))).alias("vpoc"), F.max("volume").alias("vpoc_volume"),
        F.min(ib).alias("ib_low"), F.max(ib).alias("ib_high"), F.min("tick").alias("low"), F.max("tick").alias("high"),
        F.min_by("tick", "first_ord").alias("open"), F.sum("volume").alias("total_volume"), F.sum("delta").alias("delta"))

    # spread the rows over the span: each volume followed by a zero per untraded tick up to the next row
    def spread(r: Column, i: Column) -> Column:
        skipped = F.coalesce(F.get(F.col("_r"), i + 1)["tick"] - r["tick"] - 1, F.lit(0)).cast("int")
        return F.concat(F.array(r["volume"]), F.array_repeat(F.lit(0).cast("long"), skipped))

    p = p.withColumn("_v", F.flatten(F.transform("_r", spread))).drop("_r")
    p = p.withColumns({"_n": F.size("_v"), "_poc": (F.col("vpoc") - F.col("low")).cast("int"),
                       "_target": F.call_function("div", F.col("total_volume") * VALUE_AREA_PERCENT + 99, F.lit(100))})
    n = F.col("_n")

    def at(i: Column) -> Column:
        return F.when((i >= 0) & (i < n), F.get(F.col("_v"), i)).otherwise(F.lit(0).cast("long"))

    start = F.struct(F.col("_poc").alias("lo"), F.col("_poc").alias("hi"), F.col("vpoc_volume").alias("acc"))

    def grow(s: Column, _: Column) -> Column:
        up = at(s["hi"] + 1) + at(s["hi"] + 2)
        down = at(s["lo"] - 1) + at(s["lo"] - 2)
        take_up = (s["hi"] < n - 1) & ((s["lo"] == 0) | (up >= down))
        done = (s["acc"] >= F.col("_target")) | ((s["lo"] == 0) & (s["hi"] == n - 1))
        return F.when(done, s).when(
            take_up, F.struct(s["lo"].alias("lo"), F.least(s["hi"] + 2, n - 1).alias("hi"), (s["acc"] + up).alias("acc"))
        ).otherwise(F.struct(F.greatest(s["lo"] - 2, F.lit(0)).alias("lo"), s["hi"].alias("hi"), (s["acc"] + down).alias("acc")))

    p = p.withColumn("_a", F.aggregate(F.sequence(F.lit(1), n), start, grow))
    return p.withColumns({"val": F.col("low") + F.col("_a.lo"), "vah": F.col("low") + F.col("_a.hi"),
                          "area_volume": F.col("_a.acc")}).drop("_v", "_n", "_poc", "_target", "_a")


def value_area(rows: DataFrame) -> DataFrame:
    return session_figures(rows).select(*KEY, "vpoc", "val", "vah", "area_volume", F.col("total_volume").alias("total"))


def session_stats(rows: DataFrame) -> DataFrame:
    """Initial balance, range, open (first print), total volume and session delta."""
    ib = F.when(F.col("in_ib"), F.col("tick"))
    return rows.groupBy(*KEY).agg(
        F.min(ib).alias("ib_low"), F.max(ib).alias("ib_high"), F.min("tick").alias("low"), F.max("tick").alias("high"),
        F.min_by("tick", "first_ord").alias("open"), F.sum("volume").alias("total_volume"), F.sum("delta").alias("delta"))


def session_counters(events: DataFrame) -> DataFrame:
    """Developing half-hour, gap-in-half-hour flag and the profile's counters."""
    return _counters(with_period(events))


def _counters(ev: DataFrame) -> DataFrame:
    zero_trade = (F.col("kind") == "Trade") & (F.col("size") == 0)
    current = F.coalesce(F.col("current_period"), F.lit(0))
    gap_now = (F.col("kind") == "Gap") & F.col("in_lettering") & (F.col("dev_period") == current)
    return ev.groupBy(*KEY).agg(
        F.max(current).alias("current_period"), F.max(gap_now).alias("period_gap"),
        F.count_if(~F.col("in_lettering")).alias("post_close_events"), F.count_if("backward").alias("backward_events"),
        F.count_if(zero_trade).alias("zero_size_trades"))


def _signed(tr: DataFrame) -> DataFrame:
    sided = tr.filter(F.col("in_lettering") & F.col("side").isin("B", "A"))
    return sided.withColumn("signed", F.when(F.col("side") == "B", F.col("size")).otherwise(-F.col("size")))


def cvd_path(tr: DataFrame) -> DataFrame:
    """Running buy minus sell volume after every sided trade."""
    path = prefix_scan(_signed(tr), KEY, {"cvd": Scan("sum", F.col("signed"), inclusive=True)})
    return path.select(*KEY, "ordinal", "dev_period", "signed", "cvd")


def cvd_range(path: DataFrame) -> DataFrame:
    return path.groupBy(*KEY).agg(F.least(F.lit(0), F.min("cvd")).alias("cvd_low"),
                                  F.greatest(F.lit(0), F.max("cvd")).alias("cvd_high"),
                                  F.max_by("cvd", "ordinal").alias("cvd"))


def cvd_candles(path: DataFrame) -> DataFrame:
    """Half-hour candles up to the last traded half-hour; quiet ones carry flat."""
    per = path.groupBy(*KEY, F.col("dev_period").alias("period")).agg(
        F.max("cvd").alias("_h"), F.min("cvd").alias("_l"), F.max_by("cvd", "ordinal").alias("_c"))
    grid = per.groupBy(*KEY).agg(F.max("period").alias("_last")).select(
        *KEY, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("period"))
    full = grid.join(per, [*KEY, "period"], "left")
    earlier = Window.partitionBy(*KEY).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("open", F.coalesce(F.last("_c", ignorenulls=True).over(earlier), F.lit(0)))
    close = F.coalesce(F.col("_c"), F.col("open"))
    return full.select(
        *KEY, "period", "open", F.greatest("open", "_h").alias("high"), F.least("open", "_l").alias("low"),
        close.alias("close"), (close >= F.col("open")).alias("is_up"), (close - F.col("open")).alias("period_delta"))


def touch_counters(prints: DataFrame, gaps: DataFrame | None, counter: Column) -> DataFrame:
    """Volume traded at the current touch, per counter: it restarts whenever the
    counter's price changes, and a gap marks it until the next restart.

    ``prints`` has KEY, ordinal, tick, size; ``counter`` names cB or cA (null = neither)."""
    p = prints.select(*KEY, "ordinal", "tick", "size", counter.alias("counter")).filter(F.col("counter").isNotNull())
    k = [*KEY, "counter"]
    p = prefix_scan(p, k, {"_prev": Scan("max", F.struct("ordinal", "tick")), "_run": Scan("sum", F.col("size"))})
    changed = F.col("_prev").isNull() | (F.col("_prev.tick") != F.col("tick"))
    # all volume less what had run before the last restart (running volume never falls)
    out = p.groupBy(*k).agg(
        F.max_by("tick", "ordinal").alias("tick"), (F.sum("size") - F.max(F.when(changed, F.col("_run")))).alias("volume"),
        F.max(F.when(changed, F.col("ordinal"))).alias("since"))
    if gaps is None:
        return out
    last_gap = gaps.groupBy(*KEY).agg(F.max("ordinal").alias("_gap"))
    out = out.join(last_gap, KEY, "left")
    return out.select(*k, "tick", "volume", "since", F.coalesce(F.col("_gap") > F.col("since"), F.lit(False)).alias("gap_marked"))


def trade_touch(events: DataFrame, tr: DataFrame) -> DataFrame:
    """Touch counters from trades: a buy lifts the offer (cA), a sell hits the bid (cB)."""
    gaps = session_events(events).filter(F.col("kind") == "Gap")
    side = F.when(F.col("side") == "B", "cA").when(F.col("side") == "A", "cB")
    return touch_counters(tr.filter("in_lettering"), gaps, side)


def touch_islands(tr: DataFrame) -> DataFrame:
    """Touch counter value after every sided trade (the running form)."""
    p = tr.filter("in_lettering").withColumn(
        "counter", F.when(F.col("side") == "B", "cA").when(F.col("side") == "A", "cB")).filter(F.col("counter").isNotNull())
    k = [*KEY, "counter"]
    p = prefix_scan(p.select(*k, "ordinal", "tick", "size"), k, {
        "_prev": Scan("max", F.struct("ordinal", "tick")), "_run": Scan("sum", F.col("size"))})
    changed = F.col("_prev").isNull() | (F.col("_prev.tick") != F.col("tick"))
    # the running volume before an island is the largest one seen at any island start so far
    p = prefix_scan(p.withColumn("_base", F.when(changed, F.col("_run"))), k,
                    {"_from": Scan("max", F.col("_base"), inclusive=True)})
    return p.select(*k, "ordinal", "tick", (F.col("_run") + F.col("size") - F.col("_from")).alias("volume"))


def session_summary(events: DataFrame, ticks: DataFrame | int) -> DataFrame:
    """One record per session: open, POC, value area, balance, half-hour, gap, CVD, candles."""
    ev = with_period(events)
    tr = _trades(ev, ticks)
    path = cvd_path(tr)
    bars = cvd_candles(path).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("period", "open", "high", "low", "close"))).alias("candles"))
    # the CVD range is in the candles: their highs and lows cover every value and the opening zero
    bars = bars.withColumns({
        "cvd_low": F.array_min(F.transform("candles", lambda b: b["low"])),
        "cvd_high": F.array_max(F.transform("candles", lambda b: b["high"]))})
    out = session_figures(profile_rows(tr)).drop("vpoc_volume", "area_volume")
    out = out.join(_counters(ev), KEY).join(bars, KEY, "left")
    newest = Window.partitionBy("instrument_id")  # one row per session
    return out.withColumn("is_current", F.col("trade_date") == F.max("trade_date").over(newest))
