"""Ladder and profile views over a cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.schema import KEY
from . import asof, book, orders, profile

SCALES = (1, 2, 4)
LADDER = ["bid_size", "ask_size", "bid_orders", "ask_orders", "session_volume", "cb", "ca", "bid_added_5s",
          "bid_cancelled_5s", "ask_added_5s", "ask_cancelled_5s", "refresh_bid_count", "refresh_ask_count",
          "refresh_bid_hidden", "refresh_ask_hidden"]


def _check_scale(scale: int) -> None:
    if scale not in SCALES:
        raise ValueError("tick scale must be 1, 2 or 4")


def bucket(tick: Column, scale: int) -> Column:
    """Lower boundary of the scaled row containing ``tick``."""
    return tick - F.pmod(tick, F.lit(scale))


def _measures(df: DataFrame, **cols: Column) -> DataFrame:
    """Bring a per-level table to the ladder's columns, zero where it says nothing."""
    zero = F.lit(0).cast("long")
    return df.select(*KEY, "tick", *[F.coalesce(cols.get(c, zero), zero).cast("long").alias(c) for c in LADDER])


def ladder_measures(events: DataFrame, log: DataFrame, ticks: DataFrame | int, cut: DataFrame) -> DataFrame:
    """All ladder quantities per price at the cut: one union, one aggregate."""
    live = asof.live_orders(orders.order_intervals(log), cut)
    flow = book.flow_at(events, orders.flow_deltas(log), cut)
    fl = asof.upto(orders.fills(log), cut)
    rf = book.refresh_totals(asof.upto(orders.refreshes(log), cut))
    vol = profile.trades(asof.upto(events, cut), ticks).groupBy(*KEY, "tick").agg(F.sum("size").alias("v"))
    c = F.col
    bid, ask = c("side") == "B", c("side") == "A"
    parts = [
        _measures(book.depth(live), bid_size=F.when(bid, c("total_size")), ask_size=F.when(ask, c("total_size")),
                  bid_orders=F.when(bid, c("order_count")), ask_orders=F.when(ask, c("order_count"))),
        _measures(vol, session_volume=c("v")),
        _measures(book.inside_traded(fl), cb=F.when(c("counter") == "cB", c("volume")), ca=F.when(c("counter") == "cA", c("volume"))),
        _measures(flow, bid_added_5s=F.when(bid, c("added_5s")), bid_cancelled_5s=F.when(bid, c("cancelled_5s")),
                  ask_added_5s=F.when(ask, c("added_5s")), ask_cancelled_5s=F.when(ask, c("cancelled_5s"))),
        _measures(rf, refresh_bid_count=F.when(bid, c("refresh_count")), refresh_ask_count=F.when(ask, c("refresh_count")),
                  refresh_bid_hidden=F.when(bid, c("hidden_volume")), refresh_ask_hidden=F.when(ask, c("hidden_volume"))),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY, "tick").agg(*[F.sum(m).alias(m) for m in LADDER])


def inside(events: DataFrame, log: DataFrame, cut: DataFrame) -> DataFrame:
    """Best bid, best ask and last print of each session at the cut."""
    best = book.bbo(book.depth(asof.live_orders(orders.order_intervals(log), cut)))
    last = book.last_print(asof.upto(orders.fills(log), cut)).select(*KEY, F.col("tick").alias("last_tick"))
    return cut.select(*KEY).join(best, KEY, "left").join(last, KEY, "left")


def center_tick() -> Column:
    """Middle of the inside market, else the one side there is, else the last print, else 0."""
    mid = F.floor((F.col("best_bid") + F.col("best_ask")) / F.lit(2)).cast("long")
    return F.coalesce(mid, F.col("best_bid"), F.col("best_ask"), F.col("last_tick"), F.lit(0).cast("long"))


def ladder(measures: DataFrame, inside_rows: DataFrame, rows: int) -> DataFrame:
    """``rows`` contiguous ticks around the centre, zero-filled."""
    first = center_tick() - rows // 2
    grid = inside_rows.select(*KEY, F.explode(F.sequence(first, first + (rows - 1))).alias("tick"))
    out = grid.join(measures, [*KEY, "tick"], "left")
    return out.fillna(0, LADDER)


def rescale(ladder_rows: DataFrame, scale: int) -> DataFrame:
    """Sum ladder rows into buckets of ``scale`` ticks."""
    _check_scale(scale)
    return ladder_rows.groupBy(*KEY, bucket(F.col("tick"), scale).alias("tick")).agg(*[F.sum(m).alias(m) for m in LADDER])


def follow_price(inside_rows: DataFrame, scaled: DataFrame, scale: int) -> DataFrame:
    """Price the ladder follows at a scale: middle of the bucketed inside market,
    else one side, else the last print, else the middle row.  The midpoint may
    fall between two rows, so it is kept in half ticks (``follow_x2``)."""
    b, a, p = (bucket(F.col(c), scale) for c in ("best_bid", "best_ask", "last_tick"))
    rows = scaled.groupBy(*KEY).agg(F.array_sort(F.collect_list("tick")).alias("_r"))
    middle = F.get(F.col("_r"), F.floor(F.size("_r") / 2).cast("int"))
    x2 = F.coalesce(b + a, b * 2, a * 2, p * 2, middle * 2)
    return inside_rows.join(rows, KEY).select(*KEY, x2.alias("follow_x2"))


def row_lookup(scaled: DataFrame, target: DataFrame) -> DataFrame:
    """Nearest row (tie to the lower one) and ceiling row (else the last) of ``target_x2`` / 2."""
    j = scaled.select(*KEY, "tick").join(target, KEY)
    far = F.abs(F.col("tick") * 2 - F.col("target_x2"))
    return j.groupBy(*KEY).agg(
        F.min_by("tick", F.struct(far, F.col("tick"))).alias("nearest"),
        F.coalesce(F.min(F.when(F.col("tick") * 2 >= F.col("target_x2"), F.col("tick"))), F.max("tick")).alias("ceiling"))


def centered_window(scaled: DataFrame, center: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` present rows around a centre row, clamped to the ends."""
    w = Window.partitionBy(*KEY).orderBy("tick")  # a ladder: bounded by its row count
    j = scaled.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEY))})
    at = j.join(center, KEY).filter(F.col("tick") == F.col("center")).select(*KEY, F.col("_i").alias("_at"))
    j = j.join(at, KEY).withColumn("_k", F.least(F.lit(rows), F.col("_n")))
    start = F.least(F.greatest(F.col("_at") - F.floor(F.col("_k") / 2), F.lit(0)), F.col("_n") - F.col("_k"))
    return j.filter((F.col("_i") >= start) & (F.col("_i") < start + F.col("_k"))).drop("_i", "_n", "_at", "_k")


def anchored_window(scaled: DataFrame, anchor: DataFrame, rows: int, scale: int) -> DataFrame:
    """Exactly ``rows`` rows with the anchor's bucket in the middle; rows the
    ladder does not have are zero and marked ``source_present = false``."""
    _check_scale(scale)
    first = bucket(F.col("anchor"), scale) - (rows // 2) * scale
    grid = anchor.select(*KEY, F.explode(F.sequence(first, first + (rows - 1) * scale, F.lit(scale).cast("long"))).alias("tick"))
    out = grid.join(scaled.withColumn("source_present", F.lit(True)), [*KEY, "tick"], "left")
    return out.fillna(0, LADDER).fillna(False, ["source_present"])


def inside_flag(ladder_rows: DataFrame, inside_rows: DataFrame) -> DataFrame:
    """True on rows of the inside band (best bid to best ask, or the one side there is)."""
    b, a, t = F.col("best_bid"), F.col("best_ask"), F.col("tick")
    lo, hi = F.coalesce(b, a), F.coalesce(a, b)
    flag = F.coalesce((t >= lo) & (t <= hi), F.lit(False))
    return ladder_rows.join(inside_rows, KEY).withColumn("is_inside", flag).drop("best_bid", "best_ask", "overlap", "last_tick")


def normalised(ladder_rows: DataFrame) -> DataFrame:
    """Bid, ask and volume as a share of the visible maximum of each."""
    w = Window.partitionBy(*KEY)  # a ladder: bounded by its row count

    def share(c: str) -> Column:
        top = F.max(c).over(w)
        return F.when(top > 0, F.col(c) / top).otherwise(F.lit(0.0))

    return ladder_rows.withColumns({"bid_share": share("bid_size"), "ask_share": share("ask_size"),
                                    "volume_share": share("session_volume")})


def badges(ladder_rows: DataFrame) -> DataFrame:
    """Sides that showed native refreshes."""
    return ladder_rows.withColumns({"bid_badge": F.col("refresh_bid_count") > 0, "ask_badge": F.col("refresh_ask_count") > 0})


PROFILE_SUMS = ["volume", "period_volume", "buy_volume", "sell_volume"]


def profile_view(rows: DataFrame, scale: int, max_rows: int, center: DataFrame | None = None) -> DataFrame:
    """Profile at a scale: bitsets united, volumes summed, ``max_rows`` rows
    around the centre (default: middle of the range), zero-filled."""
    _check_scale(scale)
    b = bucket(F.col("tick"), scale)
    scaled = rows.groupBy(*KEY, b.alias("tick")).agg(
        F.bit_or("eth_bits").alias("eth_bits"), F.bit_or("rth_bits").alias("rth_bits"),
        *[F.sum(c).alias(c) for c in PROFILE_SUMS])
    span = rows.groupBy(*KEY).agg(F.min(b).alias("_lo"), F.max(b).alias("_hi"))
    mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long")
    if center is not None:
        span = span.join(center, KEY, "left")
        mid = F.coalesce("center", mid)
    first = bucket(mid, scale) - (max_rows // 2) * scale
    grid = span.select(*KEY, F.explode(F.sequence(first, first + (max_rows - 1) * scale, F.lit(scale).cast("long"))).alias("tick"))
    out = grid.join(scaled, [*KEY, "tick"], "left")
    return out.fillna(0, ["eth_bits", "rth_bits", *PROFILE_SUMS])


def open_marker(stats: DataFrame, scale: int) -> DataFrame:
    _check_scale(scale)
    return stats.select(*KEY, bucket(F.col("open"), scale).alias("open_bucket"))
