"""Order book reads: depth, best prices, queue, flow, touch counters, icebergs."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.schema import FLOW_BUCKET_NS, FLOW_BUCKETS, KEY, MAX_LONG, SNAPSHOT_CADENCE_NS
from . import asof, sweep
from .prefix import BLOCK_BITS, Scan, prefix_scan
from .profile import touch_counters
from .small import clocked, sized

cloudpickle.register_pickle_by_value(sweep)  # workers need not have this package installed


def depth(live: DataFrame) -> DataFrame:
    """Total size and order count per level."""
    return live.groupBy(*KEY, "side", "tick").agg(F.sum("size").alias("total_size"), F.count(F.lit(1)).alias("order_count"))


def best_first(levels: DataFrame, top: int | None = None) -> DataFrame:
    """Rank levels from the inside out (bids down, asks up); ``top`` levels only if given."""
    inward = F.when(F.col("side") == "B", -F.col("tick")).otherwise(F.col("tick"))
    w = Window.partitionBy(*KEY, "side").orderBy(inward)  # one row per price level
    out = levels.withColumn("level", F.row_number().over(w))
    return out if top is None else out.filter(F.col("level") <= top)


def bbo(levels: DataFrame) -> DataFrame:
    """Best bid and ask, and how they overlap."""
    out = levels.groupBy(*KEY).agg(
        F.max(F.when(F.col("side") == "B", F.col("tick"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "A", F.col("tick"))).alias("best_ask"))
    b, a = F.col("best_bid"), F.col("best_ask")
    return out.withColumn("overlap", F.when(b == a, "locked").when(b > a, "crossed").otherwise("normal"))


def bbo_series(intervals: DataFrame, points: DataFrame, cadence_ns: int = SNAPSHOT_CADENCE_NS) -> DataFrame:
    """Best bid and ask at every cadence step.

    Interval ends become +size/-size per (level, step); those sums, not orders,
    are accumulated over the steps, so the work after the first aggregate is
    bounded by price levels x steps."""
    iv = clocked(intervals, "session_open_ns")

    def at(now: str) -> Column:
        return asof.cadence_bucket(F.col(now), F.col("session_open_ns"), cadence_ns)

    ends = F.array_compact(F.array(
        F.struct(F.greatest(at("from_now"), F.lit(0)).alias("b"), F.col("size").alias("d")),
        F.when(F.col("to_ord") != MAX_LONG, F.struct(at("to_now").alias("b"), (-F.col("size")).alias("d")))))
    level = [*KEY, "clear_no", "side", "tick"]
    delta = iv.select(*level, F.explode(ends).alias("e")).groupBy(*level, F.col("e.b").alias("bucket")).agg(
        F.sum("e.d").alias("d"))
    w = Window.partitionBy(*level).orderBy("bucket")
    state = delta.withColumns({"size": F.sum("d").over(w), "_next": F.lead("bucket").over(w)}).filter(F.col("size") > 0)
    top = sized(points.groupBy(*KEY).agg(F.max("bucket").alias("_top")))
    state = state.join(top, KEY).withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_top")))
    state = state.filter(F.col("bucket") <= F.col("_to")).select(
        *KEY, "clear_no", "side", "tick", F.explode(F.sequence("bucket", "_to")).alias("bucket"))
    best = state.groupBy(*KEY, "bucket", "clear_no").agg(
        F.max(F.when(F.col("side") == "B", F.col("tick"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "A", F.col("tick"))).alias("best_ask"))
    return points.select(*KEY, "bucket", "clear_no", "cut_ord").join(best, [*KEY, "bucket", "clear_no"], "left").drop("clear_no")


def clear_ends(events: DataFrame) -> DataFrame:
    """(session, clear_no, end_ord): the ordinal of the clear that ends a clear number."""
    live = events.filter((F.col("kind") == "Clear") & ~F.col("is_snapshot")).select(*KEY, "ordinal")
    n = prefix_scan(live, KEY, {"clear_no": Scan("sum", F.lit(1).cast("long"))})
    return n.select(*KEY, "clear_no", F.col("ordinal").alias("end_ord"))


def bbo_changes(intervals: DataFrame, events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Best bid and ask after every row that changes either (null: no such side).

    Order intervals become counts per level and ordinal.  A block of ordinals is one
    group; it gets its own counts and, for every level populated at its start, the
    count carried from earlier blocks, so it knows the best price before its first row
    and gives exactly its own changes.  Carries are kept per level and block, never per order."""
    side = [*KEY, "side"]
    iv = intervals.join(clear_ends(events), [*KEY, "clear_no"], "left")
    to = F.least(F.col("to_ord"), F.coalesce("end_ord", F.lit(MAX_LONG)))
    ends = F.array_compact(F.array(F.struct(F.col("from_ord").alias("o"), F.lit(1).alias("d")), F.when(to != MAX_LONG, F.struct(to.alias("o"), F.lit(-1).alias("d")))))
    delta = iv.select(*side, "tick", F.explode(ends).alias("e")).groupBy(*side, "tick", F.col("e.o").alias("ordinal")).agg(F.sum("e.d").alias("d"))
    delta = delta.filter("d <> 0").withColumn("blk", F.shiftright("ordinal", block_bits))
    net = delta.groupBy(*side, "tick", "blk").agg(F.sum("d").alias("d"))
    by_block = Window.partitionBy(*side, "tick").orderBy("blk")  # a level's blocks
    last = net.groupBy(*side).agg(F.max("blk").alias("_last"))
    held = net.withColumns({"n": F.sum("d").over(by_block), "_next": F.lead("blk").over(by_block)}).filter("n > 0").join(last, side)
    until = F.coalesce("_next", "_last")
    held = held.filter(F.col("blk") < until).select(*side, "tick", F.explode(F.sequence(F.col("blk") + 1, until)).alias("blk"), F.col("n").alias("d"))
    held = held.join(net.select(*side, "blk").distinct(), [*side, "blk"], "left_semi")  # a block without counts of its own changes nothing
    rows = delta.select(*side, "blk", "ordinal", "tick", "d").unionByName(held.select(*side, "blk", F.lit(-1).cast("long").alias("ordinal"), "tick", "d"))
    one = rows.groupBy(*side, "blk").applyInPandas(sweep.changes, "instrument_id long, trade_date date, side string, ordinal long, best long")

    last_of = lambda s: Scan("max", F.when(F.col("side") == s, F.struct("ordinal", "best")), inclusive=True)
    # a row may change both sides: one of them comes first, the later one holds both
    both = one.withColumn("ordinal", 2 * F.col("ordinal") + F.when(F.col("side") == "A", 1).otherwise(0))
    both = prefix_scan(both, KEY, {"b": last_of("B"), "a": last_of("A")})
    row = F.shiftright("ordinal", 1)
    return both.groupBy(*KEY, row.alias("ordinal")).agg(F.max_by("b.best", "ordinal").alias("best_bid"), F.max_by("a.best", "ordinal").alias("best_ask"))


def last_print(fill_rows: DataFrame) -> DataFrame:
    """Latest execution."""
    out = fill_rows.groupBy(*KEY).agg(F.max(F.struct("ordinal", "tick", "size", "aggressor")).alias("p"))
    return out.select(*KEY, "p.tick", "p.size", "p.aggressor")


def inside_traded(fill_rows: DataFrame) -> DataFrame:
    """Touch counters from executions: resting bid feeds cB, resting ask cA."""
    side = F.when(F.col("side") == "B", "cB").when(F.col("side") == "A", "cA")
    return touch_counters(fill_rows, None, side).drop("since")


def queue(live: DataFrame) -> DataFrame:
    """Exact FIFO standing at each level: snapshot orders first, then by priority.

    Priorities are ordinals, far below 2**61, so live ones are lifted above all
    snapshot ones and one number orders the level; the prefix scan spreads a
    crowded level over tasks."""
    key = F.col("prio_ord") + F.when(F.col("prio_origin") == 1, F.lit(1 << 61)).otherwise(F.lit(0))
    rows = prefix_scan(live.withColumn("_key", key), [*KEY, "side", "tick"], {
        "orders_ahead": Scan("sum", F.lit(1).cast("long")), "contracts_ahead": Scan("sum", F.col("size"))}, order="_key")
    return rows.withColumn("queue_rank", F.col("orders_ahead") + 1).drop("_key")


# ---- five-second flow -----------------------------------------------------

def flow_rows(flow: DataFrame) -> DataFrame:
    """Flow effects with the bucket they count in: their own, or the level's
    latest one when they arrive late."""
    own = F.call_function("div", F.col("ts_ns"), F.lit(FLOW_BUCKET_NS))
    level = [*KEY, "clear_no", "side", "tick"]
    return prefix_scan(flow, level, {"bucket": Scan("max", own, inclusive=True)})


def flow_buckets(flow: DataFrame) -> DataFrame:
    return flow_rows(flow).groupBy(*KEY, "clear_no", "side", "tick", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("added", "cancelled", "traded")])


def flow_series(flow: DataFrame) -> DataFrame:
    """Window sums at the end of every bucket a level was active in."""
    w = Window.partitionBy(*KEY, "clear_no", "side", "tick").orderBy("bucket").rangeBetween(-(FLOW_BUCKETS - 1), 0)
    return flow_buckets(flow).withColumns({f"{c}_5s": F.sum(c).over(w) for c in ("added", "cancelled", "traded")})


def flow_at(events: DataFrame, flow: DataFrame, cut: DataFrame) -> DataFrame:
    """Window sums per level at the cut.  Before the first event inside the
    window no level can reach into it, so older effects are dropped by ordinal
    before anything is shuffled."""
    low = (F.call_function("div", F.col("now_ns"), F.lit(FLOW_BUCKET_NS)) - (FLOW_BUCKETS - 1)).alias("_low")
    c = sized(cut.select(*KEY, "cut_ord", F.col("clear_no").alias("_clear"), low))
    near = events.filter(~F.col("is_snapshot")).join(c, KEY).filter(
        (F.col("ordinal") <= F.col("cut_ord")) & (F.col("ts_ns") >= F.col("_low") * FLOW_BUCKET_NS))
    first = sized(near.groupBy(*KEY).agg(F.min("ordinal").alias("_first")))
    f = flow.join(c, KEY).join(first, KEY).filter(
        (F.col("ordinal") <= F.col("cut_ord")) & (F.col("ordinal") >= F.col("_first")) & (F.col("clear_no") == F.col("_clear")))
    rows = flow_rows(f).filter(F.col("bucket") >= F.col("_low"))
    return rows.groupBy(*KEY, "side", "tick").agg(*[F.sum(x).alias(f"{x}_5s") for x in ("added", "cancelled", "traded")])


# ---- icebergs -------------------------------------------------------------

def refresh_totals(refresh_rows: DataFrame) -> DataFrame:
    """Session-cumulative refresh count and hidden volume per level."""
    return refresh_rows.groupBy(*KEY, "side", "tick").agg(
        F.count(F.lit(1)).alias("refresh_count"), F.sum("hidden_size").alias("hidden_volume"))


def book_counts(live: DataFrame, cut: DataFrame) -> DataFrame:
    """Live orders, populated levels, latest event time and sequence."""
    n = live.groupBy(*KEY, "side", "tick").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEY).agg(
        F.sum("n").alias("live_orders"), F.count(F.lit(1)).alias("populated_levels"))
    out = cut.select(*KEY, "now_ns", "last_seq", "gap_pending").join(n, KEY, "left")
    return out.fillna(0, ["live_orders", "populated_levels"])


def census(log: DataFrame, refresh_rows: DataFrame, live: DataFrame) -> DataFrame:
    """Iceberg census per session: classifications, hidden volume, ids, reload
    histogram, closing states, and ids ever read as unavailable across a gap."""
    per_id = refresh_rows.groupBy(*KEY, "order_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hidden_size").alias("h"), F.max("reloads").alias("m"))
    m = F.col("m")
    totals = per_id.groupBy(*KEY).agg(
        F.sum("n").alias("refreshes"), F.sum("h").alias("hidden_volume"), F.count(F.lit(1)).alias("distinct_ids"),
        F.max("m").alias("max_reloads"), F.count_if(m == 1).alias("ids_1"), F.count_if((m >= 2) & (m <= 4)).alias("ids_2_4"),
        F.count_if((m >= 5) & (m <= 9)).alias("ids_5_9"), F.count_if(m >= 10).alias("ids_10_plus"))
    closing = live.groupBy(*KEY).agg(
        F.count_if("native").alias("closing_native"), F.count_if(F.col("refresh_state") == "Unavailable").alias("closing_unavailable"))
    seen = log.filter(F.col("opens") & (F.col("kind") != "Snapshot") & (F.col("epoch") > 0)
                      & (F.col("unavailable") | (F.col("order_epoch") < F.col("epoch")))).select(*KEY, "order_id")
    left = live.filter((F.col("refresh_state") == "Unavailable") & (F.col("gap_epoch") > 0)).select(*KEY, "order_id")
    unavail = seen.unionByName(left).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("unavailable_ids"))
    cross = refresh_totals(refresh_rows).groupBy(*KEY).agg(
        F.sum("refresh_count").alias("_n"), F.sum("hidden_volume").alias("_h"))
    out = totals.join(cross, KEY, "full").join(closing, KEY, "full").join(unavail, KEY, "full")
    nums = [c for c in out.columns if c not in KEY]
    out = out.fillna(0, nums)
    agrees = (F.col("refreshes") == F.col("_n")) & (F.col("hidden_volume") == F.col("_h"))
    return out.withColumn("totals_agree", agrees).drop("_n", "_h")
