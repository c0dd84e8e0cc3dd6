"""State as of a time: cuts in arrival order, and stored snapshots plus tail.

A pass "up to T" stops at the first event later than T *in arrival order*, so
an as-of point is an ordinal, not a time filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.schema import KEY, MAX_LONG, SNAPSHOT_CADENCE_NS
from .prefix import AGGREGATES, BLOCK_BITS, Scan, merged, prefix_scan
from .small import clocked, sized


def cut_ordinals(events: DataFrame, at_ns: Column) -> DataFrame:
    """Per session, the last ordinal of the leading run with ``ts_ns <= at_ns``."""
    first_after = F.min(F.when(F.col("ts_ns") > at_ns, F.col("ordinal")))
    return events.groupBy(*KEY).agg(
        F.coalesce(first_after - 1, F.max("ordinal")).alias("cut_ord"), F.max(at_ns).alias("at_ns"))


def cuts(events: DataFrame, at_ns: Column | None = None) -> DataFrame:
    """Book scalars of every session at its cut (``None`` = end of session).

    ``epoch`` gaps so far, ``clear_no`` clears so far, ``now_ns`` latest event
    time, sequence and gap accounting - one map-side-combined pass, evaluated
    once because every as-of read joins it."""
    at = at_ns if at_ns is not None else F.lit(MAX_LONG)
    points = sized(cut_ordinals(events, at))
    ev = events.join(points, KEY).filter(F.col("ordinal") <= F.col("cut_ord"))
    got = ev.groupBy(*KEY).agg(*[AGGREGATES[x.how](x.value).alias(n) for n, x in scalars().items()])
    return sized(_book_scalars(points.join(got, KEY, "left"), "cut_ord", "at_ns"))


def scalars() -> dict[str, Scan]:
    """What a cut says of the rows up to it."""
    live = ~F.col("is_snapshot")
    gap, clear = F.col("kind") == "Gap", F.col("kind") == "Clear"
    number = lambda when: Scan("sum", when.cast("long"), inclusive=True)
    latest = lambda when, *cols: Scan("max", F.when(when, F.struct("ordinal", *cols)), inclusive=True)
    return {"epoch": number(gap), "clear_no": number(live & clear), "snapshot_clears": number(~live & clear), "events": number(F.lit(True)),
            "now_ns": Scan("max", F.when(live, F.col("ts_ns")), inclusive=True), "_gap": latest(gap, "gap_expected", "gap_observed"),
            "_seq": latest(live & ~gap & (F.col("seq") > 0), "seq")}


def _book_scalars(cut: DataFrame, *also: str) -> DataFrame:
    pending = F.col("_gap").isNotNull() & (F.col("_seq").isNull() | (F.col("_seq.ordinal") < F.col("_gap.ordinal")))
    zero = F.lit(0).cast("long")
    return cut.select(
        *KEY, *also, *[F.coalesce(F.col(c), zero).alias(c) for c in ("epoch", "clear_no", "snapshot_clears", "events")],
        "now_ns", F.col("_gap.gap_expected").alias("gap_expected"), F.col("_gap.gap_observed").alias("gap_observed"),
        pending.alias("gap_pending"), F.when(~pending, F.col("_seq.seq")).alias("last_seq"))


def upto(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of any ordinal-keyed table at or before the cut."""
    return rows.join(cut.select(*KEY, "cut_ord"), KEY).filter(F.col("ordinal") <= F.col("cut_ord")).drop("cut_ord")


def live_orders(intervals: DataFrame, cut: DataFrame) -> DataFrame:
    """Orders resting at the cut: a filter on intervals, no replay."""
    c = cut.select(*KEY, "cut_ord", F.col("clear_no").alias("_clear"), F.col("epoch").alias("_epoch"))
    hit = (F.col("from_ord") <= F.col("cut_ord")) & (F.col("to_ord") > F.col("cut_ord")) & (F.col("clear_no") == F.col("_clear"))
    out = intervals.join(c, KEY).filter(hit)
    return _with_refresh_state(out.withColumnRenamed("_epoch", "gap_epoch")).drop("cut_ord", "_clear")


def _with_refresh_state(orders: DataFrame) -> DataFrame:
    stale = (F.col("epoch") < F.col("gap_epoch")) | F.col("unavailable")
    state = F.when(stale, "Unavailable").otherwise("Known")
    return orders.withColumns({"refresh_state": state, "native": (state == "Known") & (F.col("reloads") > 0)})


# ---- many cuts ------------------------------------------------------------

_AFTER_ALL = 1 << 60  # block number of the place after a session's last row


def block_stats(events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per session and block of ordinals: its first and last ordinal, the latest
    time in it, and its scalars.  Written beside the event table (``mbo.write_sessions``
    needs ``ordinal``: it is the first one), cuts at any time read only it and the blocks they fall into."""
    per = events.groupBy(*KEY, F.shiftright("ordinal", block_bits).alias("blk"))
    return per.agg(F.min("ordinal").alias("ordinal"), F.max("ordinal").alias("last_ord"), F.max("ts_ns").alias("max_ts"),
                   *[AGGREGATES[x.how](x.value).alias(n) for n, x in scalars().items()])


def _carried(stats: DataFrame) -> DataFrame:
    """Every block with the latest time up to its end and the scalars before its start,
    and the place after the last block.  A window over blocks, not rows."""
    how = {n: x.how for n, x in scalars().items()}
    end = stats.groupBy(*KEY).agg(F.max("last_ord").alias("last"))
    end = end.select(*KEY, F.lit(_AFTER_ALL).alias("blk"), (F.col("last") + 1).alias("ordinal"), F.lit(None).cast("long").alias("max_ts"),
                     *[F.lit(None).cast(stats.schema[n].dataType).alias(n) for n in how])
    both = stats.drop("last_ord").unionByName(end)
    w = Window.partitionBy(*KEY).orderBy("blk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*KEY, "blk", F.col("ordinal").alias("first_ord"), F.max("max_ts").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"),
                       *[AGGREGATES[h](n).over(before).alias(f"_c_{n}") for n, h in how.items()])


def cuts_at(events: DataFrame, points: DataFrame, stats: DataFrame | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``cuts`` for any number of times per session in one job.

    ``points`` has the session key and ``at_ns``, and may hold further columns, which
    stay.  A time falls into the first block whose latest time exceeds it; points and
    blocks are merged by time.  Only rows of such blocks are read; inside a block,
    points are merged with the running maximum of its times.  Nothing meets by
    times x blocks or times x rows."""
    how = {n: x.how for n, x in scalars().items()}
    blocks = _carried(block_stats(events, block_bits) if stats is None else stats)
    pt = F.struct(*[F.col(x) for x in points.columns])
    null = lambda t: F.lit(None).cast(t)
    kind = points.select(pt.alias("pt")).schema["pt"].dataType

    # the first block that goes beyond the time: of equal times points come first
    marks = blocks.filter(F.col("blk") < _AFTER_ALL).select(*KEY, F.col("peak").alias("t"), F.lit(1).alias("k"), "blk", null(kind).alias("pt"))
    marks = marks.unionByName(points.select(*KEY, F.col("at_ns").alias("t"), F.lit(0).alias("k"), null("long").alias("blk"), pt.alias("pt")))
    w = Window.partitionBy(*KEY).orderBy(F.desc("t"), "k").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("blk", F.coalesce(F.min("blk").over(w), F.lit(_AFTER_ALL))).filter(F.col("pt").isNotNull())
    placed = placed.select(*KEY, "blk", "t", "pt")

    # inside the block: the last row of the leading run of times up to the point's
    used = sized(placed.filter(F.col("blk") < _AFTER_ALL).select(*KEY, "blk").distinct())
    rows = events.withColumn("blk", F.shiftright("ordinal", block_bits)).join(used, [*KEY, "blk"], "left_semi")
    by_row = Window.partitionBy(*KEY, "blk").orderBy("ordinal")
    so_far = by_row.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.lead("ordinal").over(by_row).alias("next"), *[AGGREGATES[x.how](x.value).over(so_far).alias(n) for n, x in scalars().items()])
    rows = rows.select(*KEY, "blk", F.max("ts_ns").over(so_far).alias("t"), F.col("ordinal").alias("o"), here.alias("s"))
    merge = rows.withColumn("pt", null(kind)).unionByName(placed.select(*KEY, "blk", "t", null("long").alias("o"), null(rows.schema["s"].dataType).alias("s"), "pt"))
    up_to = Window.partitionBy(*KEY, "blk").orderBy("t", F.asc_nulls_last("o")).rowsBetween(Window.unboundedPreceding, 0)
    found = merge.withColumn("s", F.last("s", ignorenulls=True).over(up_to)).filter(F.col("pt").isNotNull())
    found = found.join(blocks.drop("peak"), [*KEY, "blk"])
    more = [x for x in points.columns if x not in KEY]
    out = found.select(*KEY, *[F.col(f"pt.{x}").alias(x) for x in more], (F.coalesce("s.next", "first_ord") - 1).alias("cut_ord"),
                       *[merged(h, F.col(f"_c_{n}"), F.col(f"s.{n}")).alias(n) for n, h in how.items()])
    return _book_scalars(out, *more, "cut_ord")


def orders_at(intervals: DataFrame, cut: DataFrame) -> DataFrame:
    """Orders resting at each of many cuts (rows of ``cuts_at``; their columns but the
    scalars come along).

    The cuts of a session and clear number are numbered in arrival order.  Two counts
    of cuts, before an interval's first ordinal and before its last, come from one
    prefix scan over both; an interval then meets exactly the cuts it spans."""
    key = [*KEY, "clear_no"]
    numbered = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("cut_ord", "at_ns")) - 1)
    end = lambda name, o: F.struct(F.lit(name).alias("e"), o.alias("o"))
    ends = F.array(end("lo", F.col("from_ord")), end("hi", F.least(F.col("to_ord"), F.lit(1 << 60))))
    marks = intervals.select(*key, "order_id", "from_ord", F.explode(ends).alias("x")).select(
        *key, "order_id", "from_ord", F.col("x.e").alias("e"), (2 * F.col("x.o")).alias("_pos"), F.lit(0).cast("long").alias("_cut"))
    marks = marks.unionByName(numbered.select(
        *key, F.lit(None).cast("long").alias("order_id"), F.lit(None).cast("long").alias("from_ord"), F.lit("cut").alias("e"),
        (2 * F.col("cut_ord") + 1).alias("_pos"), F.lit(1).cast("long").alias("_cut")))
    before = prefix_scan(marks, key, {"_n": Scan("sum", F.col("_cut"))}, order="_pos").filter(F.col("e") != "cut")
    count = lambda e: F.max(F.when(F.col("e") == e, F.col("_n"))).alias(f"_{e}")
    spans = before.groupBy(*key, "order_id", "from_ord").agg(count("lo"), count("hi")).filter(F.col("_lo") < F.col("_hi"))
    met = intervals.join(spans, [*key, "order_id", "from_ord"]).withColumn("_at", F.explode(F.sequence("_lo", F.col("_hi") - 1))).drop("_lo", "_hi")
    more = [x for x in cut.columns if x not in (*key, "epoch", "snapshot_clears", "events", "now_ns", "gap_expected", "gap_observed", "gap_pending", "last_seq")]
    out = met.join(numbered.select(*key, "_at", F.col("epoch").alias("gap_epoch"), *more), [*key, "_at"]).drop("_at")
    return _with_refresh_state(out)


# ---- stored snapshots -----------------------------------------------------

def cadence_bucket(now_ns: Column, open_ns: Column, cadence_ns: int) -> Column:
    return F.call_function("div", now_ns - open_ns, F.lit(cadence_ns))


def snapshot_cuts(events: DataFrame, cadence_ns: int = SNAPSHOT_CADENCE_NS) -> DataFrame:
    """Snapshot points: the last event of every cadence step of event time,
    counted from the session open, with the clear number there.

    Fixed steps rather than "60 s after the previous snapshot's event": the
    latter is a chain through the whole session, the former is one aggregate.
    Where snapshots lie does not change any state read through them."""
    live = ~F.col("is_snapshot")
    ev = clocked(events, "session_open_ns")
    ev = prefix_scan(ev, KEY, {
        "now_ns": Scan("max", F.when(live, F.col("ts_ns")), inclusive=True),
        "clear_no": Scan("sum", (live & (F.col("kind") == "Clear")).cast("long"), inclusive=True),
        "epoch": Scan("sum", (F.col("kind") == "Gap").cast("long"), inclusive=True)})
    ev = ev.filter(F.col("now_ns").isNotNull())
    b = cadence_bucket(F.col("now_ns"), F.col("session_open_ns"), cadence_ns)
    return ev.groupBy(*KEY, b.alias("bucket")).agg(
        F.max("ordinal").alias("cut_ord"), F.max("now_ns").alias("now_ns"), F.max("clear_no").alias("clear_no"),
        F.max("epoch").alias("epoch"))


def state_snapshots(intervals: DataFrame, points: DataFrame, cadence_ns: int = SNAPSHOT_CADENCE_NS) -> DataFrame:
    """Full resting state at every snapshot point (one row per order and point).

    Each interval lists the cadence steps it spans and meets the points on
    (session, step): an equality join, never intervals x points."""
    iv = clocked(intervals, "session_open_ns")
    first = cadence_bucket(F.col("from_now"), F.col("session_open_ns"), cadence_ns)
    last_step = F.lit(86_400_000_000_000 * 2 // cadence_ns)
    end = F.when(F.col("to_ord") == MAX_LONG, last_step).otherwise(
        cadence_bucket(F.col("to_now"), F.col("session_open_ns"), cadence_ns))
    top = points.groupBy(*KEY).agg(F.max("bucket").alias("_top"))
    iv = iv.join(sized(top), KEY).withColumns({"_a": F.greatest(first, F.lit(0)), "_b": F.least(end, F.col("_top"))})
    iv = iv.filter(F.col("_a") <= F.col("_b")).withColumn("bucket", F.explode(F.sequence("_a", "_b")))
    p = points.select(*KEY, "bucket", "cut_ord", F.col("clear_no").alias("_clear"))
    out = iv.join(p, [*KEY, "bucket"]).filter(
        (F.col("_clear") == F.col("clear_no")) & (F.col("from_ord") <= F.col("cut_ord")) & (F.col("to_ord") > F.col("cut_ord")))
    return out.drop("session_open_ns", "_a", "_b", "_top", "_clear")


def nearest_snapshot(points: DataFrame, cut: DataFrame) -> DataFrame:
    """Latest snapshot point at or before each cut."""
    c = cut.select(*KEY, F.col("cut_ord").alias("_cut"))
    return points.join(c, KEY).filter(F.col("cut_ord") <= F.col("_cut")).groupBy(*KEY).agg(
        F.max("bucket").alias("bucket"), F.max("cut_ord").alias("snap_ord"))


def live_from_snapshot(snapshots: DataFrame, intervals: DataFrame, points: DataFrame, cut: DataFrame) -> DataFrame:
    """Same orders as ``live_orders``, read from the nearest snapshot plus the
    intervals opened after it.  A snapshot row survives if its state still holds
    at the cut; both parts are pruned by ordinal, so old history is not read."""
    near = nearest_snapshot(points, cut)
    c = cut.select(*KEY, "cut_ord", F.col("clear_no").alias("_clear")).join(near, KEY, "left")
    c = sized(c.withColumn("snap_ord", F.coalesce("snap_ord", F.lit(-1).cast("long"))))
    cols = [x for x in intervals.columns]
    alive = (F.col("to_ord") > F.col("_cut")) & (F.col("clear_no") == F.col("_clear"))
    kept = snapshots.drop("cut_ord").join(c.withColumnRenamed("cut_ord", "_cut"), [*KEY, "bucket"]).filter(alive).select(*cols)
    tail = intervals.join(c.drop("bucket").withColumnRenamed("cut_ord", "_cut"), KEY).filter(
        (F.col("from_ord") > F.col("snap_ord")) & (F.col("from_ord") <= F.col("_cut")) & alive).select(*cols)
    return kept.unionByName(tail)
