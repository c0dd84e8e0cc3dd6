"""Order feed derived from the driver's ``events`` table.

The test tables hold no order data, so an ``events`` row is read as one step in
the life of a resting order.  Within a frame of 64 consecutive event ids, 16
orders are open at once and each gets four steps (add, modify, execute,
withdraw).  Grouping is by life - four rows at most - so no group can become
hot whatever the distribution of users, times or values.

Two shapes come out: ``canonical_events`` (the library's event model) and
``raw_rows`` (a vendor-style export with bad rows, sequence regressions and day
files, used by the ingest operators).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import calendar as cal
from ..functions.schema import EVENT_SCHEMA, RAW_SCHEMA

TICK_SIZE = 250_000_000
UOM_QTY = 50_000_000_000
BACKDATE_US = 2_400_000_000  # 40 minutes, for the rows that arrive with an old time
SNAPSHOT_ID_BASE = 1_000_000_000_000


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        "event_id",
        (cal.ntz_micros(F.col("ts")) - F.when(F.col("event_id") % 41 == 0, BACKDATE_US).otherwise(0)).alias("us"),
        F.floor("value").cast("long").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def _instrument(life: Column) -> Column:
    """Half of all orders fall on instrument 1, so the hot key is always there."""
    m = life % 8
    return F.when(m < 4, 1).when(m < 6, 2).when(m < 7, 3).otherwise(4).cast("long")


def _channel(instrument: Column) -> Column:
    return F.when(instrument <= 2, 0).otherwise(1).cast("int")


def _row(when: Column, event_id: Column, sub: int, us: Column, kind: str, side: Column, size: Column,
         tick: Column) -> Column:
    return F.when(when, F.struct(
        (event_id * 8 + sub).alias("ordinal"), us.alias("us"), F.lit(kind).alias("kind"), side.alias("side"),
        size.cast("long").alias("size"), tick.cast("long").alias("tick")))


def _order_rows(base: DataFrame) -> DataFrame:
    step = F.shiftright(F.col("event_id") % 64, 4)
    life = F.shiftright(F.col("event_id"), 6) * 16 + F.col("event_id") % 16
    picks = [F.max(F.when(F.col("step") == s, F.col(c))).alias(f"{c}{s}")
             for s in range(4) for c in ("event_id", "us", "v", "k")]
    lives = base.withColumns({"step": step, "life": life}).groupBy("life").agg(*picks)
    c = F.col
    lives = lives.withColumns({
        "instrument_id": _instrument(c("life")),
        "own": F.when(F.shiftright(c("life"), 3) % 2 == 0, "B").otherwise("A"),
        "s0": 2 + c("v0") % 20,
        "t0": F.when(F.shiftright(c("life"), 3) % 2 == 0, -1 - c("k0") % 6).otherwise(c("k0") % 6)
              + 20000 + F.shiftright(c("life"), 4) % 16,
    })
    lives = lives.withColumns({
        "s1": F.when(c("k1") % 3 == 0, F.greatest(F.lit(1), c("s0") - 1)).when(c("k1") % 3 == 1, c("s0") + 2)
               .otherwise(c("s0")),
        "t1": c("t0") + F.when(c("k1") % 3 == 2, 1).otherwise(0),
        "anon": c("k2") % 11 == 0,
    })
    full = F.when(c("k2") % 5 == 0, 1).otherwise(c("s1"))
    rest = F.when(c("k2") % 4 == 3, c("s1")).otherwise(c("s0"))
    other = F.when(c("own") == "B", "A").otherwise("B")
    no_side = F.lit("N")
    t = F.lit(True)
    has = [c(f"event_id{s}").isNotNull() for s in range(4)]
    rows = [
        _row(has[0], c("event_id0"), 0, c("us0"), "Add", c("own"), c("s0"), c("t0")),
        _row(has[1], c("event_id1"), 0, c("us1"), "Modify", c("own"), c("s1"), c("t1")),
        _row(has[2], c("event_id2"), 0, c("us2"), "Trade", F.when(c("anon"), no_side).otherwise(other),
             F.when(c("k2") % 13 == 0, 0).otherwise(full), c("t1")),
        _row(has[2], c("event_id2"), 1, c("us2"), "Fill", F.when(c("anon"), no_side).otherwise(c("own")), full,
             c("t1") + F.when(c("k2") % 17 == 0, 1).otherwise(0)),
        _row(has[2] & (c("k2") % 2 == 0), c("event_id2"), 2, c("us2") + 1, "Cancel", c("own"), c("s1"), c("t1")),
        _row(has[2] & (c("k2") % 2 == 0), c("event_id2"), 3, c("us2") + 2, "Add", c("own"), c("s0"), c("t1")),
        _row(has[2] & (c("k2") % 4 == 1), c("event_id2"), 2, c("us2") + 1, "Modify", c("own"), c("s0"), c("t1")),
        _row(has[3] & (c("life") % 3 != 0), c("event_id3"), 0, c("us3"), "Cancel", c("own"), rest, c("t1")),
        _row(has[3] & (c("life") % 3 == 0) & (rest > 1), c("event_id3"), 0, c("us3"), "Cancel", c("own"),
             F.lit(1), c("t1")),
        _row(has[3] & (c("k3") % 7 == 0) & (c("life") % 3 != 0), c("event_id3"), 1, c("us3"), "Cancel", c("own"),
             rest, c("t1")),
    ]
    flat = lives.select("life", "instrument_id", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return flat.select("instrument_id", "r.*", (c("life") + 1).alias("order_id"), F.lit(0).alias("flags"))


def _special_rows(base: DataFrame) -> DataFrame:
    """Gaps (channel-wide, one row per instrument of the channel), clears, status
    rows and snapshot blocks; a pure projection of ``events``."""
    c = F.col
    e = c("event_id")
    pos = e > 0

    def item(when, instrument, sub, us, kind, side, size, tick, order_id, flags):
        return F.when(when, F.struct(
            instrument.cast("long").alias("instrument_id"), (e * 8 + sub).alias("ordinal"), us.alias("us"),
            F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.lit(size).cast("long").alias("size"),
            F.lit(tick).cast("long").alias("tick"), order_id.cast("long").alias("order_id"),
            F.lit(flags).alias("flags")))

    zero = F.lit(0)
    snap_inst = 1 + F.call_function("div", e, F.lit(500)) % 4
    stale = c("us") - 86_400_000_000
    gap_first = F.when(e % 2 == 0, 1).otherwise(3)
    items = [
        item(pos & (e % 997 == 0), gap_first, 4, c("us"), "Gap", "N", 0, 0, zero, 0),
        item(pos & (e % 997 == 0), gap_first + 1, 4, c("us"), "Gap", "N", 0, 0, zero, 0),
        item(pos & (e % 2503 == 0), F.lit(1), 5, c("us"), "Clear", "N", 0, 0, zero, 0),
        item(pos & (e % 701 == 0), F.lit(2), 5, c("us"), "Status", "N", 1, 0, zero, 0),
        item(e % 500 == 1, snap_inst, 6, stale, "Clear", "N", 0, 0, zero, 40),
        item(e % 500 == 1, snap_inst, 7, stale, "Add", "B", 5, 19990, SNAPSHOT_ID_BASE + e, 32),
        item(e % 500 == 33, snap_inst, 6, c("us"), "Modify", "B", 7, 19990, SNAPSHOT_ID_BASE + e - 32, 0),
    ]
    flat = base.select("us", F.explode(F.array_compact(F.array(*items))).alias("r"))
    # the admitting block's date, not the stale stamp, dates a snapshot row
    return flat.select("r.*", c("us").alias("carrier_us"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    c = F.col
    orders = _order_rows(base).withColumn("carrier_us", c("us"))
    cols = ["instrument_id", "ordinal", "us", "kind", "side", "size", "tick", "order_id", "flags", "carrier_us"]
    rows = orders.select(*cols).unionByName(_special_rows(base).select(*cols))
    gap = c("kind") == "Gap"
    snap = c("flags") >= 32
    day = cal.trade_date(c("carrier_us") * 1000)
    unseq = gap | snap
    out = rows.select(
        "instrument_id", _channel(c("instrument_id")).alias("channel_id"),
        F.concat(F.lit("day-"), F.date_format(day, "yyyyMMdd")).alias("source_file"),
        "ordinal", (c("us") * 1000).alias("ts_ns"),
        F.when(unseq, 0).otherwise(c("ordinal") + 1).cast("long").alias("seq"),
        "kind", "side", c("flags").cast("int").alias("flags"), snap.alias("is_snapshot"), "size",
        (c("tick") * TICK_SIZE).alias("price"), "order_id",
        F.when(gap, c("ordinal")).cast("long").alias("gap_expected"),
        F.when(gap, c("ordinal") - 800).cast("long").alias("gap_observed"), day.alias("trade_date"))
    return out.select(*[f.name for f in EVENT_SCHEMA.fields])


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor-style rows, one per event; a projection without any shuffle.

    The columns come out of ``inline``, past which Spark moves no filter: a condition on
    them would otherwise be rewritten in terms of ``events``, with the JSON field parsed
    anew at each of the many places where it names ``k``."""
    c = F.col
    base = _base(spark, sf_dir)
    e = c("event_id")
    inst = _instrument(e)
    snap = e % 61 == 7
    clear = e % 199 == 0
    action = (F.when(snap, F.when(e % 2 == 0, "A").otherwise("R")).when(clear, "R").when(e % 211 == 0, "N")
              .when(c("k") % 5 == 0, "A").when(c("k") % 5 == 1, "C").when(c("k") % 5 == 2, "M")
              .when(c("k") % 5 == 3, "T").otherwise("F"))
    side = F.when(e % 227 == 0, "X").when(action == "R", "N").when(c("v") % 2 == 0, "B").otherwise("A")
    day_us = 86_400_000_000
    file_no = F.call_function("div", c("us"), F.lit(day_us))
    undef = (e % 223 == 0) | (action == "R")
    row = F.struct(
        F.concat(F.lit("utc-"), F.date_format(F.date_from_unix_date(file_no.cast("int")), "yyyyMMdd")).alias("source_file"),
        (file_no - 19000).cast("int").alias("file_rank"), e.alias("row_index"),
        F.when(snap, c("us") * 1000 - 86_400_000_000_000).otherwise(c("us") * 1000).alias("ts_event"),
        (c("us") * 1000 + 350).alias("ts_recv"), F.lit(350).cast("long").alias("ts_in_delta"),
        inst.alias("instrument_id"), _channel(inst).alias("channel_id"),
        F.when(snap, e % 7).when(e % 301 == 0, 0).when(e % 97 == 0, e - 50)
         .otherwise(e - F.when(e % 10 == 9, 1).otherwise(0) + 100).cast("long").alias("sequence"),
        action.alias("action"), side.alias("side"),
        F.when(undef, F.lit(9223372036854775807)).otherwise(
            (20000 + c("k") % 12) * TICK_SIZE + F.when(e % 229 == 0, 1).otherwise(0)).cast("long").alias("price"),
        F.when(action == "R", F.lit(4294967295)).when(e % 233 == 0, F.lit(4294967295)).otherwise(1 + c("v") % 9)
         .cast("long").alias("size"),
        (F.when(action == "R", 0).otherwise(1 + F.call_function("div", e, F.lit(4)))).cast("long").alias("order_id"),
        F.when(snap, 32).otherwise(0).cast("int").alias("flags"))
    return base.select(F.inline(F.array(row))).select(*[f.name for f in RAW_SCHEMA.fields])


def instruments(events: DataFrame) -> DataFrame:
    """Instrument dimension for the instruments seen in ``events``."""
    ids = events.select("instrument_id").distinct()
    return ids.select(
        "instrument_id", F.concat(F.lit("FUT"), F.col("instrument_id").cast("string")).alias("symbol"),
        F.lit("TEST").alias("dataset"), F.lit(TICK_SIZE).cast("long").alias("tick_size"),
        F.lit(UOM_QTY).cast("long").alias("uom_qty"), F.lit(1).cast("long").alias("display_factor"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
