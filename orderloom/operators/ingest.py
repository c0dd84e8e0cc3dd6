"""From vendor rows to canonical events: mapping, gaps, snapshots, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.schema import ACTION_TO_KIND, EVENT_SCHEMA, KINDS, SIDES, SNAPSHOT_FLAG, UNDEF_PRICE, UNDEF_SIZE
from .prefix import Scan, prefix_scan
from .small import sized


#: Columns without which a row is no event (action and side have reasons of their own).
REQUIRED = ["channel_id", "flags", "ts_event", "sequence", "instrument_id", "order_id", "price", "size"]


def map_rows(raw: DataFrame) -> DataFrame:
    """Action to kind, undefined price/size on Clear to 0, event time from
    ``ts_event``; ``reject`` names why a row cannot be mapped, be it a code, an
    undefined value or a null in a required column."""
    kind = F.lit(None).cast("string")
    for action, name in ACTION_TO_KIND.items():
        kind = F.when(F.col("action") == action, name).otherwise(kind)
    is_clear = F.col("kind") == "Clear"
    no_price, no_size = F.col("price") == UNDEF_PRICE, F.col("size") == UNDEF_SIZE
    reject = F.when(F.col("kind").isNull(), "unmappable_action").when(F.col("side").isNull() | ~F.col("side").isin(*SIDES), "unmappable_side")
    for name in REQUIRED:
        reject = reject.when(F.col(name).isNull(), f"missing_{name}")
    reject = reject.when(no_price & ~is_clear, "undefined_price").when(no_size & ~is_clear, "undefined_size")
    out = raw.withColumn("kind", kind).withColumn("reject", reject)
    return out.withColumns({
        "price": F.when(is_clear & no_price, 0).otherwise(F.col("price")),
        "size": F.when(is_clear & no_size, 0).otherwise(F.col("size")),
        "ts_ns": F.col("ts_event"), "seq": F.col("sequence"),
        "is_snapshot": F.coalesce(F.col("flags").bitwiseAND(F.lit(SNAPSHOT_FLAG)) != 0, F.lit(False))})


def quarantine(raw: DataFrame) -> DataFrame:
    return map_rows(raw).filter(F.col("reject").isNotNull())


def accepted(raw: DataFrame) -> DataFrame:
    return map_rows(raw).filter(F.col("reject").isNull()).drop("reject")


def attach_symbol(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Symbol by instrument id; unknown ids keep a null symbol."""
    return events.join(sized(mapping.select("instrument_id", "symbol")), "instrument_id", "left")


def attach_instrument(events: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their instrument's metadata, and the ids that have none
    (metadata is supplied, never invented)."""
    d = sized(dim)
    known = events.join(d, "instrument_id")
    missing = events.join(d, "instrument_id", "left_anti").select("instrument_id").distinct()
    return known, missing


def observe_sequence(rows: DataFrame) -> DataFrame:
    """Sequence accounting per channel in arrival order.

    ``gap_expected`` is set on a row that falls below its predecessor;
    ``forward_hole`` marks a jump past the successor.  Snapshot rows and
    sequence 0 neither count nor move the position."""
    counted = ~F.col("is_snapshot") & (F.col("seq") != 0)
    rows = prefix_scan(rows, ["channel_id"], {"_last": Scan("max", F.when(counted, F.struct("ordinal", "seq")))})
    last = F.col("_last.seq")
    return rows.withColumns({
        "gap_expected": F.when(counted & (F.col("seq") < last), last + 1),
        "forward_hole": F.coalesce(counted & (F.col("seq") > last + 1), F.lit(False))}).drop("_last")


def canonicalise(rows: DataFrame) -> DataFrame:
    """Canonical events of accepted, numbered rows: a channel-wide Gap
    (instrument 0) is put before each row that revealed one, and snapshot rows
    take the trade date of their file's first live row (null = not admitted)."""
    seen = observe_sequence(rows).withColumn("own_date", cal.trade_date(F.col("ts_ns")))
    files = seen.filter(~F.col("is_snapshot")).groupBy("source_file").agg(F.min_by("own_date", "ordinal").alias("file_date"))
    seen = seen.join(sized(files), "source_file", "left")
    seen = seen.withColumn("trade_date", F.when(F.col("is_snapshot"), F.col("file_date")).otherwise(F.col("own_date")))
    row = F.struct(F.lit(False).alias("gap"), (F.col("ordinal") * 2).alias("o"))
    gap = F.struct(F.lit(True).alias("gap"), (F.col("ordinal") * 2 - 1).alias("o"))
    parts = F.when(F.col("gap_expected").isNotNull(), F.array(gap, row)).otherwise(F.array(row))
    e = seen.withColumn("p", F.explode(parts))
    g = F.col("p.gap")

    def live(c: str, on_gap) -> Column:
        return F.when(g, F.lit(on_gap)).otherwise(F.col(c)).alias(c)

    return e.select(
        live("instrument_id", 0).cast("long").alias("instrument_id"), "channel_id", "source_file", F.col("p.o").alias("ordinal"),
        "ts_ns", live("seq", 0).cast("long").alias("seq"), live("kind", "Gap"), live("side", "N"),
        live("flags", 0).cast("int").alias("flags"), live("is_snapshot", False), live("size", 0).cast("long").alias("size"),
        live("price", 0).cast("long").alias("price"), live("order_id", 0).cast("long").alias("order_id"),
        F.when(g, F.col("gap_expected")).alias("gap_expected"), F.when(g, F.col("seq")).alias("gap_observed"),
        F.col("trade_date"), F.when(g, False).otherwise(F.col("forward_hole")).alias("forward_hole"))


def fan_out_gaps(events: DataFrame) -> DataFrame:
    """Give every instrument of a channel its own copy of the channel's gaps."""
    members = sized(events.filter(F.col("kind") != "Gap").select("channel_id", "instrument_id").distinct())
    gaps = events.filter((F.col("kind") == "Gap") & (F.col("instrument_id") == 0)).drop("instrument_id").join(members, "channel_id")
    return events.filter((F.col("kind") != "Gap") | (F.col("instrument_id") != 0)).unionByName(gaps.select(*events.columns))


def one_session(events: DataFrame, instrument_id: int, trade_date: str) -> DataFrame:
    """One instrument and trade date; gaps stay by their own date whatever their instrument."""
    day = F.col("trade_date") == F.lit(trade_date).cast("date")
    return events.filter(day & ((F.col("instrument_id") == instrument_id) | (F.col("kind") == "Gap")))


def file_admission(rows: DataFrame) -> DataFrame:
    """Trade date each file's snapshot block belongs to (null: no live row, block dropped)."""
    own = rows.withColumn("own_date", F.when(~F.col("is_snapshot"), cal.trade_date(F.col("ts_ns"))))
    first = F.min(F.when(~F.col("is_snapshot"), F.struct("ordinal", "own_date")))
    return own.groupBy("source_file").agg(first.alias("f"), F.count_if("is_snapshot").alias("snapshot_rows")).select(
        "source_file", F.col("f.own_date").alias("admitted_date"), "snapshot_rows")


def ingest_stats(events: DataFrame) -> DataFrame:
    """Per session: events kept, gaps, snapshots kept.  Gaps and forward holes
    are channel-wide and counted on the date they were observed."""
    live = events.filter(F.col("trade_date").isNotNull())
    return live.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "Gap").alias("gaps_kept"),
        F.count_if("is_snapshot").alias("snapshots_kept"), F.count_if("forward_hole").alias("holes"))


def snapshot_outcome(events: DataFrame, instrument_id: int) -> DataFrame:
    """Per target date: snapshot rows of the instrument kept and dropped when
    that one session is written from all files."""
    snaps = events.filter(F.col("is_snapshot") & (F.col("instrument_id") == instrument_id))
    per = snaps.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    total = snaps.agg(F.count(F.lit(1)).alias("total"))
    days = events.filter(~F.col("is_snapshot")).select("trade_date").distinct()
    kept = F.coalesce("n", F.lit(0))
    return days.join(per, "trade_date", "left").join(F.broadcast(total)).select(  # total is one row
        "trade_date", kept.alias("snapshots_kept"), (F.col("total") - kept).alias("snapshots_dropped"))


def date_report(events: DataFrame) -> DataFrame:
    """Counts of the eight kinds and first/last time in arrival order, per trade date."""
    live = events.filter(~F.col("is_snapshot"))
    return live.groupBy("trade_date").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS], F.count(F.lit(1)).alias("total"),
        F.min_by("ts_ns", "ordinal").alias("first_ts"), F.max_by("ts_ns", "ordinal").alias("last_ts"))


def instrument_report(events: DataFrame) -> DataFrame:
    live = events.filter(~F.col("is_snapshot") & (F.col("kind") != "Gap"))
    return live.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("events"))


def file_report(events: DataFrame) -> DataFrame:
    """Per file: rows, snapshots, gaps, holes, and first/last live sequence."""
    counted = ~F.col("is_snapshot") & (F.col("kind") != "Gap") & (F.col("seq") != 0)
    pos = F.when(counted, F.col("ordinal"))
    return events.groupBy("source_file").agg(
        F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("events"), F.count_if("is_snapshot").alias("snapshots"),
        F.count_if(F.col("kind") == "Gap").alias("gaps"), F.count_if("forward_hole").alias("holes"),
        F.min_by("seq", pos).alias("first_seq"), F.max_by("seq", pos).alias("last_seq"))


def file_boundaries(report: DataFrame) -> DataFrame:
    """Where one file's last sequence does not lead into the next file's first, the
    files being in stitch order (that of their first ordinals)."""
    w = Window.orderBy("first_ordinal")  # one row per file
    r = report.select("source_file", "first_seq", "last_seq",
                      F.lag("source_file").over(w).alias("prev_file"), F.lag("last_seq").over(w).alias("prev_seq"))
    off = (F.col("first_seq") != F.col("prev_seq")) & (F.col("first_seq") != F.col("prev_seq") + 1)
    kind = F.when(F.col("first_seq") < F.col("prev_seq") + 1, "regression").otherwise("forward_hole")
    return r.filter(off).select("prev_file", "source_file", "prev_seq", "first_seq", kind.alias("discontinuity"))


def session_events(events: DataFrame) -> DataFrame:
    """Canonical table ready for the book and the profile: admitted rows only, gaps fanned out."""
    return fan_out_gaps(events.filter(F.col("trade_date").isNotNull())).select(*EVENT_SCHEMA.names)
