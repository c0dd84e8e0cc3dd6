"""Consistency audits.  Each returns the offending rows or a report; healthy input gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.schema import KEY
from .orders import with_ticks
from .prefix import Scan, prefix_scan


def off_grid(events: DataFrame, ticks: DataFrame | int) -> DataFrame:
    """Order and trade rows whose price is not a multiple of the tick size."""
    priced = events.filter(F.col("kind").isin("Add", "Cancel", "Modify", "Trade", "Fill"))
    return with_ticks(priced, ticks).filter(F.col("tick").isNull()).drop("tick")


def seq_regressions(events: DataFrame) -> DataFrame:
    """Sequenced rows below the previous one with no gap in between."""
    gap = F.col("kind") == "Gap"
    sequenced = ~F.col("is_snapshot") & ~gap & (F.col("seq") > 0)
    ev = prefix_scan(events.select(*KEY, "ordinal", "kind", "is_snapshot", "seq"), KEY, {
        "_last": Scan("max", F.when(sequenced, F.struct("ordinal", "seq"))),
        "_gap": Scan("max", F.when(gap, F.col("ordinal")))})
    anchored = F.col("_last").isNotNull() & (F.col("_gap").isNull() | (F.col("_gap") < F.col("_last.ordinal")))
    bad = ev.filter(sequenced & anchored & (F.col("seq") < F.col("_last.seq")))
    return bad.select(*KEY, "ordinal", F.col("_last.seq").alias("last_seq"), "seq")


def coverage(events: DataFrame, applied: DataFrame) -> DataFrame:
    """Events read, applied, gaps and dropped (read - applied) per session."""
    read = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("events_read"), F.count_if(F.col("kind") == "Gap").alias("gap_records"))
    done = applied.groupBy(*KEY).agg(F.count(F.lit(1)).alias("events_applied"))
    out = read.join(done, KEY, "left").fillna(0, ["events_applied"])
    return out.withColumn("dropped", F.col("events_read") - F.col("events_applied"))


def watermarks(stages: dict[str, DataFrame]) -> DataFrame:
    """Last sequence each pipeline stage has reached, per session.  A stage is an
    event table; a later sequence wins by arrival, so a gap may move it back."""
    def mark(name: str, df: DataFrame) -> DataFrame:
        seq = df.filter(~F.col("is_snapshot") & (F.col("kind") != "Gap") & (F.col("seq") > 0))
        return seq.groupBy(*KEY).agg(F.max_by("seq", "ordinal").alias("last_seq")).select(
            *KEY, F.lit(name).alias("stage"), "last_seq")
    return reduce(DataFrame.unionByName, [mark(n, d) for n, d in stages.items()])


def book_counters(log: DataFrame, cut: DataFrame) -> DataFrame:
    """Diagnostic counters of the book and the snapshot clears it ignored."""
    flags = ["unknown_ref", "desync_add", "desync_cancel", "desync_modify", "desync_fill", "off_display"]
    n = log.groupBy(*KEY).agg(*[F.count_if(F.col(f)).alias(f) for f in flags],
                              F.count("violation").alias("violations"))
    out = cut.select(*KEY, "snapshot_clears").join(n, KEY, "left")
    return out.fillna(0, [*flags, "violations"])


def book_structure(live: DataFrame, queue_rows: DataFrame, depth_rows: DataFrame) -> DataFrame:
    """Structural checks of a book state: positive sizes, unique ids, ranks
    contiguous from 1, snapshot orders first, totals equal to the walk."""
    what = lambda df, name: df.select(*KEY, F.lit(name).alias("check"))
    level = [*KEY, "side", "tick"]
    walk = queue_rows.groupBy(*level).agg(
        F.max("queue_rank").alias("top"), F.count(F.lit(1)).alias("n"), F.countDistinct("queue_rank").alias("u"),
        F.max(F.struct("queue_rank", "contracts_ahead", "size")).alias("tail"),
        F.max(F.when(F.col("prio_origin") == 0, F.col("queue_rank"))).alias("snap_max"),
        F.min(F.when(F.col("prio_origin") == 1, F.col("queue_rank"))).alias("live_min"))
    totals = walk.join(depth_rows, level, "full")
    return reduce(DataFrame.unionByName, [
        what(live.filter((F.col("size") <= 0) | ~F.col("side").isin("B", "A")), "size_or_side"),
        what(live.groupBy(*KEY, "order_id").count().filter(F.col("count") > 1), "duplicate_id"),
        what(walk.filter((F.col("top") != F.col("n")) | (F.col("u") != F.col("n"))), "rank_gap"),
        what(walk.filter(F.col("snap_max") > F.col("live_min")), "snapshot_after_live"),
        what(totals.filter(~F.coalesce((F.col("total_size") == F.col("tail.contracts_ahead") + F.col("tail.size"))
                                       & (F.col("order_count") == F.col("n")), F.lit(False))), "totals_differ")])


def volume_agreement(trade_volume: DataFrame, fill_volume: DataFrame) -> DataFrame:
    """Trade-sourced against fill-sourced volume on the prices both have."""
    j = trade_volume.join(fill_volume, [*KEY, "tick"])
    bad = F.col("trade_volume") != F.col("fill_volume")
    return j.groupBy(*KEY).agg(F.count(F.lit(1)).alias("compared"), F.count_if(bad).alias("mismatched"),
                               F.min(F.when(bad, F.col("tick"))).alias("first_mismatch"))


def ladder_breaks(ladder_rows: DataFrame) -> DataFrame:
    """Ladder rows whose successor is not the next tick."""
    w = Window.partitionBy(*KEY).orderBy("tick")
    return ladder_rows.withColumn("next_tick", F.lead("tick").over(w)).filter(
        F.col("next_tick") - F.col("tick") != 1).select(*KEY, "tick", "next_tick")


def raw_outcome(read: DataFrame, mapped: DataFrame, canonical: DataFrame, session_rows: DataFrame) -> DataFrame:
    """(outcome, n): what became of the rows read.  Every reason of rejection, snapshot
    rows that no session admits, rows in a session, and ``lost``: rows read less all of
    these.  The four tables are counted apart, so a row lost between them shows."""
    row = F.col("kind") != "Gap"
    parts = [
        read.agg(F.count(F.lit(1)).alias("n")).select(F.lit("read").alias("outcome"), "n"),
        mapped.filter(F.col("reject").isNotNull()).groupBy(F.col("reject").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
        canonical.filter(row & F.col("trade_date").isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unadmitted").alias("outcome"), "n"),
        session_rows.filter(row).agg(F.count(F.lit(1)).alias("n")).select(F.lit("session").alias("outcome"), "n")]
    out = reduce(DataFrame.unionByName, parts)  # as many rows as there are reasons
    sign = F.when(F.col("outcome") == "read", F.col("n")).otherwise(-F.col("n"))
    one = out.agg(F.collect_list(F.struct("outcome", "n")).alias("x"), F.struct(F.lit("lost").alias("outcome"), F.sum(sign).alias("n")).alias("lost"))
    return one.select(F.explode(F.concat("x", F.array("lost"))).alias("x")).select("x.*")
