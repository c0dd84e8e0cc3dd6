"""Order lifecycle: scalars -> per-order fold -> intervals, flow, fills, refreshes."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.schema import KEY, REFRESH_WINDOW_NS, tick_of
from . import fold
from .prefix import Scan, prefix_scan
from .small import sized

cloudpickle.register_pickle_by_value(fold)  # workers need not have this package installed

HOT_ROWS = 1_000_000
_SAMPLE = 1024


def with_ticks(events: DataFrame, ticks: DataFrame | int) -> DataFrame:
    """Attach ``tick``: from one tick size, or from an instrument dimension (a
    missing instrument keeps a null tick and is reported by the grid audit)."""
    if isinstance(ticks, int):
        return events.withColumn("tick", tick_of(F.col("price"), F.lit(ticks).cast("long")))
    dim = sized(ticks.select("instrument_id", F.col("tick_size").alias("_ts")))
    return events.join(dim, "instrument_id", "left").withColumn("tick", tick_of(F.col("price"), F.col("_ts"))).drop("_ts")


def with_scalars(events: DataFrame) -> DataFrame:
    """Gap epoch, clear number and largest earlier event time of every row."""
    live = ~F.col("is_snapshot")
    return prefix_scan(events, KEY, {
        "epoch": Scan("sum", (F.col("kind") == "Gap").cast("long")),
        "clear_no": Scan("sum", ((F.col("kind") == "Clear") & live).cast("long")),
        "now_before": Scan("max", F.when(live, F.col("ts_ns"))),
    })


def side_no(side: Column) -> Column:
    return F.when(side == "B", 1).when(side == "A", 2).otherwise(0).cast("long")


def side_name(no: Column) -> Column:
    return F.when(no == 1, "B").when(no == 2, "A").otherwise("N")


def fold_input(events: DataFrame, ticks: DataFrame | int) -> DataFrame:
    cols = [*KEY, "ordinal", "ts_ns", "kind", "side", "is_snapshot", "size", "price", "order_id"]
    rows = with_scalars(events.select(*cols))
    snap = F.col("is_snapshot")
    code = (F.when(snap & (F.col("kind") == "Add"), fold.SNAP).when(snap, F.lit(None))
            .when(F.col("kind") == "Add", fold.ADD).when(F.col("kind") == "Cancel", fold.CANCEL)
            .when(F.col("kind") == "Modify", fold.MODIFY).when(F.col("kind") == "Fill", fold.FILL)).cast("long")
    rows = rows.withColumn("code", code).filter(F.col("code").isNotNull())
    rows = with_ticks(rows, ticks).filter(F.col("tick").isNotNull())
    return rows.select("instrument_id", F.unix_date("trade_date").cast("long").alias("day"), "order_id", "ordinal",
                       "ts_ns", "code", side_no(F.col("side")).alias("side_no"), "tick", "size", "epoch", "clear_no",
                       F.coalesce("now_before", F.lit(-1).cast("long")).alias("now_before"))


def hot_orders(events: DataFrame, hot_rows: int) -> DataFrame:
    """Order ids that hold very many rows.  Only *finding* them uses a thin slice
    of the ordinals; a missed id is folded unsplit, with the same result."""
    thin = events.filter(F.pmod(F.xxhash64("ordinal"), F.lit(_SAMPLE)) == 0)
    n = thin.groupBy("instrument_id", F.unix_date("trade_date").cast("long").alias("day"), "order_id").count()
    return n.filter(F.col("count") * _SAMPLE >= hot_rows).drop("count")


def split_lives(rows: DataFrame, window_ns: int) -> DataFrame:
    """Cut the history of ids at rows where nothing older can matter.

    A clear forgets everything, so the first row of a clear number starts from
    nothing.  So does an add later than every earlier fill plus the refresh
    window: it replaces whatever rests under its id, and only an execution within
    the window can leave a trace.  Such a row is given to both sides: as first row
    of the new piece and as END mark of the old one."""
    okey = ["instrument_id", "day", "order_id"]
    many = prefix_scan(rows, okey, {
        "_fill": Scan("max", F.when(F.col("code") == fold.FILL, F.col("ts_ns"))), "_clear": Scan("max", F.col("clear_no"))})
    clean = F.col("_fill").isNull() | (F.col("now_before") - F.col("_fill") > window_ns)
    fresh = (F.col("code") == fold.ADD) & (F.col("side_no") != 0) & (F.col("size") > 0) & clean
    many = many.withColumn("_fresh", F.coalesce(fresh, F.lit(False)) | F.coalesce(F.col("clear_no") > F.col("_clear"), F.lit(False)))
    many = prefix_scan(many, okey, {"seg": Scan("sum", F.col("_fresh").cast("long"), inclusive=True)})
    head = F.struct("code", "seg", "ts_ns")
    # a snapshot row carries an old time of its own; what it ends, it ends at the session's present
    present = F.when((F.col("code") == fold.SNAP) & (F.col("now_before") >= 0), F.col("now_before")).otherwise(F.col("ts_ns"))
    tail = F.struct(F.lit(fold.END).cast("long").alias("code"), (F.col("seg") - 1).alias("seg"), present.alias("ts_ns"))
    both = F.when(F.col("_fresh"), F.array(head, tail)).otherwise(F.array(head))
    many = many.withColumn("_p", F.explode(both)).withColumns({"code": F.col("_p.code"), "seg": F.col("_p.seg"), "ts_ns": F.col("_p.ts_ns")})
    return many.select(*fold.IN_NAMES)


def _fold(rows: DataFrame, window_ns: int) -> DataFrame:
    okey = ["instrument_id", "day", "order_id", "seg"]
    rows = rows.select(*fold.IN_NAMES).repartition(*okey).sortWithinPartitions(*okey, "ordinal")
    return rows.mapInArrow(lambda b: fold.fold_batches(b, window_ns), ", ".join(f"{n} long" for n in fold.OUT_NAMES))


def _one_row_per_event(out: DataFrame) -> DataFrame:
    """What an END mark found about the life it ended belongs to the row that ended it."""
    key = ["instrument_id", "day", "order_id", "ordinal"]
    ends = out.filter((F.col("code") == fold.END) & ((F.col("flags") != 0) | (F.col("violation") != 0)))
    ends = ends.select(*key, F.col("flags").alias("_flags"), F.col("violation").alias("_bad"))
    rows = out.filter(F.col("code") != fold.END).join(ends, key, "left")
    return rows.withColumns({"flags": F.col("flags").bitwiseOR(F.coalesce("_flags", F.lit(0).cast("long"))),
                             "violation": F.greatest("violation", F.coalesce("_bad", F.lit(0).cast("long")))}).drop("_flags", "_bad")


def order_log(events: DataFrame, ticks: DataFrame | int, window_ns: int = REFRESH_WINDOW_NS,
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per order event with its effects, and the resting state it opened
    (``opens``) valid for ordinals ``[ordinal, to_ord)`` within its clear number.

    Off-grid rows are left out here and reported by ``audit.off_grid``.  With
    ``hot_rows`` set, one small job looks for hot order ids while the plan is
    built, so that the splitting branch exists only when it is needed."""
    rows = fold_input(events, ticks)
    hot = hot_orders(events, hot_rows) if hot_rows is not None else None
    whole = rows.withColumn("seg", F.lit(0).cast("long"))
    if hot is None or hot.isEmpty():
        out = _fold(whole, window_ns)
    else:
        okey = ["instrument_id", "day", "order_id"]
        out = _fold(whole.join(hot, okey, "left_anti"), window_ns).unionByName(
            _one_row_per_event(_fold(split_lives(rows.join(hot, okey, "left_semi"), window_ns), window_ns)))
    names = F.array(*[F.lit(v) for v in fold.VIOLATIONS])
    flag = F.col("flags")
    kind = F.when(F.col("code") == fold.ADD, "Add").when(F.col("code") == fold.CANCEL, "Cancel").when(
        F.col("code") == fold.MODIFY, "Modify").when(F.col("code") == fold.FILL, "Fill").when(
        F.col("code") == fold.SNAP, "Snapshot")
    bits = {"unknown_ref": fold.UNKNOWN_REF, "desync_add": fold.DESYNC_ADD, "desync_cancel": fold.DESYNC_CANCEL,
            "desync_modify": fold.DESYNC_MODIFY, "desync_fill": fold.DESYNC_FILL, "off_display": fold.OFF_DISPLAY,
            "depletes": fold.DEPLETES, "replaces_depleted": fold.REPLACES}
    return out.select(
        "instrument_id", F.date_from_unix_date(F.col("day").cast("int")).alias("trade_date"), "order_id", "ordinal",
        "ts_ns", kind.alias("kind"), "epoch", "clear_no", "now_ns",
        side_name(F.col("old_side")).alias("old_side"), "old_tick", "cancelled",
        side_name(F.col("fx_side")).alias("fx_side"), "fx_tick", "added", "traded",
        F.when(F.col("refreshed") >= 0, F.col("refreshed")).alias("refreshed"),
        *[(flag.bitwiseAND(F.lit(b)) != 0).alias(n) for n, b in bits.items()],
        F.when(F.col("violation") > 0, names[F.col("violation").cast("int")]).alias("violation"),
        (F.col("opens") == 1).alias("opens"), side_name(F.col("side_no")).alias("side"), "tick", "size",
        F.col("prio_origin").cast("int").alias("prio_origin"), "prio_ord", "order_epoch", "reloads", "hidden",
        (F.col("unavailable") == 1).alias("unavailable"), "to_ord", "to_now")


def order_intervals(log: DataFrame) -> DataFrame:
    """Resting state over time: one row per state of an order."""
    return log.filter("opens").select(
        *KEY, "order_id", "side", "tick", "size", F.col("ordinal").alias("from_ord"), "to_ord",
        F.col("ts_ns").alias("from_ts"), F.col("now_ns").alias("from_now"), "to_now", "clear_no", "prio_origin", "prio_ord",
        F.col("order_epoch").alias("epoch"), "reloads", "hidden", "unavailable")


def flow_deltas(log: DataFrame) -> DataFrame:
    """Size added, withdrawn or executed at a level, one row per effect."""
    zero = F.lit(0).cast("long")
    off = F.struct(F.col("old_side").alias("side"), F.col("old_tick").alias("tick"), zero.alias("added"),
                   F.col("cancelled").alias("cancelled"), zero.alias("traded"))
    on = F.struct(F.col("fx_side").alias("side"), F.col("fx_tick").alias("tick"), F.col("added").alias("added"),
                  zero.alias("cancelled"), F.col("traded").alias("traded"))
    parts = F.array_compact(F.array(F.when(F.col("cancelled") > 0, off),
                                    F.when(((F.col("added") > 0) | (F.col("traded") > 0)) & (F.col("fx_side") != "N"), on)))
    return log.select(*KEY, "order_id", "ordinal", "ts_ns", "clear_no", F.explode(parts).alias("p")).select(
        *KEY, "order_id", "ordinal", "ts_ns", "clear_no", "p.*")


def fills(log: DataFrame) -> DataFrame:
    """Executions with the resting side resolved by order id where the event had none."""
    aggressor = F.when(F.col("fx_side") == "B", "A").when(F.col("fx_side") == "A", "B").otherwise("N")
    return log.filter((F.col("kind") == "Fill") & (F.col("traded") > 0)).select(
        *KEY, "order_id", "ordinal", "ts_ns", F.col("fx_side").alias("side"), F.col("fx_tick").alias("tick"),
        F.col("traded").alias("size"), aggressor.alias("aggressor"), "off_display", "unknown_ref")


def refreshes(log: DataFrame) -> DataFrame:
    """Placements classified as native refreshes."""
    return log.filter(F.col("refreshed").isNotNull()).select(
        *KEY, "order_id", "ordinal", "ts_ns", F.col("fx_side").alias("side"), F.col("fx_tick").alias("tick"),
        F.col("refreshed").alias("hidden_size"), "reloads")


def faults(log: DataFrame) -> DataFrame:
    """Rows the book could not take at face value."""
    flags = ["unknown_ref", "desync_add", "desync_cancel", "desync_modify", "desync_fill", "off_display"]
    reason = F.coalesce("violation", *[F.when(F.col(f), f) for f in flags])
    return log.select(*KEY, "order_id", "ordinal", "kind", reason.alias("reason")).filter(F.col("reason").isNotNull())
