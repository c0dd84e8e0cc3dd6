"""Live forms: append sink, windows, stateful orders, publication, lag.

Arrival order stays the truth.  Watermarks are used to let window state expire,
never to reorder; rows later than the watermark are the documented difference
from a batch pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.schema import EVENT_SCHEMA, FLOW_BUCKET_NS, FLOW_BUCKETS, KEY, REFRESH_WINDOW_NS
from ..operators import fold, orders, profile


def event_time(events: DataFrame) -> DataFrame:
    """Microsecond event time for windows and watermarks only."""
    return events.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every event once; the file sink and its checkpoint survive restarts."""
    return (events.writeStream.format("parquet").outputMode("append").partitionBy("trade_date", "instrument_id")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def half_hour_volume(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Traded volume per instrument and half-hour of event time."""
    t = event_time(events.filter((F.col("kind") == "Trade") & ~F.col("is_snapshot"))).withWatermark("ts", watermark)
    return t.groupBy("instrument_id", F.window("ts", "30 minutes").alias("w")).agg(F.sum("size").alias("volume")).select(
        "instrument_id", F.unix_micros("w.start").alias("start_us"), "volume")


def traded_flow(events: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Executed volume per price over the sliding 5 s window, every 500 ms."""
    width = f"{FLOW_BUCKET_NS * FLOW_BUCKETS // 1_000_000} milliseconds"
    slide = f"{FLOW_BUCKET_NS // 1_000_000} milliseconds"
    f = event_time(events.filter((F.col("kind") == "Fill") & ~F.col("is_snapshot"))).withWatermark("ts", watermark)
    return f.groupBy("instrument_id", "price", F.window("ts", width, slide).alias("w")).agg(
        F.sum("size").alias("traded")).select("instrument_id", "price", F.unix_micros("w.end").alias("end_us"), "traded")


def session_volume(events: DataFrame) -> DataFrame:
    """Volume by price per trade date: the session is a calendar key, not a gap-based window."""
    t = events.filter((F.col("kind") == "Trade") & ~F.col("is_snapshot"))
    return t.groupBy(*KEY, "price").agg(F.sum("size").alias("volume"))


# ---- order lifecycle ------------------------------------------------------

class ScalarStage:
    """First stage of the live lifecycle: gives each micro-batch its gap epoch,
    clear number and latest earlier time, continuing from the batch before.

    The carried table has one row per session.  Rows and carry of batch N are
    overwritten under N, so a retried batch leaves the same result.  Batches must
    continue the arrival order of a session: a row at or below an ordinal of an
    earlier batch stops the stream.  The carry, which finds that out, is written
    first, so readers of the rows never see a refused batch."""

    COLUMNS = [f.name for f in EVENT_SCHEMA.fields] + ["epoch", "clear_no", "now_before"]

    def __init__(self, out_path: str, carry_path: str):
        self.out_path, self.carry_path = out_path, carry_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live = ~F.col("is_snapshot")
        schema = "instrument_id long, trade_date date, c_epoch long, c_clear long, c_now long, c_ord long"
        if batch_id > 0:
            old = spark.read.schema(schema).parquet(f"{self.carry_path}/{batch_id - 1}")
        else:
            old = spark.createDataFrame([], schema)
        rows = orders.with_scalars(batch).join(old, KEY, "left")
        zero = F.lit(0).cast("long")
        rows = rows.withColumns({
            "epoch": F.col("epoch") + F.coalesce("c_epoch", zero), "clear_no": F.col("clear_no") + F.coalesce("c_clear", zero),
            "now_before": F.greatest("now_before", "c_now")})
        here = batch.groupBy(*KEY).agg(
            F.count_if(F.col("kind") == "Gap").alias("n_epoch"), F.count_if((F.col("kind") == "Clear") & live).alias("n_clear"),
            F.max(F.when(live, F.col("ts_ns"))).alias("n_now"), F.min("ordinal").alias("n_first"), F.max("ordinal").alias("n_ord"))
        new = old.join(here, KEY, "full").select(
            *KEY, (F.coalesce("c_epoch", zero) + F.coalesce("n_epoch", zero)).alias("c_epoch"),
            (F.coalesce("c_clear", zero) + F.coalesce("n_clear", zero)).alias("c_clear"),
            F.greatest("c_now", "n_now").alias("c_now"),
            F.when(F.col("n_first") <= F.col("c_ord"), F.raise_error(F.lit("a batch goes back in the arrival order")).cast("long"))
            .otherwise(F.greatest("c_ord", "n_ord")).alias("c_ord"))
        new.write.mode("overwrite").parquet(f"{self.carry_path}/{batch_id}")
        rows.select(*self.COLUMNS).write.mode("overwrite").parquet(f"{self.out_path}/batch={batch_id}")


SCALED_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields) + \
    ", epoch bigint, clear_no bigint, now_before bigint"
_STATE = ["order_id", *fold.STATE_FIELDS, "open_ord", "seen_ms"]
#: Groups an instrument-day's orders are dealt into; a group's state is one row.
STATE_PARTS = 32
_FX = ["old_side", "old_tick", "cancelled", "fx_side", "fx_tick", "added", "traded", "refreshed", "flags", "violation"]
_REST = ["side_no", "tick", "size", "prio_origin", "prio_ord", "order_epoch", "reloads", "hidden", "unavailable"]
_OUT = ["instrument_id", "day", "order_id", "ordinal", "ts_ns", "code", "epoch", "clear_no", *_FX, "opens", *_REST, "closes_ord"]


def _fold_part(rows, states, day: tuple, now_ms: int, window_ns: int):
    """Events of one group in arrival order over its orders' saved states, one row of ``_STATE``
    each: effect columns, and the states after them.  Only orders that have events are unpacked."""
    from array import array

    import numpy as np

    names = ["order_id", "ordinal", "ts_ns", "code", "side_no", "tick", "size", "epoch", "clear_no", "now_before"]
    rows = np.stack([np.concatenate([f[n].to_numpy() for f in rows]) for n in names])
    rows = rows[:, np.argsort(rows[1], kind="stable")]
    ids = rows[0]
    touched = np.isin(states[:, 0], ids)
    orders_now: dict[int, list] = {}
    for oid, *saved, open_ord, _ in states[touched].tolist():
        o = fold.Order()
        for name, value in zip(fold.STATE_FIELDS, saved):
            setattr(o, name, value)
        orders_now[oid] = [o, open_ord]
    out = array("q")
    for oid, ordinal, ts, code, side, tick, size, epoch, clear_no, before in rows.T.tolist():
        kept = orders_now.get(oid)
        if kept is None:
            kept = orders_now[oid] = [fold.Order(clear_no), -1]
        o, open_ord = kept
        changed, *fx = fold.step(o, code, ordinal, ts, side, tick, size, epoch, clear_no, before, window_ns)
        if changed:
            kept[1] = ordinal if o.live else -1
        out.extend((*day, oid, ordinal, ts, code, epoch, clear_no))
        out.extend(fx)
        out.extend((1, o.side, o.tick, o.size, o.origin, o.prio, o.epoch, o.reloads, o.hidden, o.unavail) if changed and o.live else (0,) * 10)
        out.append(open_ord if changed else -1)
    after = [(oid, *[int(getattr(o, n)) for n in fold.STATE_FIELDS], open_ord, now_ms) for oid, (o, open_ord) in orders_now.items() if o.live or o.t_ts >= 0]
    states = np.concatenate([states[~touched], np.array(after, np.int64).reshape(-1, len(_STATE))])
    return np.frombuffer(out, np.int64).reshape(-1, len(_OUT)), states


def order_effects(scaled: DataFrame, tick_size: int, window_ns: int = REFRESH_WINDOW_NS, hold_ms: int | None = None,
                  parts: int = STATE_PARTS) -> DataFrame:
    """Second stage: the batch fold's step, per order, across micro-batches.

    An instrument-day's orders are dealt by hash into ``parts`` groups, and Spark keeps
    one state per group: the states of its orders.  So a micro-batch calls Python once
    per group it touches, not once per order.

    ``closes_ord`` names the interval an event ended.  There is no watermark, so
    rows of any age are applied.  State of an order that is neither resting nor
    awaiting a refresh is dropped: the next event starts from the same empty
    state.  A pending refresh expires by the times of later events, as in the
    batch fold.  Its state is freed ``hold_ms`` of processing time after the last
    event of the id (choose it longer than a session), or kept if that is None:
    such a timeout asks for batches without end, so an ``availableNow`` run,
    which ends with its data, must not set it."""
    e = scaled
    snap = F.col("is_snapshot")
    code = (F.when(snap & (F.col("kind") == "Add"), fold.SNAP).when(snap, F.lit(None))
            .when(F.col("kind") == "Add", fold.ADD).when(F.col("kind") == "Cancel", fold.CANCEL)
            .when(F.col("kind") == "Modify", fold.MODIFY).when(F.col("kind") == "Fill", fold.FILL)).cast("long")
    e = orders.with_ticks(e.withColumn("code", code).filter(F.col("code").isNotNull()), tick_size)
    e = e.filter(F.col("tick").isNotNull()).select(
        "instrument_id", F.unix_date("trade_date").cast("long").alias("day"), F.pmod(F.xxhash64("order_id"), F.lit(parts)).alias("part"),
        "order_id", "ordinal", "ts_ns", "code", orders.side_no(F.col("side")).alias("side_no"), "tick", "size", "epoch", "clear_no",
        F.coalesce("now_before", F.lit(-1).cast("long")).alias("now_before"))

    def run(key, frames, state):
        import numpy as np
        import pandas as pd
        states = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(-1, len(_STATE))
        now_ms = state.getCurrentProcessingTimeMs() if hold_ms is not None else 0
        rows = None
        if not state.hasTimedOut:
            rows, states = _fold_part(list(frames), states, key[:2], now_ms, window_ns)
        pending = states[:, 1] == 0
        if hold_ms is not None:
            states = states[~pending | (states[:, -1] + hold_ms > now_ms)]
            pending = states[:, 1] == 0
        if len(states):
            state.update((states.tobytes(),))
            if hold_ms is not None and pending.any():
                state.setTimeoutDuration(int(max(1, states[pending, -1].min() + hold_ms - now_ms)))
        elif state.exists:
            state.remove()
        if rows is not None:
            yield pd.DataFrame(rows, columns=_OUT)

    return e.groupBy("instrument_id", "day", "part").applyInPandasWithState(
        run, ", ".join(f"{n} long" for n in _OUT), "orders binary", "append",
        GroupStateTimeout.NoTimeout if hold_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


# ---- publication ----------------------------------------------------------

HEADS = "instrument_id bigint, trade_date date, c_period int, at bigint"


def publish_profiles(state_path: str, out_path: str, ticks: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the profiles of the sessions a batch touches.

    A batch reads its own rows, the highest half-hour each session had reached
    (``heads``) and the sessions' partials, one row per price and half-hour; never
    earlier events.  Heads and partials of batch N lie under N; a head names the
    batch that holds the newest partials of its session.  So batch N changes nothing
    that it reads, and a retry leaves the same result.  Batches must continue the
    arrival order (``ScalarStage`` stops one that does not)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = spark.read.schema(HEADS).parquet(f"{state_path}/heads/{batch_id - 1}") if batch_id > 0 else spark.createDataFrame([], HEADS)
        rows = profile.with_period(batch)
        here = rows.groupBy(*KEY).agg(F.max("current_period").cast("int").alias("n_period"), F.lit(batch_id).cast("long").alias("n_at"))
        old.join(here, KEY, "full").select(
            *KEY, F.greatest("c_period", "n_period").alias("c_period"), F.coalesce("n_at", "at").alias("at")).write.mode(
            "overwrite").parquet(f"{state_path}/heads/{batch_id}")
        touched = spark.read.schema(HEADS).parquet(f"{state_path}/heads/{batch_id}").filter(F.col("at") == batch_id).select(
            *KEY, F.col("c_period").alias("current_period"))
        before = old.join(touched, KEY, "left_semi")
        parts = profile.partials(profile.continue_period(rows.join(before.drop("at"), KEY, "left"), F.col("c_period")), ticks)
        held = [r.at for r in before.select("at").distinct().collect()]  # batch numbers, not rows
        if held:
            saved = spark.read.schema(profile.PARTIALS + ", batch bigint").option("basePath", f"{state_path}/partials").parquet(
                *[f"{state_path}/partials/batch={i}" for i in held])
            saved = saved.join(before.select(*KEY, F.col("at").alias("batch")), [*KEY, "batch"], "left_semi").drop("batch")
            parts = profile.merge_partials(parts.unionByName(saved))
        path = f"{state_path}/partials/batch={batch_id}"
        parts.write.mode("overwrite").parquet(path)
        out = profile.rows_of_partials(spark.read.schema(profile.PARTIALS).parquet(path), touched)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("trade_date", "instrument_id").parquet(out_path))
    return run


def late_rows(scaled: DataFrame) -> DataFrame:
    """Live rows that came after a later time of their session, counted from the first stage's rows."""
    late = F.coalesce(F.col("ts_ns") < F.col("now_before"), F.lit(False))
    return scaled.filter(~F.col("is_snapshot")).groupBy(*KEY).agg(F.count_if(late).alias("late_rows"))


def head_lag(events: DataFrame, clock_us) -> DataFrame:
    """How far the newest event of each instrument is behind ``clock_us``."""
    return events.filter(~F.col("is_snapshot")).groupBy("instrument_id").agg(F.max("ts_ns").alias("head_ns")).withColumn(
        "lag_ns", clock_us * F.lit(1000) - F.col("head_ns"))
