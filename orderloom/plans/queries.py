"""Registered queries: every operator over the whole of the given tables.

Book reads are taken at 15:00 Chicago of every session (``AT``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import calendar as cal, letters
from ..functions.schema import EVENT_SCHEMA, KEY, tick_value
from ..operators import asof, audit, book, ingest, orders, priors, profile, views
from ..operators.small import bucket_by_calendar
from ..sources import events_feed as feed, mbo
from ..streaming import live as streaming
from .store import stored, stored_path
from .workdir import work_dir

TICK = feed.TICK_SIZE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register; integers come out as long so that both engines agree on types."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        small = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))]
        return df.withColumns({n: c(n).cast("long") for n in small}) if small else df
    QUERIES[fn.__name__] = run
    return fn


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """The stored event table."""
    return stored(spark, sf, "events", lambda: feed.canonical_events(spark, sf))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return mbo.with_ordinal(feed.raw_rows(spark, sf))


def canon(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.canonicalise(ingest.accepted(numbered(spark, sf)))


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    """The stored order log."""
    return stored(spark, sf, "order_log", lambda: orders.order_log(ev(spark, sf), TICK))


def at() -> F.Column:
    return cal.session_clock(c("trade_date"))["rth_close_ns"]


def cut_of(events: DataFrame) -> DataFrame:
    return asof.cuts(events, at())


def live_of(spark: SparkSession, sf: str) -> DataFrame:
    return asof.live_orders(orders.order_intervals(log_of(spark, sf)), cut_of(ev(spark, sf)))


def tr_of(spark: SparkSession, sf: str) -> DataFrame:
    return profile.trades(ev(spark, sf), TICK)


def rows_of(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_rows(tr_of(spark, sf))


# ---- A: sources and sinks -------------------------------------------------

@query
def a01_raw_scan(spark, sf):
    return feed.raw_rows(spark, sf).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_event").alias("first_event"), F.max("ts_recv").alias("last_recv"),
        F.sum("sequence").alias("seq_sum"))


@query
def a02_action_mapping(spark, sf):
    return ingest.accepted(feed.raw_rows(spark, sf)).select("row_index", "instrument_id", "kind", "side", "order_id")


@query
def a03_undefined_values(spark, sf):
    m = ingest.map_rows(feed.raw_rows(spark, sf))
    return m.groupBy("kind", "reject").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((c("price") == 0) & (c("size") == 0)).alias("zeroed"))


@query
def a03_quarantine(spark, sf):
    return ingest.quarantine(feed.raw_rows(spark, sf)).select("row_index", "action", "side", "reject")


@query
def a04_event_time(spark, sf):
    return ingest.accepted(feed.raw_rows(spark, sf)).select(
        "row_index", "ts_ns", (c("ts_recv") - c("ts_ns")).alias("recv_delay"), "flags", "is_snapshot")


@query
def a05_symbology(spark, sf):
    raw = feed.raw_rows(spark, sf)
    mapping = feed.instruments(raw).filter(c("instrument_id") != 4)
    return ingest.attach_symbol(raw, mapping).groupBy("instrument_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query
def a06_instrument_meta(spark, sf):
    raw = feed.raw_rows(spark, sf)
    known, _ = ingest.attach_instrument(raw, feed.instruments(raw).filter(c("instrument_id") != 4))
    return known.groupBy("instrument_id", "symbol", "tick_size", "uom_qty", "display_factor").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "tick_value", tick_value(c("tick_size"), c("uom_qty")))


@query
def a06_missing_meta(spark, sf):
    raw = feed.raw_rows(spark, sf)
    return ingest.attach_instrument(raw, feed.instruments(raw).filter(c("instrument_id") != 4))[1]


@query
def a07_one_session(spark, sf):
    one = ingest.one_session(canon(spark, sf), 1, "2024-01-10")
    return one.select("ordinal", "instrument_id", "kind", "ts_ns", "seq", "is_snapshot")


@query
def a08_stitched_files(spark, sf):
    return canon(spark, sf).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ord"), F.max("ordinal").alias("last_ord"),
        F.count_if(c("kind") == "Gap").alias("gaps"))


@query
def a09_partitioned_write(spark, sf):
    path = work_dir(spark, "events")
    mbo.write_events(feed.canonical_events(spark, sf), path)
    return mbo.read_events(spark, path).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ord"), F.max("ordinal").alias("last_ord"),
        F.sum("size").alias("size_sum"))


@query
def a10_range_scan(spark, sf):
    day = (1704844800000000000, 1704931200000000000 - 1)
    return mbo.scan_range(ev(spark, sf), times_ns=day).select("instrument_id", "ordinal", "ts_ns", "kind")


@query
def a11_arrival_ordinal(spark, sf):
    return numbered(spark, sf).select("row_index", "source_file", "ordinal")


@query
def a12_text_dump(spark, sf):
    return mbo.text_dump(ev(spark, sf))


@query
def a13_slice(spark, sf):
    return mbo.slice_rows(numbered(spark, sf), 1000, 500).select("ordinal", "row_index", "instrument_id", "action")


def _splice_bounds():
    clock = cal.session_clock(c("trade_date"))
    return clock["rth_open_ns"], clock["rth_close_ns"]


@query
def a14_injected_gap(spark, sf):
    e = ev(spark, sf)
    after, through = _splice_bounds()
    out = mbo.inject_gap(e, after, through, 100, 200, mbo.splice_problems(e, after, through))
    return out.select("instrument_id", "trade_date", "ordinal", "ts_ns", "kind", "gap_expected", "gap_observed")


@query
def a14_splice_problems(spark, sf):
    return mbo.splice_problems(ev(spark, sf), *_splice_bounds())


def _sessions(spark, sf):
    return ev(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_events"))


def _offers(spark, sf):
    """Every session offered from up to three places."""
    day = F.unix_date("trade_date")
    places = F.array_compact(F.array(F.lit("cache"), F.when(day % 2 == 0, "same_dir"), F.when(day % 5 == 0, "explicit")))
    s = _sessions(spark, sf).select(*KEY, "n_events", F.explode(places).alias("source"))
    return s.withColumn("path", F.concat_ws("/", "source", c("instrument_id").cast("string"), c("trade_date").cast("string")))


def _current(spark, sf):
    return _sessions(spark, sf).groupBy("instrument_id").agg(F.max("trade_date").alias("trade_date"))


@query
def a15_prior_discovery(spark, sf):
    return priors.discover(_offers(spark, sf), _current(spark, sf)).select("instrument_id", "trade_date", "source", "path")


def _candidate_dates(spark, sf):
    files = feed.raw_rows(spark, sf).select(
        F.to_date(F.substring("source_file", 5, 8), "yyyyMMdd").alias("file_date")).distinct()
    return priors.candidate_dates(files, _current(spark, sf))


@query
def a16_candidate_dates(spark, sf):
    return _candidate_dates(spark, sf)


@query
def a16_missing_dates(spark, sf):
    have = _sessions(spark, sf).filter(F.unix_date("trade_date") % 3 != 0)
    return priors.missing_dates(_candidate_dates(spark, sf), have)


def _stream(spark, sf, files_per_batch: int | None = None):
    path = stored_path(spark, sf, "events", lambda: feed.canonical_events(spark, sf))
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _drain(spark, rows: DataFrame) -> DataFrame:
    """Run a stream over what is stored and read the sink back."""
    out = work_dir(spark, "sink")
    streaming.append_rows(rows, out, work_dir(spark, "ckpt")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query
def a17_live_append(spark, sf):
    path = work_dir(spark, "live")
    streaming.append_events(_stream(spark, sf), path, work_dir(spark, "ckpt")).awaitTermination()
    return mbo.read_events(spark, path).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("distinct_ord"), F.max("ordinal").alias("frontier"))


# ---- B: session time ------------------------------------------------------

def _when(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", (cal.ntz_micros(c("ts")) * 1000).alias("ts_ns"))


@query
def b01_trade_date(spark, sf):
    return _when(spark, sf).select("event_id", cal.trade_date(c("ts_ns")).alias("trade_date"))


def _days(spark, sf):
    return b01_trade_date(spark, sf).select("trade_date")


@query
def b02_session_open(spark, sf):
    return _days(spark, sf).distinct().select("trade_date", cal.session_open_ns(c("trade_date")).alias("session_open_ns"))


@query
def b03_epoch_days(spark, sf):
    return _days(spark, sf).groupBy(F.unix_date("trade_date").alias("epoch_day")).agg(F.count(F.lit(1)).alias("n"))


@query
def b04_calendar_bucket(spark, sf):
    w = _when(spark, sf)
    calendar = cal.session_calendar(w.select(cal.trade_date(c("ts_ns")).alias("trade_date")))
    return bucket_by_calendar(w, calendar).select("event_id", "bucket_date")


@query
def b05_session_calendar(spark, sf):
    return cal.session_calendar(_days(spark, sf))


def _clocked(spark, sf):
    e = _when(spark, sf).withColumn("trade_date", cal.trade_date(c("ts_ns")))
    return cal.with_clock(e, "session_open_ns", "rth_open_ns", "rth_close_ns", "eth_end_ns", "session_end_ns", "rth_offset")


@query
def b06_eth_period(spark, sf):
    return _clocked(spark, sf).select("event_id", cal.eth_period(c("ts_ns"), c("session_open_ns"), c("eth_end_ns")).alias("eth_period"))


@query
def b07_rth_period(spark, sf):
    return _clocked(spark, sf).select("event_id", cal.rth_period(c("ts_ns"), c("rth_open_ns"), c("rth_close_ns")).alias("rth_period"))


@query
def b08_rth_offset(spark, sf):
    return _clocked(spark, sf).groupBy("trade_date").agg(F.max("rth_offset").alias("rth_offset"))


@query
def b09_admission(spark, sf):
    e = _clocked(spark, sf)
    post = (c("ts_ns") >= c("eth_end_ns")) & (c("ts_ns") < c("session_end_ns"))
    admits = (c("ts_ns") >= c("session_open_ns")) & (c("ts_ns") < c("session_end_ns"))
    return e.select("event_id", admits.alias("admits"), post.alias("post_close"))


@query
def b10_developing_period(spark, sf):
    return profile.with_period(ev(spark, sf)).select("instrument_id", "ordinal", "dev_period", "rth_period", "backward")


@query
def b11_off_grid(spark, sf):
    rows = ingest.accepted(feed.raw_rows(spark, sf))
    return audit.off_grid(rows.withColumnRenamed("row_index", "ordinal"), TICK).select("ordinal", "instrument_id", "kind", "price")


@query
def b12_snapshots_ignored(spark, sf):
    return ev(spark, sf).groupBy(*KEY).agg(
        F.count_if("is_snapshot").alias("ignored"), F.count_if(c("is_snapshot") & ~c("kind").isin("Add", "Clear")).alias("illegal"),
        F.count_if(~c("is_snapshot")).alias("used"))


@query
def b13_zero_size_trades(spark, sf):
    return profile.session_counters(ev(spark, sf)).select(*KEY, "zero_size_trades", "current_period")


@query
def b14_post_close(spark, sf):
    t = tr_of(spark, sf)
    return t.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(~c("in_lettering"), c("size"))), F.lit(0)).alias("post_close_volume"),
        F.coalesce(F.sum(F.when(c("in_lettering"), c("size"))), F.lit(0)).alias("lettered_volume"))


# ---- C: ingest quality ----------------------------------------------------

@query
def c01_sequence_gaps(spark, sf):
    return canon(spark, sf).filter(c("kind") == "Gap").select("channel_id", "ordinal", "ts_ns", "gap_expected", "gap_observed", "trade_date")


@query
def c02_emission_order(spark, sf):
    return canon(spark, sf).select("ordinal", "instrument_id", "channel_id", "kind", "seq", "gap_expected", "gap_observed")


@query
def c03_snapshot_admission(spark, sf):
    return ingest.file_admission(ingest.accepted(numbered(spark, sf)))


@query
def c03_snapshot_outcome(spark, sf):
    return ingest.snapshot_outcome(canon(spark, sf), 1)


@query
def c04_forward_holes(spark, sf):
    return canon(spark, sf).filter("forward_hole").groupBy("trade_date", "channel_id").agg(F.count(F.lit(1)).alias("holes"))


@query
def c05_ingest_stats(spark, sf):
    return ingest.ingest_stats(canon(spark, sf))


@query
def c06_date_report(spark, sf):
    return ingest.date_report(canon(spark, sf))


@query
def c06_instrument_report(spark, sf):
    return ingest.instrument_report(canon(spark, sf))


@query
def c06_file_report(spark, sf):
    return ingest.file_report(canon(spark, sf)).drop("first_ordinal")


@query
def c07_file_boundaries(spark, sf):
    return ingest.file_boundaries(ingest.file_report(canon(spark, sf)))


@query
def c08_seq_regressions(spark, sf):
    rows = ingest.accepted(numbered(spark, sf)).withColumn("trade_date", cal.trade_date(c("ts_ns")))
    return audit.seq_regressions(rows)


@query
def c09_gap_epoch(spark, sf):
    return orders.with_scalars(ev(spark, sf)).select("instrument_id", "ordinal", "epoch", "clear_no", "now_before")


@query
def c10_last_gap(spark, sf):
    return asof.cuts(ev(spark, sf), at()).select(*KEY, "epoch", "gap_expected", "gap_observed", "gap_pending", "last_seq")


@query
def c11_coverage(spark, sf):
    """Applied: what reached the order log, the profile or the session's control rows."""
    e = ev(spark, sf)
    at_ = [*KEY, "ordinal"]
    control = e.filter(c("kind").isin("Clear", "Status", "Gap")).select(*at_)
    used = log_of(spark, sf).select(*at_).unionByName(profile.trades(e, TICK).select(*at_)).unionByName(control)
    return audit.coverage(e, used.distinct())


@query
def c11_quarantine_coverage(spark, sf):
    raw = feed.raw_rows(spark, sf)
    m = ingest.map_rows(raw)
    return m.groupBy("source_file").agg(F.count(F.lit(1)).alias("events_read"), F.count_if(c("reject").isNull()).alias("events_applied"),
                                        F.count("reject").alias("quarantined"))


@query
def c12_watermarks(spark, sf):
    e = ev(spark, sf)
    logged = e.join(log_of(spark, sf).select(*KEY, "ordinal"), [*KEY, "ordinal"], "left_semi")
    profiled = e.join(profile.trades(e, TICK).select(*KEY, "ordinal"), [*KEY, "ordinal"], "left_semi")
    return audit.watermarks({"received": e, "logged": logged, "profiled": profiled, "published": asof.upto(e, cut_of(e))})


@query
def c13_book_counters(spark, sf):
    e = ev(spark, sf)
    return audit.book_counters(log_of(spark, sf), asof.cuts(e))


@query
def c13_profile_counters(spark, sf):
    return profile.session_counters(ev(spark, sf)).select(*KEY, "post_close_events", "backward_events", "zero_size_trades")


@query
def c14_book_structure(spark, sf):
    live = live_of(spark, sf)
    bad = audit.book_structure(live, book.queue(live), book.depth(live)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("problems"))
    n = live.groupBy(*KEY).agg(F.count(F.lit(1)).alias("live_orders"), F.sum("size").alias("total_size"))
    return n.join(bad, KEY, "left").fillna(0, ["problems"])


# ---- D: market profile ----------------------------------------------------

@query
def d01_volume_at_price(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", "volume")


@query
def d02_spectrum(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", "buy_volume", "sell_volume")


@query
def d03_tpo_bitsets(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", "eth_bits", "rth_bits")


@query
def d04_single_prints(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", "tpo_count", "single_print")


@query
def d05_period_volume(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", "period_volume")


@query
def d06_period_matrix(spark, sf):
    return profile.period_matrix(tr_of(spark, sf))


@query
def d07_period_gap(spark, sf):
    return profile.session_counters(ev(spark, sf)).select(*KEY, "current_period", "period_gap")


@query
def d08_vpoc(spark, sf):
    return profile.vpoc(rows_of(spark, sf))


@query
def d09_value_area(spark, sf):
    return profile.value_area(rows_of(spark, sf))


@query
def d10_initial_balance(spark, sf):
    return profile.session_stats(rows_of(spark, sf)).select(*KEY, "ib_low", "ib_high")


@query
def d11_range_open_total(spark, sf):
    return profile.session_stats(rows_of(spark, sf)).select(*KEY, "low", "high", "open", "total_volume")


@query
def d12_session_delta(spark, sf):
    return profile.session_stats(rows_of(spark, sf)).select(*KEY, "delta")


@query
def d13_cvd_path(spark, sf):
    return profile.cvd_path(tr_of(spark, sf))


@query
def d14_cvd_range(spark, sf):
    return profile.cvd_range(profile.cvd_path(tr_of(spark, sf)))


@query
def d15_cvd_candles(spark, sf):
    return profile.cvd_candles(profile.cvd_path(tr_of(spark, sf))).select(*KEY, "period", "open", "high", "low", "close")


@query
def d16_candle_direction(spark, sf):
    return profile.cvd_candles(profile.cvd_path(tr_of(spark, sf))).select(*KEY, "period", "is_up", "period_delta")


@query
def d17_touch_counters(spark, sf):
    return profile.trade_touch(ev(spark, sf), tr_of(spark, sf))


@query
def d17_touch_path(spark, sf):
    return profile.touch_islands(tr_of(spark, sf))


@query
def d18_dense_rows(spark, sf):
    return profile.dense_rows(rows_of(spark, sf))


@query
def d19_period_letter(spark, sf):
    return profile.with_period(ev(spark, sf)).select("instrument_id", "ordinal", letters.period_letter(c("dev_period")).alias("letter"))


@query
def d20_bitset_letters(spark, sf):
    return rows_of(spark, sf).select(*KEY, "tick", letters.tpo_letters(c("eth_bits"), 2).alias("letters"))


@query
def d21_display_cells(spark, sf):
    cells = letters.display_cells(c("eth_bits"), c("rth_bits"))
    return rows_of(spark, sf).select(*KEY, "tick", F.explode(cells).alias("x")).select(*KEY, "tick", "x.col", "x.letter", "x.kind")


@query
def d22_letter_strings(spark, sf):
    cells = letters.display_cells(c("eth_bits"), c("rth_bits"))
    return rows_of(spark, sf).withColumn("cells", cells).select(
        *KEY, "tick", letters.collapsed(c("cells"), "ETH").alias("cp_eth"), letters.collapsed(c("cells"), "RTH").alias("cp_rth"),
        letters.expanded(c("cells"), "ETH").alias("ep_eth"), letters.expanded(c("cells"), "RTH").alias("ep_rth"))


@query
def d23_sessions(spark, sf):
    s = profile.session_stats(rows_of(spark, sf))
    newest = F.max("trade_date").over(Window.partitionBy("instrument_id"))
    return s.select(*KEY, "total_volume", (c("trade_date") == newest).alias("is_current"))


def _decisions(spark, sf):
    offers = _offers(spark, sf).withColumns({
        "symbol": F.concat(F.lit("FUT"), c("instrument_id").cast("string"), F.when(c("source") == "explicit", "X").otherwise("")),
        "tick_size": F.when(F.day("trade_date") == 9, 1).otherwise(TICK), "offer": c("path")})
    cur = _current(spark, sf).withColumns({"symbol": F.concat(F.lit("FUT"), c("instrument_id").cast("string")), "tick_size": F.lit(TICK)})
    return priors.accept(offers, cur)


@query
def d24_prior_acceptance(spark, sf):
    return _decisions(spark, sf).select("instrument_id", "trade_date", "source", "reject")


@query
def d25_merged_sessions(spark, sf):
    rows = rows_of(spark, sf).select(*KEY, "tick", "volume")
    cur = _current(spark, sf)
    now = rows.join(cur, KEY, "left_semi")
    return priors.merge_sessions(now, rows.join(cur, KEY, "left_anti"), _decisions(spark, sf))


def _summary(events: DataFrame) -> DataFrame:
    s = profile.session_summary(events, TICK)
    bars = F.array_join(F.transform("candles", lambda x: F.concat_ws(":", x["period"], x["open"], x["high"], x["low"], x["close"])), " ")
    return s.select(*KEY, "open", "vpoc", "val", "vah", "ib_low", "ib_high", "current_period", "period_gap", "delta",
                    "cvd_low", "cvd_high", "is_current", bars.alias("candles"))


@query
def d26_session_summary(spark, sf):
    return _summary(ev(spark, sf))


def raw_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows taken all the way: numbered, mapped, gaps observed and fanned out, snapshots admitted; stored."""
    return stored(spark, sf, "raw_sessions", lambda: ingest.session_events(canon(spark, sf)))


@query
def p01_raw_to_summary(spark, sf):
    return _summary(raw_sessions(spark, sf))


@query
def p02_raw_to_order_log(spark, sf):
    log = orders.order_log(raw_sessions(spark, sf), TICK)
    return log.groupBy(*KEY, "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opened"), F.sum("added").alias("added"), F.sum("cancelled").alias("cancelled"),
        F.sum("traded").alias("traded"), F.count_if("unknown_ref").alias("unknown_ref"), F.count("violation").alias("violations"))


NULLED = ["channel_id", "flags", "ts_event", "side", "action", "sequence", "price", "order_id", "instrument_id", "size"]


def raw_exports(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows as a user has them: a folder per day of files in time order, some rows with a null; read by ``mbo.read_raw``."""
    raw = feed.raw_rows(spark, sf)
    bad = F.when(c("row_index") % 509 == 0, F.call_function("div", c("row_index"), F.lit(509)) % len(NULLED))
    raw = raw.withColumns({x: F.when(bad == i, F.lit(None)).otherwise(c(x)) for i, x in enumerate(NULLED)})
    path = work_dir(spark, "raw_exports")
    raw.repartitionByRange("source_file", "row_index").sortWithinPartitions("source_file", "row_index").drop("file_rank", "row_index").write.partitionBy("source_file").parquet(path)
    return mbo.read_raw(spark, [path])


@query
def p03_raw_file_outcome(spark, sf):
    """Files with nulls taken to sessions: every row read is in one, or is reported."""
    raw = mbo.with_ordinal(raw_exports(spark, sf))
    rows = ingest.canonicalise(ingest.accepted(raw))
    return audit.raw_outcome(feed.raw_rows(spark, sf), ingest.map_rows(raw), rows, ingest.session_events(rows))


# ---- E: order book --------------------------------------------------------

EFFECT = ["instrument_id", "trade_date", "order_id", "ordinal"]
STATE = ["opens", "side", "tick", "size", "prio_origin", "prio_ord", "to_ord"]


def _kind(spark, sf, kind: str, *cols: str) -> DataFrame:
    return log_of(spark, sf).filter(c("kind") == kind).select(*EFFECT, *cols)


@query
def e01_adds(spark, sf):
    return _kind(spark, sf, "Add", "added", "desync_add", "violation", *STATE)


@query
def e02_placements(spark, sf):
    out = log_of(spark, sf).filter(c("opens") & (c("prio_ord") == c("ordinal")) & (c("prio_origin") == 1))
    return out.select(*EFFECT, "side", "tick", "size", "added", "order_epoch")


@query
def e03_cancels(spark, sf):
    return _kind(spark, sf, "Cancel", "old_side", "old_tick", "cancelled", "desync_cancel", "violation", *STATE)


@query
def e04_unknown_refs(spark, sf):
    return log_of(spark, sf).filter("unknown_ref").select(*EFFECT, "kind")


@query
def e05_removals(spark, sf):
    out = log_of(spark, sf).filter(~c("opens") & (c("cancelled") > 0))
    return out.select(*EFFECT, "kind", "old_side", "old_tick", "cancelled")


@query
def e06_modifies(spark, sf):
    return _kind(spark, sf, "Modify", "old_side", "old_tick", "cancelled", "added", "desync_modify", "violation", *STATE)


@query
def e07_depleted_modifies(spark, sf):
    out = log_of(spark, sf).filter("replaces_depleted")
    return out.select(*EFFECT, "side", "tick", "size", "reloads", "hidden")


@query
def e08_fills(spark, sf):
    return orders.fills(log_of(spark, sf)).select(*EFFECT, "side", "tick", "size", "aggressor", "unknown_ref")


@query
def e09_off_display(spark, sf):
    return orders.fills(log_of(spark, sf)).groupBy(*KEY).agg(F.count_if("off_display").alias("off_display"), F.count(F.lit(1)).alias("fills"))


@query
def e10_book_events(spark, sf):
    return log_of(spark, sf).groupBy(*KEY, "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def e11_clear_numbers(spark, sf):
    return log_of(spark, sf).groupBy(*KEY, "clear_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opened"), F.count_if("unknown_ref").alias("unknown"))


@query
def e12_snapshot_orders(spark, sf):
    return _kind(spark, sf, "Snapshot", "unavailable", "violation", *STATE)


@query
def e13_gap_epochs(spark, sf):
    return log_of(spark, sf).filter("opens").select(*EFFECT, "order_epoch", (c("epoch") - c("order_epoch")).alias("gaps_survived"))


@query
def e14_desync(spark, sf):
    log = log_of(spark, sf)
    return log.groupBy(*KEY).agg(*[F.count_if(c(f"desync_{k}")).alias(f"desync_{k}") for k in ("add", "cancel", "modify", "fill")])


@query
def e15_depth(spark, sf):
    return book.depth(live_of(spark, sf))


@query
def e16_best_first(spark, sf):
    return book.best_first(book.depth(live_of(spark, sf)))


@query
def e17_bbo(spark, sf):
    return book.bbo(book.depth(live_of(spark, sf))).drop("overlap")


@query
def e17_bbo_changes(spark, sf):
    """Best prices after every change, not at steps."""
    return book.bbo_changes(orders.order_intervals(log_of(spark, sf)), ev(spark, sf))


@query
def e17_bbo_series(spark, sf):
    e = ev(spark, sf)
    return book.bbo_series(orders.order_intervals(log_of(spark, sf)), asof.snapshot_cuts(e))


@query
def e18_overlap(spark, sf):
    return book.bbo(book.depth(live_of(spark, sf))).select(*KEY, "overlap")


@query
def e19_last_print(spark, sf):
    return book.last_print(orders.fills(log_of(spark, sf)))


@query
def e20_inside_traded(spark, sf):
    return book.inside_traded(orders.fills(log_of(spark, sf)))


@query
def e21_fifo(spark, sf):
    return book.queue(live_of(spark, sf)).select(*KEY, "side", "tick", "order_id", "size", "queue_rank")


@query
def e22_queue_position(spark, sf):
    return book.queue(live_of(spark, sf)).select(*KEY, "order_id", "orders_ahead", "contracts_ahead", "queue_rank")


@query
def e23_flow_series(spark, sf):
    return book.flow_series(orders.flow_deltas(log_of(spark, sf)))


@query
def e23_flow_window(spark, sf):
    e = ev(spark, sf)
    return book.flow_at(e, orders.flow_deltas(log_of(spark, sf)), cut_of(e))


@query
def e24_depletions(spark, sf):
    return log_of(spark, sf).filter("depletes").select(*EFFECT, "ts_ns", "epoch")


@query
def e25_refreshes(spark, sf):
    return orders.refreshes(log_of(spark, sf)).select(*EFFECT, "side", "tick", "hidden_size", "reloads")


@query
def e26_narrow_window(spark, sf):
    log = orders.order_log(ev(spark, sf), TICK, window_ns=1500)
    return orders.refreshes(log).select(*EFFECT, "hidden_size")


@query
def e27_refresh_state(spark, sf):
    return live_of(spark, sf).select(*KEY, "order_id", "refresh_state", "native", "reloads", "hidden")


@query
def e28_refresh_totals(spark, sf):
    return book.refresh_totals(orders.refreshes(log_of(spark, sf)))


@query
def e29_book_counts(spark, sf):
    e = ev(spark, sf)
    cut = cut_of(e)
    return book.book_counts(asof.live_orders(orders.order_intervals(log_of(spark, sf)), cut), cut)


@query
def e30_iceberg_census(spark, sf):
    e = ev(spark, sf)
    log = log_of(spark, sf)
    live = asof.live_orders(orders.order_intervals(log), asof.cuts(e))
    return book.census(log, orders.refreshes(log), live)


# ---- F: as-of, ladder, profile views --------------------------------------

LIVE = [*KEY, "order_id", "side", "tick", "size", "from_ord"]


@query
def f01_state_at(spark, sf):
    return live_of(spark, sf).select(*LIVE)


def block_stats_of(spark: SparkSession, sf: str) -> DataFrame:
    """The stored block statistics of the event table."""
    return stored(spark, sf, "block_stats", lambda: asof.block_stats(ev(spark, sf)))


def many_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 times per session, 82.8 s apart from its open."""
    stats = block_stats_of(spark, sf)
    sessions = stats.select(*KEY).distinct().withColumn("_open", cal.session_clock(c("trade_date"))["session_open_ns"])
    points = sessions.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("i"), "_open").select(
        *KEY, (c("_open") + c("i") * 82_800_000_000).alias("at_ns"))
    return asof.cuts_at(ev(spark, sf), points, stats)


@query
def f01_many_cuts(spark, sf):
    return many_cuts(spark, sf)


@query
def f01_many_states(spark, sf):
    """What rests at each of 1,000 times per session."""
    live = asof.orders_at(orders.order_intervals(log_of(spark, sf)), many_cuts(spark, sf))
    return live.groupBy(*KEY, "at_ns").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("size").alias("total_size"), F.max(F.when(c("side") == "B", c("tick"))).alias("best_bid"),
        F.min(F.when(c("side") == "A", c("tick"))).alias("best_ask"), F.count_if(c("refresh_state") == "Unavailable").alias("unavailable"))


@query
def f02_state_snapshots(spark, sf):
    e = ev(spark, sf)
    snaps = asof.state_snapshots(orders.order_intervals(log_of(spark, sf)), asof.snapshot_cuts(e, 600_000_000_000), 600_000_000_000)
    return snaps.select(*KEY, "bucket", "cut_ord", "order_id", "side", "tick", "size")


@query
def f03_nearest_snapshot(spark, sf):
    e = ev(spark, sf)
    return asof.nearest_snapshot(asof.snapshot_cuts(e), asof.cuts(e, at()))


@query
def f03_state_from_snapshot(spark, sf):
    e = ev(spark, sf)
    step = 600_000_000_000
    iv = orders.order_intervals(log_of(spark, sf))
    points = asof.snapshot_cuts(e, step)
    return asof.live_from_snapshot(asof.state_snapshots(iv, points, step), iv, points, cut_of(e)).select(*LIVE)


def _ladder(spark, sf):
    e = ev(spark, sf)
    log = log_of(spark, sf)
    cut = cut_of(e)
    ins = views.inside(e, log, cut)
    return views.ladder(views.ladder_measures(e, log, TICK, cut), ins, 40), ins


@query
def f04_ladder(spark, sf):
    return _ladder(spark, sf)[0]


@query
def f05_rescaled_ladder(spark, sf):
    return views.rescale(_ladder(spark, sf)[0], 4)


@query
def f06_profile_view(spark, sf):
    return views.profile_view(rows_of(spark, sf), 2, 24)


@query
def f07_centered_window(spark, sf):
    lad, ins = _ladder(spark, sf)
    s = views.rescale(lad, 2)
    target = views.follow_price(ins, s, 2).withColumnRenamed("follow_x2", "target_x2")
    center = views.row_lookup(s, target).select(*KEY, c("ceiling").alias("center"))
    return views.centered_window(s, center, 9).select(*KEY, "tick", "bid_size", "ask_size", "session_volume")


@query
def f07_anchored_window(spark, sf):
    lad, ins = _ladder(spark, sf)
    anchor = ins.select(*KEY, F.lit(20030).cast("long").alias("anchor"))
    out = views.anchored_window(views.rescale(lad, 2), anchor, 21, 2)
    return out.select(*KEY, "tick", "source_present", "bid_size", "ask_size", "session_volume")


@query
def f08_row_lookup(spark, sf):
    lad, ins = _ladder(spark, sf)
    target = ins.select(*KEY, F.coalesce(c("last_tick"), F.lit(0)).alias("t")).select(*KEY, (c("t") * 2 + 1).alias("target_x2"))
    return views.row_lookup(views.rescale(lad, 2), target)


@query
def f09_follow_price(spark, sf):
    lad, ins = _ladder(spark, sf)
    return views.follow_price(ins, views.rescale(lad, 2), 2)


@query
def f10_inside_market(spark, sf):
    lad, ins = _ladder(spark, sf)
    return views.inside_flag(lad, ins).select(*KEY, "tick", "is_inside")


@query
def f11_normalised(spark, sf):
    return views.normalised(_ladder(spark, sf)[0]).select(*KEY, "tick", "bid_share", "ask_share", "volume_share")


@query
def f12_badges(spark, sf):
    return views.badges(_ladder(spark, sf)[0]).select(*KEY, "tick", "bid_badge", "ask_badge")


@query
def f13_volume_agreement(spark, sf):
    e = ev(spark, sf)
    traded = profile.trades(e, TICK).groupBy(*KEY, "tick").agg(F.sum("size").alias("trade_volume"))
    filled = orders.fills(log_of(spark, sf)).groupBy(*KEY, "tick").agg(F.sum("size").alias("fill_volume"))
    return audit.volume_agreement(traded, filled)


@query
def f13_pane_agreement(spark, sf):
    """The ladder's trade volume against the executions of the order log, both up to the cut."""
    cut = cut_of(ev(spark, sf)).select(*KEY, "cut_ord")
    pane = _ladder(spark, sf)[0].select(*KEY, "tick", c("session_volume").alias("trade_volume"))
    done = orders.fills(log_of(spark, sf)).join(cut, KEY).filter(c("ordinal") <= c("cut_ord"))
    return audit.volume_agreement(pane, done.groupBy(*KEY, "tick").agg(F.sum("size").alias("fill_volume")))


@query
def f14_ladder_breaks(spark, sf):
    lad, _ = _ladder(spark, sf)
    bad = audit.ladder_breaks(lad).groupBy(*KEY).agg(F.count(F.lit(1)).alias("breaks"))
    return lad.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")).join(bad, KEY, "left").fillna(0, ["breaks"])


@query
def f15_open_marker(spark, sf):
    return views.open_marker(profile.session_stats(rows_of(spark, sf)), 4)


# ---- H: streaming ---------------------------------------------------------

def _latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Final value per key of an update-mode change log (sums only grow)."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value))


def _drain_updates(spark, rows: DataFrame) -> DataFrame:
    """Run an aggregating stream in update mode; each micro-batch's changed rows
    are written under its batch id."""
    out = work_dir(spark, "updates")
    q = (rows.writeStream.outputMode("update").option("checkpointLocation", work_dir(spark, "ckpt")).trigger(availableNow=True)
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())
    q.awaitTermination()
    return spark.read.schema(rows.schema).option("basePath", out).parquet(f"{out}/batch=*")


@query
def h01_stream_equals_batch(spark, sf):
    """The batch mapping applied to a stream: grid, clock and half-hour columns."""
    s = cal.with_clock(_stream(spark, sf).filter(~c("is_snapshot")), "session_open_ns", "eth_end_ns")
    s = orders.with_ticks(s, TICK).select("instrument_id", "ordinal", "kind", "tick", cal.eth_period(
        c("ts_ns"), c("session_open_ns"), c("eth_end_ns")).alias("eth_period"))
    return _drain(spark, s)


def _arrivals(spark, sf, parts: int, start) -> None:
    """The event table arriving in ``parts`` runs of its arrival order; ``start`` gives
    the stream to run on what has come so far, after each of them."""
    e, src = ev(spark, sf), work_dir(spark, "arrivals")
    top = e.agg(F.max("ordinal")).first()[0] + 1
    for i in range(parts):
        run = e.filter((c("ordinal") >= i * top // parts) & (c("ordinal") < (i + 1) * top // parts))
        run.select(*EVENT_SCHEMA.names).write.mode("append").parquet(src)
        start(spark.readStream.schema(EVENT_SCHEMA).parquet(src))


def _scaled(spark, sf, parts: int) -> str:
    """First stage over ``parts`` micro-batches; the folder of its rows."""
    scaled, carry, ckpt = work_dir(spark, "scaled"), work_dir(spark, "carry"), work_dir(spark, "ckpt")
    stage = streaming.ScalarStage(scaled, carry)
    _arrivals(spark, sf, parts, lambda s: s.writeStream.foreachBatch(stage).trigger(availableNow=True)
              .option("checkpointLocation", ckpt).start().awaitTermination())
    return scaled


@query
def h02_late_rows(spark, sf):
    """Late rows counted by the stream over several micro-batches."""
    s = spark.readStream.schema(streaming.SCALED_SCHEMA).option("maxFilesPerTrigger", 8).parquet(f"{_scaled(spark, sf, 3)}/*")
    return _latest(_drain_updates(spark, streaming.late_rows(s)), KEY, "late_rows")


@query
def h03_half_hour_volume(spark, sf):
    rows = _drain_updates(spark, streaming.half_hour_volume(_stream(spark, sf), "365 days"))
    return _latest(rows, ["instrument_id", "start_us"], "volume")


@query
def h04_sliding_flow(spark, sf):
    rows = _drain_updates(spark, streaming.traded_flow(_stream(spark, sf), "365 days"))
    return _latest(rows, ["instrument_id", "price", "end_us"], "traded")


@query
def h05_session_volume(spark, sf):
    rows = _drain_updates(spark, streaming.session_volume(_stream(spark, sf)))
    return _latest(rows, [*KEY, "price"], "volume")


@query
def h06_stateful_orders(spark, sf):
    """Five micro-batches of the first stage, then as many of the second, with late rows and snapshot blocks among them."""
    parts = 5
    scaled, out, ckpt = _scaled(spark, sf, parts), work_dir(spark, "effects"), work_dir(spark, "ckpt")
    for i in range(parts):
        # one more batch of the first stage becomes visible at each start
        s = spark.readStream.schema(streaming.SCALED_SCHEMA).parquet(f"{scaled}/batch={{{','.join(str(k) for k in range(i + 1))}}}")
        streaming.append_rows(streaming.order_effects(s, TICK), out, ckpt).awaitTermination()
    fx = spark.read.parquet(out)
    return fx.select("instrument_id", "order_id", "ordinal", "cancelled", "added", "traded", "refreshed", "flags", "opens", "size", "closes_ord")


@query
def h07_profile_publication(spark, sf):
    """Four micro-batches, each published from its own rows and the sessions' partials."""
    out, ckpt = work_dir(spark, "profile"), work_dir(spark, "ckpt")
    publish = streaming.publish_profiles(work_dir(spark, "partials"), out, TICK)
    _arrivals(spark, sf, 4, lambda s: s.writeStream.foreachBatch(publish).trigger(availableNow=True)
              .option("checkpointLocation", ckpt).start().awaitTermination())
    return spark.read.parquet(out).select(c("instrument_id").cast("long"), c("trade_date").cast("date"), "tick", "volume", "eth_bits", "period_volume")


@query
def h08_restarted_append(spark, sf):
    """The append sink started anew after every arrival, and twice after the last: nothing is lost or written again."""
    path, ckpt = work_dir(spark, "live"), work_dir(spark, "ckpt")
    last: list = []

    def start(s):
        last[:] = [s]
        streaming.append_events(s, path, ckpt).awaitTermination()

    _arrivals(spark, sf, 3, start)
    start(last[0])
    return mbo.read_events(spark, path).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("distinct_ord"), F.max("ordinal").alias("frontier"))


@query
def h10_chunked_replay(spark, sf):
    """The same volumes as one pass, taken over several micro-batches."""
    rows = _drain_updates(spark, streaming.session_volume(_stream(spark, sf, 40)))
    return _latest(rows, [*KEY, "price"], "volume")


@query
def h09_head_lag(spark, sf):
    e = ev(spark, sf)
    clock = F.lit(1706745600000000)  # 2024-02-01 00:00 UTC, a fixed clock so that the lag is a value
    return streaming.head_lag(e, clock)
