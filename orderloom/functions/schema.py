"""Fixed schemas and codes of the event model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

KEY = ["instrument_id", "trade_date"]

# Fixed values of the event model.
KINDS = ["Add", "Cancel", "Modify", "Trade", "Fill", "Clear", "Status", "Gap"]
ACTION_TO_KIND = {"A": "Add", "C": "Cancel", "M": "Modify", "T": "Trade", "F": "Fill", "R": "Clear"}
SIDES = ["B", "A", "N"]
SNAPSHOT_FLAG = 32
UNDEF_PRICE = 9223372036854775807
UNDEF_SIZE = 4294967295
PERIOD_NS = 1_800_000_000_000
ETH_PERIODS = 46
RTH_PERIODS = 13
FLOW_BUCKET_NS = 500_000_000
FLOW_BUCKETS = 10
REFRESH_WINDOW_NS = 1_000_000
SNAPSHOT_CADENCE_NS = 60_000_000_000
VALUE_AREA_PERCENT = 70
MAX_LONG = 9223372036854775807

RAW_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("file_rank", T.IntegerType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("ts_event", T.LongType()),
    T.StructField("ts_recv", T.LongType()),
    T.StructField("ts_in_delta", T.LongType()),
    T.StructField("instrument_id", T.LongType()),
    T.StructField("channel_id", T.IntegerType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("flags", T.IntegerType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("instrument_id", T.LongType()),
    T.StructField("channel_id", T.IntegerType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("is_snapshot", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("price", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("gap_expected", T.LongType()),
    T.StructField("gap_observed", T.LongType()),
    T.StructField("trade_date", T.DateType()),
])

INSTRUMENT_SCHEMA = T.StructType([
    T.StructField("instrument_id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("tick_size", T.LongType()),
    T.StructField("uom_qty", T.LongType()),
    T.StructField("display_factor", T.LongType()),
])


def tick_of(price: Column, tick_size: Column) -> Column:
    """Price on the instrument's grid as a tick number; null when off the grid."""
    return F.when(F.pmod(price, tick_size) == 0, F.call_function("div", price, tick_size))


def tick_value(tick_size: Column, uom_qty: Column) -> Column:
    """Money value of one tick in 1e-9 units; the product needs more than 64 bits."""
    wide = tick_size.cast("decimal(19,0)") * uom_qty.cast("decimal(19,0)")
    return F.call_function("div", wide, F.lit(1_000_000_000).cast("decimal(10,0)"))


def opposite(side: Column) -> Column:
    return F.when(side == "B", "A").when(side == "A", "B").otherwise("N")
