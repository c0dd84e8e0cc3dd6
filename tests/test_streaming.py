import random

import pytest
from pyspark.sql import functions as F

from feed import A, C, Fi, TICK, T, frame
from orderloom.functions.schema import EVENT_SCHEMA
from orderloom.operators import fold, orders, profile
from orderloom.streaming import live
from test_orders import random_stream

FX = ["instrument_id", "order_id", "ordinal", "cancelled", "added", "traded", "size"]


def chunks(ev, path, edges):
    """Write the events as one file per ordinal range, in order."""
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = ev.filter((F.col("ordinal") >= a) & (F.col("ordinal") < b)).coalesce(1)
        part.write.mode("append").parquet(f"{path}/part={i:03d}")


def stream(spark, path, per_trigger=1):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}/*")


def test_chunked_orders_equal_one_batch(spark, tmp_path):
    rng = random.Random(3)
    ev = frame(spark, [random_stream(rng, 120)[0] for _ in range(5)])
    src, scaled, carry, out = (str(tmp_path / n) for n in ("src", "scaled", "carry", "out"))
    chunks(ev, src, [0, 17, 60, 61, 120])
    q = (stream(spark, src).writeStream.foreachBatch(live.ScalarStage(scaled, carry)).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "c1")).start())
    q.awaitTermination()
    s = spark.readStream.schema(live.SCALED_SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{scaled}/*")
    fx = live.order_effects(s, TICK)
    live.append_rows(fx, out, str(tmp_path / "c2")).awaitTermination()
    got = spark.read.schema(fx.schema).parquet(out)
    want = orders.order_log(ev, TICK)
    a, b = ({tuple(r) for r in x.select(*FX, "opens").collect()} for x in (got.withColumn("opens", F.col("opens") == 1), want))
    assert a == b
    closed = {(r.instrument_id, r.order_id, r.closes_ord, r.ordinal) for r in got.filter("closes_ord >= 0").collect()}
    ends = {(r.instrument_id, r.order_id, r.from_ord, r.to_ord) for r in orders.order_intervals(want).filter(f"to_ord < {2**62}").collect()}
    assert closed == ends


def test_append_is_exactly_once_over_restarts(spark, tmp_path):
    ev = frame(spark, [[T(100 + i % 3, 1) for i in range(40)]])
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    chunks(ev, src, [0, 10, 20])
    live.append_events(stream(spark, src), out, ck).awaitTermination()
    live.append_events(stream(spark, src), out, ck).awaitTermination()  # restart with nothing new
    ev.filter("ordinal >= 20").write.parquet(f"{src}/part=900")
    live.append_events(stream(spark, src), out, ck).awaitTermination()
    got = [r.ordinal for r in spark.read.schema(EVENT_SCHEMA).parquet(out).orderBy("ordinal").collect()]
    assert got == list(range(40))


def test_published_profile_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    ev = frame(spark, [[T(rng.randint(95, 105), rng.randint(0, 4), rng.choice("BAN"), dt_ns=10**12) for _ in range(60)] for _ in range(3)])
    src, table, out = str(tmp_path / "src"), str(tmp_path / "table"), str(tmp_path / "out")
    chunks(ev, src, [0, 25, 26, 60])
    q = (stream(spark, src).writeStream.foreachBatch(live.publish_profiles(table, out, TICK)).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    cols = ["instrument_id", "tick", "volume", "period_volume", "eth_bits", "delta"]
    got = {tuple(r) for r in spark.read.parquet(out).select(*cols).collect()}
    want = {tuple(r) for r in profile.profile_rows(profile.trades(ev, TICK)).select(*cols).collect()}
    assert got == want


PROFILE = ["instrument_id", "tick", "volume", "buy_volume", "sell_volume", "period_volume", "eth_bits", "rth_bits", "first_ord", "last_ord",
           "delta", "in_ib", "tpo_count", "single_print"]


def test_published_profile_carries_the_half_hour_and_survives_retries(spark, tmp_path):
    rng = random.Random(11)
    # steps of up to ten minutes, forwards and backwards, so that half-hours of earlier batches are met again
    ev = frame(spark, [[T(rng.randint(95, 99), rng.randint(0, 4), rng.choice("BAN"), dt_ns=rng.randint(-4, 6) * 10**11) for _ in range(120)]
                       for _ in range(3)])
    publish = live.publish_profiles(str(tmp_path / "state"), str(tmp_path / "out"), TICK)
    edges = [0, 40, 41, 41, 90, 120]  # one batch is empty
    want = lambda upto: {tuple(r) for r in profile.profile_rows(profile.trades(ev.filter(F.col("ordinal") < upto), TICK)).select(*PROFILE).collect()}
    got = lambda: {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*PROFILE).collect()}
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = ev.filter((F.col("ordinal") >= a) & (F.col("ordinal") < b))
        publish(part, i)
        if i in (0, 3):  # the batch failed before it was committed
            publish(part, i)
        assert got() == want(b) and got()


def test_a_refused_batch_is_not_published(spark, tmp_path):
    ev = frame(spark, [[A(i + 1, 9) for i in range(20)]])
    stage = live.ScalarStage(str(tmp_path / "rows"), str(tmp_path / "carry"))
    stage(ev.filter("ordinal < 10"), 0)
    with pytest.raises(Exception, match="goes back in the arrival order"):
        stage(ev.filter("ordinal >= 5"), 1)
    assert not (tmp_path / "rows" / "batch=1").exists()
    stage(ev.filter("ordinal >= 10"), 1)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 20


def test_window_streams_match_batch(spark, tmp_path):
    ev = frame(spark, [[A(1, 9), Fi(1, 2, dt_ns=100_000_000), Fi(1, 3, dt_ns=700_000_000), T(100, 4, dt_ns=2 * 10**12), C(1, 9)]])
    src = str(tmp_path / "src")
    chunks(ev, src, [0, 2, 5])
    for name, make, keys, value in (("half", live.half_hour_volume, ["instrument_id", "start_us"], "volume"),
                                    ("flow", live.traded_flow, ["instrument_id", "price", "end_us"], "traded")):
        out = str(tmp_path / name)
        q = (make(stream(spark, src), "1 day").writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / f"{name}-ck"))
             .foreachBatch(lambda b, i, out=out: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())
        q.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{out}/batch=*").groupBy(*keys).agg(F.max(value)).collect()}
        want = {tuple(r) for r in make(ev, "1 day").collect()}
        assert got == want and got
    lag = live.head_lag(ev, F.lit(0)).first()
    assert lag.lag_ns == -lag.head_ns


def test_state_is_kept_per_group_of_orders(spark, tmp_path):
    """Python is called, and state kept, once per group of an instrument-day, not once per order."""
    ev = frame(spark, [[A(i + 1, 9) for i in range(300)]])
    live.ScalarStage(str(tmp_path / "rows"), str(tmp_path / "carry"))(ev, 0)
    s = spark.readStream.schema(live.SCALED_SCHEMA).parquet(f"{tmp_path}/rows/*")
    q = live.append_rows(live.order_effects(s, TICK), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("opens = 1").count() == 300
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= live.STATE_PARTS


def test_pending_refreshes_are_freed_and_resting_orders_kept():
    row = [{"order_id": o, "ordinal": n, "ts_ns": n, "code": code, "side_no": 1, "tick": 100, "size": 9, "epoch": 0, "clear_no": 0, "now_before": n - 1}
           for n, (o, code) in enumerate([(1, fold.ADD), (2, fold.ADD), (1, fold.FILL), (1, fold.CANCEL)])]
    import numpy as np
    import pandas as pd
    none = np.empty((0, len(live._STATE)), np.int64)
    rows, states = live._fold_part([pd.DataFrame(row[3:]), pd.DataFrame(row[:3])], none, (7, 19000), 50, 1000)
    assert [tuple(r[2:4]) for r in rows.tolist()] == [(1, 0), (2, 1), (1, 2), (1, 3)]
    assert {(r[0], r[1], r[-1]) for r in states.tolist()} == {(1, 0, 50), (2, 1, 50)}  # one pending, one resting
    again, later = live._fold_part([pd.DataFrame([{**row[0], "ordinal": 9, "ts_ns": 9, "now_before": 3}])], states, (7, 19000), 60, 1000)
    assert again[0, live._OUT.index("refreshed")] == 9
    assert {(r[0], r[1], r[-1]) for r in later.tolist()} == {(1, 1, 60), (2, 1, 50)}
