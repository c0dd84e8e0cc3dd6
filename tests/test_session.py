import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from feed import HALF_HOUR, OPEN, T, TICK, G, frame
from orderloom.functions import calendar as cal, letters
from orderloom.functions.schema import tick_value
from orderloom.operators import audit, ingest, priors, profile, views
from orderloom.operators.prefix import Scan, prefix_scan
from orderloom.sources import mbo

KEYS = ["instrument_id", "trade_date"]


def test_prefix_scan_equals_plain_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("ordinal"),
                                  F.pmod(F.hash("id"), F.lit(1000)).cast("long").alias("v")).withColumn(
        "v", F.when(F.col("v") % 5 != 0, F.col("v")))
    got = prefix_scan(df, ["k"], {"s": Scan("sum", F.col("v")), "m": Scan("max", F.col("v"), inclusive=True),
                                  "last": Scan("max", F.struct("ordinal", "v")), "lo": Scan("min", F.col("v"))}, block_bits=6)
    before = Window.partitionBy("k").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "ordinal", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
                     F.lag("v").over(Window.partitionBy("k").orderBy("ordinal")).alias("last"), F.min("v").over(before).alias("lo"))
    got = got.select("k", "ordinal", "s", "m", F.col("last.v").alias("last"), "lo")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_calendar_probes(spark):
    ns = 1_000_000_000
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * ns
    probes = [(utc(2026, 7, 28, 22) - 1, "2026-07-28"), (utc(2026, 7, 28, 22), "2026-07-29"), (utc(2026, 7, 26, 22), "2026-07-27"),
              (utc(2026, 1, 15, 23) - 1, "2026-01-15"), (utc(2026, 1, 15, 23), "2026-01-16")]
    df = spark.createDataFrame([(t,) for t, _ in probes], "t long")
    assert [str(r.d) for r in df.select(cal.trade_date(F.col("t")).alias("d")).collect()] == [d for _, d in probes]
    assert spark.range(1).select(cal.session_open_ns(F.lit("2026-07-29").cast("date")).alias("x")).first().x == OPEN
    days = spark.createDataFrame([("2026-07-29",), ("2026-03-08",), ("2026-11-01",)], "d string").select(F.col("d").cast("date").alias("trade_date"))
    got = {str(r.trade_date): (r.eth_periods, r.rth_periods, r.rth_offset, r.irregular) for r in cal.session_calendar(days).collect()}
    assert got == {"2026-07-29": (46, 13, 31, False), "2026-03-08": (44, 13, 29, True), "2026-11-01": (48, 13, 33, True)}


def p(i):
    """Start of half-hour ``i``."""
    return OPEN + i * HALF_HOUR


PROFILES = [
    [T(20000, 10), T(20001, 2), T(19999, 2), T(20002, 1), T(19998, 1)],
    [T(20000, 10), T(19999, 4), T(19998, 5), T(20001, 1)],
    [T(19990, 1), T(20000, 1, ts=p(31)), T(20005, 1, ts=p(32)), T(20010, 1, ts=p(33))],
    [T(20000, 7), T(20000, 3, ts=p(1))],
    [T(20000, 10, "B"), T(19999, 4, "A"), T(20000, 5, "B")],
    [T(20000, 10, "B"), T(20000, 3, "A"), T(20000, 1, "B", ts=p(2))],
    [T(20000, 5, "A"), T(20000, 3, "A"), T(19999, 2, "A"), T(20001, 4, "B"), T(20001, 1, "B"), G()],
    [T(20000, 7), T(20005, 0, ts=p(1))],
    [T(20000, 5), T(20000, 2, ts=p(46)), T(20001, 9, "B", ts=p(46))],
    [T(20000, 5, ts=p(3)), T(20001, 2, ts=p(1)), G(ts=p(3))],
    [T(20001, 5), T(20000, 3), T(20000, 2)],
]


def test_profile_table(spark):
    ev = frame(spark, PROFILES)
    tr = profile.trades(ev, TICK)
    rows = profile.profile_rows(tr).cache()
    fig = {r.instrument_id: r for r in profile.session_figures(rows).collect()}
    at = {(r.instrument_id, r.tick): r for r in rows.collect()}
    assert (fig[0].vpoc, fig[0].val, fig[0].vah, fig[0].total_volume) == (20000, 20000, 20002, 16)
    assert (fig[1].val, fig[1].vah) == (19998, 20000)
    assert (fig[2].ib_low, fig[2].ib_high, fig[2].low, fig[2].high, fig[2].open) == (20000, 20005, 19990, 20010, 19990)
    r = at[(3, 20000)]
    assert (r.period_volume, r.volume, r.eth_bits, r.tpo_count) == (3, 10, 3, 2)
    assert (at[(4, 20000)].buy_volume, at[(4, 19999)].sell_volume, fig[4].delta) == (15, 4, 11)
    bars = profile.cvd_candles(profile.cvd_path(tr)).filter("instrument_id = 5").orderBy("period").collect()
    assert [(b.open, b.high, b.low, b.close) for b in bars] == [(0, 10, 0, 7), (7, 7, 7, 7), (7, 8, 7, 8)]
    rng = profile.cvd_range(profile.cvd_path(tr)).filter("instrument_id = 5").first()
    assert (rng.cvd_low, rng.cvd_high) == (0, 10)
    touch = {r.counter: (r.tick, r.volume, r.gap_marked) for r in profile.trade_touch(ev, tr).filter("instrument_id = 6").collect()}
    assert touch == {"cB": (19999, 2, True), "cA": (20001, 5, True)}
    count = {r.instrument_id: r for r in profile.session_counters(ev).collect()}
    assert (count[7].zero_size_trades, count[7].current_period) == (1, 1) and (7, 20005) not in at and at[(7, 20000)].period_volume == 0
    post = at[(8, 20001)]
    assert (post.volume, post.eth_bits, post.buy_volume, fig[8].delta, count[8].post_close_events) == (9, 0, 9, 0, 2)
    assert (count[9].backward_events, count[9].period_gap, at[(9, 20001)].eth_bits) == (1, True, 8)
    assert fig[10].vpoc == 20001  # first to reach the maximum


def test_lettering(spark):
    one = spark.range(1)
    got = one.select(*[letters.period_letter(F.lit(i)).alias(f"c{i}") for i in (0, 25, 26, 51, 52)]).first()
    assert list(got) == ["A", "Z", "a", "z", "?"]
    bits = F.lit((1 << 0) | (1 << 2) | (1 << 30)).cast("long")
    assert list(one.select(letters.tpo_letters(bits, 5), letters.tpo_letters(bits, 2), letters.tpo_letters(F.lit(0).cast("long"), 3)).first()) == ["ACe", "AC…", ""]
    cells = letters.display_cells(F.lit((1 << 0) | (1 << 31) | (1 << 44)).cast("long"), F.lit(1).cast("long"))
    r = one.select(letters.collapsed(cells, "ETH").alias("e"), letters.collapsed(cells, "RTH").alias("r"), letters.expanded(cells, "RTH").alias("x")).first()
    assert (r.e, r.r, r.x) == ("A s", " A ", " " * 31 + "A" + " " * 14)


def test_tick_value_needs_wide_product(spark):
    r = spark.range(1).select(tick_value(F.lit(250_000_000).cast("long"), F.lit(50_000_000_000).cast("long")).alias("v")).first()
    assert r.v == 12_500_000_000


def raw(spark, rows):
    """rows: (file_rank, ts, instrument, channel, seq, action, flags)"""
    from orderloom.functions.schema import RAW_SCHEMA
    data = [(f"f{f}", f, i, ts, ts + 1, 1, inst, ch, seq, act, "N" if act == "R" else "B", 20000 * TICK, 1, i, fl)
            for i, (f, ts, inst, ch, seq, act, fl) in enumerate(rows)]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_sequence_rules(spark):
    seqs = [(0, 0), (0, 100), (0, 100), (0, 101), (0, 107), (0, 3), (1, 500), (0, 4)]
    rows = raw(spark, [(0, OPEN + i, 1, ch, s, "A", 0) for i, (ch, s) in enumerate(seqs)])
    c = ingest.canonicalise(ingest.accepted(mbo.with_ordinal(rows))).cache()
    gaps = c.filter("kind = 'Gap'").collect()
    assert [(g.gap_expected, g.gap_observed, g.channel_id, g.ordinal) for g in gaps] == [(108, 3, 0, 9)]
    assert c.filter("forward_hole").count() == 1
    assert ingest.fan_out_gaps(c).filter("kind = 'Gap'").select("instrument_id").first()[0] == 1


def test_snapshot_admission_and_stitching(spark):
    before, day = OPEN - 10, OPEN + 10
    rows = raw(spark, [(0, before - 99, 1, 0, 1, "A", 32), (0, before - 98, 1, 0, 2, "A", 32), (0, before, 1, 0, 100, "A", 0),
                       (1, before - 97, 1, 0, 1, "R", 40), (1, before - 96, 1, 0, 2, "A", 32), (1, before - 95, 1, 0, 3, "A", 32),
                       (1, day, 1, 0, 200, "A", 0)])
    c = ingest.canonicalise(ingest.accepted(mbo.with_ordinal(rows)))
    one = ingest.one_session(c, 1, "2026-07-29")
    assert (one.count(), one.filter("is_snapshot").count(), one.filter("forward_hole").count()) == (4, 3, 1)
    out = ingest.snapshot_outcome(c, 1).filter("trade_date = '2026-07-29'").first()
    assert (out.snapshots_kept, out.snapshots_dropped) == (3, 2)
    rows = raw(spark, [(0, before, 1, 0, 50, "A", 0), (1, day, 1, 0, 40, "A", 0)])
    one = ingest.one_session(ingest.canonicalise(ingest.accepted(mbo.with_ordinal(rows))), 1, "2026-07-29").orderBy("ordinal").collect()
    assert [(r.kind, r.gap_expected, r.gap_observed) for r in one] == [("Gap", 51, 40), ("Add", None, None)]


def test_inject_gap(spark):
    ev = frame(spark, [[T(100, 1, ts=OPEN + t) for t in (10, 20, 30)], [T(100, 1, ts=OPEN + t) for t in (20, 10)], [T(100, 1, ts=OPEN + 5)]])
    after, through = F.lit(OPEN + 10), F.lit(OPEN + 20)
    bad = mbo.splice_problems(ev, after, through)
    assert {r.instrument_id: r.problem for r in bad.collect()} == {1: "backward_ts", 2: "anchor_missing"}
    got = mbo.inject_gap(ev, after, through, 5, 9, bad).orderBy("ordinal").collect()
    assert [(r.kind, r.ts_ns - OPEN) for r in got] == [("Trade", 10), ("Gap", 20), ("Trade", 20)]
    try:
        mbo.inject_gap(ev, after, through, 9, 9)
    except ValueError:
        return
    raise AssertionError("observed must exceed expected")


def test_write_and_read_back(spark, tmp_path):
    ev = frame(spark, [[T(100, 1), T(101, 2)], [T(100, 5)]])
    mbo.write_events(ev, str(tmp_path / "ev"))
    back = mbo.read_events(spark, str(tmp_path / "ev"))
    assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0
    try:
        mbo.write_events(ev.limit(0), str(tmp_path / "none"))
    except ValueError:
        pass
    else:
        raise AssertionError("an empty table must be refused")


def test_read_raw_numbers_rows_by_file_order(spark, tmp_path):
    import csv
    names = ["ts_event", "ts_recv", "ts_in_delta", "instrument_id", "channel_id", "sequence", "action", "side", "price", "size", "order_id", "flags"]
    for f, n in (("b.csv", 3), ("a.csv", 2)):
        with open(tmp_path / f, "w", newline="") as h:
            w = csv.writer(h)
            w.writerow(names)
            for i in range(n):
                w.writerow([OPEN + i, OPEN + i, 0, 1, 0, 10 + i, "A", "B", TICK, 1, i, 0])
    got = mbo.with_ordinal(mbo.read_raw(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], "csv", header=True))
    assert [(r.source_file, r.sequence) for r in got.orderBy("ordinal").collect()] == [("b.csv", 10), ("b.csv", 11), ("b.csv", 12), ("a.csv", 10), ("a.csv", 11)]


def test_read_raw_keeps_equal_names_apart_and_expands_folders(spark, tmp_path):
    names = "ts_event long, ts_recv long, ts_in_delta long, instrument_id long, channel_id int, sequence long, action string, side string, price long, size long, order_id long, flags int"
    for d, n in (("one", 2), ("two", 3)):
        rows = [(OPEN + i, OPEN + i, 0, 1, 0, 10 * n + i, "A", "B", TICK, 1, i, 0) for i in range(n)]
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / d / "raw"))
        part = next((tmp_path / d / "raw").glob("part-*.parquet"))
        (tmp_path / d / "day.parquet").write_bytes(part.read_bytes())
    both = [str(tmp_path / d / "day.parquet") for d in ("two", "one")]
    got = mbo.with_ordinal(mbo.read_raw(spark, both)).orderBy("ordinal").collect()
    assert [r.sequence for r in got] == [30, 31, 32, 20, 21] and len({r.source_file for r in got}) == 2
    assert mbo.read_raw(spark, [str(tmp_path / "two" / "raw")]).count() == 3
    with pytest.raises(ValueError):
        mbo.read_raw(spark, [both[0], both[0]])


RAW = ("source_file string, file_rank int, row_index long, ts_event long, ts_recv long, ts_in_delta long, instrument_id long, channel_id int, "
       "sequence long, action string, side string, price long, size long, order_id long, flags int")


def test_no_raw_row_is_lost(spark):
    """A null in any required column is a reason of its own; what is accepted reaches its session."""
    good = ["f", 0, 0, OPEN, OPEN, 0, 1, 0, 10, "A", "B", TICK, 1, 1, 0]
    names = [x.split()[0] for x in RAW.split(", ")]
    rows = [list(good)]
    for name in ("channel_id", "flags", "ts_event", "side", "action", "sequence", "price", "order_id", "instrument_id", "size"):
        rows.append([None if n == name else v for n, v in zip(names, good)])
    rows.append([None if n in ("ts_recv", "ts_in_delta") else v for n, v in zip(names, good)])
    for i, r in enumerate(rows):
        r[2] = i
    raw = mbo.with_ordinal(spark.createDataFrame([tuple(r) for r in rows], RAW))
    why = {r.row_index: r.reject for r in ingest.map_rows(raw).collect()}
    assert why == {0: None, 1: "missing_channel_id", 2: "missing_flags", 3: "missing_ts_event", 4: "unmappable_side", 5: "unmappable_action",
                   6: "missing_sequence", 7: "missing_price", 8: "missing_order_id", 9: "missing_instrument_id", 10: "missing_size", 11: None}
    canonical = ingest.canonicalise(ingest.accepted(raw))
    out = {r.outcome: r.n for r in audit.raw_outcome(raw, ingest.map_rows(raw), canonical, ingest.session_events(canonical)).collect()}
    assert out.pop("session") == 2 and out.pop("read") == 12 and out.pop("lost") == 0 and out.pop("unadmitted") == 0 and sum(out.values()) == 10


def test_a_null_key_stops_a_prefix_scan(spark):
    rows = spark.createDataFrame([(1, 1), (None, 2), (1, 3)], "k long, ordinal long")
    with pytest.raises(Exception, match="a row has no k"):
        prefix_scan(rows, ["k"], {"n": Scan("sum", F.lit(1).cast("long"))}).collect()
    got = prefix_scan(rows.filter("k = 1"), ["k"], {"n": Scan("sum", F.lit(1).cast("long"))}).orderBy("ordinal").collect()
    assert [r.n for r in got] == [0, 1]


def test_prior_rules(spark):
    d = lambda n: dt.date(2026, 7, n)
    cur = spark.createDataFrame([(1, d(30), "X", 5)], "instrument_id long, trade_date date, symbol string, tick_size long")
    c = spark.createDataFrame([(1, d(28), "cache", "c1"), (1, d(28), "same_dir", "s1"), (1, d(29), "explicit", "e1"), (1, d(29), "same_dir", "s2"),
                               (1, d(30), "cache", "c2"), (2, d(28), "cache", "c3")], "instrument_id long, trade_date date, source string, path string")
    assert sorted(r.path for r in priors.discover(c, cur).collect()) == ["e1", "s1"]
    offers = spark.createDataFrame([(1, "X", d(28), 5, 1, 9), (1, "X", d(28), 5, 2, 9), (1, "Y", d(27), 5, 3, 9), (1, "X", d(30), 5, 4, 9),
                                    (1, "X", d(26), 5, 5, 0)], "instrument_id long, symbol string, trade_date date, tick_size long, offer long, n_events long")
    got = {r.offer: r.reject for r in priors.accept(offers, cur).collect()}
    assert got == {1: None, 2: "already_present", 3: "instrument_mismatch", 4: "not_earlier", 5: "no_session"}


def test_views_on_negative_ticks_and_scales(spark):
    got = spark.createDataFrame([(-1,), (0,), (3,), (4,)], "t long").select(views.bucket(F.col("t"), 4).alias("b")).collect()
    assert [r.b for r in got] == [-4, 0, 0, 4]
    try:
        views.bucket(F.lit(1), 4)
        views.rescale(spark.range(1), 3)
    except ValueError:
        return
    raise AssertionError("scale 3 must be refused")
