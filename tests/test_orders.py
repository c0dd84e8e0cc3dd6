import random

import pytest
from pyspark.sql import functions as F

from feed import A, C, Fi, G, M, S, TICK, clear, e, frame
from naive_book import NaiveBook
from orderloom.functions import calendar as cal
from orderloom.functions.schema import KEY
from orderloom.operators import asof, audit, book, orders
from orderloom.plans import queries as registry

MS = 1_000_000


def live_table(spark, scenarios, **kw):
    ev = frame(spark, scenarios)
    log = orders.order_log(ev, TICK, **kw).cache()
    live = asof.live_orders(orders.order_intervals(log), asof.cuts(ev))
    q = book.queue(live).collect()
    got = {}
    for r in q:
        got.setdefault(r.instrument_id, {})[r.order_id] = (r.side, r.tick, r["size"], r.queue_rank, r.contracts_ahead,
                                                           r.refresh_state, r.reloads, r.hidden)
    return ev, log, got


# name, events, expected (refresh_state, reloads, hidden) of id 1 (None = not resting), refresh totals (count, hidden)
ICEBERGS = [
    ("single", [A(1, 5), A(2, 7), Fi(1, 5), C(1, 5), A(1, 5)], ("Known", 1, 5), (1, 5)),
    ("by_modify", [A(1, 4), A(2, 3), Fi(1, 4), M(1, 6)], ("Known", 1, 6), (1, 6)),
    ("three_reloads", [A(1, 5)] + [Fi(1, 5), C(1, 5), A(1, 5)] * 3, ("Known", 3, 15), (3, 15)),
    ("partial_fill_modify", [A(1, 10), Fi(1, 4), M(1, 8)], ("Known", 0, 0), (0, 0)),
    ("other_id", [A(1, 5), Fi(1, 5), C(1, 5), A(9, 5)], None, (0, 0)),
    ("terminal_cancel", [A(1, 5), Fi(1, 5), C(1, 5), C(1, 5), A(1, 5)], ("Known", 0, 0), (0, 0)),
    ("across_gap", [A(1, 5), Fi(1, 5), C(1, 5), G(), A(1, 5)], ("Unavailable", 0, 0), (0, 0)),
    ("reproved_after_gap", [A(1, 5), Fi(1, 5), C(1, 5), G(), A(1, 5), Fi(1, 5), C(1, 5), A(1, 5)], ("Known", 1, 5), (1, 5)),
    ("late", [A(1, 5), Fi(1, 5), C(1, 5), A(1, 5, dt_ns=MS + 1)], ("Known", 0, 0), (0, 0)),
    ("cumulative", [A(1, 5), Fi(1, 2), Fi(1, 3), C(1, 5), A(1, 6)], ("Known", 1, 6), (1, 6)),
    ("partial_then_gap", [A(1, 5), Fi(1, 2), G(), Fi(1, 3), C(1, 5), A(1, 5)], ("Known", 0, 0), (0, 0)),
    ("gap_then_modify", [A(1, 5), Fi(1, 5), G(), M(1, 6)], ("Unavailable", 0, 0), (0, 0)),
    ("other_price", [A(1, 5), Fi(1, 5), C(1, 5), A(1, 5, tick=101)], ("Known", 0, 0), (0, 0)),
    ("expired_by_other_event", [A(1, 5), Fi(1, 5), C(1, 5), A(2, 1, dt_ns=2 * MS), A(1, 5, dt_ns=-2 * MS)], ("Known", 0, 0), (0, 0)),
    ("cleared", [A(1, 5), Fi(1, 5), C(1, 5), clear(), A(1, 5)], ("Known", 0, 0), (0, 0)),
]


def test_iceberg_scenarios(spark):
    _, log, got = live_table(spark, [s[1] for s in ICEBERGS])
    totals = {r.instrument_id: (r.n, r.h) for r in orders.refreshes(log).groupBy("instrument_id").agg(
        F.count("*").alias("n"), F.sum("hidden_size").alias("h")).collect()}
    for i, (name, _, want, total) in enumerate(ICEBERGS):
        mine = got.get(i, {}).get(1)
        assert (mine[5:] if mine else None) == want, name
        assert totals.get(i, (0, 0)) == total, name
    assert got[0][1][3] == 2  # the reload went behind id 2


# name, events, expected {id: (side, tick, size, rank, ahead)}, expected fault reasons
CASES = [
    ("size_down_keeps_rank", [A(1, 5), A(2, 7), M(1, 3)], {1: ("B", 100, 3, 1, 0), 2: ("B", 100, 7, 2, 3)}, []),
    ("size_up_goes_back", [A(1, 5), A(2, 7), M(1, 6)], {2: ("B", 100, 7, 1, 0), 1: ("B", 100, 6, 2, 7)}, []),
    ("price_change_goes_back", [A(1, 5), A(2, 7, tick=101), M(1, 5, tick=101)], {2: ("B", 101, 7, 1, 0), 1: ("B", 101, 5, 2, 7)}, []),
    ("partial_cancel_keeps_rank", [A(1, 5), A(2, 7), C(1, 2)], {1: ("B", 100, 3, 1, 0), 2: ("B", 100, 7, 2, 3)}, []),
    ("zero_modify_removes", [A(1, 5), M(1, 0)], {}, []),
    ("unknown_refs", [C(1, 1), M(2, 1), Fi(3, 1)], {}, ["unknown_ref"] * 3),
    ("fill_keeps_depth", [A(1, 5), Fi(1, 3)], {1: ("B", 100, 5, 1, 0)}, []),
    ("off_display", [A(1, 5), Fi(1, 3, tick=99)], {1: ("B", 100, 5, 1, 0)}, ["off_display"]),
    ("snapshot_prefix", [A(1, 5), S(8, 2), S(9, 3)], {8: ("B", 100, 2, 1, 0), 9: ("B", 100, 3, 2, 2), 1: ("B", 100, 5, 3, 5)}, []),
    ("snapshot_known_id", [A(1, 5), S(1, 5)], {1: ("B", 100, 5, 1, 0)}, []),
    ("snapshot_mismatch", [A(1, 5), S(1, 4)], {1: ("B", 100, 5, 1, 0)}, ["snapshot_mismatch"]),
    ("snapshot_clear_ignored", [A(1, 5), e("Clear", side="N", tick=0, snap=True)], {1: ("B", 100, 5, 1, 0)}, []),
    ("snapshot_moved_is_live", [S(8, 2), A(1, 5), M(8, 4)], {1: ("B", 100, 5, 1, 0), 8: ("B", 100, 4, 2, 5)}, []),
    ("clear_empties", [A(1, 5), clear(), A(2, 1)], {2: ("B", 100, 1, 1, 0)}, []),
    ("desync_add", [A(1, 5), G(), A(1, 7, tick=99)], {1: ("B", 99, 7, 1, 0)}, ["desync_add"]),
    ("desync_cancel", [A(1, 5), G(), C(1, 9)], {}, ["desync_cancel"]),
    ("desync_modify", [A(1, 5), G(), M(1, 4, side="A", tick=105)], {1: ("A", 105, 4, 1, 0)}, ["desync_modify"]),
    ("desync_modify_zero", [A(1, 5), G(), M(1, 0, tick=105)], {}, ["desync_modify"]),
    ("desync_fill", [A(1, 5), G(), Fi(1, 5, side="A")], {1: ("B", 100, 5, 1, 0)}, ["desync_fill"]),
    ("sideless_fill_after_gap", [A(1, 5), G(), Fi(1, 5, side="N")], {1: ("B", 100, 5, 1, 0)}, ["desync_fill"]),
    ("duplicate_add", [A(1, 5), A(1, 6)], {1: ("B", 100, 6, 1, 0)}, ["duplicate_add"]),
    ("oversize_cancel", [A(1, 5), C(1, 6)], {1: ("B", 100, 5, 1, 0)}, ["cancel_mismatch"]),
    ("zero_cancel", [A(1, 5), C(1, 0)], {1: ("B", 100, 5, 1, 0)}, ["cancel_size_zero"]),
    ("bad_adds", [A(1, 5, side="N"), A(2, 0)], {}, ["add_without_side", "add_size_zero"]),
    ("bad_modify", [A(1, 5), M(1, 5, side="A"), M(1, 0, tick=99)], {1: ("B", 100, 5, 1, 0)}, ["modify_mismatch"] * 2),
    ("bad_fills", [A(1, 5), Fi(1, 0), Fi(1, 1, side="A")], {1: ("B", 100, 5, 1, 0)}, ["fill_size_zero", "fill_side_mismatch"]),
]


def test_book_cases(spark):
    ev, log, got = live_table(spark, [c[1] for c in CASES])
    seen = {}
    for r in orders.faults(log).orderBy("instrument_id", "ordinal").collect():
        seen.setdefault(r.instrument_id, []).append(r.reason)
    for i, (name, _, want, reasons) in enumerate(CASES):
        assert {k: v[:5] for k, v in got.get(i, {}).items()} == want, name
        assert seen.get(i, []) == reasons, name
    live = asof.live_orders(orders.order_intervals(log), asof.cuts(ev))
    assert audit.book_structure(live, book.queue(live), book.depth(live)).count() == 0


def test_sideless_fill_resolves_side(spark):
    ev = frame(spark, [[A(1, 5, side="A"), Fi(1, 2, side="N"), Fi(7, 3, side="N")]])
    got = orders.fills(orders.order_log(ev, TICK)).orderBy("ordinal").select("side", "size", "aggressor", "unknown_ref").collect()
    assert [tuple(r) for r in got] == [("A", 2, "B", False), ("N", 3, "N", True)]


def test_flow_window(spark):
    s = 1_000_000_000
    base = 1785276000 * s

    def at(*events):
        return [dict(x, ts=base + int(t * s)) for t, x in events]

    status = lambda: e("Status", side="N", tick=0)
    first = [(10, A(1, 5)), (10.4, C(1, 2)), (11, Fi(1, 3))]
    cases = [(at(*first), (5, 2, 3)), (at(*first, (14.9, status())), (5, 2, 3)), (at(*first, (17, status())), None),
             (at((10, A(1, 5)), (13, A(2, 7)), (15.5, status())), (7, 0, 0)),
             (at((13, A(1, 5)), (10, A(2, 7)), (17, status())), (12, 0, 0)),  # the late add counts in the level's latest bucket
             (at((13, A(1, 5)), (13.1, clear()), (13.2, A(2, 1))), (1, 0, 0))]
    ev = frame(spark, [c[0] for c in cases])
    log = orders.order_log(ev, TICK)
    got = {r.instrument_id: (r.added_5s, r.cancelled_5s, r.traded_5s) for r in book.flow_at(ev, orders.flow_deltas(log), asof.cuts(ev)).collect()}
    for i, (_, want) in enumerate(cases):
        assert got.get(i) == want, i


def random_stream(rng, n):
    """A stream the strict rules accept: sizes and sides of known orders are
    respected unless a gap has made them stale."""
    b, out, ts = NaiveBook(), [], 10**15
    for _ in range(n):
        ts += rng.choice([1, 50, 1000, 400_000, 2_000_000, -300_000])
        oid, side, tick, size = rng.randint(1, 12), rng.choice("BA"), rng.randint(98, 102), rng.randint(1, 6)
        o = b.orders.get(oid)
        stale = o is not None and o["epoch"] < b.epoch
        pick = rng.random()
        if pick < 0.02:
            x = G()
        elif pick < 0.03:
            x = clear()
        elif pick < 0.06:
            x = S(oid, size, tick=tick, side=side)
            if o is not None:
                x = S(oid, o["size"], tick=o["tick"], side=o["side"])
        elif o is None or (stale and pick < 0.2):
            x = rng.choice([A, A, A, C, M, Fi])(oid, size, tick=tick, side=side)
        elif stale and pick < 0.4:
            x = rng.choice([C, M, Fi])(oid, rng.choice([size, o["size"]]), tick=tick, side=rng.choice(["N", side]))
        else:
            own = rng.choice(["N", o["side"]])
            kind = rng.random()
            if kind < 0.35:
                x = Fi(oid, rng.choice([o["size"], 1]), tick=o["tick"], side=own)
            elif kind < 0.6:
                x = C(oid, rng.choice([o["size"], o["size"], 1]), tick=o["tick"], side=own)
            elif kind < 0.65:
                x = M(oid, 0, tick=o["tick"], side=own)
            else:
                x = M(oid, size, tick=rng.choice([tick, o["tick"]]), side=own)
        x = dict(x, ts=ts)
        b.apply(x, ts)
        out.append(x)
    return out, b


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_random_streams_match_naive_book(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(orders, "_SAMPLE", 1)  # with hot_rows=1 every id is split
    rng = random.Random(7)
    made = [random_stream(rng, 250) for _ in range(60)]
    _, log, got = live_table(spark, [m[0] for m in made], hot_rows=hot_rows)
    totals = {}
    for r in book.refresh_totals(orders.refreshes(log)).collect():
        totals.setdefault(r.instrument_id, {})[(r.side, r.tick)] = (r.refresh_count, r.hidden_volume)
    desync = F.col("desync_add") | F.col("desync_cancel") | F.col("desync_modify") | F.col("desync_fill")
    n = {r.instrument_id: (r.u, r.d, r.v) for r in log.groupBy("instrument_id").agg(
        F.count_if("unknown_ref").alias("u"), F.count_if(desync).alias("d"), F.count("violation").alias("v")).collect()}
    for i, (_, b) in enumerate(made):
        assert got.get(i, {}) == b.state(), i
        assert totals.get(i, {}) == b.totals, i
        assert n[i] == (b.unknown, b.desync, 0), i
    assert sum(len(t) for t in totals.values()) > 50


def test_splitting_hot_ids_changes_no_row_of_the_log(spark, monkeypatch):
    monkeypatch.setattr(orders, "_SAMPLE", 1)
    rng = random.Random(13)
    made = [random_stream(rng, 250)[0] for _ in range(30)]
    made.append([A(1, 5), A(1, 7), M(1, 3), A(1, 2), C(1, 2), A(2, 4), clear(), A(2, 6), Fi(2, 6), C(2, 6), clear(), C(2, 6), Fi(3, 1), Fi(3, 2)])
    ev = frame(spark, made)
    whole = orders.order_log(ev, TICK, hot_rows=None)
    split = orders.order_log(ev, TICK, hot_rows=1)
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (whole, split))
    assert a == b and len(a) > 5000


def test_asof_any_point_equals_prefix_run(spark):
    rng = random.Random(11)
    ev = frame(spark, [random_stream(rng, 200)[0] for _ in range(8)])
    iv = orders.order_intervals(orders.order_log(ev, TICK)).cache()
    for t in (10**15 + 5_000_000, 10**15 + 30_000_000):
        cut = asof.cuts(ev, F.lit(t))
        whole = asof.live_orders(iv, cut)
        short = asof.upto(ev, cut)
        again = asof.live_orders(orders.order_intervals(orders.order_log(short, TICK)), asof.cuts(short))
        cols = ["instrument_id", "order_id", "side", "tick", "size", "prio_ord", "refresh_state", "reloads", "hidden"]
        a, b = ({tuple(r) for r in x.select(*cols).collect()} for x in (whole, again))
        assert a == b and a


def test_cuts_at_many_times_equal_one_cut_each(spark):
    """Small blocks, so that carries, block edges and times outside the session are met."""
    sf = "/root/testdata/sf0.001"
    events = registry.ev(spark, sf)
    opens = F.lit(0).cast("long") + cal.session_clock(F.col("trade_date"))["session_open_ns"]
    offsets = [-10**15, 0, 7_200_000_000_000, 43_200_000_000_000, 10**15]
    points = events.select(*KEY).distinct().withColumn("off", F.explode(F.array(*[F.lit(x).cast("long") for x in offsets]))).withColumn("at_ns", opens + F.col("off"))
    many = asof.cuts_at(events, points, block_bits=9).collect()
    for off in offsets:
        want = {(r.instrument_id, r.trade_date): r.asDict() for r in asof.cuts(events, opens + off).collect()}
        got = {(r.instrument_id, r.trade_date): {k: v for k, v in r.asDict().items() if k != "off"} for r in many if r.off == off}
        assert got == want
    intervals = orders.order_intervals(registry.log_of(spark, sf))
    cut = asof.cuts_at(events, points.drop("off"), block_bits=9)
    both = [sorted((r.instrument_id, r.trade_date, r.order_id, r.size, r.refresh_state, r.native) for r in x.collect())
            for x in (asof.orders_at(intervals, cut).filter(F.col("at_ns") == opens + offsets[3]), asof.live_orders(intervals, asof.cuts(events, opens + offsets[3])))]
    assert both[0] == both[1] and both[0]


@pytest.mark.parametrize("bits", [3, 6, 16])
def test_best_prices_at_every_change(spark, bits):
    """Against a plain loop over the levels, with blocks of a few rows."""
    sf = "/root/testdata/sf0.001"
    iv = orders.order_intervals(registry.log_of(spark, sf))
    events = registry.ev(spark, sf)
    got = sorted(map(tuple, book.bbo_changes(iv, events, block_bits=bits).select(*KEY, "ordinal", "best_bid", "best_ask").collect()), key=str)
    clears = {}
    for r in events.filter("kind = 'Clear' AND NOT is_snapshot").orderBy("ordinal").collect():
        clears.setdefault((r.instrument_id, r.trade_date), []).append(r.ordinal)
    held = {}
    for r in iv.collect():
        key = (r.instrument_id, r.trade_date)
        end = clears.get(key, [])[r.clear_no:r.clear_no + 1]
        held.setdefault(key, []).append((r.side, r.tick, r.from_ord, min([r.to_ord, *end])))
    want = []
    for key, rows in held.items():
        last = (None, None)
        for o in sorted({x for r in rows for x in r[2:] if x < 2**62}):
            now = (max((t for s, t, a, z in rows if s == "B" and a <= o < z), default=None), min((t for s, t, a, z in rows if s == "A" and a <= o < z), default=None))
            if now != last:
                want.append((*key, o, *now))
            last = now
    assert got == sorted(want, key=str) and len(want) > 200
