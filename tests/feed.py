"""Small hand-made event streams.  Every scenario gets its own instrument, so one
Spark job evaluates many of them."""

import datetime as dt

from orderloom.functions.schema import EVENT_SCHEMA

TICK = 250_000_000
DAY = dt.date(2026, 7, 29)
OPEN = 1785276000_000_000_000  # 2026-07-28 22:00 UTC, the session open
HALF_HOUR = 1_800_000_000_000


def e(kind, oid=0, size=0, tick=100, side="B", dt_ns=1, ts=None, snap=False, gap=None, seq=0):
    return dict(kind=kind, oid=oid, size=size, tick=tick, side=side, dt_ns=dt_ns, ts=ts, snap=snap, gap=gap, seq=seq)


def A(oid, size, **k):
    return e("Add", oid, size, **k)


def C(oid, size, **k):
    return e("Cancel", oid, size, **k)


def M(oid, size, **k):
    return e("Modify", oid, size, **k)


def Fi(oid, size, **k):
    return e("Fill", oid, size, **k)


def S(oid, size, **k):
    return e("Add", oid, size, snap=True, **k)


def T(tick, size, side="N", **k):
    return e("Trade", 0, size, tick=tick, side=side, **k)


def G(**k):
    return e("Gap", side="N", tick=0, gap=(10, 20), **k)


def clear(**k):
    return e("Clear", side="N", tick=0, **k)


def rows(instrument, events, day=DAY, start=OPEN):
    out, now = [], start
    for i, x in enumerate(events):
        now = x["ts"] if x["ts"] is not None else now + x["dt_ns"]
        g = x["gap"] or (None, None)
        out.append((instrument, 0, "f", i, now, x["seq"], x["kind"], x["side"], 32 if x["snap"] else 0, x["snap"], x["size"],
                    x["tick"] * TICK, x["oid"], g[0], g[1], day))
    return out


def frame(spark, scenarios):
    """``scenarios``: list of event lists -> one DataFrame, instruments 0, 1, ..."""
    data = [r for i, s in enumerate(scenarios) for r in rows(i, s)]
    return spark.createDataFrame(data, EVENT_SCHEMA)
