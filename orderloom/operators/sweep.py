"""Best price along one block of ordinals, for one side of one session."""

from __future__ import annotations


def changes(rows):
    """Rows (ordinal, tick, d) of a block: d orders more or fewer at a level; ordinal -1
    holds what was there before.  Gives the best tick after every ordinal that changes
    it.  Bids are best when high, asks when low; an emptied level leaves the heap when
    it comes to the top."""
    from heapq import heappop, heappush

    import pandas as pd

    first = rows.iloc[0]
    sign = -1 if first["side"] == "B" else 1
    rows = rows.sort_values(["ordinal", "tick"])
    count, heap, best, out, at = {}, [], None, [], -1

    def settle(ordinal):
        nonlocal best
        while heap and not count[heap[0] * sign]:
            heappop(heap)
        now = heap[0] * sign if heap else None
        if now != best:
            if ordinal >= 0:
                out.append((ordinal, now))
            best = now

    for ordinal, tick, d in zip(rows["ordinal"].tolist(), rows["tick"].tolist(), rows["d"].tolist()):
        if ordinal != at:
            settle(at)
            at = ordinal
        had = count.get(tick, 0)
        count[tick] = had + d
        if not had:
            heappush(heap, tick * sign)
    settle(at)
    n = len(out)
    return pd.DataFrame({
        "instrument_id": pd.Series([first["instrument_id"]] * n, dtype="int64"), "trade_date": pd.Series([first["trade_date"]] * n, dtype=object),
        "side": pd.Series([first["side"]] * n, dtype=object), "ordinal": pd.Series([o for o, _ in out], dtype="int64"), "best": pd.Series([b for _, b in out], dtype="Int64")})
