"""Per-order state step, shared by the batch and the streaming lifecycle.

One order id depends on the rest of the book only through three numbers that
are attached to every event beforehand: how many gaps and how many clears came
before it, and the largest event time before it.  Given those, an order folds
alone, with constant memory; Spark does the shuffling and sorting around it.
"""

from __future__ import annotations

NONE, BID, ASK = 0, 1, 2
END, ADD, CANCEL, MODIFY, FILL, SNAP = 0, 1, 2, 3, 4, 5
OPEN_END = 9223372036854775807

# flag bits
UNKNOWN_REF, DESYNC_ADD, DESYNC_CANCEL, DESYNC_MODIFY, DESYNC_FILL, OFF_DISPLAY, DEPLETES, REPLACES = 1, 2, 4, 8, 16, 32, 64, 128

# violation codes, by position
VIOLATIONS = ["", "add_without_side", "add_size_zero", "duplicate_add", "cancel_mismatch", "cancel_size_zero",
              "modify_mismatch", "fill_size_zero", "fill_side_mismatch", "snapshot_mismatch"]
ADD_SIDE, ADD_SIZE, DUP_ADD, CANCEL_BAD, CANCEL_ZERO, MODIFY_BAD, FILL_ZERO, FILL_SIDE, SNAP_BAD = range(1, 10)

STATE_FIELDS = ("live", "side", "tick", "size", "epoch", "origin", "prio", "reloads", "hidden", "unavail",
                "fill_qty", "fill_done", "fill_epoch", "fill_seen",
                "t_side", "t_tick", "t_ts", "t_epoch", "t_reloads", "t_hidden", "clear_no")


class Order:
    """Everything remembered about one order id.  ``fill_qty`` is the execution
    evidence on the displayed tranche (``fill_done`` = when it covered it, else
    -1); ``t_*`` is the trace of a fully executed, removed order (``t_ts`` = -1
    when there is none)."""

    __slots__ = STATE_FIELDS

    def __init__(self, clear_no: int = 0):
        self.live, self.side, self.tick, self.size = 0, 0, 0, 0
        self.epoch, self.origin, self.prio = 0, 1, 0
        self.reloads, self.hidden, self.unavail = 0, 0, 0
        self.fill_qty, self.fill_done, self.fill_epoch, self.fill_seen = 0, -1, 0, 0
        self.t_side, self.t_tick, self.t_ts, self.t_epoch, self.t_reloads, self.t_hidden = 0, 0, -1, 0, 0, 0
        self.clear_no = clear_no

    def forget_fills(self):
        self.fill_qty, self.fill_done = 0, -1

    def place(self, side, tick, size, ts, ordinal, epoch, window):
        """Rest at the back of a level.  Returns the refreshed size when this
        placement restores a fully executed tranche, else -1."""
        self.forget_fills()
        self.reloads = self.hidden = self.unavail = 0
        refreshed = -1
        if self.t_ts >= 0:
            if self.t_side == side and self.t_tick == tick and ts - self.t_ts <= window:
                self.reloads, self.hidden = self.t_reloads, self.t_hidden
                if self.t_epoch == epoch:
                    self.reloads += 1
                    self.hidden += size
                    refreshed = size
                else:
                    self.unavail = 1
            self.t_ts = -1
        self.live, self.side, self.tick, self.size = 1, side, tick, size
        self.epoch, self.origin, self.prio = epoch, 1, ordinal
        return refreshed

    def remove(self):
        if self.fill_done >= 0:
            self.t_side, self.t_tick, self.t_ts, self.t_epoch = self.side, self.tick, self.fill_done, self.fill_epoch
            self.t_reloads, self.t_hidden = self.reloads, self.hidden
        self.forget_fills()
        self.live = self.reloads = self.hidden = self.unavail = 0


def step(o: Order, code, ordinal, ts, side, tick, size, epoch, clear_no, now_before, window):
    """Apply one event (``now_before`` is -1 when nothing came before).  Returns ``(changed, old_side, old_tick, cancelled, side,
    tick, added, traded, refreshed, flags, violation)``; ``changed`` says the
    visible resting state is different now."""
    changed = 0
    if clear_no != o.clear_no:
        changed = o.live
        o.__init__(clear_no)
    if o.fill_qty and o.fill_done < 0 and o.fill_seen != epoch:
        o.forget_fills()
    if o.t_ts >= 0 and now_before - o.t_ts > window:
        o.t_ts = -1
    stale = o.live and o.epoch < epoch
    old_side, old_tick = o.side, o.tick

    if code == ADD:
        if side == NONE or size <= 0:
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, ADD_SIDE if side == NONE else ADD_SIZE
        flags = bad = 0
        if o.live:
            if stale:
                flags = DESYNC_ADD
            else:
                bad = DUP_ADD
            o.forget_fills()
            o.remove()
        refreshed = o.place(side, tick, size, ts, ordinal, epoch, window)
        return 1, 0, 0, 0, side, tick, size, 0, refreshed, flags, bad

    if code == CANCEL:
        if not o.live:
            if o.t_ts >= 0:
                o.t_ts = -1
                return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, UNKNOWN_REF, 0
        if size <= 0:
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, CANCEL_ZERO
        flags = 0
        gone = o.size
        if not ((side == NONE or side == o.side) and tick == o.tick and size <= o.size):
            if not stale:
                return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, CANCEL_BAD
            flags = DESYNC_CANCEL
            o.remove()
        elif size < o.size:
            gone = size
            o.size -= size
            o.forget_fills()
        else:
            o.remove()
        return 1, old_side, old_tick, gone, 0, 0, 0, 0, -1, flags, 0

    if code == MODIFY:
        if not o.live:
            if o.t_ts < 0:
                return changed, 0, 0, 0, 0, 0, 0, 0, -1, UNKNOWN_REF, 0
            if size == 0:
                o.t_ts = -1
                return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0
            side = side or o.t_side
            refreshed = o.place(side, tick, size, ts, ordinal, epoch, window)
            return 1, 0, 0, 0, side, tick, size, 0, refreshed, 0, 0
        if not ((side == NONE or side == o.side) and (size != 0 or tick == o.tick)):
            if not stale:
                return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, MODIFY_BAD
            gone = o.size
            o.remove()
            if size == 0:
                return 1, old_side, old_tick, gone, 0, 0, 0, 0, -1, DESYNC_MODIFY, 0
            side = side or old_side
            refreshed = o.place(side, tick, size, ts, ordinal, epoch, window)
            return 1, old_side, old_tick, gone, side, tick, size, 0, refreshed, DESYNC_MODIFY, 0
        gone = o.size
        if size == 0:
            o.remove()
            return 1, old_side, old_tick, gone, 0, 0, 0, 0, -1, 0, 0
        if o.fill_done >= 0:
            o.remove()
            refreshed = o.place(old_side, tick, size, ts, ordinal, epoch, window)
            return 1, 0, 0, 0, old_side, tick, size, 0, refreshed, REPLACES, 0
        o.forget_fills()
        o.size = size
        if tick == old_tick and size <= gone:
            if size == gone:
                return 1, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0
            return 1, old_side, old_tick, gone - size, 0, 0, 0, 0, -1, 0, 0
        o.tick, o.origin, o.prio = tick, 1, ordinal
        if tick == old_tick:
            return 1, 0, 0, 0, old_side, tick, size - gone, 0, -1, 0, 0
        return 1, old_side, old_tick, gone, old_side, tick, size, 0, -1, 0, 0

    if code == FILL:
        if size <= 0:
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, FILL_ZERO
        wrong_side = o.live and side != NONE and side != o.side
        if wrong_side and not stale:
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, FILL_SIDE
        if not o.live:
            return changed, 0, 0, 0, side, tick, 0, size, -1, UNKNOWN_REF, 0
        if wrong_side or (stale and side == NONE):
            return changed, 0, 0, 0, side or o.side, tick, 0, size, -1, DESYNC_FILL, 0
        if not o.fill_qty:
            o.fill_epoch = epoch
        o.fill_qty += size
        o.fill_seen = epoch
        flags = 0 if tick == o.tick else OFF_DISPLAY
        if o.fill_done < 0 and o.fill_qty >= o.size:
            o.fill_done = ts
            flags |= DEPLETES
        return changed, 0, 0, 0, o.side, tick, 0, size, -1, flags, 0

    if code == SNAP:
        if side == NONE or size <= 0:
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, ADD_SIDE if side == NONE else ADD_SIZE
        if o.live:
            same = side == o.side and tick == o.tick and size == o.size
            return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0 if same else SNAP_BAD
        o.forget_fills()
        o.reloads, o.hidden = (o.t_reloads, o.t_hidden) if o.t_ts >= 0 else (0, 0)
        o.t_ts, o.unavail = -1, 1
        o.live, o.side, o.tick, o.size = 1, side, tick, size
        o.epoch, o.origin, o.prio = epoch, 0, ordinal
        return 1, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0

    # END: the next life of a split id begins here and supersedes this one
    if not o.live:
        return changed, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0
    o.forget_fills()
    o.remove()
    return 1, 0, 0, 0, 0, 0, 0, 0, -1, DESYNC_ADD if stale else 0, 0 if stale else DUP_ADD


def fold_batches(batches, window):
    """Stream Arrow batches sorted by (order, ordinal) into effect rows.

    State is one ``Order`` plus at most one row held back until the resting
    state it opened is superseded, so a hot order id costs time but no memory.
    A row's end is patched in place while its batch is still open."""
    from array import array

    import numpy as np
    import pyarrow as pa

    n_in, width = len(HEAD), len(BODY)
    key, o, held, open_at = None, None, None, -1  # held: open row of an earlier batch; open_at: its place in this one
    schema = pa.schema([(n, pa.int64()) for n in OUT_NAMES])
    closed, rest = (0,) * 12, (OPEN_END, OPEN_END)

    def emit(head, body, extra):
        cols = [np.concatenate([c, np.array([x[i] for x in extra], np.int64)]) if extra else c for i, c in enumerate([*head, *body])]
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], schema=schema)

    for batch in batches:
        head = [batch.column(n).to_numpy() for n in HEAD]
        now = np.where((batch.column("code").to_numpy() == SNAP) & (head[-1] >= 0), head[-1], np.maximum(head[-1], head[4]))
        head[-1] = now
        now = now.tolist()
        out, extra = array("q"), []
        put = out.extend
        cols = [batch.column(n).to_numpy().tolist() for n in IN_NAMES]
        row = -1
        for inst, day, oid, seg, ordinal, ts, code, side, tick, size, epoch, clear_no, before in zip(*cols):
            row += 1
            k = (oid, inst, day, seg)
            if k != key:
                if held is not None:
                    extra.append(held)
                    held = None
                key, o, open_at = k, Order(clear_no), -1
            changed, *fx = step(o, code, ordinal, ts, side, tick, size, epoch, clear_no, before, window)
            put(fx)
            if not changed:
                put(closed)
                continue
            if open_at >= 0:
                out[open_at + width - 2], out[open_at + width - 1] = ordinal, now[row]
                open_at = -1
            elif held is not None:
                held[-2:] = ordinal, now[row]
                extra.append(held)
                held = None
            if o.live:
                open_at = row * width
                put((1, o.side, o.tick, o.size, o.origin, o.prio, o.epoch, o.reloads, o.hidden, o.unavail))
                put(rest)
            else:
                put(closed)
        body = np.frombuffer(out, np.int64).reshape(-1, width).T
        if open_at >= 0:  # its end may come with the next batch
            at = open_at // width
            held, open_at = [int(c[at]) for c in head] + [int(c[at]) for c in body], -1
            head, body = [np.delete(c, at) for c in head], np.delete(body, at, axis=1)
        yield emit(head, body, extra)
    if held is not None:
        yield emit([np.empty(0, np.int64)] * n_in, [np.empty(0, np.int64)] * width, [held])


IN_NAMES = ["instrument_id", "day", "order_id", "seg", "ordinal", "ts_ns", "code", "side_no", "tick", "size",
            "epoch", "clear_no", "now_before"]
# carried over from the input (``now_before``, -1 for none, becomes the time after the event) ...
HEAD = ["instrument_id", "day", "order_id", "ordinal", "ts_ns", "code", "epoch", "clear_no", "now_before"]
# ... and computed
BODY = ["old_side", "old_tick", "cancelled", "fx_side", "fx_tick", "added", "traded", "refreshed", "flags", "violation",
        "opens", "side_no", "tick", "size", "prio_origin", "prio_ord", "order_epoch", "reloads", "hidden", "unavailable",
        "to_ord", "to_now"]
OUT_NAMES = [*HEAD[:-1], "now_ns", *BODY]
