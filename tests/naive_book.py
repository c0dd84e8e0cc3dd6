"""One-event-at-a-time ordered-list book, the independent side of randomized tests."""


class NaiveBook:
    def __init__(self, window=1_000_000):
        self.levels = {}  # (side, tick) -> list of ids, head first
        self.orders = {}  # id -> dict
        self.evidence = {}  # id -> [qty, done_ts or None, epoch]
        self.graves = {}  # id -> (side, tick, ts, epoch, reloads, hidden)
        self.epoch, self.now, self.window = 0, None, window
        self.unknown, self.desync, self.totals = 0, 0, {}

    def _unlink(self, oid):
        o = self.orders[oid]
        self.levels[(o["side"], o["tick"])].remove(oid)

    def _link(self, oid, snapshot=False):
        o = self.orders[oid]
        line = self.levels.setdefault((o["side"], o["tick"]), [])
        if snapshot:
            n = sum(1 for x in line if self.orders[x]["snap"])
            line.insert(n, oid)
        else:
            line.append(oid)

    def place(self, oid, side, tick, size, ts):
        self.evidence.pop(oid, None)
        g = self.graves.pop(oid, None)
        reloads, hidden, unavail = 0, 0, False
        if g and g[0] == side and g[1] == tick and ts - g[2] <= self.window:
            reloads, hidden = g[4], g[5]
            if g[3] == self.epoch:
                reloads, hidden = reloads + 1, hidden + size
                n, h = self.totals.get((side, tick), (0, 0))
                self.totals[(side, tick)] = (n + 1, h + size)
            else:
                unavail = True
        self.orders[oid] = dict(side=side, tick=tick, size=size, epoch=self.epoch, snap=False, reloads=reloads, hidden=hidden, unavail=unavail)
        self._link(oid)

    def remove(self, oid):
        self._unlink(oid)
        o = self.orders.pop(oid)
        ev = self.evidence.pop(oid, None)
        if ev and ev[1] is not None:
            self.graves[oid] = (o["side"], o["tick"], ev[1], ev[2], o["reloads"], o["hidden"])

    def apply(self, x, ts):
        oid, size, tick, side, kind = x["oid"], x["size"], x["tick"], x["side"], x["kind"]
        o = self.orders.get(oid)
        if x["snap"]:
            if o is None:
                g = self.graves.pop(oid, None)
                self.evidence.pop(oid, None)
                self.orders[oid] = dict(side=side, tick=tick, size=size, epoch=self.epoch, snap=True, reloads=g[4] if g else 0,
                                        hidden=g[5] if g else 0, unavail=True)
                self._link(oid, snapshot=True)
            return
        self.now = ts if self.now is None else max(self.now, ts)
        stale = o is not None and o["epoch"] < self.epoch
        if kind == "Add":
            if o is not None:
                if not stale:
                    raise AssertionError("generator made a duplicate add")
                self.desync += 1
                self.evidence.pop(oid, None)
                self.remove(oid)
            self.place(oid, side, tick, size, ts)
        elif kind == "Cancel":
            if o is None:
                if self.graves.pop(oid, None) is None:
                    self.unknown += 1
            elif not (side in ("N", o["side"]) and tick == o["tick"] and size <= o["size"]):
                assert stale
                self.desync += 1
                self.remove(oid)
            elif size < o["size"]:
                o["size"] -= size
                self.evidence.pop(oid, None)
            else:
                self.remove(oid)
        elif kind == "Modify":
            if o is None:
                if oid not in self.graves:
                    self.unknown += 1
                elif size == 0:
                    self.graves.pop(oid)
                else:
                    self.place(oid, self.graves[oid][0] if side == "N" else side, tick, size, ts)
            elif side not in ("N", o["side"]) or (size == 0 and tick != o["tick"]):
                assert stale
                self.desync += 1
                was = o["side"]
                self.remove(oid)
                if size:
                    self.place(oid, was if side == "N" else side, tick, size, ts)
            elif size == 0:
                self.remove(oid)
            elif self.evidence.get(oid, (0, None))[1] is not None:
                was = o["side"]
                self.remove(oid)
                self.place(oid, was, tick, size, ts)
            else:
                self.evidence.pop(oid, None)
                if tick == o["tick"] and size <= o["size"]:
                    o["size"] = size
                else:
                    self._unlink(oid)
                    o.update(tick=tick, size=size, snap=False)
                    self._link(oid)
        elif kind == "Fill":
            if o is None:
                self.unknown += 1
            elif side not in ("N", o["side"]) or (stale and side == "N"):
                assert stale
                self.desync += 1
            else:
                ev = self.evidence.setdefault(oid, [0, None, self.epoch])
                ev[0] += size
                if ev[1] is None and ev[0] >= o["size"]:
                    ev[1] = ts
        elif kind == "Gap":
            self.epoch += 1
            self.evidence = {k: v for k, v in self.evidence.items() if v[1] is not None}
        elif kind == "Clear":
            self.levels, self.orders, self.evidence, self.graves = {}, {}, {}, {}
        self.graves = {k: g for k, g in self.graves.items() if self.now - g[2] <= self.window}

    def state(self):
        out = {}
        for (side, tick), line in self.levels.items():
            ahead = 0
            for i, oid in enumerate(line):
                o = self.orders[oid]
                na = o["unavail"] or o["epoch"] < self.epoch
                out[oid] = (side, tick, o["size"], i + 1, ahead, "Unavailable" if na else "Known", o["reloads"], o["hidden"])
                ahead += o["size"]
        return out
