"""DuckDB SQL for the registered queries.

Written from the definitions, with plain windows and one recursive pass per
order, so that it shares no technique with the Spark side.  ``sql(name)`` glues
the common table expressions a body asks for in front of it."""

from __future__ import annotations

import re

TICK = 250000000

CTES: dict[str, str] = {}

CTES["b"] = """
SELECT event_id, epoch_us(ts) - CASE WHEN event_id % 41 = 0 THEN 2400000000 ELSE 0 END AS us,
       CAST(floor(value) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events"""

CTES["lives0"] = """
SELECT (event_id // 64) * 16 + event_id % 16 AS life,
       max(event_id) FILTER (s = 0) AS e0, max(us) FILTER (s = 0) AS u0, max(v) FILTER (s = 0) AS v0, max(k) FILTER (s = 0) AS k0,
       max(event_id) FILTER (s = 1) AS e1, max(us) FILTER (s = 1) AS u1, max(k) FILTER (s = 1) AS k1,
       max(event_id) FILTER (s = 2) AS e2, max(us) FILTER (s = 2) AS u2, max(k) FILTER (s = 2) AS k2,
       max(event_id) FILTER (s = 3) AS e3, max(us) FILTER (s = 3) AS u3, max(k) FILTER (s = 3) AS k3
FROM (SELECT *, (event_id % 64) // 16 AS s FROM b) GROUP BY 1"""

CTES["lives"] = """
SELECT *, CASE WHEN k2 % 5 = 0 THEN 1 ELSE s1 END AS f, CASE WHEN k2 % 4 = 3 THEN s1 ELSE s0 END AS rest,
       CASE WHEN own = 'B' THEN 'A' ELSE 'B' END AS other FROM (
  SELECT *, CASE WHEN k1 % 3 = 0 THEN greatest(1, s0 - 1) WHEN k1 % 3 = 1 THEN s0 + 2 ELSE s0 END AS s1,
         t0 + CASE WHEN k1 % 3 = 2 THEN 1 ELSE 0 END AS t1 FROM (
    SELECT *, CAST(CASE WHEN life % 8 < 4 THEN 1 WHEN life % 8 < 6 THEN 2 WHEN life % 8 < 7 THEN 3 ELSE 4 END AS BIGINT) AS inst,
           CASE WHEN (life // 8) % 2 = 0 THEN 'B' ELSE 'A' END AS own, 2 + v0 % 20 AS s0,
           CASE WHEN (life // 8) % 2 = 0 THEN -1 - k0 % 6 ELSE k0 % 6 END + 20000 + (life // 16) % 16 AS t0
    FROM lives0))"""

CTES["rows0"] = """
SELECT inst, e0 * 8 AS ordinal, u0 AS us, 'Add' AS kind, own AS side, s0 AS size, t0 AS tick, life + 1 AS order_id, 0 AS flags, u0 AS cu FROM lives WHERE e0 IS NOT NULL
UNION ALL SELECT inst, e1 * 8, u1, 'Modify', own, s1, t1, life + 1, 0, u1 FROM lives WHERE e1 IS NOT NULL
UNION ALL SELECT inst, e2 * 8, u2, 'Trade', CASE WHEN k2 % 11 = 0 THEN 'N' ELSE other END, CASE WHEN k2 % 13 = 0 THEN 0 ELSE f END, t1, life + 1, 0, u2 FROM lives WHERE e2 IS NOT NULL
UNION ALL SELECT inst, e2 * 8 + 1, u2, 'Fill', CASE WHEN k2 % 11 = 0 THEN 'N' ELSE own END, f, t1 + CASE WHEN k2 % 17 = 0 THEN 1 ELSE 0 END, life + 1, 0, u2 FROM lives WHERE e2 IS NOT NULL
UNION ALL SELECT inst, e2 * 8 + 2, u2 + 1, 'Cancel', own, s1, t1, life + 1, 0, u2 + 1 FROM lives WHERE e2 IS NOT NULL AND k2 % 2 = 0
UNION ALL SELECT inst, e2 * 8 + 3, u2 + 2, 'Add', own, s0, t1, life + 1, 0, u2 + 2 FROM lives WHERE e2 IS NOT NULL AND k2 % 2 = 0
UNION ALL SELECT inst, e2 * 8 + 2, u2 + 1, 'Modify', own, s0, t1, life + 1, 0, u2 + 1 FROM lives WHERE e2 IS NOT NULL AND k2 % 4 = 1
UNION ALL SELECT inst, e3 * 8, u3, 'Cancel', own, rest, t1, life + 1, 0, u3 FROM lives WHERE e3 IS NOT NULL AND life % 3 <> 0
UNION ALL SELECT inst, e3 * 8, u3, 'Cancel', own, 1, t1, life + 1, 0, u3 FROM lives WHERE e3 IS NOT NULL AND life % 3 = 0 AND rest > 1
UNION ALL SELECT inst, e3 * 8 + 1, u3, 'Cancel', own, rest, t1, life + 1, 0, u3 FROM lives WHERE e3 IS NOT NULL AND k3 % 7 = 0 AND life % 3 <> 0
UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END + n, event_id * 8 + 4, us, 'Gap', 'N', 0, 0, 0, 0, us FROM b, (SELECT unnest([0, 1]) AS n) WHERE event_id > 0 AND event_id % 997 = 0
UNION ALL SELECT 1, event_id * 8 + 5, us, 'Clear', 'N', 0, 0, 0, 0, us FROM b WHERE event_id > 0 AND event_id % 2503 = 0
UNION ALL SELECT 2, event_id * 8 + 5, us, 'Status', 'N', 1, 0, 0, 0, us FROM b WHERE event_id > 0 AND event_id % 701 = 0
UNION ALL SELECT 1 + (event_id // 500) % 4, event_id * 8 + 6, us - 86400000000, 'Clear', 'N', 0, 0, 0, 40, us FROM b WHERE event_id % 500 = 1
UNION ALL SELECT 1 + (event_id // 500) % 4, event_id * 8 + 7, us - 86400000000, 'Add', 'B', 5, 19990, 1000000000000 + event_id, 32, us FROM b WHERE event_id % 500 = 1
UNION ALL SELECT 1 + (event_id // 500) % 4, event_id * 8 + 6, us, 'Modify', 'B', 7, 19990, 1000000000000 + event_id - 32, 0, us FROM b WHERE event_id % 500 = 33"""

CTES["ev"] = f"""
SELECT CAST(inst AS BIGINT) AS instrument_id, CAST(CASE WHEN inst <= 2 THEN 0 ELSE 1 END AS BIGINT) AS channel_id,
       'day-' || strftime(d, '%Y%m%d') AS source_file, ordinal, us * 1000 AS ts_ns,
       CASE WHEN kind = 'Gap' OR flags >= 32 THEN 0 ELSE ordinal + 1 END AS seq, kind, side, flags, flags >= 32 AS is_snapshot,
       CAST(size AS BIGINT) AS size, CAST(tick AS BIGINT) AS tick, CAST(tick AS BIGINT) * {TICK} AS price, CAST(order_id AS BIGINT) AS order_id,
       CASE WHEN kind = 'Gap' THEN ordinal END AS gap_expected, CASE WHEN kind = 'Gap' THEN ordinal - 800 END AS gap_observed,
       d AS trade_date
FROM (SELECT *, CAST(timezone('America/Chicago', make_timestamptz(cu)) + INTERVAL 7 HOUR AS DATE) AS d FROM rows0)"""

CTES["tsn"] = """
SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, CAST(timezone('America/Chicago', timezone('UTC', ts)) + INTERVAL 7 HOUR AS DATE) AS trade_date FROM events"""

_CLOCK = """
SELECT trade_date, epoch_us(timezone('America/Chicago', CAST(trade_date AS TIMESTAMP) - INTERVAL 7 HOUR)) * 1000 AS session_open_ns,
       epoch_us(timezone('America/Chicago', CAST(trade_date AS TIMESTAMP) + INTERVAL 510 MINUTE)) * 1000 AS rth_open_ns,
       epoch_us(timezone('America/Chicago', CAST(trade_date AS TIMESTAMP) + INTERVAL 15 HOUR)) * 1000 AS rth_close_ns,
       epoch_us(timezone('America/Chicago', CAST(trade_date AS TIMESTAMP) + INTERVAL 16 HOUR)) * 1000 AS eth_end_ns,
       epoch_us(timezone('America/Chicago', CAST(trade_date AS TIMESTAMP) + INTERVAL 17 HOUR)) * 1000 AS session_end_ns
FROM (SELECT DISTINCT trade_date FROM {src})"""
_CAL = "SELECT *, (rth_open_ns - session_open_ns) // 1800000000000 AS rth_offset FROM ({clock})"
CTES["cal"] = _CAL.format(clock=_CLOCK.format(src="ev"))
CTES["calt"] = _CAL.format(clock=_CLOCK.format(src="tsn"))

K = "instrument_id, trade_date"

CTES["se"] = f"""
SELECT *, CASE WHEN in_lettering THEN coalesce(max(eth_period) OVER (PARTITION BY {K} ORDER BY ordinal), 0) END AS dev_period,
       coalesce(max(eth_period) OVER (PARTITION BY {K}), 0) AS current_period
FROM (SELECT ev.*, session_open_ns, eth_end_ns, rth_offset, ts_ns < eth_end_ns AS in_lettering,
             CASE WHEN ts_ns < eth_end_ns THEN (ts_ns - session_open_ns) // 1800000000000 END AS eth_period
      FROM ev JOIN cal USING (trade_date) WHERE NOT is_snapshot AND ts_ns >= session_open_ns AND ts_ns < session_end_ns)"""

CTES["sr"] = """
SELECT *, CASE WHEN dev_period - rth_offset BETWEEN 0 AND 12 THEN dev_period - rth_offset END AS rth_period FROM se"""

CTES["tr"] = "SELECT * FROM sr WHERE kind = 'Trade' AND size > 0 AND tick IS NOT NULL"

CTES["pr"] = f"""
SELECT {K}, tick, sum(size)::BIGINT AS volume, coalesce(sum(size) FILTER (side = 'B'), 0)::BIGINT AS buy_volume,
       coalesce(sum(size) FILTER (side = 'A'), 0)::BIGINT AS sell_volume,
       coalesce(sum(size) FILTER (in_lettering AND dev_period = current_period), 0)::BIGINT AS period_volume,
       coalesce(bit_or(1::BIGINT << dev_period::INT) FILTER (in_lettering), 0)::BIGINT AS eth_bits,
       coalesce(bit_or(1::BIGINT << rth_period::INT) FILTER (rth_period IS NOT NULL), 0)::BIGINT AS rth_bits, max(ordinal) AS last_ord
FROM tr GROUP BY ALL"""

CTES["poc"] = f"""
SELECT {K}, tick AS vpoc, volume AS vpoc_volume FROM pr QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY volume DESC, last_ord) = 1"""

CTES["span"] = f"SELECT {K}, min(tick) AS lo, max(tick) AS hi, sum(volume)::BIGINT AS total FROM pr GROUP BY ALL"

CTES["dense"] = f"""
SELECT g.instrument_id, g.trade_date, g.tick, coalesce(volume, 0) AS volume, coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume,
       coalesce(period_volume, 0) AS period_volume, coalesce(eth_bits, 0) AS eth_bits, coalesce(rth_bits, 0) AS rth_bits
FROM (SELECT {K}, unnest(range(lo, hi + 1)) AS tick FROM span) g LEFT JOIN pr USING (instrument_id, trade_date, tick)"""

# value area: the expansion spelled out as one recursive step per added pair
CTES["va"] = f"""
SELECT {K}, arg_max(a_lo, n) AS val, arg_max(a_hi, n) AS vah, max(acc)::BIGINT AS area_volume FROM va_steps GROUP BY ALL"""
CTES["va_steps"] = f"""
SELECT s.instrument_id, s.trade_date, lo, hi, total, (total * 70 + 99) // 100 AS target, vpoc AS a_lo, vpoc AS a_hi, vpoc_volume AS acc, 0 AS n
FROM span s JOIN poc USING (instrument_id, trade_date)
UNION ALL
SELECT instrument_id, trade_date, lo, hi, total, target, CASE WHEN up_wins THEN a_lo ELSE greatest(a_lo - 2, lo) END,
       CASE WHEN up_wins THEN least(a_hi + 2, hi) ELSE a_hi END, acc + CASE WHEN up_wins THEN up ELSE down END, n + 1
FROM (SELECT *, CASE WHEN a_hi = hi THEN false WHEN a_lo = lo THEN true ELSE up >= down END AS up_wins
      FROM (SELECT v.*, (SELECT coalesce(sum(volume), 0)::BIGINT FROM dense d WHERE d.instrument_id = v.instrument_id AND d.trade_date = v.trade_date AND d.tick IN (a_hi + 1, a_hi + 2)) AS up,
                   (SELECT coalesce(sum(volume), 0)::BIGINT FROM dense d WHERE d.instrument_id = v.instrument_id AND d.trade_date = v.trade_date AND d.tick IN (a_lo - 1, a_lo - 2)) AS down
            FROM va_steps v WHERE acc < target AND NOT (a_lo = lo AND a_hi = hi)))"""

CTES["st"] = f"""
SELECT {K}, min(tick) FILTER (rth_period IN (0, 1)) AS ib_low, max(tick) FILTER (rth_period IN (0, 1)) AS ib_high, min(tick) AS low, max(tick) AS high,
       arg_min(tick, ordinal) AS open, sum(size)::BIGINT AS total_volume,
       coalesce(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size END) FILTER (in_lettering), 0)::BIGINT AS delta FROM tr GROUP BY ALL"""

CTES["path"] = f"""
SELECT {K}, ordinal, dev_period, tick, side, size, CASE side WHEN 'B' THEN size ELSE -size END AS signed,
       (sum(CASE side WHEN 'B' THEN size ELSE -size END) OVER (PARTITION BY {K} ORDER BY ordinal))::BIGINT AS cvd
FROM tr WHERE in_lettering AND side IN ('B', 'A')"""

CTES["bars"] = f"""
SELECT *, greatest(open, coalesce(h, open)) AS high, least(open, coalesce(l, open)) AS low, coalesce(cl, open) AS close
FROM (SELECT g.instrument_id, g.trade_date, g.period, h, l, cl,
             coalesce(last_value(cl IGNORE NULLS) OVER (PARTITION BY g.instrument_id, g.trade_date ORDER BY g.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
      FROM (SELECT {K}, unnest(range(0, max(dev_period) + 1)) AS period FROM path GROUP BY {K}) g
      LEFT JOIN (SELECT {K}, dev_period AS period, max(cvd) AS h, min(cvd) AS l, arg_max(cvd, ordinal) AS cl FROM path GROUP BY ALL) p USING (instrument_id, trade_date, period))"""

CTES["cnt"] = f"""
SELECT {K}, max(current_period) AS current_period, coalesce(bool_or(kind = 'Gap' AND in_lettering AND dev_period = current_period), false) AS period_gap,
       count(*) FILTER (NOT in_lettering) AS post_close_events, count(*) FILTER (eth_period < dev_period) AS backward_events,
       count(*) FILTER (kind = 'Trade' AND size = 0) AS zero_size_trades FROM se GROUP BY ALL"""


def _touch(src: str, key: str) -> str:
    """Islands of equal tick per counter."""
    return f"""
SELECT *, (sum(size) OVER (PARTITION BY {K}, counter, isl ORDER BY ordinal))::BIGINT AS run,
       min(ordinal) OVER (PARTITION BY {K}, counter, isl) AS since
FROM (SELECT *, sum(chg) OVER (PARTITION BY {K}, counter ORDER BY ordinal) AS isl
      FROM (SELECT {K}, ordinal, tick, size, {key} AS counter,
                   CASE WHEN lag(tick) OVER (PARTITION BY {K}, {key} ORDER BY ordinal) = tick THEN 0 ELSE 1 END AS chg FROM {src}))"""


CTES["touch"] = _touch("path", "CASE side WHEN 'B' THEN 'cA' ELSE 'cB' END")

# ---- raw rows -------------------------------------------------------------

CTES["raw0"] = """
SELECT *, event_id % 61 = 7 AS snap, us // 86400000000 AS file_no, CAST(CASE WHEN event_id % 8 < 4 THEN 1 WHEN event_id % 8 < 6 THEN 2 WHEN event_id % 8 < 7 THEN 3 ELSE 4 END AS BIGINT) AS inst,
       CASE WHEN event_id % 61 = 7 THEN CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'R' END WHEN event_id % 199 = 0 THEN 'R' WHEN event_id % 211 = 0 THEN 'N'
            WHEN k % 5 = 0 THEN 'A' WHEN k % 5 = 1 THEN 'C' WHEN k % 5 = 2 THEN 'M' WHEN k % 5 = 3 THEN 'T' ELSE 'F' END AS action FROM b"""

CTES["raw"] = f"""
SELECT 'utc-' || strftime(DATE '1970-01-01' + CAST(file_no AS INT), '%Y%m%d') AS source_file, file_no - 19000 AS file_rank, event_id AS row_index,
       CASE WHEN snap THEN us * 1000 - 86400000000000 ELSE us * 1000 END AS ts_event, us * 1000 + 350 AS ts_recv, inst AS instrument_id,
       CAST(CASE WHEN inst <= 2 THEN 0 ELSE 1 END AS BIGINT) AS channel_id,
       CASE WHEN snap THEN event_id % 7 WHEN event_id % 301 = 0 THEN 0 WHEN event_id % 97 = 0 THEN event_id - 50
            ELSE event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END + 100 END AS sequence,
       action, CASE WHEN event_id % 227 = 0 THEN 'X' WHEN action = 'R' THEN 'N' WHEN v % 2 = 0 THEN 'B' ELSE 'A' END AS side,
       CASE WHEN event_id % 223 = 0 OR action = 'R' THEN 9223372036854775807 ELSE (20000 + k % 12) * {TICK} + CASE WHEN event_id % 229 = 0 THEN 1 ELSE 0 END END AS price,
       CASE WHEN action = 'R' OR event_id % 233 = 0 THEN 4294967295 ELSE 1 + v % 9 END AS size,
       CASE WHEN action = 'R' THEN 0 ELSE 1 + event_id // 4 END AS order_id, CAST(CASE WHEN snap THEN 32 ELSE 0 END AS BIGINT) AS flags
FROM raw0"""

CTES["mp"] = """
SELECT * EXCLUDE (price, size), ts_event AS ts_ns, sequence AS seq, flags >= 32 AS is_snapshot,
       CASE WHEN kind = 'Clear' AND price = 9223372036854775807 THEN 0 ELSE price END AS price,
       CASE WHEN kind = 'Clear' AND size = 4294967295 THEN 0 ELSE size END AS size,
       CASE WHEN kind IS NULL THEN 'unmappable_action' WHEN side NOT IN ('B', 'A', 'N') THEN 'unmappable_side'
            WHEN price = 9223372036854775807 AND kind <> 'Clear' THEN 'undefined_price' WHEN size = 4294967295 AND kind <> 'Clear' THEN 'undefined_size' END AS reject
FROM (SELECT *, CASE action WHEN 'A' THEN 'Add' WHEN 'C' THEN 'Cancel' WHEN 'M' THEN 'Modify' WHEN 'T' THEN 'Trade' WHEN 'F' THEN 'Fill' WHEN 'R' THEN 'Clear' END AS kind FROM rawn)"""

CTES["rawn"] = "SELECT *, row_number() OVER (ORDER BY file_rank, row_index) - 1 AS ordinal FROM raw"

CTES["ok"] = "SELECT * FROM mp WHERE reject IS NULL"

CTES["sq"] = """
SELECT *, CASE WHEN counted AND seq < last THEN last + 1 END AS gx, coalesce(counted AND seq > last + 1, false) AS forward_hole,
       CAST(timezone('America/Chicago', make_timestamptz(ts_ns // 1000)) + INTERVAL 7 HOUR AS DATE) AS own_date
FROM (SELECT *, last_value(CASE WHEN counted THEN seq END IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
      FROM (SELECT *, NOT is_snapshot AND seq <> 0 AS counted FROM ok))"""

CTES["fd"] = "SELECT source_file, arg_min(own_date, ordinal) FILTER (NOT is_snapshot) AS file_date, count(*) FILTER (is_snapshot) AS snapshot_rows FROM sq GROUP BY 1"

CTES["cn"] = """
SELECT instrument_id, channel_id, source_file, ordinal * 2 AS ordinal, ts_ns, seq, kind, side, flags, is_snapshot, size, price, order_id,
       NULL::BIGINT AS gap_expected, NULL::BIGINT AS gap_observed, CASE WHEN is_snapshot THEN file_date ELSE own_date END AS trade_date, forward_hole
FROM sq LEFT JOIN fd USING (source_file)
UNION ALL
SELECT 0, channel_id, source_file, ordinal * 2 - 1, ts_ns, 0, 'Gap', 'N', 0, false, 0, 0, 0, gx, seq, own_date, false FROM sq WHERE gx IS NOT NULL"""

# ---- order fold -----------------------------------------------------------

CTES["sc"] = f"""
SELECT *, (coalesce(sum(CASE WHEN kind = 'Gap' THEN 1 ELSE 0 END) OVER w, 0))::BIGINT AS epoch,
       (coalesce(sum(CASE WHEN kind = 'Clear' AND NOT is_snapshot THEN 1 ELSE 0 END) OVER w, 0))::BIGINT AS clear_no,
       max(CASE WHEN NOT is_snapshot THEN ts_ns END) OVER w AS now_before
FROM ev WINDOW w AS (PARTITION BY {K} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

CTES["fi"] = f"""
SELECT *, row_number() OVER (PARTITION BY {K}, order_id ORDER BY ordinal) AS rn
FROM (SELECT {K}, order_id, ordinal, ts_ns, CASE WHEN is_snapshot THEN 'Snapshot' ELSE kind END AS kind, side, tick, size, epoch, clear_no, now_before
      FROM sc WHERE tick IS NOT NULL AND ((is_snapshot AND kind = 'Add') OR (NOT is_snapshot AND kind IN ('Add', 'Cancel', 'Modify', 'Fill'))))"""

_ST = ["live", "o_side", "o_tick", "o_size", "o_epoch", "o_origin", "o_prio", "rel", "hid", "unav", "fq", "fdone", "fep", "fseen",
       "t_side", "t_tick", "t_ts", "t_epoch", "t_rel", "t_hid"]
_EFF = ["changed", "act", "c_side", "c_tick", "cancelled", "a_side", "a_tick", "added", "traded", "refreshed", "depletes", "off_display"]

# One step: previous state x next event of the order -> new state and effects.
_STEP = """
SELECT instrument_id, trade_date, order_id, ordinal, ts_ns, kind, side, tick, size, epoch, clear_no, now_before, rn,
  CASE WHEN puts OR act IN ('reduce', 'shrink', 'grow', 'move', 'snap_load') THEN true WHEN drops THEN false ELSE L END AS live,
  CASE WHEN puts THEN p_side WHEN act = 'snap_load' THEN side ELSE o_side END AS o_side,
  CASE WHEN puts OR act IN ('snap_load', 'move', 'grow', 'shrink') THEN tick ELSE o_tick END AS o_tick,
  CASE WHEN puts OR act IN ('snap_load', 'move', 'grow', 'shrink') THEN size WHEN act = 'reduce' THEN o_size - size ELSE o_size END AS o_size,
  CASE WHEN puts OR act = 'snap_load' THEN epoch ELSE o_epoch END AS o_epoch,
  CASE WHEN puts OR act IN ('move', 'grow') THEN 1 WHEN act = 'snap_load' THEN 0 ELSE o_origin END AS o_origin,
  CASE WHEN puts OR act IN ('move', 'grow', 'snap_load') THEN ordinal ELSE o_prio END AS o_prio,
  CASE WHEN puts THEN CASE WHEN matched AND p_epoch = epoch THEN p_rel + 1 WHEN matched THEN p_rel ELSE 0 END
       WHEN act = 'snap_load' THEN CASE WHEN tts IS NOT NULL THEN t_rel ELSE 0 END WHEN drops THEN 0 ELSE rel END AS rel,
  CASE WHEN puts THEN CASE WHEN matched AND p_epoch = epoch THEN p_hid + size WHEN matched THEN p_hid ELSE 0 END
       WHEN act = 'snap_load' THEN CASE WHEN tts IS NOT NULL THEN t_hid ELSE 0 END WHEN drops THEN 0 ELSE hid END AS hid,
  CASE WHEN puts THEN matched AND p_epoch <> epoch WHEN act = 'snap_load' THEN true WHEN drops THEN false ELSE unav END AS unav,
  CASE WHEN act = 'fill' THEN F + size WHEN puts OR drops OR act IN ('reduce', 'shrink', 'grow', 'move', 'snap_load') THEN 0 ELSE F END AS fq,
  CASE WHEN act = 'fill' AND FD IS NULL AND F + size >= o_size THEN ts_ns
       WHEN puts OR drops OR act IN ('reduce', 'shrink', 'grow', 'move', 'snap_load') THEN NULL ELSE FD END AS fdone,
  CASE WHEN act = 'fill' AND F = 0 THEN epoch ELSE fep END AS fep, CASE WHEN act = 'fill' THEN epoch ELSE fseen END AS fseen,
  CASE WHEN drops AND NOT puts AND FD IS NOT NULL THEN o_side ELSE t_side END AS t_side,
  CASE WHEN drops AND NOT puts AND FD IS NOT NULL THEN o_tick ELSE t_tick END AS t_tick,
  CASE WHEN puts OR act IN ('tomb_cancel', 'snap_load') THEN NULL WHEN drops THEN FD ELSE tts END AS t_ts,
  CASE WHEN drops AND NOT puts AND FD IS NOT NULL THEN fep ELSE t_epoch END AS t_epoch,
  CASE WHEN drops AND NOT puts AND FD IS NOT NULL THEN rel ELSE t_rel END AS t_rel,
  CASE WHEN drops AND NOT puts AND FD IS NOT NULL THEN hid ELSE t_hid END AS t_hid,
  (puts OR drops OR act IN ('reduce', 'shrink', 'grow', 'move', 'snap_load') OR was_reset) AS changed, act,
  CASE WHEN gone > 0 THEN o_side ELSE 'N' END AS c_side, CASE WHEN gone > 0 THEN o_tick ELSE 0 END AS c_tick, gone AS cancelled,
  CASE WHEN act LIKE 'fill%' THEN CASE WHEN side = 'N' AND L THEN o_side ELSE side END WHEN puts THEN p_side WHEN act IN ('grow', 'move') THEN o_side ELSE 'N' END AS a_side,
  CASE WHEN act LIKE 'fill%' OR puts OR act IN ('grow', 'move') THEN tick ELSE 0 END AS a_tick,
  CASE WHEN puts OR act = 'move' THEN size WHEN act = 'grow' THEN size - o_size ELSE 0 END AS added,
  CASE WHEN act LIKE 'fill%' THEN size ELSE 0 END AS traded, CASE WHEN puts AND matched AND p_epoch = epoch THEN size END AS refreshed,
  act = 'fill' AND FD IS NULL AND F + size >= o_size AS depletes, act = 'fill' AND tick <> o_tick AS off_display
FROM (SELECT *, coalesce(p_ts IS NOT NULL AND p_pside = p_side AND p_tick = tick AND ts_ns - p_ts <= {window}, false) AS matched FROM (
  SELECT *, act IN ('place', 'place_desync', 'place_dup', 'place_tomb', 'replace_depleted', 'desync_replace') AS puts,
    act IN ('remove', 'desync_cancel', 'desync_remove', 'replace_depleted', 'desync_replace') AS drops,
    CASE WHEN act IN ('remove', 'desync_cancel', 'desync_remove', 'desync_replace', 'move') THEN o_size WHEN act = 'reduce' THEN size WHEN act = 'shrink' THEN o_size - size ELSE 0 END AS gone,
    CASE WHEN act = 'replace_depleted' OR (act = 'desync_replace' AND side = 'N') THEN o_side WHEN act = 'place_tomb' AND side = 'N' THEN t_side ELSE side END AS p_side,
    CASE WHEN act IN ('place', 'place_tomb') THEN tts WHEN act IN ('replace_depleted', 'desync_replace') THEN FD END AS p_ts,
    CASE WHEN act IN ('place', 'place_tomb') THEN t_side ELSE o_side END AS p_pside, CASE WHEN act IN ('place', 'place_tomb') THEN t_tick ELSE o_tick END AS p_tick,
    CASE WHEN act IN ('place', 'place_tomb') THEN t_epoch ELSE fep END AS p_epoch, CASE WHEN act IN ('place', 'place_tomb') THEN t_rel ELSE rel END AS p_rel,
    CASE WHEN act IN ('place', 'place_tomb') THEN t_hid ELSE hid END AS p_hid
  FROM (SELECT *, CASE
      WHEN kind = 'Add' THEN CASE WHEN side = 'N' OR size <= 0 THEN 'bad' WHEN L AND stale THEN 'place_desync' WHEN L THEN 'place_dup' ELSE 'place' END
      WHEN kind = 'Snapshot' THEN CASE WHEN side = 'N' OR size <= 0 THEN 'bad' WHEN L AND side = o_side AND tick = o_tick AND size = o_size THEN 'snap_known' WHEN L THEN 'bad' ELSE 'snap_load' END
      WHEN kind = 'Cancel' AND NOT L THEN CASE WHEN tts IS NOT NULL THEN 'tomb_cancel' ELSE 'unknown' END
      WHEN kind = 'Cancel' THEN CASE WHEN size <= 0 THEN 'bad' WHEN side NOT IN ('N', o_side) OR tick <> o_tick OR size > o_size THEN CASE WHEN stale THEN 'desync_cancel' ELSE 'bad' END
           WHEN size < o_size THEN 'reduce' ELSE 'remove' END
      WHEN kind = 'Modify' AND NOT L THEN CASE WHEN tts IS NULL THEN 'unknown' WHEN size = 0 THEN 'tomb_cancel' ELSE 'place_tomb' END
      WHEN kind = 'Modify' THEN CASE WHEN side NOT IN ('N', o_side) OR (size = 0 AND tick <> o_tick) THEN CASE WHEN NOT stale THEN 'bad' WHEN size = 0 THEN 'desync_remove' ELSE 'desync_replace' END
           WHEN size = 0 THEN 'remove' WHEN FD IS NOT NULL THEN 'replace_depleted' WHEN tick <> o_tick THEN 'move' WHEN size <= o_size THEN 'shrink' ELSE 'grow' END
      ELSE CASE WHEN size <= 0 OR (L AND side NOT IN ('N', o_side) AND NOT stale) THEN 'bad' WHEN NOT L THEN 'fill_unknown'
           WHEN side NOT IN ('N', o_side) OR (stale AND side = 'N') THEN 'fill_desync' ELSE 'fill' END END AS act
    FROM (SELECT *, L AND o_epoch < epoch AS stale FROM (
      SELECT i.*, {prev}, p_live AND p_clear <> i.clear_no AS was_reset, p_live AND p_clear = i.clear_no AS L,
        CASE WHEN p_clear <> i.clear_no OR (p_fdone IS NULL AND p_fseen <> i.epoch) THEN 0 ELSE p_fq END AS F,
        CASE WHEN p_clear <> i.clear_no THEN NULL ELSE p_fdone END AS FD,
        CASE WHEN p_clear <> i.clear_no OR i.now_before - p_t_ts > {window} THEN NULL ELSE p_t_ts END AS tts
      FROM ({source}) i)))))"""

_RAW_PREV = ", ".join(f"p_{s} AS {s}" for s in _ST if s not in ("live", "fq", "fdone", "t_ts"))
_BLANK = ("false AS p_live, 'N' AS p_o_side, 0::BIGINT AS p_o_tick, 0::BIGINT AS p_o_size, 0::BIGINT AS p_o_epoch, 1 AS p_o_origin, 0::BIGINT AS p_o_prio, "
          "0::BIGINT AS p_rel, 0::BIGINT AS p_hid, false AS p_unav, 0::BIGINT AS p_fq, NULL::BIGINT AS p_fdone, 0::BIGINT AS p_fep, 0::BIGINT AS p_fseen, "
          "'N' AS p_t_side, 0::BIGINT AS p_t_tick, NULL::BIGINT AS p_t_ts, 0::BIGINT AS p_t_epoch, 0::BIGINT AS p_t_rel, 0::BIGINT AS p_t_hid, clear_no AS p_clear")


def _fold(name: str, window: int) -> str:
    seed = _STEP.format(window=window, prev=_RAW_PREV, source=f"SELECT *, {_BLANK} FROM fi WHERE rn = 1")
    carry = ", ".join(f"q.{s} AS p_{s}" for s in _ST)
    nxt = _STEP.format(window=window, prev=_RAW_PREV, source=(
        f"SELECT n.*, {carry}, q.clear_no AS p_clear FROM {name} q JOIN fi n ON n.instrument_id = q.instrument_id "
        "AND n.trade_date = q.trade_date AND n.order_id = q.order_id AND n.rn = q.rn + 1"))
    return f"{seed}\nUNION ALL\n{nxt}"


CTES["fo"] = _fold("fo", 1000000)
CTES["fow"] = _fold("fow", 1500)
RECURSIVE = {"fo", "fow", "va_steps"}

CTES["lg"] = f"""
SELECT *, changed AND live AS opens, greatest(coalesce(now_before, ts_ns), CASE WHEN kind = 'Snapshot' THEN coalesce(now_before, ts_ns) ELSE ts_ns END) AS now_ns,
       CASE WHEN changed AND live THEN coalesce(nxt, 9223372036854775807) ELSE 0 END AS to_ord
FROM (SELECT f.*, (SELECT min(g.ordinal) FROM fo g WHERE g.instrument_id = f.instrument_id AND g.trade_date = f.trade_date AND g.order_id = f.order_id AND g.ordinal > f.ordinal AND g.changed) AS nxt
      FROM fo f)"""

CTES["st0"] = """
SELECT *, CASE WHEN opens THEN o_side ELSE 'N' END AS s_side, CASE WHEN opens THEN o_tick ELSE 0 END AS s_tick, CASE WHEN opens THEN o_size ELSE 0 END AS s_size,
       CAST(CASE WHEN opens THEN o_origin ELSE 0 END AS BIGINT) AS s_origin, CASE WHEN opens THEN o_prio ELSE 0 END AS s_prio FROM lg"""

CTES["cut0"] = f"""
SELECT {K}, coalesce(min(ordinal) FILTER (ts_ns > rth_close_ns) - 1, max(ordinal)) AS cut_ord FROM ev JOIN cal USING (trade_date) GROUP BY ALL"""
CTES["cut"] = f"""
SELECT c.instrument_id, c.trade_date, c.cut_ord, count(*) FILTER (kind = 'Gap') AS epoch, count(*) FILTER (kind = 'Clear' AND NOT is_snapshot) AS clear_no,
       max(ts_ns) FILTER (NOT is_snapshot) AS now_ns, arg_max(gap_expected, ordinal) FILTER (kind = 'Gap') AS gap_expected,
       arg_max(gap_observed, ordinal) FILTER (kind = 'Gap') AS gap_observed, coalesce(max(ordinal) FILTER (kind = 'Gap') > coalesce(max(ordinal) FILTER (seq > 0), -1), false) AS gap_pending,
       arg_max(seq, ordinal) FILTER (seq > 0) AS seq0
FROM cut0 c LEFT JOIN ev e ON e.instrument_id = c.instrument_id AND e.trade_date = c.trade_date AND e.ordinal <= c.cut_ord GROUP BY ALL"""

CTES["mpt"] = f"""
SELECT {K}, session_open_ns + i * 82800000000 AS at_ns FROM (SELECT DISTINCT {K}, session_open_ns FROM ev JOIN cal USING (trade_date)), range(1000) AS r(i)"""
CTES["mc0"] = f"""
SELECT {K}, at_ns, coalesce(min(ordinal) FILTER (ts_ns > at_ns) - 1, max(ordinal)) AS cut_ord FROM mpt JOIN ev USING (instrument_id, trade_date) GROUP BY ALL"""
CTES["mc"] = f"""
SELECT c.instrument_id, c.trade_date, c.at_ns, c.cut_ord, count(*) FILTER (kind = 'Gap') AS epoch, count(*) FILTER (kind = 'Clear' AND NOT is_snapshot) AS clear_no,
       count(*) FILTER (kind = 'Clear' AND is_snapshot) AS snapshot_clears, count(e.ordinal) AS events,
       max(ts_ns) FILTER (NOT is_snapshot) AS now_ns, arg_max(gap_expected, ordinal) FILTER (kind = 'Gap') AS gap_expected,
       arg_max(gap_observed, ordinal) FILTER (kind = 'Gap') AS gap_observed, coalesce(max(ordinal) FILTER (kind = 'Gap') > coalesce(max(ordinal) FILTER (seq > 0), -1), false) AS gap_pending,
       arg_max(seq, ordinal) FILTER (seq > 0) AS seq0
FROM mc0 c LEFT JOIN ev e ON e.instrument_id = c.instrument_id AND e.trade_date = c.trade_date AND e.ordinal <= c.cut_ord GROUP BY ALL"""

CTES["lv"] = f"""
SELECT l.*, c.epoch AS g_epoch, l.unav OR l.o_epoch < c.epoch AS na FROM lg l JOIN cut c USING (instrument_id, trade_date)
WHERE l.opens AND l.ordinal <= c.cut_ord AND l.to_ord > c.cut_ord AND l.clear_no = c.clear_no"""

CTES["dp"] = f"SELECT {K}, o_side AS side, o_tick AS tick, sum(o_size)::BIGINT AS total_size, count(*) AS order_count FROM lv GROUP BY ALL"
CTES["bb"] = f"SELECT {K}, max(tick) FILTER (side = 'B') AS best_bid, min(tick) FILTER (side = 'A') AS best_ask FROM dp GROUP BY ALL"
CTES["qu"] = f"""
SELECT {K}, o_side AS side, o_tick AS tick, order_id, o_size AS size, o_origin, row_number() OVER w - 1 AS orders_ahead,
       (coalesce(sum(o_size) OVER (PARTITION BY {K}, o_side, o_tick ORDER BY o_origin, o_prio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS contracts_ahead,
       row_number() OVER w AS queue_rank FROM lv WINDOW w AS (PARTITION BY {K}, o_side, o_tick ORDER BY o_origin, o_prio)"""
CTES["fl"] = f"SELECT {K}, order_id, ordinal, ts_ns, a_side AS side, a_tick AS tick, traded AS size, CASE a_side WHEN 'B' THEN 'A' WHEN 'A' THEN 'B' ELSE 'N' END AS aggressor, off_display, act = 'fill_unknown' AS unknown_ref FROM lg WHERE act LIKE 'fill%'"
CTES["fx"] = f"""
SELECT {K}, ordinal, ts_ns, clear_no, c_side AS side, c_tick AS tick, 0::BIGINT AS added, cancelled, 0::BIGINT AS traded FROM lg WHERE cancelled > 0
UNION ALL SELECT {K}, ordinal, ts_ns, clear_no, a_side, a_tick, added, 0, traded FROM lg WHERE (added > 0 OR traded > 0) AND a_side <> 'N'"""
CTES["fb"] = f"""
SELECT {K}, clear_no, side, tick, bucket, sum(added)::BIGINT AS added, sum(cancelled)::BIGINT AS cancelled, sum(traded)::BIGINT AS traded
FROM (SELECT *, max(ts_ns // 500000000) OVER (PARTITION BY {K}, clear_no, side, tick ORDER BY ordinal) AS bucket FROM fx) GROUP BY ALL"""
CTES["fxc"] = f"""
SELECT {K}, side, tick, sum(added)::BIGINT AS added_5s, sum(cancelled)::BIGINT AS cancelled_5s, sum(traded)::BIGINT AS traded_5s
FROM (SELECT f.*, c.now_ns, max(ts_ns // 500000000) OVER (PARTITION BY f.instrument_id, f.trade_date, side, tick ORDER BY ordinal) AS bucket FROM fx f JOIN cut c USING (instrument_id, trade_date)
      WHERE f.ordinal <= c.cut_ord AND f.clear_no = c.clear_no) WHERE bucket > now_ns // 500000000 - 10 GROUP BY ALL"""
CTES["rf"] = f"SELECT {K}, order_id, ordinal, a_side AS side, a_tick AS tick, refreshed AS hidden_size, rel AS reloads FROM lg WHERE refreshed IS NOT NULL"
CTES["ft"] = _touch("(SELECT * FROM fl WHERE side <> 'N')", "CASE side WHEN 'B' THEN 'cB' ELSE 'cA' END")
CTES["ftc"] = _touch("(SELECT fl.* FROM fl JOIN cut USING (instrument_id, trade_date) WHERE side <> 'N' AND ordinal <= cut_ord)", "CASE side WHEN 'B' THEN 'cB' ELSE 'cA' END")
CTES["lp"] = f"SELECT {K}, arg_max(tick, ordinal) AS last_tick FROM fl JOIN cut USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL"
CTES["ins"] = f"SELECT {K}, best_bid, best_ask, last_tick FROM cut LEFT JOIN bb USING (instrument_id, trade_date) LEFT JOIN lp USING (instrument_id, trade_date)"


def _points(step: int) -> str:
    return f"""
SELECT {K}, (now_ns - session_open_ns) // {step} AS bucket, max(ordinal) AS cut_ord, max(clear_no) AS clear_no
FROM (SELECT sc.*, session_open_ns, coalesce(greatest(now_before, CASE WHEN NOT is_snapshot THEN ts_ns END), now_before, CASE WHEN NOT is_snapshot THEN ts_ns END) AS now_ns FROM (
        SELECT * REPLACE (clear_no + CASE WHEN kind = 'Clear' AND NOT is_snapshot THEN 1 ELSE 0 END AS clear_no) FROM sc) sc JOIN cal USING (trade_date))
WHERE now_ns IS NOT NULL GROUP BY ALL"""


CTES["pt"] = _points(60000000000)
CTES["pt10"] = _points(600000000000)

LADDER = ["bid_size", "ask_size", "bid_orders", "ask_orders", "session_volume", "cb", "ca", "bid_added_5s", "bid_cancelled_5s", "ask_added_5s",
          "ask_cancelled_5s", "refresh_bid_count", "refresh_ask_count", "refresh_bid_hidden", "refresh_ask_hidden"]

CTES["lad"] = f"""
WITH g AS (SELECT {K}, unnest(range(c - 20, c + 20)) AS tick FROM (SELECT *, coalesce((best_bid + best_ask) // 2, best_bid, best_ask, last_tick, 0) AS c FROM ins)),
 v AS (SELECT {K}, tick, sum(size)::BIGINT AS vol FROM tr JOIN cut USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL),
 t AS (SELECT {K}, counter, tick, run FROM ftc QUALIFY row_number() OVER (PARTITION BY {K}, counter ORDER BY ordinal DESC) = 1),
 r AS (SELECT {K}, side, tick, count(*) AS n, sum(hidden_size)::BIGINT AS h FROM rf JOIN cut USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL)
SELECT g.instrument_id, g.trade_date, g.tick, coalesce(db.total_size, 0) AS bid_size, coalesce(da.total_size, 0) AS ask_size, coalesce(db.order_count, 0) AS bid_orders,
 coalesce(da.order_count, 0) AS ask_orders, coalesce(vol, 0) AS session_volume, coalesce(tb.run, 0) AS cb, coalesce(ta.run, 0) AS ca, coalesce(xb.added_5s, 0) AS bid_added_5s,
 coalesce(xb.cancelled_5s, 0) AS bid_cancelled_5s, coalesce(xa.added_5s, 0) AS ask_added_5s, coalesce(xa.cancelled_5s, 0) AS ask_cancelled_5s, coalesce(rb.n, 0) AS refresh_bid_count,
 coalesce(ra.n, 0) AS refresh_ask_count, coalesce(rb.h, 0) AS refresh_bid_hidden, coalesce(ra.h, 0) AS refresh_ask_hidden
FROM g LEFT JOIN v USING (instrument_id, trade_date, tick)
""" + "".join(f"LEFT JOIN (SELECT * FROM {src} WHERE {cond}) {a} ON {a}.instrument_id = g.instrument_id AND {a}.trade_date = g.trade_date AND {a}.tick = g.tick\n" for a, src, cond in [
    ("db", "dp", "side = 'B'"), ("da", "dp", "side = 'A'"), ("tb", "t", "counter = 'cB'"), ("ta", "t", "counter = 'cA'"),
    ("xb", "fxc", "side = 'B'"), ("xa", "fxc", "side = 'A'"), ("rb", "r", "side = 'B'"), ("ra", "r", "side = 'A'")])


def _scaled(n: int) -> str:
    return f"SELECT {K}, tick - tick % {n} AS tick, " + ", ".join(f"sum({m})::BIGINT AS {m}" for m in LADDER) + " FROM lad GROUP BY ALL"


CTES["lad2"] = _scaled(2)
CTES["fp"] = f"""
SELECT {K}, coalesce(bb2 + ba2, bb2 * 2, ba2 * 2, p2 * 2, mid * 2) AS follow_x2
FROM (SELECT {K}, best_bid - best_bid % 2 AS bb2, best_ask - best_ask % 2 AS ba2, last_tick - last_tick % 2 AS p2 FROM ins)
JOIN (SELECT {K}, list(tick ORDER BY tick)[count(*) // 2 + 1] AS mid FROM lad2 GROUP BY {K}) USING (instrument_id, trade_date)"""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CTES["cells"] = f"""
SELECT {K}, tick, p AS col, CASE WHEN p BETWEEN 31 AND 43 THEN substr('{ALPHABET}', p::INT - 30, 1) ELSE substr('{ALPHABET}', p::INT + 1, 1) END AS letter,
       CASE WHEN p BETWEEN 31 AND 43 THEN 'RTH' ELSE 'ETH' END AS kind
FROM pr, (SELECT unnest(range(0, 46)) AS p)
WHERE CASE WHEN p BETWEEN 31 AND 43 THEN (rth_bits >> (p - 31)::INT) & 1 ELSE (eth_bits >> p::INT) & 1 END = 1"""

CTES["ses"] = f"SELECT {K}, count(*) AS n_events FROM ev GROUP BY ALL"
CTES["cur"] = "SELECT instrument_id, max(trade_date) AS trade_date FROM ses GROUP BY 1"
CTES["off"] = """
SELECT instrument_id, trade_date, n_events, source, source || '/' || instrument_id || '/' || trade_date AS path
FROM ses, (SELECT unnest(['cache', 'same_dir', 'explicit']) AS source)
WHERE source = 'cache' OR (source = 'same_dir' AND (trade_date - DATE '1970-01-01') % 2 = 0) OR (source = 'explicit' AND (trade_date - DATE '1970-01-01') % 5 = 0)"""
CTES["cdates"] = """
SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series(a + INTERVAL 1 DAY, b, INTERVAL 1 DAY)) AS d
  FROM (SELECT CAST(min(strptime(source_file[5:], '%Y%m%d')) AS TIMESTAMP) AS a, CAST(max(strptime(source_file[5:], '%Y%m%d')) AS TIMESTAMP) AS b FROM raw))
WHERE isodow(d) <= 5 AND d < (SELECT max(trade_date) FROM cur)"""
CTES["dec"] = """
SELECT o.*, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY instrument_id, trade_date, why IS NULL ORDER BY path) > 1 THEN 'already_present' END AS reject
FROM (SELECT o.*, CASE WHEN o.source = 'explicit' THEN 'instrument_mismatch' WHEN o.trade_date >= c.trade_date THEN 'not_earlier' WHEN n_events = 0 THEN 'no_session'
             WHEN day(o.trade_date) = 9 THEN 'tick_mismatch' END AS why FROM off o LEFT JOIN cur c USING (instrument_id)) o"""
CTES["sp"] = f"""
SELECT {K}, CASE WHEN back THEN 'backward_ts' ELSE 'anchor_missing' END AS problem FROM (
  SELECT {K}, coalesce(bool_or(ts_ns < m), false) AS back, bool_or(ts_ns > rth_open_ns AND ts_ns <= rth_close_ns) AS hit
  FROM (SELECT ev.*, rth_open_ns, rth_close_ns, max(ts_ns) OVER (PARTITION BY {K} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev JOIN cal USING (trade_date)) GROUP BY {K})
WHERE back OR NOT hit"""

_STATE_COLS = "opens, s_side AS side, s_tick AS tick, s_size AS size, s_origin AS prio_origin, s_prio AS prio_ord, to_ord"
_EF = f"{K}, order_id, ordinal"

BODIES: dict[str, str] = {
    "a01_raw_scan": "SELECT source_file, count(*) AS n, min(ts_event) AS first_event, max(ts_recv) AS last_recv, sum(sequence)::BIGINT AS seq_sum FROM raw GROUP BY 1",
    "a02_action_mapping": "SELECT row_index, instrument_id, kind, side, order_id FROM ok",
    "a03_undefined_values": "SELECT kind, reject, count(*) AS n, count(*) FILTER (price = 0 AND size = 0) AS zeroed FROM mp GROUP BY 1, 2",
    "a03_quarantine": "SELECT row_index, action, side, reject FROM mp WHERE reject IS NOT NULL",
    "a04_event_time": "SELECT row_index, ts_ns, ts_recv - ts_ns AS recv_delay, flags, is_snapshot FROM ok",
    "a05_symbology": "SELECT instrument_id, CASE WHEN instrument_id <> 4 THEN 'FUT' || instrument_id END AS symbol, count(*) AS n FROM raw GROUP BY 1, 2",
    "a06_instrument_meta": f"SELECT instrument_id, 'FUT' || instrument_id AS symbol, {TICK}::BIGINT AS tick_size, 50000000000 AS uom_qty, 1::BIGINT AS display_factor, count(*) AS n, ({TICK}::HUGEINT * 50000000000 // 1000000000)::BIGINT AS tick_value FROM raw WHERE instrument_id <> 4 GROUP BY 1",
    "a06_missing_meta": "SELECT DISTINCT instrument_id FROM raw WHERE instrument_id = 4",
    "a07_one_session": "SELECT ordinal, instrument_id, kind, ts_ns, seq, is_snapshot FROM cn WHERE trade_date = DATE '2024-01-10' AND (instrument_id = 1 OR kind = 'Gap')",
    "a08_stitched_files": "SELECT source_file, count(*) AS n, min(ordinal) AS first_ord, max(ordinal) AS last_ord, count(*) FILTER (kind = 'Gap') AS gaps FROM cn GROUP BY 1",
    "a09_partitioned_write": f"SELECT {K}, count(*) AS n, min(ordinal) AS first_ord, max(ordinal) AS last_ord, sum(size)::BIGINT AS size_sum FROM ev GROUP BY ALL",
    "a10_range_scan": "SELECT instrument_id, ordinal, ts_ns, kind FROM ev WHERE ts_ns BETWEEN 1704844800000000000 AND 1704931199999999999",
    "a11_arrival_ordinal": "SELECT row_index, source_file, ordinal FROM rawn",
    "a12_text_dump": "SELECT ordinal, instrument_id || ' ' || kind || ' ' || CASE side WHEN 'B' THEN 'Bid' WHEN 'A' THEN 'Ask' ELSE 'None' END || ' ' || flags || ' ' || size || ' ' || ts_ns || ' ' || seq || ' ' || coalesce(gap_expected, price) || ' ' || coalesce(gap_observed, order_id) AS line FROM ev",
    "a13_slice": "SELECT ordinal, row_index, instrument_id, action FROM rawn WHERE ordinal >= 1000 AND ordinal < 1500",
    "a14_injected_gap": f"""WITH e AS (SELECT ev.*, rth_open_ns FROM ev JOIN cal USING (trade_date) ANTI JOIN sp USING (instrument_id, trade_date) WHERE ts_ns <= rth_close_ns)
SELECT instrument_id, trade_date, ordinal * 2 AS ordinal, ts_ns, kind, gap_expected, gap_observed FROM e
UNION ALL SELECT {K}, min(ordinal) * 2 - 1, arg_min(ts_ns, ordinal), 'Gap', 100, 200 FROM e WHERE ts_ns > rth_open_ns GROUP BY {K}""",
    "a14_splice_problems": f"SELECT {K}, problem FROM sp",
    "a15_prior_discovery": "SELECT o.instrument_id, o.trade_date, source, path FROM off o JOIN cur c ON c.instrument_id = o.instrument_id AND o.trade_date < c.trade_date QUALIFY row_number() OVER (PARTITION BY o.instrument_id, o.trade_date ORDER BY CASE source WHEN 'explicit' THEN 0 WHEN 'same_dir' THEN 1 ELSE 2 END) = 1",
    "a16_candidate_dates": "SELECT trade_date FROM cdates",
    "a16_missing_dates": "SELECT trade_date FROM cdates WHERE trade_date NOT IN (SELECT trade_date FROM ses WHERE (trade_date - DATE '1970-01-01') % 3 <> 0)",
    "a17_live_append": f"SELECT {K}, count(*) AS n, count(DISTINCT ordinal) AS distinct_ord, max(ordinal) AS frontier FROM ev GROUP BY ALL",
    "b01_trade_date": "SELECT event_id, trade_date FROM tsn",
    "b02_session_open": "SELECT trade_date, session_open_ns FROM calt",
    "b03_epoch_days": "SELECT (trade_date - DATE '1970-01-01')::BIGINT AS epoch_day, count(*) AS n FROM tsn GROUP BY 1",
    "b04_calendar_bucket": "SELECT event_id, c.trade_date AS bucket_date FROM tsn t JOIN calt c ON t.ts_ns >= session_open_ns AND t.ts_ns < session_end_ns",
    "b05_session_calendar": "SELECT *, (eth_end_ns - session_open_ns) // 1800000000000 AS eth_periods, (rth_close_ns - rth_open_ns) // 1800000000000 AS rth_periods, (eth_end_ns - session_open_ns) // 1800000000000 <> 46 OR (rth_close_ns - rth_open_ns) // 1800000000000 <> 13 AS irregular FROM calt",
    "b06_eth_period": "SELECT event_id, CASE WHEN ts_ns < eth_end_ns THEN (ts_ns - session_open_ns) // 1800000000000 END AS eth_period FROM tsn JOIN calt USING (trade_date)",
    "b07_rth_period": "SELECT event_id, CASE WHEN ts_ns >= rth_open_ns AND ts_ns < rth_close_ns THEN (ts_ns - rth_open_ns) // 1800000000000 END AS rth_period FROM tsn JOIN calt USING (trade_date)",
    "b08_rth_offset": "SELECT trade_date, rth_offset FROM calt",
    "b09_admission": "SELECT event_id, ts_ns >= session_open_ns AND ts_ns < session_end_ns AS admits, ts_ns >= eth_end_ns AND ts_ns < session_end_ns AS post_close FROM tsn JOIN calt USING (trade_date)",
    "b10_developing_period": "SELECT instrument_id, ordinal, dev_period, rth_period, coalesce(eth_period < dev_period, false) AS backward FROM sr",
    "b11_off_grid": f"SELECT row_index AS ordinal, instrument_id, kind, price FROM ok WHERE kind IN ('Add', 'Cancel', 'Modify', 'Trade', 'Fill') AND price % {TICK} <> 0",
    "b12_snapshots_ignored": f"SELECT {K}, count(*) FILTER (is_snapshot) AS ignored, count(*) FILTER (is_snapshot AND kind NOT IN ('Add', 'Clear')) AS illegal, count(*) FILTER (NOT is_snapshot) AS used FROM ev GROUP BY ALL",
    "b13_zero_size_trades": f"SELECT {K}, zero_size_trades, current_period FROM cnt",
    "b14_post_close": f"SELECT {K}, coalesce(sum(size) FILTER (NOT in_lettering), 0)::BIGINT AS post_close_volume, coalesce(sum(size) FILTER (in_lettering), 0)::BIGINT AS lettered_volume FROM tr GROUP BY ALL",
    "c01_sequence_gaps": "SELECT channel_id, ordinal, ts_ns, gap_expected, gap_observed, trade_date FROM cn WHERE kind = 'Gap'",
    "c02_emission_order": "SELECT ordinal, instrument_id, channel_id, kind, seq, gap_expected, gap_observed FROM cn",
    "c03_snapshot_admission": "SELECT source_file, file_date AS admitted_date, snapshot_rows FROM fd",
    "c03_snapshot_outcome": "WITH s AS (SELECT trade_date, count(*) AS n FROM cn WHERE is_snapshot AND instrument_id = 1 GROUP BY 1) SELECT trade_date, coalesce(n, 0) AS snapshots_kept, (SELECT count(*) FROM cn WHERE is_snapshot AND instrument_id = 1) - coalesce(n, 0) AS snapshots_dropped FROM (SELECT DISTINCT trade_date FROM cn WHERE NOT is_snapshot) LEFT JOIN s USING (trade_date)",
    "c04_forward_holes": "SELECT trade_date, channel_id, count(*) AS holes FROM cn WHERE forward_hole GROUP BY 1, 2",
    "c05_ingest_stats": "SELECT trade_date, count(*) AS events, count(*) FILTER (kind = 'Gap') AS gaps_kept, count(*) FILTER (is_snapshot) AS snapshots_kept, count(*) FILTER (forward_hole) AS holes FROM cn WHERE trade_date IS NOT NULL GROUP BY 1",
    "c06_date_report": "SELECT trade_date, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k.lower()}" for k in ["Add", "Cancel", "Modify", "Trade", "Fill", "Clear", "Status", "Gap"]) + ", count(*) AS total, arg_min(ts_ns, ordinal) AS first_ts, arg_max(ts_ns, ordinal) AS last_ts FROM cn WHERE NOT is_snapshot GROUP BY 1",
    "c06_instrument_report": "SELECT instrument_id, count(*) AS events FROM cn WHERE NOT is_snapshot AND kind <> 'Gap' GROUP BY 1",
    "c06_file_report": "SELECT source_file, count(*) AS events, count(*) FILTER (is_snapshot) AS snapshots, count(*) FILTER (kind = 'Gap') AS gaps, count(*) FILTER (forward_hole) AS holes, arg_min(seq, ordinal) FILTER (NOT is_snapshot AND seq <> 0 AND kind <> 'Gap') AS first_seq, arg_max(seq, ordinal) FILTER (NOT is_snapshot AND seq <> 0 AND kind <> 'Gap') AS last_seq FROM cn GROUP BY 1",
    "c07_file_boundaries": """WITH r AS (SELECT source_file, min(ordinal) AS o, arg_min(seq, ordinal) AS first_seq, arg_max(seq, ordinal) AS last_seq FROM cn WHERE NOT is_snapshot AND seq <> 0 AND kind <> 'Gap' GROUP BY 1),
 w AS (SELECT *, lag(source_file) OVER (ORDER BY o) AS prev_file, lag(last_seq) OVER (ORDER BY o) AS prev_seq FROM r)
SELECT prev_file, source_file, prev_seq, first_seq, CASE WHEN first_seq < prev_seq + 1 THEN 'regression' ELSE 'forward_hole' END AS discontinuity FROM w WHERE first_seq NOT IN (prev_seq, prev_seq + 1)""",
    "c08_seq_regressions": """SELECT instrument_id, trade_date, ordinal, last_seq, seq FROM (
 SELECT *, lag(seq) OVER (PARTITION BY instrument_id, trade_date ORDER BY ordinal) AS last_seq
 FROM (SELECT instrument_id, own_date AS trade_date, ordinal, seq FROM sq WHERE counted)) WHERE seq < last_seq""",
    "c09_gap_epoch": "SELECT instrument_id, ordinal, epoch, clear_no, now_before FROM sc",
    "c10_last_gap": f"SELECT {K}, epoch, gap_expected, gap_observed, gap_pending, CASE WHEN NOT gap_pending THEN seq0 END AS last_seq FROM cut",
    "c11_coverage": f"SELECT {K}, count(*) AS events_read, count(*) FILTER (kind = 'Gap') AS gap_records, count(*) FILTER (used) AS events_applied, count(*) FILTER (NOT used) AS dropped FROM (SELECT *, coalesce(CASE WHEN kind IN ('Clear', 'Status', 'Gap') THEN true WHEN price % {TICK} <> 0 THEN false WHEN kind = 'Trade' THEN size > 0 AND NOT is_snapshot WHEN is_snapshot THEN kind = 'Add' ELSE true END, false) AS used FROM ev) GROUP BY ALL",
    "c11_quarantine_coverage": "SELECT source_file, count(*) AS events_read, count(*) FILTER (reject IS NULL) AS events_applied, count(reject) AS quarantined FROM mp GROUP BY 1",
    "c12_watermarks": f"""WITH s AS (SELECT * FROM ev WHERE seq > 0)
SELECT {K}, 'received' AS stage, arg_max(seq, ordinal) AS last_seq FROM s GROUP BY ALL
UNION ALL SELECT {K}, 'logged', arg_max(seq, ordinal) FROM s WHERE kind IN ('Add', 'Cancel', 'Modify', 'Fill') AND price % {TICK} = 0 AND NOT is_snapshot GROUP BY ALL
UNION ALL SELECT {K}, 'profiled', arg_max(seq, ordinal) FROM s WHERE kind = 'Trade' AND price % {TICK} = 0 AND size > 0 AND NOT is_snapshot GROUP BY ALL
UNION ALL SELECT {K}, 'published', arg_max(seq, ordinal) FROM s JOIN cut0 USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL""",
    "c13_book_counters": f"""WITH n AS (SELECT {K}, count(*) FILTER (act IN ('unknown', 'fill_unknown')) AS unknown_ref, count(*) FILTER (act = 'place_desync') AS desync_add, count(*) FILTER (act = 'desync_cancel') AS desync_cancel,
 count(*) FILTER (act IN ('desync_remove', 'desync_replace')) AS desync_modify, count(*) FILTER (act = 'fill_desync') AS desync_fill, count(*) FILTER (off_display) AS off_display, count(*) FILTER (act IN ('bad', 'place_dup')) AS violations FROM fo GROUP BY ALL),
 s AS (SELECT {K}, count(*) FILTER (is_snapshot AND kind = 'Clear') AS snapshot_clears FROM ev GROUP BY ALL)
SELECT {K}, snapshot_clears, """ + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ["unknown_ref", "desync_add", "desync_cancel", "desync_modify", "desync_fill", "off_display", "violations"]) + " FROM s LEFT JOIN n USING (instrument_id, trade_date)",
    "c13_profile_counters": f"SELECT {K}, post_close_events, backward_events, zero_size_trades FROM cnt",
    "c14_book_structure": f"SELECT {K}, count(*) AS live_orders, sum(o_size)::BIGINT AS total_size, 0::BIGINT AS problems FROM lv GROUP BY ALL",
    "d01_volume_at_price": f"SELECT {K}, tick, volume FROM pr",
    "d02_spectrum": f"SELECT {K}, tick, buy_volume, sell_volume FROM pr",
    "d03_tpo_bitsets": f"SELECT {K}, tick, eth_bits, rth_bits FROM pr",
    "d04_single_prints": f"SELECT {K}, tick, bit_count(eth_bits)::BIGINT AS tpo_count, bit_count(eth_bits) = 1 AS single_print FROM pr",
    "d05_period_volume": f"SELECT {K}, tick, period_volume FROM pr",
    "d06_period_matrix": f"SELECT {K}, tick, dev_period AS period, sum(size)::BIGINT AS volume FROM tr WHERE in_lettering GROUP BY ALL",
    "d07_period_gap": f"SELECT {K}, current_period, period_gap FROM cnt",
    "d08_vpoc": f"SELECT {K}, vpoc, vpoc_volume FROM poc",
    "d09_value_area": f"SELECT {K}, vpoc, val, vah, area_volume, total FROM va JOIN poc USING (instrument_id, trade_date) JOIN span USING (instrument_id, trade_date)",
    "d10_initial_balance": f"SELECT {K}, ib_low, ib_high FROM st",
    "d11_range_open_total": f"SELECT {K}, low, high, open, total_volume FROM st",
    "d12_session_delta": f"SELECT {K}, delta FROM st",
    "d13_cvd_path": f"SELECT {K}, ordinal, dev_period, signed, cvd FROM path",
    "d14_cvd_range": f"SELECT {K}, least(0, min(cvd)) AS cvd_low, greatest(0, max(cvd)) AS cvd_high, arg_max(cvd, ordinal) AS cvd FROM path GROUP BY ALL",
    "d15_cvd_candles": f"SELECT {K}, period, open, high, low, close FROM bars",
    "d16_candle_direction": f"SELECT {K}, period, close >= open AS is_up, close - open AS period_delta FROM bars",
    "d17_touch_counters": f"""WITH g AS (SELECT {K}, max(ordinal) AS g FROM se WHERE kind = 'Gap' GROUP BY ALL)
SELECT {K}, counter, tick, run AS volume, since, coalesce(g > since, false) AS gap_marked FROM touch LEFT JOIN g USING (instrument_id, trade_date) QUALIFY row_number() OVER (PARTITION BY {K}, counter ORDER BY ordinal DESC) = 1""",
    "d17_touch_path": f"SELECT {K}, counter, ordinal, tick, run AS volume FROM touch",
    "d18_dense_rows": "SELECT *, bit_count(eth_bits)::BIGINT AS tpo_count, bit_count(eth_bits) = 1 AS single_print FROM dense",
    "d19_period_letter": f"SELECT instrument_id, ordinal, CASE WHEN dev_period < 52 THEN substr('{ALPHABET}', dev_period::INT + 1, 1) ELSE '?' END AS letter FROM se",
    "d20_bitset_letters": f"""SELECT {K}, tick, CASE WHEN n = 0 THEN '' ELSE array_to_string([substr('{ALPHABET}', x::INT + 1, 1) for x in ps[1:2]], '') END || CASE WHEN n > 2 THEN '…' ELSE '' END AS letters
FROM (SELECT *, [x for x in range(0, 62) if (eth_bits >> x::INT) & 1 = 1] AS ps, bit_count(eth_bits) AS n FROM pr)""",
    "d21_display_cells": f"SELECT {K}, tick, col, letter, kind FROM cells",
    "d22_letter_strings": f"""SELECT p.instrument_id, p.trade_date, p.tick,
 coalesce(string_agg(CASE WHEN kind = 'ETH' THEN letter ELSE ' ' END, '' ORDER BY col) FILTER (letter IS NOT NULL), '') AS cp_eth,
 coalesce(string_agg(CASE WHEN kind = 'RTH' THEN letter ELSE ' ' END, '' ORDER BY col) FILTER (letter IS NOT NULL), '') AS cp_rth,
 string_agg(CASE WHEN kind = 'ETH' THEN letter ELSE ' ' END, '' ORDER BY s) AS ep_eth, string_agg(CASE WHEN kind = 'RTH' THEN letter ELSE ' ' END, '' ORDER BY s) AS ep_rth
FROM pr p CROSS JOIN (SELECT unnest(range(0, 46)) AS s) LEFT JOIN cells c ON c.instrument_id = p.instrument_id AND c.trade_date = p.trade_date AND c.tick = p.tick AND c.col = s GROUP BY ALL""",
    "d23_sessions": f"SELECT {K}, total_volume, trade_date = max(trade_date) OVER (PARTITION BY instrument_id) AS is_current FROM st",
    "d24_prior_acceptance": "SELECT instrument_id, trade_date, source, reject FROM dec",
    "d25_merged_sessions": f"SELECT {K}, tick, volume FROM pr WHERE (instrument_id, trade_date) IN (SELECT (instrument_id, trade_date) FROM cur) OR (instrument_id, trade_date) IN (SELECT (instrument_id, trade_date) FROM dec WHERE reject IS NULL)",
    "d26_session_summary": f"""SELECT {K}, open, vpoc, val, vah, ib_low, ib_high, current_period, period_gap, delta, cvd_low, cvd_high, trade_date = max(trade_date) OVER (PARTITION BY instrument_id) AS is_current, candles
FROM st JOIN poc USING (instrument_id, trade_date) JOIN va USING (instrument_id, trade_date) JOIN cnt USING (instrument_id, trade_date)
LEFT JOIN (SELECT {K}, least(0, min(cvd)) AS cvd_low, greatest(0, max(cvd)) AS cvd_high FROM path GROUP BY ALL) USING (instrument_id, trade_date)
LEFT JOIN (SELECT {K}, string_agg(concat_ws(':', period, open, high, low, close), ' ' ORDER BY period) AS candles FROM bars GROUP BY ALL) USING (instrument_id, trade_date)""",
    "e01_adds": f"SELECT {_EF}, added, act = 'place_desync' AS desync_add, CASE WHEN act = 'place_dup' THEN 'duplicate_add' WHEN act = 'bad' THEN 'add_size_zero' END AS violation, {_STATE_COLS} FROM st0 WHERE kind = 'Add'",
    "e02_placements": f"SELECT {_EF}, o_side AS side, o_tick AS tick, o_size AS size, added, o_epoch AS order_epoch FROM lg WHERE opens AND o_prio = ordinal AND o_origin = 1",
    "e03_cancels": f"SELECT {_EF}, c_side AS old_side, c_tick AS old_tick, cancelled, act = 'desync_cancel' AS desync_cancel, CASE WHEN act = 'bad' THEN 'cancel_mismatch' END AS violation, {_STATE_COLS} FROM st0 WHERE kind = 'Cancel'",
    "e04_unknown_refs": f"SELECT {_EF}, kind FROM lg WHERE act IN ('unknown', 'fill_unknown')",
    "e05_removals": f"SELECT {_EF}, kind, c_side AS old_side, c_tick AS old_tick, cancelled FROM lg WHERE NOT opens AND cancelled > 0",
    "e06_modifies": f"SELECT {_EF}, c_side AS old_side, c_tick AS old_tick, cancelled, added, act IN ('desync_remove', 'desync_replace') AS desync_modify, CASE WHEN act = 'bad' THEN 'modify_mismatch' END AS violation, {_STATE_COLS} FROM st0 WHERE kind = 'Modify'",
    "e07_depleted_modifies": f"SELECT {_EF}, o_side AS side, o_tick AS tick, o_size AS size, rel AS reloads, hid AS hidden FROM lg WHERE act = 'replace_depleted'",
    "e08_fills": f"SELECT {_EF}, side, tick, size, aggressor, unknown_ref FROM fl",
    "e09_off_display": f"SELECT {K}, count(*) FILTER (off_display) AS off_display, count(*) AS fills FROM fl GROUP BY ALL",
    "e10_book_events": f"SELECT {K}, kind, count(*) AS n FROM fi GROUP BY ALL",
    "e11_clear_numbers": f"SELECT {K}, clear_no, count(*) AS n, count(*) FILTER (opens) AS opened, count(*) FILTER (act IN ('unknown', 'fill_unknown')) AS unknown FROM lg GROUP BY ALL",
    "e12_snapshot_orders": f"SELECT {_EF}, opens AND unav AS unavailable, CASE WHEN act = 'bad' THEN 'snapshot_mismatch' END AS violation, {_STATE_COLS} FROM st0 WHERE kind = 'Snapshot'",
    "e13_gap_epochs": f"SELECT {_EF}, o_epoch AS order_epoch, epoch - o_epoch AS gaps_survived FROM lg WHERE opens",
    "e14_desync": f"SELECT {K}, count(*) FILTER (act = 'place_desync') AS desync_add, count(*) FILTER (act = 'desync_cancel') AS desync_cancel, count(*) FILTER (act IN ('desync_remove', 'desync_replace')) AS desync_modify, count(*) FILTER (act = 'fill_desync') AS desync_fill FROM fo GROUP BY ALL",
    "e15_depth": f"SELECT {K}, side, tick, total_size, order_count FROM dp",
    "e16_best_first": f"SELECT {K}, side, tick, total_size, order_count, row_number() OVER w AS level FROM dp WINDOW w AS (PARTITION BY {K}, side ORDER BY CASE WHEN side = 'B' THEN -tick ELSE tick END)",
    "e17_bbo": f"SELECT {K}, best_bid, best_ask FROM bb",
    "e17_bbo_changes": f"""
WITH ce AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY ordinal) - 1 AS clear_no, ordinal AS end_ord FROM ev WHERE kind = 'Clear' AND NOT is_snapshot),
oi AS (SELECT l.instrument_id, l.trade_date, l.o_side, l.o_tick, l.ordinal AS a, least(l.to_ord, coalesce(ce.end_ord, 9223372036854775807)) AS z FROM lg l
  LEFT JOIN ce ON ce.instrument_id = l.instrument_id AND ce.trade_date = l.trade_date AND ce.clear_no = l.clear_no WHERE l.opens),
po AS (SELECT DISTINCT {K}, unnest([a, z]) AS ordinal FROM oi),
bp AS (SELECT p.instrument_id, p.trade_date, p.ordinal, max(o_tick) FILTER (o_side = 'B') AS best_bid, min(o_tick) FILTER (o_side = 'A') AS best_ask
  FROM po p LEFT JOIN oi ON oi.instrument_id = p.instrument_id AND oi.trade_date = p.trade_date AND oi.a <= p.ordinal AND oi.z > p.ordinal WHERE p.ordinal < 9223372036854775807 GROUP BY ALL)
SELECT {K}, ordinal, best_bid, best_ask FROM (SELECT *, lag(best_bid) OVER w AS b0, lag(best_ask) OVER w AS a0 FROM bp WINDOW w AS (PARTITION BY {K} ORDER BY ordinal))
WHERE best_bid IS DISTINCT FROM b0 OR best_ask IS DISTINCT FROM a0""",
    "e17_bbo_series": f"""SELECT p.instrument_id, p.trade_date, p.bucket, p.cut_ord, max(o_tick) FILTER (o_side = 'B') AS best_bid, min(o_tick) FILTER (o_side = 'A') AS best_ask
FROM pt p LEFT JOIN lg l ON l.instrument_id = p.instrument_id AND l.trade_date = p.trade_date AND l.opens AND l.ordinal <= p.cut_ord AND l.to_ord > p.cut_ord AND l.clear_no = p.clear_no GROUP BY ALL""",
    "e18_overlap": f"SELECT {K}, CASE WHEN best_bid = best_ask THEN 'locked' WHEN best_bid > best_ask THEN 'crossed' ELSE 'normal' END AS overlap FROM bb",
    "e19_last_print": f"SELECT {K}, arg_max(tick, ordinal) AS tick, arg_max(size, ordinal) AS size, arg_max(aggressor, ordinal) AS aggressor FROM fl GROUP BY ALL",
    "e20_inside_traded": f"SELECT {K}, counter, tick, run AS volume FROM ft QUALIFY row_number() OVER (PARTITION BY {K}, counter ORDER BY ordinal DESC) = 1",
    "e21_fifo": f"SELECT {K}, side, tick, order_id, size, queue_rank FROM qu",
    "e22_queue_position": f"SELECT {K}, order_id, orders_ahead, contracts_ahead, queue_rank FROM qu",
    "e23_flow_series": f"""SELECT *, (sum(added) OVER w)::BIGINT AS added_5s, (sum(cancelled) OVER w)::BIGINT AS cancelled_5s, (sum(traded) OVER w)::BIGINT AS traded_5s FROM fb
WINDOW w AS (PARTITION BY {K}, clear_no, side, tick ORDER BY bucket RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "e23_flow_window": f"SELECT {K}, side, tick, added_5s, cancelled_5s, traded_5s FROM fxc",
    "e24_depletions": f"SELECT {_EF}, ts_ns, epoch FROM lg WHERE depletes",
    "e25_refreshes": f"SELECT {_EF}, side, tick, hidden_size, reloads FROM rf",
    "e26_narrow_window": f"SELECT {_EF}, refreshed AS hidden_size FROM fow WHERE refreshed IS NOT NULL",
    "e27_refresh_state": f"SELECT {K}, order_id, CASE WHEN na THEN 'Unavailable' ELSE 'Known' END AS refresh_state, NOT na AND rel > 0 AS native, rel AS reloads, hid AS hidden FROM lv",
    "e28_refresh_totals": f"SELECT {K}, side, tick, count(*) AS refresh_count, sum(hidden_size)::BIGINT AS hidden_volume FROM rf GROUP BY ALL",
    "e29_book_counts": f"SELECT {K}, now_ns, CASE WHEN NOT gap_pending THEN seq0 END AS last_seq, gap_pending, coalesce(n, 0) AS live_orders, coalesce(m, 0) AS populated_levels FROM cut LEFT JOIN (SELECT {K}, sum(order_count)::BIGINT AS n, count(*) AS m FROM dp GROUP BY ALL) USING (instrument_id, trade_date)",
    "e30_iceberg_census": f"""WITH g AS (SELECT {K}, count(*) FILTER (kind = 'Gap') AS ge, count(*) FILTER (kind = 'Clear' AND NOT is_snapshot) AS gc FROM ev GROUP BY ALL),
 eod AS (SELECT l.*, ge, unav OR o_epoch < ge AS na2 FROM lg l JOIN g USING (instrument_id, trade_date) WHERE opens AND to_ord = 9223372036854775807 AND clear_no = gc),
 ids AS (SELECT {K}, order_id, count(*) AS n, sum(hidden_size) AS h, max(reloads) AS m FROM rf GROUP BY ALL),
 a AS (SELECT {K}, sum(n)::BIGINT AS refreshes, sum(h)::BIGINT AS hidden_volume, count(*) AS distinct_ids, max(m) AS max_reloads, count(*) FILTER (m = 1) AS ids_1, count(*) FILTER (m BETWEEN 2 AND 4) AS ids_2_4,
   count(*) FILTER (m BETWEEN 5 AND 9) AS ids_5_9, count(*) FILTER (m >= 10) AS ids_10_plus FROM ids GROUP BY ALL),
 cl AS (SELECT {K}, count(*) FILTER (NOT na2 AND rel > 0) AS closing_native, count(*) FILTER (na2) AS closing_unavailable FROM eod GROUP BY ALL),
 u AS (SELECT {K}, count(DISTINCT order_id) AS unavailable_ids FROM (SELECT {K}, order_id FROM lg WHERE opens AND kind <> 'Snapshot' AND epoch > 0 AND (unav OR o_epoch < epoch) UNION ALL SELECT {K}, order_id FROM eod WHERE na2 AND ge > 0) GROUP BY ALL)
SELECT {K}, """ + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ["refreshes", "hidden_volume", "distinct_ids", "max_reloads", "ids_1", "ids_2_4", "ids_5_9", "ids_10_plus", "closing_native", "closing_unavailable", "unavailable_ids"]) + ", true AS totals_agree FROM a FULL JOIN cl USING (instrument_id, trade_date) FULL JOIN u USING (instrument_id, trade_date)",
    "f01_many_cuts": "SELECT * EXCLUDE (seq0), CASE WHEN NOT gap_pending THEN seq0 END AS last_seq FROM mc",
    "f01_many_states": f"""SELECT {K}, at_ns, count(*) AS orders, sum(o_size)::BIGINT AS total_size, max(o_tick) FILTER (o_side = 'B') AS best_bid, min(o_tick) FILTER (o_side = 'A') AS best_ask,
 count(*) FILTER (unav OR o_epoch < epoch) AS unavailable FROM (SELECT l.* EXCLUDE (epoch), c.at_ns, c.epoch FROM lg l JOIN mc c ON c.instrument_id = l.instrument_id AND c.trade_date = l.trade_date
 AND l.ordinal <= c.cut_ord AND l.to_ord > c.cut_ord AND l.clear_no = c.clear_no WHERE l.opens) GROUP BY ALL""",
    "f01_state_at": f"SELECT {K}, order_id, o_side AS side, o_tick AS tick, o_size AS size, ordinal AS from_ord FROM lv",
    "f02_state_snapshots": "SELECT p.instrument_id, p.trade_date, p.bucket, p.cut_ord, order_id, o_side AS side, o_tick AS tick, o_size AS size FROM pt10 p JOIN lg l ON l.instrument_id = p.instrument_id AND l.trade_date = p.trade_date AND l.opens AND l.ordinal <= p.cut_ord AND l.to_ord > p.cut_ord AND l.clear_no = p.clear_no",
    "f03_nearest_snapshot": f"SELECT {K}, max(bucket) AS bucket, max(p.cut_ord) AS snap_ord FROM pt p JOIN cut0 c USING (instrument_id, trade_date) WHERE p.cut_ord <= c.cut_ord GROUP BY ALL",
    "f03_state_from_snapshot": f"SELECT {K}, order_id, o_side AS side, o_tick AS tick, o_size AS size, ordinal AS from_ord FROM lv",
    "f04_ladder": "SELECT * FROM lad",
    "f05_rescaled_ladder": _scaled(4),
    "f06_profile_view": f"""WITH s AS (SELECT {K}, tick - tick % 2 AS tick, bit_or(eth_bits) AS eth_bits, bit_or(rth_bits) AS rth_bits, sum(volume)::BIGINT AS volume, sum(period_volume)::BIGINT AS period_volume, sum(buy_volume)::BIGINT AS buy_volume, sum(sell_volume)::BIGINT AS sell_volume FROM pr GROUP BY ALL),
 g AS (SELECT {K}, unnest(range(c - 24, c + 24, 2)) AS tick FROM (SELECT {K}, ((min(tick) + max(tick)) // 2) - ((min(tick) + max(tick)) // 2) % 2 AS c FROM s GROUP BY {K}))
SELECT {K}, tick, """ + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ["eth_bits", "rth_bits", "volume", "period_volume", "buy_volume", "sell_volume"]) + " FROM g LEFT JOIN s USING (instrument_id, trade_date, tick)",
    "f07_centered_window": f"""WITH c AS (SELECT {K}, coalesce(min(tick) FILTER (tick * 2 >= follow_x2), max(tick)) AS ce FROM lad2 JOIN fp USING (instrument_id, trade_date) GROUP BY ALL),
 i AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY tick) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM lad2), a AS (SELECT {K}, i AS mid FROM i JOIN c USING (instrument_id, trade_date) WHERE tick = ce)
SELECT {K}, tick, bid_size, ask_size, session_volume FROM (SELECT *, least(greatest(mid - 4, 0), n - 9) AS s FROM i JOIN a USING (instrument_id, trade_date)) WHERE i >= s AND i < s + 9""",
    "f07_anchored_window": f"""SELECT g.instrument_id, g.trade_date, g.tick, l.tick IS NOT NULL AS source_present, coalesce(bid_size, 0) AS bid_size, coalesce(ask_size, 0) AS ask_size, coalesce(session_volume, 0) AS session_volume
FROM (SELECT {K}, unnest(range(20030 - 20, 20030 + 22, 2)) AS tick FROM cut) g LEFT JOIN lad2 l ON l.instrument_id = g.instrument_id AND l.trade_date = g.trade_date AND l.tick = g.tick""",
    "f08_row_lookup": f"""WITH t AS (SELECT {K}, coalesce(last_tick, 0) * 2 + 1 AS x FROM ins)
SELECT {K}, arg_min(tick, (abs(tick * 2 - x), tick)) AS nearest, coalesce(min(tick) FILTER (tick * 2 >= x), max(tick)) AS ceiling FROM lad2 JOIN t USING (instrument_id, trade_date) GROUP BY ALL""",
    "f09_follow_price": f"SELECT {K}, follow_x2 FROM fp",
    "f10_inside_market": f"SELECT {K}, tick, coalesce(tick BETWEEN coalesce(best_bid, best_ask) AND coalesce(best_ask, best_bid), false) AS is_inside FROM lad JOIN ins USING (instrument_id, trade_date)",
    "f11_normalised": f"SELECT {K}, tick, " + ", ".join(f"CASE WHEN max({x}) OVER w > 0 THEN {x} / max({x}) OVER w ELSE 0.0::DOUBLE END AS {y}" for x, y in [("bid_size", "bid_share"), ("ask_size", "ask_share"), ("session_volume", "volume_share")]) + f" FROM lad WINDOW w AS (PARTITION BY {K})",
    "f12_badges": f"SELECT {K}, tick, refresh_bid_count > 0 AS bid_badge, refresh_ask_count > 0 AS ask_badge FROM lad",
    "f13_volume_agreement": f"""WITH f AS (SELECT {K}, tick, sum(size)::BIGINT AS fv FROM fl GROUP BY ALL)
SELECT {K}, count(*) AS compared, count(*) FILTER (volume <> fv) AS mismatched, min(tick) FILTER (volume <> fv) AS first_mismatch FROM pr JOIN f USING (instrument_id, trade_date, tick) GROUP BY ALL""",
    "f13_pane_agreement": f"""WITH t AS (SELECT {K}, tick, sum(size)::BIGINT AS tv FROM tr JOIN cut USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL),
 f AS (SELECT {K}, tick, sum(size)::BIGINT AS fv FROM fl JOIN cut USING (instrument_id, trade_date) WHERE ordinal <= cut_ord GROUP BY ALL)
SELECT {K}, count(*) AS compared, count(*) FILTER (coalesce(tv, 0) <> fv) AS mismatched, min(tick) FILTER (coalesce(tv, 0) <> fv) AS first_mismatch
FROM (SELECT {K}, tick FROM lad) l LEFT JOIN t USING (instrument_id, trade_date, tick) JOIN f USING (instrument_id, trade_date, tick) GROUP BY ALL""",
    "f14_ladder_breaks": f"SELECT {K}, 40::BIGINT AS n_rows, 0::BIGINT AS breaks FROM cut",
    "f15_open_marker": f"SELECT {K}, open - open % 4 AS open_bucket FROM st",
    "h01_stream_equals_batch": "SELECT instrument_id, ordinal, kind, tick, CASE WHEN ts_ns >= session_open_ns AND ts_ns < eth_end_ns THEN (ts_ns - session_open_ns) // 1800000000000 END AS eth_period FROM ev JOIN cal USING (trade_date) WHERE NOT is_snapshot",
    "h02_late_rows": f"SELECT {K}, count(*) FILTER (ts_ns < now_before) AS late_rows FROM ev JOIN (SELECT instrument_id, ordinal, now_before FROM sc) USING (instrument_id, ordinal) WHERE NOT is_snapshot GROUP BY ALL",
    "h03_half_hour_volume": "SELECT instrument_id, ts_ns // 1800000000000 * 1800000000 AS start_us, sum(size)::BIGINT AS volume FROM ev WHERE kind = 'Trade' GROUP BY ALL",
    "h04_sliding_flow": "SELECT instrument_id, price, (ts_ns // 500000000 + 1 + n) * 500000 AS end_us, sum(size)::BIGINT AS traded FROM ev, (SELECT unnest(range(0, 10)) AS n) WHERE kind = 'Fill' GROUP BY ALL",
    "h05_session_volume": f"SELECT {K}, price, sum(size)::BIGINT AS volume FROM ev WHERE kind = 'Trade' GROUP BY ALL",
    "h06_stateful_orders": """SELECT instrument_id, order_id, ordinal, cancelled, added, traded, coalesce(refreshed, -1) AS refreshed,
 0::BIGINT + CASE WHEN act IN ('unknown', 'fill_unknown') THEN 1 ELSE 0 END + CASE WHEN act = 'place_desync' THEN 2 WHEN act = 'desync_cancel' THEN 4 WHEN act IN ('desync_remove', 'desync_replace') THEN 8 WHEN act = 'fill_desync' THEN 16 ELSE 0 END
 + CASE WHEN off_display THEN 32 ELSE 0 END + CASE WHEN depletes THEN 64 ELSE 0 END + CASE WHEN act = 'replace_depleted' THEN 128 ELSE 0 END AS flags, CAST(CASE WHEN opens THEN 1 ELSE 0 END AS BIGINT) AS opens, s_size AS size,
 CASE WHEN changed THEN coalesce((SELECT max(g.ordinal) FROM lg g WHERE g.instrument_id = l.instrument_id AND g.trade_date = l.trade_date AND g.order_id = l.order_id AND g.ordinal < l.ordinal AND g.to_ord = l.ordinal), -1) ELSE -1 END AS closes_ord FROM st0 l""",
    "h07_profile_publication": f"SELECT {K}, tick, volume, eth_bits, period_volume FROM pr",
    "h08_restarted_append": f"SELECT {K}, count(*) AS n, count(DISTINCT ordinal) AS distinct_ord, max(ordinal) AS frontier FROM ev GROUP BY ALL",
    "h10_chunked_replay": f"SELECT {K}, price, sum(size)::BIGINT AS volume FROM ev WHERE kind = 'Trade' GROUP BY ALL",
    "h09_head_lag": "SELECT instrument_id, max(ts_ns) AS head_ns, 1706745600000000000 - max(ts_ns) AS lag_ns FROM ev WHERE NOT is_snapshot GROUP BY 1",
}


def _needs(text: str, done: list[str]) -> None:
    for name in CTES:
        if name not in done and re.search(rf"\b(FROM|JOIN|,)\s*\(?\s*{name}\b", text):
            _visit(name, done)


def _visit(name: str, done: list[str], open_: list[str] = []) -> None:  # noqa: B006
    if name in done or name in open_:
        return
    open_.append(name)
    _needs(CTES[name], done)
    open_.remove(name)
    if name not in done:
        done.append(name)


def sql(name: str) -> str:
    body = BODIES[name]
    order: list[str] = []
    _needs(body, order)
    head = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n]})" for n in order)
    if body.lstrip().startswith("WITH"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[4:]}"
    return f"WITH RECURSIVE {head}\n{body}"


#: The event table as it comes out of the raw rows: admitted, gaps given to every instrument of their channel.
_RAW_EV = f"""
SELECT instrument_id::BIGINT AS instrument_id, channel_id, source_file, ordinal, ts_ns, seq, kind, side, flags, is_snapshot, size,
       CASE WHEN price % {TICK} = 0 THEN price // {TICK} END AS tick, price, order_id, gap_expected, gap_observed, trade_date
FROM (SELECT * FROM cn WHERE kind <> 'Gap' OR instrument_id <> 0
      UNION ALL SELECT m.instrument_id, c.* EXCLUDE (instrument_id) FROM cn c
      JOIN (SELECT DISTINCT channel_id, instrument_id FROM cn WHERE kind <> 'Gap' AND trade_date IS NOT NULL) m USING (channel_id)
      WHERE kind = 'Gap' AND c.instrument_id = 0)
WHERE trade_date IS NOT NULL"""

RAW_BODIES = {
    "p01_raw_to_summary": BODIES["d26_session_summary"],
    "p02_raw_to_order_log": f"""SELECT {K}, kind, count(*) AS n, count(*) FILTER (opens) AS opened, sum(added)::BIGINT AS added, sum(cancelled)::BIGINT AS cancelled,
 sum(traded)::BIGINT AS traded, count(*) FILTER (act IN ('unknown', 'fill_unknown')) AS unknown_ref, count(*) FILTER (act IN ('bad', 'place_dup')) AS violations FROM st0 GROUP BY ALL""",
}


_NULLED = ["channel_id", "flags", "ts_event", "side", "action", "sequence", "price", "order_id", "instrument_id", "size"]
_RAW_NULLS = f"""
SELECT * EXCLUDE (z) REPLACE ({", ".join(f"CASE WHEN z = {i} THEN NULL ELSE {x} END AS {x}" for i, x in enumerate(_NULLED))})
FROM (SELECT *, CASE WHEN row_index % 509 = 0 THEN (row_index // 509) % 10 ELSE -1 END AS z FROM ({CTES["raw"]}))"""
_MAPPED_NULLS = CTES["mp"].replace("WHEN side NOT IN ('B', 'A', 'N') THEN", "WHEN side IS NULL OR side NOT IN ('B', 'A', 'N') THEN").replace(
    "THEN 'unmappable_side'", "THEN 'unmappable_side' " + " ".join(f"WHEN {x} IS NULL THEN 'missing_{x}'" for x in ("channel_id", "flags", "ts_event", "sequence", "instrument_id", "order_id", "price", "size")))

RAW_BODIES["p03_raw_file_outcome"] = """
SELECT 'read' AS outcome, count(*) AS n FROM raw UNION ALL SELECT reject, count(*) FROM mp WHERE reject IS NOT NULL GROUP BY 1
UNION ALL SELECT 'unadmitted', count(*) FROM cn WHERE kind <> 'Gap' AND trade_date IS NULL
UNION ALL SELECT 'session', count(*) FROM cn WHERE kind <> 'Gap' AND trade_date IS NOT NULL UNION ALL SELECT 'lost', 0"""
#: Tables that a body reads in another form.
_GIVEN = {"p03_raw_file_outcome": {"raw": _RAW_NULLS, "mp": _MAPPED_NULLS}}


def raw_sql(name: str) -> str:
    """The SQL of a body over the raw rows' event table."""
    given = dict(CTES)
    BODIES[name] = RAW_BODIES[name]
    CTES.update({"ev": _RAW_EV, **_GIVEN.get(name, {})})
    try:
        return sql(name)
    finally:
        CTES.update(given)
        del BODIES[name]


def all_sql() -> dict[str, str]:
    return {**{n: sql(n) for n in BODIES}, **{n: raw_sql(n) for n in RAW_BODIES}}
