"""Half-hour lettering of price rows: period bitsets to letters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .schema import ETH_PERIODS, RTH_PERIODS

# Letters of periods 0..51, and the columns RTH letters occupy.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RTH_FIRST_COLUMN = 31


def period_letter(period: Column) -> Column:
    inside = (period >= 0) & (period < len(ALPHABET))
    return F.when(inside, F.substring(F.lit(ALPHABET), period.cast("int") + 1, F.lit(1))).otherwise("?")


def _has_bit(bits: Column, n: Column) -> Column:
    return F.call_function("shiftright", bits, n.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _periods(bits: Column, last: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(last)), lambda p: _has_bit(bits, p))


def tpo_letters(bits: Column, max_chars: int) -> Column:
    """Letters of a bitset in time order, cut with an ellipsis past ``max_chars``."""
    found = _periods(bits, 62)
    shown = F.array_join(F.transform(F.slice(found, 1, max_chars), period_letter), "") if max_chars > 0 else F.lit("")
    return F.concat(shown, F.when(F.size(found) > max_chars, "…").otherwise(""))


def display_cells(eth: Column, rth: Column) -> Column:
    """Occupied display columns: array of (col, letter, kind).  While the day
    session is open the clock restarts at A and reads the RTH bitset."""
    last_rth = RTH_FIRST_COLUMN + RTH_PERIODS

    def cell(p: Column) -> Column:
        day = (p >= RTH_FIRST_COLUMN) & (p < last_rth)
        shown = F.when(day, _has_bit(rth, p - RTH_FIRST_COLUMN)).otherwise(_has_bit(eth, p))
        letter = period_letter(F.when(day, p - RTH_FIRST_COLUMN).otherwise(p))
        return F.struct(shown.alias("shown"), p.alias("col"), letter.alias("letter"),
                        F.when(day, "RTH").otherwise("ETH").alias("kind"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(ETH_PERIODS - 1)), cell)
    # shiftright by a negative count wraps around, so hidden cells are dropped only after the choice above
    return F.transform(F.filter(cells, lambda c: c["shown"]),
                       lambda c: F.struct(c["col"].alias("col"), c["letter"].alias("letter"), c["kind"].alias("kind")))


def collapsed(cells: Column, kind: str) -> Column:
    """Letters packed to the left; the other kind's letters show as blanks."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["kind"] == kind, c["letter"]).otherwise(" ")), "")


def expanded(cells: Column, kind: str) -> Column:
    """One character per half-hour column, blank where nothing of ``kind`` traded."""
    mine = F.filter(cells, lambda c: c["kind"] == kind)
    at = F.map_from_arrays(F.transform(mine, lambda c: c["col"]), F.transform(mine, lambda c: c["letter"]))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ETH_PERIODS - 1)),
                                    lambda p: F.coalesce(F.element_at(at, p), F.lit(" "))), "")
