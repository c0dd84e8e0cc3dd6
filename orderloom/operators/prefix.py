"""Two-level prefix scan: running sums and maxima over one huge ordered key.

A plain ``Window.partitionBy(key).orderBy(ordinal)`` puts a hot instrument-day
into one task.  Here the key is cut into ordinal blocks: block totals come from
a map-side-combined aggregate, the (small) block table gets the carry of all
earlier blocks, and rows are windowed only inside their block.  Rows shuffle
once, by (key, block), whatever the skew of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 16


@dataclass(frozen=True)
class Scan:
    """``how`` is sum, max or min; the result covers *earlier* rows only, plus
    the row itself when ``inclusive``.  Structs compare field by field, so
    ``max(struct(ordinal, x))`` is "the latest x"."""

    how: str
    value: Column
    inclusive: bool = False


AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def merged(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    # greatest/least skip nulls
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def prefix_scan(df: DataFrame, keys: Sequence[str], scans: dict[str, Scan],
                order: str = "ordinal", block_bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with one column per scan.  Keys and order must not be null: such a row
    belongs nowhere, and stops the job instead of leaving it unseen."""
    keys = list(keys)
    vals = {n: f"_v_{n}" for n in scans}
    base = df.withColumns({vals[n]: s.value for n, s in scans.items()})
    base = base.withColumn("_blk", F.shiftright(F.col(order), block_bits))

    blocks = base.groupBy(*keys, "_blk").agg(*[AGGREGATES[s.how](vals[n]).alias(f"_t_{n}") for n, s in scans.items()])
    earlier_blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_blk", F.lit(True).alias("_met"),
                          *[AGGREGATES[s.how](f"_t_{n}").over(earlier_blocks).alias(f"_c_{n}") for n, s in scans.items()])

    earlier_rows = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # window before join: the window's sort order already serves a merge join on (key, block)
    out = base.withColumns({f"_w_{n}": AGGREGATES[s.how](vals[n]).over(earlier_rows) for n, s in scans.items()})
    out = out.join(carry, [*keys, "_blk"], "left").withColumn("_blk", F.when(F.col("_met"), F.col("_blk")).otherwise(
        F.raise_error(F.lit(f"a row has no {', '.join(keys)} or {order}")).cast("long")))
    out = out.filter(F.col("_blk").isNotNull())  # so that the check is not pruned away
    result = {}
    for n, s in scans.items():
        v = merged(s.how, F.col(f"_c_{n}"), F.col(f"_w_{n}"))
        result[n] = merged(s.how, v, F.col(vals[n])) if s.inclusive else v
    out = out.withColumns(result)
    return out.drop("_blk", "_met", *vals.values(), *[f"_c_{n}" for n in scans], *[f"_w_{n}" for n in scans])
