"""Connected components of a link table, by alternating stars.

Every round is two groupings and two equi-joins over edges, written to the
shared folder; a hot node only ever meets its own minimum, and nothing is
gathered on the driver but two sums that tell whether a round changed anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, stored


def _toward_least(e: DataFrame, keep_all: bool) -> DataFrame:
    """Edges (u, v): hang u's neighbours on the least of them and u."""
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
    if keep_all:  # smaller neighbours and u itself
        hung = hung.select("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    else:  # larger neighbours only
        hung = hung.filter(F.col("u") > F.col("w")).select("u", "v")
    return hung.filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, False)
        before, e = e, stored(_toward_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), True), "stars")
        release(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
