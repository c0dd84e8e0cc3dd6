"""Which earlier sessions to show beside the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Precedence of where a session came from.
SOURCE_RANK = {"explicit": 0, "same_dir": 1, "cache": 2}


def _rank(source: Column) -> Column:
    out = F.lit(len(SOURCE_RANK))
    for name, r in SOURCE_RANK.items():
        out = F.when(source == name, r).otherwise(out)
    return out


def discover(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier sessions of the current instrument, one per date: explicit wins
    over the same directory, which wins over the cache.  ``current`` is one row
    per instrument: instrument_id, trade_date."""
    cur = current.select("instrument_id", F.col("trade_date").alias("_cur"))
    c = candidates.join(cur, "instrument_id").filter(F.col("trade_date") < F.col("_cur"))
    w = Window.partitionBy("instrument_id", "trade_date").orderBy(_rank(F.col("source")), "path")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_cur")


def candidate_dates(files: DataFrame, current: DataFrame) -> DataFrame:
    """Weekdays a range of UTC day files can fully supply: from the day after
    the first file to the last, before the current date."""
    span = files.agg(F.min("file_date").alias("a"), F.max("file_date").alias("b")).filter(F.col("a") < F.col("b"))
    days = span.select(F.explode(F.sequence(F.date_add("a", 1), F.col("b"))).alias("trade_date"))
    weekday = ~F.dayofweek("trade_date").isin(1, 7)
    cur = current.agg(F.max("trade_date").alias("_cur"))
    return days.filter(weekday).join(F.broadcast(cur), F.col("trade_date") < F.col("_cur")).drop("_cur")  # one row


def missing_dates(candidates: DataFrame, available: DataFrame) -> DataFrame:
    return candidates.join(available.select("trade_date").distinct(), "trade_date", "left_anti")


def accept(priors: DataFrame, current: DataFrame) -> DataFrame:
    """Decide per offered prior session; ``reject`` is null where it is taken.
    ``priors``: instrument_id, symbol, trade_date, tick_size, offer (order of
    arrival), n_events; ``current``: one row per instrument, same naming."""
    cur = current.select(F.col("instrument_id"), F.col("symbol").alias("_sym"), F.col("trade_date").alias("_cur"),
                         F.col("tick_size").alias("_tick"))
    j = priors.join(cur, "instrument_id", "left")
    reason = (F.when(F.col("_sym").isNull() | (F.col("symbol") != F.col("_sym")), "instrument_mismatch")
              .when(F.col("trade_date") >= F.col("_cur"), "not_earlier").when(F.col("n_events") == 0, "no_session")
              .when(F.col("tick_size") != F.col("_tick"), "tick_mismatch"))
    j = j.withColumn("_why", reason)
    # a date already taken by an earlier acceptable offer is a duplicate
    w = Window.partitionBy("instrument_id", "trade_date", F.col("_why").isNull()).orderBy("offer")
    dup = F.when(F.col("_why").isNull() & (F.row_number().over(w) > 1), "already_present")
    return j.withColumn("reject", F.coalesce("_why", dup)).drop("_why", "_sym", "_cur", "_tick")


def merge_sessions(current_rows: DataFrame, prior_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current profile rows plus those of accepted priors (ordered by date at read)."""
    ok = decisions.filter(F.col("reject").isNull()).select("instrument_id", "trade_date")
    return current_rows.unionByName(prior_rows.join(ok, ["instrument_id", "trade_date"], "left_semi"))
