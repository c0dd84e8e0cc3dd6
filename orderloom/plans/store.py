"""Stored base tables the registered queries read.

The event table and the order log are written once per session and data folder
and then scanned like any other table: column pruning, partition pruning and
ordinal/time statistics work, long plans are cut at a durable table, and a lost
executor only costs a re-read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import mbo
from .workdir import work_dir

_PATHS: dict[tuple[str, str, str], str] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = work_dir(spark, name)
        mbo.write_sessions(build(), path)
        _PATHS[key] = path
    return _PATHS[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table; its files are listed once per session, not per use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = mbo.read_sessions(spark, stored_path(spark, sf_dir, name, build))
    return _TABLES[key]
