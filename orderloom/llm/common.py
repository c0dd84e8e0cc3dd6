"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.workdir import work_dir

T = TypeVar("T")
#: White space of the word rule; a word is a longest run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS = 512


#: Arrow batches for Python tasks are cut by bytes too, for tables of long texts.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back: it is
    computed once, and a lost executor costs a re-read, not the lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._stored_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` and as many underscores as make it differ from every column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fingerprint(*names: str) -> Column:
    """64-bit hash that tells apart rows which share an id.  Rows equal in id and
    fingerprint get equal results, so they may share one."""
    return F.xxhash64(*[F.col(n) for n in names])


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small, so that Python objects of few texts live at once.  What
    Arrow has kept of a batch goes back to the system before the next one."""
    pool = pa.default_memory_pool()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pool.release_unused()


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_llm_worker_objects", types.ModuleType("_llm_worker_objects")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def bitset(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Membership filter of 2**bits bits over a column of 64-bit hashes.

    The bits are OR-ed by Spark; the driver gets at most 2**(bits-6) words, a
    bound that does not depend on the data (2 MB for 24 bits, 16 MB for 27).  A
    full filter passes everything, which costs time and never a result."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int"))).alias("b")))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitset(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit hashes may be members."""
    bits = int(words.size).bit_length() - 1 + 6
    s = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
