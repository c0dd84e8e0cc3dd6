"""Reading, numbering, writing and cutting event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.schema import EVENT_SCHEMA, KEY, RAW_SCHEMA
from ..operators.prefix import Scan, prefix_scan
from ..operators.small import sized

ROWS_PER_FILE_BITS = 22


def raw_files(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> list[tuple[str, str, int]]:
    """(full path, name, rank) of every file below ``paths``: in the order of the
    list, and by full path below a folder or glob.  A name that occurs twice is
    given with its path.  A path without files, or a file met twice, is an error."""
    schema = type(RAW_SCHEMA)([RAW_SCHEMA.fields[0]])
    found: list[str] = []
    for p in paths:
        files = sorted(spark.read.schema(schema).options(**options).format(fmt).load(p).inputFiles())
        if not files:
            raise ValueError(f"no files below {p}")
        found += files
    if len(set(found)) < len(found):
        raise ValueError("a file is listed twice")
    names = [f.rsplit("/", 1)[-1] for f in found]
    return [(f, n if names.count(n) == 1 else f, i) for i, (f, n) in enumerate(zip(found, names))]


def read_raw(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """Vendor exports in stitch order.  The order of ``raw_files`` is the file
    rank; rows keep their place in the file: parquet's own row index, or for text
    formats the split offset and the position in the split."""
    data = [f for f in RAW_SCHEMA.fields if f.name not in ("source_file", "file_rank", "row_index")]
    files = raw_files(spark, paths, fmt, **options)
    # listings write file:///x, rows file:/x
    plain = lambda col: F.regexp_replace(col, "^([A-Za-z0-9]+):/+", "$1:/")
    ranks = spark.createDataFrame(files, "_path string, source_file string, file_rank int").withColumn("_path", plain("_path"))
    df = spark.read.schema(type(RAW_SCHEMA)(data)).options(**options).format(fmt).load([f for f, _, _ in files])
    df = df.withColumns({
        "_path": plain(F.col("_metadata.file_path")), "_split": F.col("_metadata.file_block_start"),
        "_pos": F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()})
    # one row per listed file; a row that no file claims stops the read
    df = df.join(ranks, "_path", "left").withColumn(
        "file_rank", F.coalesce("file_rank", F.raise_error(F.concat(F.lit("row of an unlisted file: "), "_path")).cast("int"))).drop("_path")
    if fmt == "parquet":
        return df.withColumn("row_index", F.col("_pos")).drop("_split", "_pos").select(*RAW_SCHEMA.names)
    # position ids rise within a split; splits of a file are put in offset order
    first = Window.partitionBy("file_rank").orderBy("_split")
    splits = df.groupBy("file_rank", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(splits.drop("_n"), ["file_rank", "_split"])
    return df.withColumn("row_index", F.col("_off") + F.col("_pos") - F.col("_p0")).select(*RAW_SCHEMA.names)


def with_ordinal(raw: DataFrame) -> DataFrame:
    """Dense arrival number over the stitched files: rows before this one in
    its file plus all rows of earlier files."""
    per_file = raw.groupBy("file_rank").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = sized(per_file.select("file_rank", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    rows = prefix_scan(raw, ["file_rank"], {"_at": Scan("sum", F.lit(1).cast("long"))}, order="row_index")
    return rows.join(base, "file_rank").withColumn("ordinal", F.col("_base") + F.col("_at")).drop("_base", "_at")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path).select(*EVENT_SCHEMA.names)  # partition columns read last otherwise


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Any table written by ``write_sessions``, with the session key typed as such."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, {"instrument_id": T.LongType(), "trade_date": T.DateType()}.get(f.name, f.dataType)) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_sessions(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Session-partitioned parquet of an ordinal-keyed table.

    A hot session is written by many tasks, each holding a contiguous run of
    ordinals, so ordinal and time statistics prune."""
    out = rows.withColumn("_run", F.shiftright("ordinal", ROWS_PER_FILE_BITS))
    # rebalanced: as many writers as the rows need at the session's advisory size, large runs split
    out = out.hint("rebalance", *KEY, "_run").sortWithinPartitions(*KEY, "ordinal").drop("_run")
    out.write.mode(mode).partitionBy("trade_date", "instrument_id").option("compression", "zstd").parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the event table; an empty result is an error, not an empty log."""
    write_sessions(events.select(*EVENT_SCHEMA.names), path, mode)
    if read_events(events.sparkSession, path).isEmpty():
        raise ValueError("no events to write")


def scan_range(events: DataFrame, ordinals: tuple[int, int] | None = None, times_ns: tuple[int, int] | None = None) -> DataFrame:
    """Rows in a closed range of ordinals and/or times; both reach the parquet reader."""
    out = events
    if ordinals:
        out = out.filter((F.col("ordinal") >= ordinals[0]) & (F.col("ordinal") <= ordinals[1]))
    if times_ns:
        out = out.filter((F.col("ts_ns") >= times_ns[0]) & (F.col("ts_ns") <= times_ns[1]))
    return out


def canonical_line() -> Column:
    """Text form: id kind side flags size ts seq price order_id."""
    side = F.when(F.col("side") == "B", "Bid").when(F.col("side") == "A", "Ask").otherwise("None")
    gap = F.col("kind") == "Gap"
    price = F.when(gap, F.col("gap_expected")).otherwise(F.col("price"))
    oid = F.when(gap, F.col("gap_observed")).otherwise(F.col("order_id"))
    return F.concat_ws(" ", F.col("instrument_id").cast("string"), "kind", side, *[
        F.col(c).cast("string") for c in ("flags", "size", "ts_ns", "seq")], price.cast("string"), oid.cast("string"))


def text_dump(events: DataFrame, limit: int | None = None) -> DataFrame:
    out = events.select("ordinal", canonical_line().alias("line"))
    return out if limit is None else out.orderBy("ordinal").limit(limit)


def write_text(events: DataFrame, path: str, limit: int | None = None) -> None:
    """Lines in arrival order: files in range order, sorted inside, so that reading them
    by name gives the order back."""
    rows = text_dump(events, limit)
    rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("line").write.text(path)


def slice_rows(rows: DataFrame, skip: int, count: int) -> DataFrame:
    """``count`` records after ``skip``, by dense ordinal."""
    return rows.filter((F.col("ordinal") >= skip) & (F.col("ordinal") < skip + count))


def splice_problems(events: DataFrame, after_ns: Column, through_ns: Column) -> DataFrame:
    """Sessions a gap cannot be spliced into: time runs backwards, or no event
    lies in ``(after, through]``."""
    ev = prefix_scan(events, KEY, {"_max": Scan("max", F.col("ts_ns"))})
    hit = (F.col("ts_ns") > after_ns) & (F.col("ts_ns") <= through_ns)
    per = ev.groupBy(*KEY).agg(F.max(F.coalesce(F.col("ts_ns") < F.col("_max"), F.lit(False))).alias("back"), F.max(hit).alias("hit"))
    return per.filter(F.col("back") | ~F.col("hit")).select(
        *KEY, F.when(F.col("back"), "backward_ts").otherwise("anchor_missing").alias("problem"))


def inject_gap(events: DataFrame, after_ns: Column, through_ns: Column, expected: int, observed: int,
               problems: DataFrame | None = None) -> DataFrame:
    """Copy each session up to ``through_ns`` with one Gap just before its first
    event later than ``after_ns``.  Sessions listed in ``problems`` are left out;
    with ``problems=None`` the caller vouches for the input."""
    if observed <= expected:
        raise ValueError("observed must be greater than expected")
    ev = events if problems is None else events.join(sized(problems.select(*KEY)), KEY, "left_anti")
    ev = ev.filter(F.col("ts_ns") <= through_ns)
    anchor = ev.filter(F.col("ts_ns") > after_ns).groupBy(*KEY).agg(
        F.min_by(F.struct("channel_id", "source_file", "ordinal", "ts_ns"), "ordinal").alias("a"))
    lit = {"seq": 0, "kind": "Gap", "side": "N", "flags": 0, "is_snapshot": False, "size": 0, "price": 0, "order_id": 0,
           "gap_expected": expected, "gap_observed": observed}
    gap = anchor.select(
        *KEY, F.col("a.channel_id"), F.col("a.source_file"), (F.col("a.ordinal") * 2 - 1).alias("ordinal"), F.col("a.ts_ns"),
        *[F.lit(v).cast(EVENT_SCHEMA[c].dataType).alias(c) for c, v in lit.items()])
    moved = ev.withColumn("ordinal", F.col("ordinal") * 2)
    return moved.select(*EVENT_SCHEMA.names).unionByName(gap.select(*EVENT_SCHEMA.names))
