"""Parquet layout: positions, per-bucket and per-month counts, the merged sorted table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.operators.counts import merge_counts
from plyframe.schemas import (COUNTERS, COUNTS, COVERED, COVERS, LOG_ENTRIES, MONTHLY_COUNTS, POSITIONS, STORED_COUNTS)
from plyframe.session import scratch_path
from plyframe.sources import commit_log
from plyframe.sources.sorted_table import index_path, read_for, read_table, row_at_index, write_sorted

MAX_RECORDS_PER_FILE = 10_000_000
#: Sorted runs of one level that are merged into one of the next.
FANOUT = 4
#: Loads whose directories a scan names, at most; beyond it the join alone picks their rows.
NAMED_LOADS = 5_000
#: Files under this size are what compaction puts together.
SMALL_BYTES = 32 << 20
#: Rows a file of a merged run holds, at most.
RUN_FILE_ROWS = 2_000_000


def write_positions(positions: DataFrame, path: str, max_records: int = MAX_RECORDS_PER_FILE) -> None:
    """M4 rows to bounded files (each writer task rolls over at ``max_records``)."""
    (positions.select(*[f.name for f in POSITIONS.fields])
     .write.mode("overwrite").option("maxRecordsPerFile", max_records)
     .option("compression", "snappy").parquet(path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSITIONS).parquet(path)


def write_bucketed_counts(counts: DataFrame, path: str, by: str = "player_elo_bucket") -> None:
    """Counts partitioned by rating bucket: one directory per bucket, pruned on read."""
    counts.write.mode("overwrite").partitionBy(by).parquet(path)


FULL_PART = "full"


def log_path(root: str) -> str:
    """The commit log of the store at ``root``: loads and processed months in one order."""
    return root.rstrip("/") + "_log"


def _loads_path(root: str) -> str:
    return root.rstrip("/") + "_loads"


def write_month(counts: DataFrame, root: str, month: str | None = None, part: str = FULL_PART,
                parts: DataFrame | None = None, whole: bool | None = None, processed: Iterable[str] = (),
                batch_id: int | None = None, after: int | None = None) -> int | None:
    """Write one load of monthly counts and make it the current one.

    ``part`` names what the rows came from; counts with a ``part`` column of
    their own hold many.  A load replaces the earlier loads of its parts, and
    where ``whole`` (the default for the part ``full``) all earlier loads of its
    months, whatever path wrote them.  A load goes to its own ``load=`` directory, the parts it
    covers to ``<root>_loads``, and it counts from the moment its entry is in the
    commit log (``<root>_log``, one numbered entry a load), so readers see the old
    load or the new one, months can be written at the same time, two loads of one
    month have an order, and a repeated batch replaces itself.  The same entry
    says which months are now ``processed`` (the ledger): data and ledger can not differ.

    ``parts`` (month, part, and counters where known) names what the load covers
    where some of it may have no rows; with ``month`` given the month is covered
    even if ``counts`` is empty.  ``after`` names the last entry the rows were made from: another entry since is
    ``commit_log.Taken``, and nothing is committed.  Returns the entry's number (None where there was nothing to log).

    Rows are rebalanced by (month, part) before the write: few large files for
    each, and a hot month is still split over tasks.
    """
    spark = counts.sparkSession
    if month is not None:
        counts = counts.withColumn("month", F.lit(month))
    if whole is None:
        whole = part == FULL_PART and "part" not in counts.columns
    if "part" not in counts.columns:
        counts = counts.withColumn("part", F.lit(part))
    load = uuid.uuid4().hex
    (counts.select(*[f.name for f in MONTHLY_COUNTS.fields]).hint("rebalance", "month", "part")
     .write.partitionBy("month", "part").parquet(f"{root.rstrip('/')}/load={load}"))
    if parts is None and month is not None:
        parts = spark.createDataFrame([(month, part)], "month string, part string")
    written = read_table(spark, root, STORED_COUNTS)
    covers = [] if written is None else [written.filter(F.col("load") == load).select(
        "month", "part", *[F.lit(None).cast("long").alias(c) for c in COUNTERS])]
    if parts is not None:
        covers.append(parts.select("month", "part", *[
            (F.col(c) if c in parts.columns else F.lit(None)).cast("long").alias(c) for c in COUNTERS]))
    log = reduce(DataFrame.unionByName, covers).groupBy("month", "part").agg(*[F.max(c).alias(c) for c in COUNTERS]) if covers else None
    if log is None and not processed and batch_id is None:
        return None
    if log is not None:
        log.coalesce(1).write.parquet(f"{_loads_path(root)}/load={load}")
    entry = {"kind": "load", "load": load, "whole": whole, "processed": sorted(processed)}
    return commit_log.append(spark, log_path(root), entry if batch_id is None else {**entry, "batch_id": batch_id},
                             None if after is None else after + 1)


def log_entries(spark: SparkSession, root: str) -> DataFrame | None:
    """The store's commit log, one row an entry; None where nothing was ever committed."""
    return commit_log.read(spark, log_path(root), LOG_ENTRIES)


def committed_covers(spark: SparkSession, root: str) -> DataFrame | None:
    """(month, part, load, whole, seq, batch_id and counters) of every committed load."""
    entries, covers = log_entries(spark, root), read_table(spark, _loads_path(root), COVERS)
    if entries is None or covers is None:
        return None
    return covers.join(entries.filter("kind = 'load'").select("load", "whole", "seq", "batch_id"), "load")


def current_loads(spark: SparkSession, root: str) -> DataFrame | None:
    """(month, part, load) that count: the last load of each part, not older than the month's last whole one."""
    log = committed_covers(spark, root)
    if log is None:
        return None
    newest = F.struct("seq", "load")
    last = log.groupBy("month", "part").agg(F.max(newest).alias("l"))
    full = (log.filter("whole").groupBy(F.col("month").alias("_m")).agg(F.max(newest).alias("f")))
    return (last.join(full, F.col("month").eqNullSafe(F.col("_m")), "left")
            .filter(F.col("f").isNull() | (F.col("l") >= F.col("f")))
            .select("month", "part", F.col("l.load").alias("load")))


def _rows_of(spark: SparkSession, root: str, loads: DataFrame) -> DataFrame | None:
    """The rows of the named loads (``STORED_COUNTS``), current or not."""
    data = read_table(spark, root, STORED_COUNTS)
    if data is None:
        return None
    names = [r["load"] for r in loads.select("load").distinct().limit(NAMED_LOADS + 1).collect()]
    if len(names) <= NAMED_LOADS:  # their directories alone are listed for the scan
        data = data.filter(F.col("load").isin(names)) if names else data.limit(0)
    return data.join(loads.select("load", "month", "part"), ["load", "month", "part"], "left_semi")


def read_monthly(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the current loads (``MONTHLY_COUNTS``); None where nothing was ever loaded."""
    loads = current_loads(spark, root)
    if loads is None:
        if read_table(spark, root, STORED_COUNTS) is not None:
            return spark.createDataFrame([], MONTHLY_COUNTS)  # a first load that never got to its log entry
        return None
    rows = _rows_of(spark, root, loads)
    return spark.createDataFrame([], MONTHLY_COUNTS) if rows is None else rows.select(*[f.name for f in MONTHLY_COUNTS.fields])


def compact_month(spark: SparkSession, root: str, month: str) -> None:
    """Merge all parts of a month into one full load with few files."""
    if read_monthly(spark, root) is None:
        raise FileNotFoundError(root)
    _compact(spark, root, lambda: [month])


def compact_small(spark: SparkSession, root: str, small_bytes: int = SMALL_BYTES, files: int = 2) -> list[str]:
    """Merge the parts of every month that has ``files`` or more files under ``small_bytes``, all in one load, and return
    those months.  The load's files are sized by the rebalance of its write."""
    def small() -> list[str]:
        loads, data = current_loads(spark, root), read_table(spark, root, STORED_COUNTS)
        if loads is None or data is None:
            return []
        seen = data.select("month", "part", "load", F.col("_metadata.file_path").alias("file"),
                           F.col("_metadata.file_size").alias("bytes")).distinct()
        per = (seen.join(loads, ["month", "part", "load"], "left_semi").filter(F.col("bytes") < small_bytes)
               .groupBy("month").count().filter(F.col("count") >= files))
        return sorted(r["month"] for r in per.collect())  # one name a month

    return _compact(spark, root, small)


def _compact(spark: SparkSession, root: str, months) -> list[str]:
    """One full load of all rows of ``months()``.  A load committed meanwhile is not overwritten: the work starts again."""
    while True:
        after, names = commit_log.last(spark, log_path(root)), months()
        if not names:
            return []
        rows = read_monthly(spark, root).filter(F.col("month").isin(names))
        one = merge_counts(rows, keys=("month", "base_fen", "player_elo_bucket", "move_san"))
        parts = spark.createDataFrame([(m, FULL_PART) for m in names], "month string, part string")
        try:
            write_month(one, root, whole=True, parts=parts, after=after)
        except commit_log.Taken:
            continue
        return names


def read_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """A count table; None where there is none."""
    return read_table(spark, path, COUNTS)


def _version(spark: SparkSession, merged_path: str) -> dict | None:
    """The manifest of the last finished version of the merged table: ``seq``, ``covered``, ``runs``."""
    log = log_path(merged_path)
    seq = commit_log.last(spark, log)
    if seq:
        return commit_log.entry(spark, log, seq)
    if read_counts(spark, merged_path) is not None:
        raise ValueError(f"{merged_path} holds data but no finished version: which months it covers is not known")
    return None


def _signed(rows: DataFrame | None, sign: int) -> list[DataFrame]:
    if rows is None:
        return []
    plays = F.col("times_played") if sign > 0 else (-F.col("times_played")).alias("times_played")
    return [rows.select("base_fen", "player_elo_bucket", "move_san", plays)]


def _changes(spark: SparkSession, monthly_root: str, covered: DataFrame, loads: DataFrame) -> list[DataFrame]:
    """What the monthly store holds beside the covered loads: newer loads, and with their counts negated the
    covered loads that have been replaced since."""
    keys = ["month", "part", "load"]
    return (_signed(_rows_of(spark, monthly_root, loads.join(covered, keys, "left_anti")), 1)
            + _signed(_rows_of(spark, monthly_root, covered.join(loads, keys, "left_anti")), -1))


def _write_run(spark: SparkSession, parts: list[DataFrame], merged_path: str, level: int, partitions: int | None) -> dict | None:
    """One sorted run of the summed ``parts``; None if nothing is left of them."""
    path = f"{merged_path.rstrip('/')}/{uuid.uuid4().hex}"
    write_sorted(merge_counts(*parts), path, partitions, RUN_FILE_ROWS)
    rows = spark.read.schema(COUNTS).parquet(path).count()
    return {"path": path, "level": level, "rows": rows} if rows else None


def merge_months(spark: SparkSession, monthly_root: str, merged_path: str, partitions: int | None = None, *,
                 full: bool = False, fanout: int = FANOUT) -> DataFrame:
    """Bring the merged table up to the current loads, as a new version.

    A version is a manifest in the commit log ``<merged_path>_log``: the sorted runs that make it
    up, each indexed by key range, and the loads they cover.  What changed since the last version
    (new loads, and the replaced ones with negative counts) becomes one more run; ``fanout`` runs of a level
    become one of the next.  So merging a month reads and writes that month, and a row is written
    again once a level, not once a merge.  ``full`` sums every current load into one run instead.

    A reader sees a whole version or the one before, and earlier versions stay readable
    (``vacuum`` removes them).  Where another merge finishes first this one starts again from its version.
    """
    while True:
        loads, before = current_loads(spark, monthly_root), _version(spark, merged_path)
        if loads is None:
            raise FileNotFoundError(monthly_root)
        covered_path = f"{merged_path.rstrip('/')}_covered/{uuid.uuid4().hex}"
        loads.coalesce(1).write.parquet(covered_path)
        loads = spark.read.schema(COVERED).parquet(covered_path)
        runs = [] if full or before is None else before["runs"]
        known = spark.createDataFrame([], COVERED) if full or before is None else spark.read.schema(COVERED).parquet(before["covered"])
        changes = _changes(spark, monthly_root, known, loads)
        new = _write_run(spark, changes, merged_path, 0, partitions) if changes else None
        runs = [*runs, new] if new else list(runs)
        level = 0
        while any(r["level"] >= level for r in runs):
            own = [r for r in runs if r["level"] == level]
            if len(own) >= fanout:
                read = [spark.read.schema(COUNTS).parquet(r["path"]) for r in own]
                one = _write_run(spark, read, merged_path, level + 1, partitions)
                runs = [r for r in runs if r["level"] != level] + ([one] if one else [])
            level += 1
        try:
            commit_log.append(spark, log_path(merged_path), {"kind": "version", "covered": covered_path, "runs": runs},
                              (before["seq"] if before else 0) + 1)
        except commit_log.Taken:
            continue
        return read_merged(spark, merged_path)


def merged_runs(spark: SparkSession, merged_path: str) -> list[dict]:
    """The runs of the last version (``path``, ``level``, ``rows``)."""
    version = _version(spark, merged_path)
    return [] if version is None else version["runs"]


def _union_runs(spark: SparkSession, runs: list[dict], keys: DataFrame | None = None) -> list[DataFrame]:
    return [spark.read.schema(COUNTS).parquet(r["path"]) if keys is None else read_for(spark, r["path"], keys) for r in runs]


def read_merged(spark: SparkSession, merged_path: str) -> DataFrame | None:
    """The last finished version of the merged table, one row a key."""
    version = _version(spark, merged_path)
    if version is None:
        return None
    runs = _union_runs(spark, version["runs"])
    return spark.createDataFrame([], COUNTS) if not runs else runs[0] if len(runs) == 1 else merge_counts(*runs)


def counts_view(spark: SparkSession, merged_path: str | None, monthly_root: str | None,
                prefer: str = "union", keys: DataFrame | None = None) -> DataFrame | None:
    """The counts to answer lookups from, re-resolved on every call.

    ``union``: the merged table's runs plus the loads made after its version, so new months and
    micro-batches are visible at once, less the covered loads that have been replaced since: their rows
    come with negative counts, so the merged table is still what is read.  ``merged_first``: the
    merged table alone when present, else all monthly loads.  None when there is no data at all; merged
    data without a finished version is an error, never "nothing covered".

    The view is a UNION ALL, not re-aggregated: a key may appear more than once, and sums are what
    counts (lookups sum after their position filter has reached every scan, and leave out what sums to
    0).  Use ``merge_counts(view)`` where one row per key is needed.  With ``keys`` (``base_fen``) only
    the files of the merged table that can hold one of them are opened; rows of other keys may remain.
    """
    version = _version(spark, merged_path) if merged_path else None
    if version is None:
        monthly = read_monthly(spark, monthly_root) if monthly_root else None
        return None if monthly is None else monthly.drop("month", "part")
    sources = _union_runs(spark, version["runs"], keys)
    loads = current_loads(spark, monthly_root) if monthly_root else None
    if loads is not None and prefer != "merged_first":
        sources += _changes(spark, monthly_root, spark.read.schema(COVERED).parquet(version["covered"]), loads)
    return reduce(DataFrame.unionByName, sources) if sources else spark.createDataFrame([], COUNTS)


def vacuum(spark: SparkSession, monthly_root: str, merged_path: str | None = None, *, keep_versions: int = 1,
           older_than_seconds: float = 7 * 24 * 3600, dry_run: bool = False) -> list[str]:
    """Remove loads and runs that no reader of the last ``keep_versions`` versions needs; returns their paths.

    Kept are the current loads, the loads a kept version covers (a view may have to take them back out), the
    runs of kept versions, and whatever is younger than ``older_than_seconds``: readers that
    started on something older, and writers that have not committed yet.  Log entries stay.
    """
    kept_loads, kept_paths = current_loads(spark, monthly_root), set()
    kept = [] if kept_loads is None else [kept_loads.select("load")]
    if merged_path is not None:
        log = log_path(merged_path)
        newest = commit_log.last(spark, log)
        for seq in range(max(1, newest - keep_versions + 1), newest + 1):
            version = commit_log.entry(spark, log, seq)
            kept_paths |= {version["covered"], *(r["path"] for r in version["runs"]), *(index_path(r["path"]) for r in version["runs"])}
            kept.append(spark.read.schema(COVERED).parquet(version["covered"]).select("load"))
    needed = {r["load"] for r in reduce(DataFrame.union, kept).distinct().toLocalIterator()} if kept else set()
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    folders = [monthly_root, _loads_path(monthly_root)]
    folders += [] if merged_path is None else [merged_path, f"{merged_path.rstrip('/')}_covered"]
    gone, kept_names = [], {p.rstrip("/").rsplit("/", 1)[-1] for p in kept_paths}
    for folder in folders:
        where = path(folder)
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(where):
            continue
        now = sc._jvm.java.lang.System.currentTimeMillis()
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            used = name.removeprefix("load=") in needed if folder in folders[:2] else name in kept_names
            if used or not status.isDirectory() or now - status.getModificationTime() < older_than_seconds * 1000:
                continue
            gone.append(status.getPath().toString())
            if not dry_run:
                fs.delete(status.getPath(), True)
    return gone


def head_rows(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def row_at(df: DataFrame, index: int, order_by) -> DataFrame:
    """The row at 0-based ``index`` in ``order_by`` order.

    Rows are range-partitioned and written; the chunks' row counts say which one
    holds the index, and only that chunk is sorted, so the work of one task does
    not grow with the index.
    """
    spark, cols = df.sparkSession, [order_by] if isinstance(order_by, str) else list(order_by)
    path = scratch_path(spark, "row-at-chunks")
    df.repartitionByRange(*cols).withColumn("_chunk", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType(df.schema.fields + [T.StructField("_chunk", T.IntegerType())])).parquet(path)
    rest = index
    for chunk, n in sorted((r["_chunk"], r["count"]) for r in rows.groupBy("_chunk").count().collect()):
        if rest < n:
            return rows.filter(F.col("_chunk") == chunk).drop("_chunk").orderBy(*cols).offset(rest).limit(1)
        rest -= n
    return rows.drop("_chunk").limit(0)
