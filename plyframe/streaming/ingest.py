"""Incremental ingest of monthly archives: catalogue, ledger, batch and streaming paths."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.columns import col_of, url_join
from plyframe.operators.counts import count_moves
from plyframe.operators.extract import extract_positions
from plyframe.operators.qualify import qualify_games
from plyframe.schemas import COUNTERS, COVERS, LEDGER, STORED_COUNTS
from plyframe.session import scratch_path
from plyframe.sources import commit_log
from plyframe.sources.archive import RECORD_SEP, parse_games, read_records
from plyframe.sources.storage import (FULL_PART, committed_covers, log_entries, log_path, read_table, write_month)

# Monthly archive links on a listing page: an optional folder, a name ending in
# _YYYY-MM, the .pgn.zst suffix (path = group 1, month = group 2).
ARCHIVE_LINK_PATTERN = r'href="((?:[\w-]+/)?[\w-]*?_(\d{4}-\d{2})\.pgn\.zst)"'
ARCHIVE_BASE_URL = "https://archive.example.org/"
MAX_MONTHS_PER_RUN = 3
MONTH_IN_PATH = r"(\d{4}-\d{2})"
UNKNOWN_MONTH = "unknown"


def list_links(pages: DataFrame, html_col: str = "html", pattern: str = ARCHIVE_LINK_PATTERN,
               base_url: str = ARCHIVE_BASE_URL, path_group: int = 1, key_group: int = 2,
               key_name: str = "year_month") -> DataFrame:
    """Every match in every page -> (key, absolute url), one row per key, in no order.

    A key listed twice is kept once (smallest url, so reruns agree).
    """
    html = F.col(html_col)
    keys = F.regexp_extract_all(html, F.lit(pattern), key_group)
    if path_group == key_group:  # one regex pass when the key is the path itself
        found = pages.select(F.explode(keys).alias("k")).select(F.col("k").alias(key_name),
                                                                 url_join(base_url, "k").alias("url"))
    else:
        pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(html, F.lit(pattern), path_group).alias("p"))
        found = pages.select(F.inline(pairs)).select(F.col("k").alias(key_name),
                                                     url_join(base_url, "p").alias("url"))
    return found.groupBy(key_name).agg(F.min("url").alias("url"))


def list_months(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return list_links(pages, html_col)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Processed months as a sorted set, out of the commit log of the store at ``path``; a missing log is empty."""
    entries = log_entries(spark, path)
    if entries is None:
        return spark.createDataFrame([], LEDGER)
    return entries.select(F.explode("processed").alias("year_month")).distinct().orderBy("year_month")


def add_to_ledger(spark: SparkSession, path: str, months: DataFrame) -> DataFrame:
    """Name months as processed without data (set semantics on read, so adding again changes nothing): one
    entry of the commit log, whoever else writes.  The months of one run pass through the driver."""
    names = sorted(r["year_month"] for r in months.select("year_month").distinct().collect())
    if names:
        commit_log.append(spark, log_path(path), {"kind": "ledger", "processed": names})
    return load_ledger(spark, path)


def ledger_union(ledger: DataFrame, months: DataFrame) -> DataFrame:
    return ledger.select("year_month").union(months.select("year_month")).distinct().orderBy("year_month")


def pending_months(available: DataFrame, ledger: DataFrame, max_months: int | None = None) -> DataFrame:
    """Months listed but not yet processed, oldest first, capped per run (dry run = this frame)."""
    todo = available.join(ledger.select("year_month"), "year_month", "left_anti").orderBy("year_month")
    return todo.limit(max_months) if max_months is not None else todo


def part_of(file) -> Column:
    """The part a file's rows are loaded as: the same for every path that reads the file."""
    return F.substring(F.sha2(col_of(file), 256), 1, 16)


def _counted(positions: DataFrame, buckets: tuple[int, int] | None) -> DataFrame:
    kept = positions if buckets is None else positions.filter(F.col("player_elo_bucket").between(*buckets))
    return count_moves(kept, keys=("month", "part", "base_fen", "player_elo_bucket", "move_san"))


def _judged(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Records (month, part, value) parsed and judged, written once under the shared scratch folder.

    Counters and positions both come from what was written: the archive is decompressed once, the replay is
    spread by the written rows, and what a rejected game looked like is not kept."""
    games = parse_games(records.hint("rebalance")).select(
        F.lit(None).cast("string").alias("game_id"), "month", "part", "headers", "movetext")
    judged = qualify_games(games, with_reason=True)
    judged = judged.withColumn("movetext", F.when(F.col("reject_reason").isNull(), F.col("movetext")))
    path, schema = scratch_path(spark, "judged"), judged.schema
    judged.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _counters(judged: DataFrame) -> DataFrame:
    """(month, part) with games scanned, kept and rejected by reason: plain counts of the judged games, so a
    month whose games are all rejected has its numbers like any other."""
    reason = F.col("reject_reason")
    return judged.groupBy("month", "part").agg(
        F.count(F.lit(1)).alias("scanned"), F.count(F.when(reason.isNull(), 1)).alias("kept"),
        *[F.count(F.when(reason == name, 1)).alias(name) for name in COUNTERS[2:]])


def _stored(spark: SparkSession, root: str, seq: int) -> dict:
    """Counters and positions of the load committed as entry ``seq``."""
    load = commit_log.entry(spark, log_path(root), seq)["load"]
    covers = read_table(spark, f"{root.rstrip('/')}_loads", COVERS).filter(F.col("load") == load)
    numbers = covers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).first().asDict()
    rows = read_table(spark, root, STORED_COUNTS)
    rows = rows.filter(F.col("load") == load) if rows is not None else None
    numbers["positions"] = 0 if rows is None else rows.agg(F.coalesce(F.sum("times_played"), F.lit(0))).first()[0]
    return numbers


def ingest(spark: SparkSession, archives: DataFrame, monthly_root: str, *,
           record_sep: str = RECORD_SEP, buckets: tuple[int, int] | None = None, at_once: int = 4,
           extract=extract_positions) -> DataFrame:
    """Batch path: (year_month, path) archives -> the current load of each month.

    Each month is one distributed pipeline (read, judge, replay, count, write); its load
    replaces everything loaded for the month before, by batch or stream, and
    its rows are filed by source file, so the stream reading the same file
    replaces them too.  ``at_once`` months run together: while one is
    decompressed by a single task the others fill the cluster.  A failing month
    commits nothing, is reported with its whole message and does not stop the
    others.  The month's load and its place in the ledger (``load_ledger(spark, monthly_root)``) are one entry of
    the commit log; a month without a game that qualifies is processed like any other, as an empty load.

    ``archives`` is the list of one run (as ``update_months`` caps it): its rows
    pass through the driver, one at a time.  ``buckets`` keeps an inclusive
    range of rating buckets (None: all); ``extract`` makes positions of games (``steps.extract_steps`` keys them by
    their line of moves, without a replay).  Returns a report (year_month, status,
    error, games_scanned, games_kept, rejected_bullet, rejected_termination, rejected_rating,
    positions stored, files, seconds); the counters are stored with the load.
    """
    def one(row) -> tuple:
        month, path = row["year_month"], row["path"]
        began = time.monotonic()
        try:
            judged = _judged(spark, read_records(spark, path, record_sep).select(
                F.lit(month).alias("month"), part_of("file").alias("part"), "value"))
            kept = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
            covers = _counters(judged).unionByName(
                spark.createDataFrame([(month, FULL_PART)], "month string, part string"), allowMissingColumns=True)
            files = spark.read.format("binaryFile").load(path).select("path").count()
            seq = write_month(_counted(extract(kept), buckets), monthly_root, whole=True, parts=covers,
                              processed=[month])
        except Exception as e:  # isolate the month; the others still run
            return month, "failed", f"{type(e).__name__}: {e}", *[None] * 7, time.monotonic() - began
        n = _stored(spark, monthly_root, seq)
        return (month, "done", None, *[n[c] for c in COUNTERS], n["positions"], files, time.monotonic() - began)

    rows = archives.select("year_month", "path").orderBy("year_month").toLocalIterator()
    report = []
    with ThreadPoolExecutor(at_once) as pool:
        for batch in iter(lambda: list(islice(rows, at_once)), []):
            report += list(pool.map(one, batch))
    return spark.createDataFrame(report, "year_month string, status string, error string, games_scanned long, games_kept long, "
                                         "rejected_bullet long, rejected_termination long, rejected_rating long, "
                                         "positions long, files long, seconds double")


def stream_progress(spark: SparkSession, monthly_root: str) -> DataFrame:
    """Per micro-batch counters of ``ingest_stream`` (games scanned, kept and rejected by reason, positions stored):
    those of the load the batch committed last."""
    covers = committed_covers(spark, monthly_root).filter("batch_id is not null")
    last = covers.groupBy("batch_id").agg(F.max("seq").alias("seq"))
    names = ["games_scanned", "games_kept", *[f"rejected_{c}" for c in COUNTERS[2:]]]
    own = covers.join(last, ["batch_id", "seq"]).groupBy("batch_id", "load").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(COUNTERS, names)])
    data = read_table(spark, monthly_root, STORED_COUNTS)
    plays = (spark.createDataFrame([], "load string, positions long") if data is None
             else data.groupBy("load").agg(F.sum("times_played").alias("positions")))
    return (own.join(plays, "load", "left").select("batch_id", *names, F.coalesce("positions", F.lit(0)).alias("positions"))
            .orderBy("batch_id"))


def ingest_stream(spark: SparkSession, source_dir: str, monthly_root: str, checkpoint: str, *,
                  path_glob: str = "*", month_pattern: str = MONTH_IN_PATH,
                  max_files_per_trigger: int | None = None, record_sep: str = RECORD_SEP,
                  buckets: tuple[int, int] | None = None, extract=extract_positions):
    """Streaming path: new archive files under ``source_dir`` -> month partitions.

    ``availableNow`` drains what is there and stops; the file source's
    checkpoint log is the ledger, so a rerun sees only files added since.
    Each file is read whole in one micro-batch and its counts are loaded as its
    own part of every month it holds: a replayed batch, a lost checkpoint, other
    batch sizes and the batch path all replace the same part instead of adding
    to it, also where a file has no game left that qualifies.  Records are rebalanced over the cluster right after
    they are split, so a compressed month is not parsed and replayed by the task that
    decompresses it.
    """
    tag = record_sep.lstrip("\n")
    reader = spark.readStream.option("lineSep", record_sep)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.text(f"{source_dir.rstrip('/')}/{path_glob}")
    value = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit(tag), "value"))
    file = F.col("_metadata.file_path")
    month = F.regexp_extract(file, month_pattern, 1)
    # A file whose path names no month is kept, under month=unknown.
    records = stream.select(F.when(month != "", month).otherwise(F.lit(UNKNOWN_MONTH)).alias("month"),
                            part_of(file).alias("part"), value.alias("value"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        judged = _judged(spark, batch)
        kept = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
        write_month(_counted(extract(kept), buckets), monthly_root, parts=_counters(judged), batch_id=batch_id)

    query = (records.writeStream.foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def update_months(spark: SparkSession, available: DataFrame, archive_dir: str,
                  monthly_root: str, *, max_months: int = MAX_MONTHS_PER_RUN, dry_run: bool = False):
    """One scheduled run: catalogue minus ledger, capped, then ingest.

    ``available`` is the (year_month, url) catalogue (``list_months``); each
    archive is expected in ``archive_dir`` under the url's file name (fetching
    is outside this library).  The ledger is the store's own commit log.  ``dry_run`` returns the pending months without
    reading anything.  Returns (report, months still pending after the cap).
    """
    todo = pending_months(available, load_ledger(spark, monthly_root))
    batch = todo.limit(max_months)
    if dry_run:
        return batch, None
    remaining = todo.count() - batch.count()
    base = archive_dir.rstrip("/") + "/"
    archives = batch.select("year_month", F.concat(F.lit(base), F.substring_index("url", "/", -1)).alias("path"))
    return ingest(spark, archives, monthly_root), remaining
