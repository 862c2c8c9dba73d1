"""Game archives (PGN text, plain or compressed) as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.columns import record_games
from plyframe.sources.zstd_frames import PARTITION_BYTES, read_frames

# A record starts at every game's first tag; the text source splits on it, so
# big plain files split across tasks without losing or duplicating games.
RECORD_SEP = "\n[Event "


def parse_games(records: DataFrame, value_col: str = "value") -> DataFrame:
    """Records of archive text -> one row per game: ``headers map, movetext``.

    Other record columns are carried along; ``game_index`` is the game's
    position inside its record.
    """
    keep = [c for c in records.columns if c != value_col]
    return (records
            .select(*keep, F.posexplode(record_games(value_col)).alias("game_index", "g"))
            .select(*keep, "game_index", F.col("g.headers").alias("headers"),
                    F.col("g.movetext").alias("movetext")))


def read_records(spark: SparkSession, paths, record_sep: str = RECORD_SEP) -> DataFrame:
    """Archive files -> ``(file, record_id, value)`` with the separator's tag restored."""
    if isinstance(paths, str):
        paths = [paths]
    tag = record_sep.lstrip("\n")
    raw = spark.read.option("lineSep", record_sep).text(list(paths))
    value = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit(tag), "value"))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.monotonically_increasing_id().alias("record_id"),
                      value.alias("value"))


def read_frame_records(spark: SparkSession, path: str, record_sep: str = RECORD_SEP,
                       partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``read_records`` of a Zstandard archive of many frames (or a folder of them), read by many tasks."""
    tag = record_sep.lstrip("\n")
    raw = read_frames(spark, path, record_sep, partition_bytes)
    value = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit(tag), "value"))
    return raw.select("file", "record_id", value.alias("value"))


def read_games(spark: SparkSession, paths, *, record_sep: str = RECORD_SEP,
               partitions: int | None = None, frames: bool = False) -> DataFrame:
    """Archive files -> games(raw) with ``game_id`` = ``file#record.index`` (zero-padded).

    Compressed files are one task each; raw records are rebalanced by their
    bytes (or dealt to ``partitions``) before parsing, so the parse and replay
    are not bound to one core per file.  With ``frames`` (Zstandard archives of
    many frames) decompression is not either: each task reads its own frames.
    """
    plist = [paths] if isinstance(paths, str) else list(paths)
    if frames:
        records = reduce(DataFrame.unionByName, [read_frame_records(spark, p, record_sep) for p in plist])
    else:
        records = read_records(spark, plist, record_sep)
    records = records.repartition(partitions, "record_id") if partitions else records.hint("rebalance")
    games = parse_games(records)
    # Zero-padded so that ordering by game_id follows the order records were read.
    games = games.select(
        F.concat_ws("#", "file", F.concat_ws(".", F.lpad(F.col("record_id").cast("string"), 20, "0"),
                                             F.lpad(F.col("game_index").cast("string"), 6, "0"))).alias("game_id"),
        "headers", "movetext")
    return games
