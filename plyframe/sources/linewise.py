"""Games out of archive lines, wherever records and splits begin.

The record reader parts an archive at ``[Event``.  Here nothing marks a game but
the line rules themselves: tag lines gather, the next line that is no tag is the
movetext, which ends the game and empties the tags.  Each split of the text is
scanned once, in its own task, and gives its whole games; only what hangs over a
border - the tags after a split's last movetext, the split's first game - is put
together afterwards, from two rows a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.functions.columns import tag_of
from plyframe.schemas import HEADERS
from plyframe.session import scratch_path

FOUND = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("nth", T.LongType()),
    T.StructField("headers", HEADERS), T.StructField("movetext", T.StringType())])
#: Games sent on at once.
AT_ONCE = 1000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits in order -> games; a split's last row has its left-over tags and no movetext."""
    rows: list[tuple] = []
    place, nth, tags = None, 0, {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], FOUND.names)

    for batch in batches:
        files, splits, lines, keys, values = (batch.column(i).to_pylist() for i in range(5))
        for i, line in enumerate(lines):
            here = (files[i], splits[i])
            if here != place:
                if place is not None:
                    rows.append((*place, nth, list(tags.items()), None))
                place, nth, tags = here, 0, {}
            if keys[i] is not None:
                tags.pop(keys[i], None)  # the last of a repeated key counts
                tags[keys[i]] = values[i]
            elif not line.startswith("["):
                rows.append((*here, nth, list(tags.items()), line))
                nth, tags = nth + 1, {}
        if len(rows) >= AT_ONCE:
            yield flush()
            rows = []
    if place is not None:
        rows.append((*place, nth, list(tags.items()), None))
    if rows:
        yield flush()


def merged_maps(maps: Column) -> Column:
    """Maps put together in order; the last value of a key counts."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.aggregate(maps, empty, lambda a, m: F.map_concat(
        F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m))


def read_games_linewise(spark: SparkSession, paths) -> DataFrame:
    """Archive files -> ``game_id``, ``headers``, ``movetext``, in the order of ``game_id`` within a file.

    A line is stripped; blank lines mean nothing; a line that starts with ``[`` is a tag (without a space
    in it: nothing); any other line is a game's movetext.  Tags before it are its headers, the last of a
    repeated key counts, whatever tag comes first and wherever the file is split; tags after the
    last movetext belong to no game.  Files without a line give no game.
    """
    raw = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    line = F.trim(F.col("value"), F.lit(" \t\n\x0b\x0c\r"))
    tag = tag_of(F.col("line"))
    lines = (raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), line.alias("line"))
             .filter("line <> ''").select("file", "split", "line", tag["k"].alias("k"), tag["v"].alias("v")))
    path = scratch_path(spark, "linewise")
    lines.mapInArrow(_scan, FOUND).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    whole = found.filter("movetext is not null and nth > 0")
    # Two rows a split: its first game (which may want tags of splits before) and what is left over after its last.
    border = found.filter("movetext is null or nth = 0")
    order = Window.partitionBy("file").orderBy("split").rangeBetween(Window.unboundedPreceding, 0)
    splits = border.groupBy("file", "split").agg(F.max(F.when(F.col("movetext").isNotNull(), 1).otherwise(0)).alias("has"))
    upto = splits.select("file", "split", F.sum("has").over(order).alias("upto"))
    # Maps can not be ordered: their entries can.
    one = F.struct("split", F.map_entries("headers").alias("tags"))
    joined = border.join(upto, ["file", "split"]).withColumn(
        "at", F.when(F.col("movetext").isNotNull(), F.col("upto") - 1).otherwise(F.col("upto")))
    first = joined.groupBy("file", "at").agg(
        F.sort_array(F.collect_list(F.when(F.col("movetext").isNull(), one))).alias("before"),
        F.max(F.when(F.col("movetext").isNotNull(), F.struct("split", "movetext"))).alias("g"),
        F.max_by("headers", F.when(F.col("movetext").isNotNull(), F.col("split"))).alias("own"))
    first = first.filter("g is not null").select(
        "file", F.col("g.split").alias("split"), F.lit(0).cast("long").alias("nth"),
        merged_maps(F.concat(F.transform("before", lambda b: F.map_from_entries(b["tags"])), F.array("own"))).alias("headers"), F.col("g.movetext").alias("movetext"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 15, "0")
    return whole.unionByName(first).select(F.concat_ws("#", "file", F.concat_ws(".", pad("split"), pad("nth"))).alias("game_id"),
                                           "headers", "movetext")
