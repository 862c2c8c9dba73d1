"""Position-sorted count tables with an index of their files.

A sorted table's files hold consecutive key ranges, each file sorted.  Beside it
(``<path>_index``) stands one row per file: its first and last key, its rows and
the rows before it.  So a batch of keys opens the files that can hold one of
them, and the row at a position is in a file the index names: no row is read to
find out where to look.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.schemas import COUNT_KEYS, COUNTS

# Row groups small enough that a point lookup on the sorted key reads few of them.
SORTED_BLOCK_BYTES = 16 * 1024 * 1024
#: Files up to which the index is searched as one array; beyond it Parquet's own statistics prune.
INDEX_FILES = 50_000
#: Files that can hold a key, up to which the paths are named one by one.
NAMED_FILES = 50_000

INDEX = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("rows", T.LongType()),
    T.StructField("rows_before", T.LongType()), T.StructField("first_key", T.StringType()),
    T.StructField("last_key", T.StringType())])


def index_path(path: str) -> str:
    return path.rstrip("/") + "_index"


def read_table(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at ``path``; None only where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_sorted(counts: DataFrame, path: str, partitions: int | None = None, max_records: int = 0,
                 index: bool = True) -> None:
    """Counts sorted by (position, bucket, move): range partitions hold disjoint
    position ranges and each file is sorted, so Parquet min/max statistics let a
    lookup skip nearly every row group.  Without ``partitions`` AQE sizes the
    ranges; ``max_records`` bounds a file's rows (0: one file a range).  Row groups carry a Bloom
    filter of their positions, and the files are indexed (see ``read_index``) unless ``index`` is off."""
    cols = counts.select(*[f.name for f in COUNTS.fields])
    ranged = cols.repartitionByRange(partitions, "base_fen") if partitions else cols.repartitionByRange("base_fen")
    (ranged.sortWithinPartitions(*COUNT_KEYS).write.mode("overwrite")
     .option("parquet.block.size", SORTED_BLOCK_BYTES).option("maxRecordsPerFile", max_records)
     .option("parquet.bloom.filter.enabled#base_fen", "true").parquet(path))
    if index:
        build_index(counts.sparkSession, path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Write the index of the sorted table at ``path``: one pass over its key columns."""
    rows = spark.read.schema(COUNTS).parquet(path).select(F.col("_metadata.file_path").alias("file"), *COUNT_KEYS)
    key = F.struct(*COUNT_KEYS)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("_lo"), F.max(key).alias("_hi"),
                                     F.min("base_fen").alias("first_key"), F.max("base_fen").alias("last_key"))
    order = Window.orderBy("_lo", "_hi", "file")  # a row a file
    (files.select("file", (F.row_number().over(order) - 1).cast("long").alias("file_no"), "rows",
                  (F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("rows_before"),
                  "first_key", "last_key")
     .coalesce(1).write.mode("overwrite").parquet(index_path(path)))
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """``file``, ``file_no`` (from 0 in key order), ``rows``, ``rows_before``, ``first_key``, ``last_key``;
    None for a table without an index."""
    return read_table(spark, index_path(path), INDEX)


def count_below(values: Column, bound: Column, inclusive: bool = False, item=lambda x: x) -> Column:
    """How many of the ascending ``values`` lie under ``bound`` (with ``inclusive``: not above it).

    A binary search by doubling steps, in Catalyst: as many comparisons as the length has bits."""
    n = F.size(values)
    bits = F.length(F.bin(n)).cast("int")
    steps = F.transform(F.sequence(bits - 1, F.lit(0)), lambda b: F.pow(F.lit(2.0), b).cast("int"))
    under = lambda v: (v <= bound) if inclusive else (v < bound)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & F.coalesce(under(item(F.get(values, at + step - 1))), F.lit(False)), at + step).otherwise(at))


def _sorted_array(strings: list[str]) -> Column:
    """Strings as one array literal."""
    return F.split(F.lit("\x00".join(strings)), "\x00")


def files_of(spark: SparkSession, path: str, keys: DataFrame, key: str = "base_fen") -> list[str] | None:
    """The files of the sorted table that can hold one of ``keys``, in key order; None where that can not be told
    (no index, or more files than the driver should hold)."""
    index = read_index(spark, path)
    if index is None:
        return None
    rows = index.orderBy("file_no").limit(INDEX_FILES + 1).collect()
    if not rows or len(rows) > INDEX_FILES:
        return None if rows else []
    first = _sorted_array([r["first_key"] or "" for r in rows])
    last = _sorted_array([r["last_key"] or "" for r in rows])
    k = F.col(key)
    low, high = count_below(last, k), count_below(first, k, inclusive=True) - 1
    hit = (keys.filter(k.isNotNull()).select(low.alias("low"), high.alias("high")).filter("low <= high").distinct()
           .select(F.explode(F.sequence("low", "high")).alias("file_no")).distinct())
    return [rows[i]["file"] for i in sorted(r["file_no"] for r in hit.collect())]


def read_for(spark: SparkSession, path: str, keys: DataFrame, key: str = "base_fen") -> DataFrame:
    """The sorted table's rows in the files that can hold one of ``keys``; other files are not opened.

    One small job over the keys runs at once (a binary search in the index); rows of other keys in
    those files are still there, as the caller joins anyway."""
    files = files_of(spark, path, keys, key)
    if files is None or len(files) > NAMED_FILES:
        return spark.read.schema(COUNTS).parquet(path)
    return spark.read.schema(COUNTS).parquet(*files) if files else spark.createDataFrame([], COUNTS)


def row_at_index(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The row at 0-based ``index`` of the sorted table: the index names its file, which alone is opened; nothing is
    written.  No row beyond the end."""
    table = read_index(spark, path)
    if table is None:
        table = build_index(spark, path)
    at = table.filter((F.col("rows_before") <= index) & (F.col("rows_before") + F.col("rows") > index)).first()
    if at is None:
        return spark.createDataFrame([], COUNTS)
    rows = spark.read.schema(COUNTS).parquet(at["file"])
    return rows.orderBy(*COUNT_KEYS).offset(index - at["rows_before"]).limit(1)


def head_of(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the sorted table: the files that hold them alone are opened."""
    table = read_index(spark, path)
    if table is None:
        table = build_index(spark, path)
    files = [r["file"] for r in table.filter(F.col("rows_before") < n).select("file").collect()]  # n files at most
    return spark.read.schema(COUNTS).parquet(*files).orderBy(*COUNT_KEYS).limit(n) if files else spark.createDataFrame([], COUNTS)
