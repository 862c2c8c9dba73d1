"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.session import scratch_path

#: ASCII white space (space, tab, LF, VT, FF, CR) and its complement, as Java and DuckDB patterns.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the
    lineage, and survives the loss of any executor."""
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_fold(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as the empty text)."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def least_hashed(rows: DataFrame, n: int, *order: str, at: str = "at", total: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hash ``at`` (then ``order``), whatever the number of tasks.

    Rows are counted first, and only those under the hash that some more than ``n`` of them lie under are
    ordered: not ``n`` rows of every task meet in one place.  Where equal rows share
    hashes and too few lie under it, all are ordered, so the result is always the same."""
    total = rows.count() if total is None else total
    if total > 4 * n:
        bound = min((1 << 63) - 1, int((1.5 * n + 200) / total * 2.0 ** 64) - (1 << 63))
        some = rows.filter(F.col(at) <= F.lit(bound))
        if some.count() >= n:
            rows = some
    return rows.orderBy(at, *order).limit(n)


def row_key(text: str = "text") -> Column:
    """Fingerprint of a row's text that tells rows of one doc_id apart."""
    c = F.col(text).cast("string")
    return F.concat_ws(":", F.xxhash64(c).cast("string"), F.coalesce(F.octet_length(c), F.lit(-1)).cast("string"))


def keep_rows(docs: DataFrame, keepers: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` named by ``keepers`` (``_id``, ``_key``, ``_ties``), columns of ``docs``.

    ``_ties`` counts the rows of the group with the same id and key; such rows
    are copies of one another, so where it is over 1 one of them is taken.
    """
    cols = docs.columns
    keyed = docs.withColumn("__key", key)
    found = (keyed.join(keepers.select(F.col("_id").alias("__kid"), F.col("_key").alias("__kkey"),
                                       F.col("_ties").alias("__ties")),
                        F.col(f"`{id_col}`").eqNullSafe(F.col("__kid")) & (F.col("__key") == F.col("__kkey"))))
    if keepers.filter(F.col("_ties") > 1).isEmpty():
        return found.select(*[F.col(f"`{c}`") for c in cols])
    one = found.filter(F.col("__ties") == 1)
    many = found.filter(F.col("__ties") > 1).dropDuplicates([id_col, "__key"])
    return one.unionByName(many).select(*[F.col(f"`{c}`") for c in cols])


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Alternating large-star and small-star rounds.  Each round aggregates the
    smallest neighbour per node (combined before the shuffle) and joins it back,
    so a node with very many neighbours is never gathered in one task; each
    round's edges are written to the shared folder.
    """
    cur = save(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                                    F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        new = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        cur = save(spark, small, name)
