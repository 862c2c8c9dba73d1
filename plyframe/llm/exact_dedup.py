"""Exact dedup by deterministic block naming (DataFrame functions only).

Every normalised text is cut into blocks of a fixed number of bytes.  The
distinct blocks are sorted and numbered: equal blocks, and only they, get the
same integer.  Adjacent integers are then paired, the distinct pairs sorted and
numbered, and so on until each document is left with one integer.  Two
documents are equal exactly when they have the same number of blocks and the
same last integer.

What moves: the distinct block texts once (combined before the shuffle, so a
text with very many copies costs one row a task), and 8 to 24 bytes a block
otherwise.  A block's hash is the join key that brings its integer back; hashes
that two different blocks share are found by counting all distinct blocks, and
those blocks get their integers through their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import BLANKS, keep_rows, save, text_of

BLOCK_BYTES = 8192


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_of(col), BLANKS, " ")


def _blocks(text: Column, block_bytes: int) -> Column:
    """The UTF-8 bytes of ``text`` in blocks; the empty text is one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / F.lit(block_bytes)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _hash(block: Column, hash_bits: int) -> Column:
    h = F.xxhash64(block)
    return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))


def _name(distinct: DataFrame, by) -> DataFrame:
    """Sort and number: the partition's number and the place in its sorted order."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_texts(spark: SparkSession, rows: DataFrame, *, block_bytes: int = BLOCK_BYTES,
               hash_bits: int = 64) -> DataFrame:
    """``rid``, ``doc_id``, ``text_sha256``, ``n`` (blocks) and ``name`` for every row of
    ``rows`` (``doc_id``, ``_norm``): equal ``(n, name)`` means equal ``_norm``.

    ``hash_bits`` narrows the block hash so that tests can force shared hashes.
    """
    blocks = _blocks(F.col("_norm"), block_bytes)
    heads = save(spark, rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(F.col("_norm"), 256).alias("text_sha256"),
        F.transform(blocks, lambda b: _hash(b, hash_bits)).alias("hs")), "block-heads")
    block_rows = rows.select(F.explode(blocks).alias("block")).select(
        _hash(F.col("block"), hash_bits).alias("h"), "block")
    distinct = block_rows.distinct()
    names = save(spark, _name(distinct, ["block"]).select("h", "name"), "block-names")
    level = heads.select("rid", F.size("hs").cast("long").alias("n"), F.posexplode("hs").alias("i", "h"))
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    if shared.isEmpty():
        level = level.join(names, "h").select("rid", "n", F.col("n").alias("m"), F.col("i").cast("long").alias("i"), "name")
    else:
        level = _by_bytes(spark, rows, heads, names, shared, block_bytes, hash_bits)
    level = save(spark, level, "block-level")
    done = level.filter("m = 1").select("rid", "n", "name")
    most = level.agg(F.max("m")).first()[0] or 0
    while most > 1:
        pairs = level.filter("m > 1").groupBy("rid", "n", "m", F.expr("i div 2").alias("j")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        named = _name(pairs.select("l", "r").distinct(), ["l", "r"])
        level = save(spark, pairs.join(named, ["l", "r"]).select(
            "rid", "n", F.expr("(m + 1) div 2").alias("m"), F.col("j").alias("i"), "name"), "block-level")
        done = done.unionByName(level.filter("m = 1").select("rid", "n", "name"))
        most = (most + 1) // 2
    return done.join(heads.drop("hs"), "rid")


def _by_bytes(spark, rows, heads, names, shared, block_bytes, hash_bits) -> DataFrame:
    """The first level where some hashes are shared: those blocks are named and
    joined by their bytes, the others by hash."""
    blocks = _blocks(F.col("_norm"), block_bytes)
    text = rows.select(F.monotonically_increasing_id().alias("rid0"), "doc_id",
                       F.sha2(F.col("_norm"), 256).alias("text_sha256"), F.posexplode(blocks).alias("i", "block"))
    text = text.withColumn("h", _hash(F.col("block"), hash_bits)).join(shared, "h", "left_semi")
    clash = save(spark, text.groupBy("doc_id", "text_sha256", "i", "block").agg(F.first("h").alias("h")), "block-clash")
    top = names.agg(F.max("name")).first()[0] + 1
    own = save(spark, _name(clash.select("block").distinct(), ["block"]).select(
        "block", (F.col("name") + F.lit(top)).alias("name")), "block-clash-names")
    by_bytes = clash.join(own, "block").select("doc_id", "text_sha256", F.col("i").alias("ci"), F.col("name").alias("cname"))
    level = heads.select("rid", "doc_id", "text_sha256", F.size("hs").cast("long").alias("n"),
                         F.posexplode("hs").alias("i", "h"))
    single = names.join(shared, "h", "left_anti")
    plain = level.join(single, "h").select("rid", "n", F.col("n").alias("m"), F.col("i").cast("long").alias("i"), "name")
    other = level.join(shared, "h", "left_semi").alias("a").join(
        by_bytes.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_sha256 = b.text_sha256 and a.i = b.ci"))
    return plain.unionByName(other.select("rid", "n", F.col("n").alias("m"), F.col("i").cast("long").alias("i"),
                                          F.col("cname").alias("name")))


def exact_dedup(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after every run of ASCII white space becomes
    one space; a null text counts as empty (and equals it).  The row with the
    smallest id stays; null ids come last, and of rows with the same id and
    text one stays.  An empty table gives an empty result; other columns, of
    any name, are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(f"`{text_col}`").alias("_norm"))
    named = name_texts(spark, rows, block_bytes=block_bytes, hash_bits=hash_bits)
    named = save(spark, named, "block-identity")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    # Written, so that both sides of the join below come from exchanges of its own and a
    # large group of copies is split over tasks.
    groups = save(spark, named.groupBy("n", "name").agg(first, F.count(F.lit(1)).alias("group_size")), "block-groups")
    return named.join(groups, ["n", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")


def drop_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all their columns."""
    verdict = save(spark, exact_dedup(spark, docs, **options), "exact-dedup")
    ties = verdict.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).agg(
        F.count(F.lit(1)).alias("_ties"), F.bool_or("kept").alias("kept"))
    text_col, id_col = options.get("text_col", "text"), options.get("id_col", "doc_id")
    return keep_rows(docs, ties.filter("kept"), F.sha2(normalised(f"`{text_col}`"), 256), id_col)
