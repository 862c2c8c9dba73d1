"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. *Targets.*  Sources in code-point order weigh 5, 2, 1, repeating, and share
   150 % of all words; a target stops at twice its source's words and the excess
   is shared again by weight among the others.
2. *Draws.*  Each document has a pseudo-random place in its source (a hash of id
   and text).  A source is taken ``floor(target / size)`` times whole, and the
   rest as the documents whose place lies before a cut.  The cut is found by
   descending ten bits at a time: words per cell, running sum, go into the cell
   that holds the cut, until a cell holds one document.
3. *Blocks.*  The places of a source are divided into equal blocks; one draw of
   a block is one unit, and a source's number of units is its exact quota.
4. *Tree.*  The units are split between the left and right half of the output
   shards, again and again, by multivariate-hypergeometric draws whose seed is
   the node; a shard walks from the root to its leaf, so each shard works
   alone.  A source's units are permuted and every shard gets a run of them, so
   shards are disjoint and the quotas add up exactly.
5. *Order.*  Rows go to their shard and are shuffled there by a hash.

A document's copies depend on its source's few numbers and its own hash alone.
One row a source reaches the driver; ``max_sources`` bounds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plyframe.llm.common import WORDS, save
from plyframe.sources.sorted_table import count_below

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Bytes of text an output shard is meant to hold, bytes a word takes with its blank, and the fewest shards.
SHARD_BYTES = 256 << 20
WORD_BYTES = 7
LEAST_SHARDS = 64
DOCS_PER_BLOCK = 64
MAX_SOURCES = 100_000
SEED = 20240229
PLACE_BITS = 60
DIGIT_BITS = 10
#: A table of at most this many numbers is broadcast; a larger one is joined by a shuffle.
BROADCAST_NUMBERS = 1_000_000


def targets(sizes: Sequence[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE,
            max_epochs: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Words to take from each source of ``sizes`` (source, words)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > max_epochs * size[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = float(max_epochs * size[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def place(id_col: str, text_col: str, seed: int) -> Column:
    """A row's place in its source: ``PLACE_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string")),
                                64 - PLACE_BITS)


def quotas(shards: int, units: np.ndarray, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's first unit and number of units of every source: the path from the root."""
    first, count, low, high = np.zeros(len(units), np.int64), units.astype(np.int64), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        total = int(count.sum())
        half = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = _draw(rng, count, half)
        if shard < mid:
            count, high = left, mid
        else:
            first, count, low = first + left, count - left, mid
    return first, count


def _draw(rng: np.random.Generator, count: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: one hypergeometric draw a source.  (Above the
    generator's range of 1e9 units, counts are drawn in equal slices.)"""
    slices = int(count.sum()) // 900_000_000 + 1
    out = np.zeros(len(count), np.int64)
    for i in range(slices):
        part = count // slices + (i < count % slices)
        want = n // slices + (i < n % slices)
        out += rng.multivariate_hypergeometric(part, min(want, int(part.sum())), method="marginals")
    short = n - int(out.sum())
    for s in np.flatnonzero(count - out > 0) if short else ():
        out[s] += (more := min(short, int(count[s] - out[s])))
        short -= more
    return out


def _cut(spark: SparkSession, sized: DataFrame, wanted: list[tuple]) -> dict:
    """For each (source number, words) the place before which documents' words come nearest to it."""
    cut, low, shift, rest = {}, {}, PLACE_BITS, {}
    for s, words in wanted:
        low[s], rest[s] = 0, words
    while low:
        digit = min(DIGIT_BITS, shift)
        at = spark.createDataFrame([(s, low[s], float(rest[s])) for s in low], "sid int, low long, want double")
        at = F.broadcast(at) if len(low) * 3 <= BROADCAST_NUMBERS else at
        inside = sized.join(at, "sid").filter(F.shiftright("place", shift) == F.col("low"))
        cells = inside.groupBy("sid", "want", F.shiftright("place", shift - digit).alias("cell")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("cell"))
        found = (cells.withColumn("upto", upto).filter("upto >= want and upto - words < want")
                 .groupBy("sid").agg(F.min(F.struct("cell", "words", "rows", "upto")).alias("c")).collect())
        by, shift = {r.sid: r.c for r in found}, shift - digit
        nxt, nrest = {}, {}
        for s in low:
            c = by.get(s)
            if c is None:  # rounding: the whole of the cell is wanted
                cut[s] = (low[s] + 1) << (shift + digit)
            elif c["rows"] == 1 or not shift:
                over, under = c["upto"] - rest[s], rest[s] - (c["upto"] - c["words"])
                cut[s] = (c["cell"] + (over <= under)) << shift
            else:
                nxt[s], nrest[s] = c["cell"], rest[s] - (c["upto"] - c["words"])
        low, rest = nxt, nrest
    return cut


def _plan(spark: SparkSession, sized: DataFrame, weights, share, max_epochs, shards, docs_per_block, max_sources,
          seed) -> tuple[DataFrame, int, int]:
    """One row a source: its numbers, and where each shard's run of units begins; numbers of sources and shards."""
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    per = sorted(((r.source, int(r["size"]), int(r.rows)) for r in per.limit(max_sources + 1).collect()),
                 key=lambda r: (r[0] is None, r[0] or ""))
    if len(per) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources")
    want = targets([(s, n) for s, n, _ in per], weights, share, max_epochs)
    if shards is None:
        shards = max(LEAST_SHARDS, math.ceil(sum(want.values()) * WORD_BYTES / SHARD_BYTES))
    whole = [int(want[s] // n) if n else 0 for s, n, _ in per]
    part = [(i, want[s] - whole[i] * n) for i, (s, n, _) in enumerate(per) if n and want[s] - whole[i] * n > 0]
    names = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(per)], "sid int, source string")
    names = F.broadcast(names) if len(per) <= 10_000 else names
    numbered = sized.withColumnRenamed("source", "s").join(names, F.col("s").eqNullSafe(F.col("source"))).select(
        "sid", "size", "place")
    cut = _cut(spark, numbered, part) if part else {}
    rng = np.random.default_rng([seed, len(per)])
    bits = [min(PLACE_BITS // 2, max(0, math.ceil(math.log2(max(1, rows / docs_per_block))))) for _, _, rows in per]
    width = [1 << (PLACE_BITS - b) for b in bits]
    units = [w * (1 << b) + -(-cut.get(i, 0) // width[i]) for i, (w, b) in enumerate(zip(whole, bits))]
    mult = []
    for n in units:
        a = int(rng.integers(1, max(2, min(n, 1 << 31))))
        while math.gcd(a, max(n, 1)) != 1:
            a += 1
        mult.append(a)
    add = [int(rng.integers(0, max(1, n))) for n in units]
    rows = [(i, s, n, float(want[s]), whole[i], cut.get(i, 0), bits[i], units[i], mult[i], add[i])
            for i, (s, n, _) in enumerate(per)]
    plan = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, whole int, cut long, "
                                       "bits int, units long, mult long, add long")
    counts = np.array(units, np.int64)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                first, _ = quotas(shards, counts, seed, int(shard))
                yield pd.DataFrame({"sid": np.arange(len(counts), dtype=np.int32), "shard": np.int32(shard), "first": first})

    runs = spark.range(shards).repartition(min(shards, max(8, shards // 512))).mapInPandas(leaves, "sid int, shard int, first long")
    runs = runs.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("shard", "first"))).alias("r"))
    return save(spark, plan.join(runs, "sid").select("*", F.col("r.first").alias("firsts")).drop("r", "sid"),
                "mixture-plan"), len(per), shards


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, shards: int | None = None, docs_per_block: int = DOCS_PER_BLOCK,
        max_sources: int = MAX_SOURCES, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` (one named ``_mix`` gives way) and ``_mix``: ``size`` (words), ``source_size``, ``target`` (words of
    its source), ``shards`` (the output shard of each copy taken; empty: not taken) and ``place``.

    One row per row of ``docs``.  Without ``shards`` their number follows the words taken (some ``SHARD_BYTES``
    of text each, ``LEAST_SHARDS`` at least).  A null text has size 0; a null source is a
    source, sorted last; rows equal in id and text share their place, so a cut
    takes or leaves them together.  A source without words has target 0 and
    gives no row.  An empty table gives an empty result.
    """
    return _mixed(spark, docs, id_col, text_col, source_col, weights, share, max_epochs, shards, docs_per_block, max_sources, seed)[0]


def _mixed(spark: SparkSession, docs: DataFrame, id_col, text_col, source_col, weights, share, max_epochs, shards, docs_per_block,
           max_sources, seed) -> tuple[DataFrame, int]:
    """``mix`` and the number of shards."""
    col = lambda c: F.col(f"`{c}`")
    kept = [c for c in docs.columns if c != "_mix"]
    own_name = "__m"  # what no column of docs begins with
    while any(c.startswith(own_name) for c in docs.columns):
        own_name += "_"
    words = F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    own = place(f"`{id_col}`", f"`{text_col}`", seed)
    sized = save(spark, docs.select(col(source_col).cast("string").alias("source"), words.alias("size"),
                                    own.alias("place")), "mixture-sizes")
    plan, sources, shards = _plan(spark, sized, weights, share, max_epochs, shards, docs_per_block, max_sources, seed)
    plan = plan.select(F.struct("*").alias(f"{own_name}plan"))
    plan = F.broadcast(plan) if sources * (shards + 10) <= BROADCAST_NUMBERS else plan
    p = lambda c: F.col(f"{own_name}plan.{c}")
    t = lambda c: F.col(f"{own_name}{c}")
    joined = docs.withColumns({f"{own_name}place": own, f"{own_name}size": words}).join(
        plan, col(source_col).cast("string").eqNullSafe(p("source")))
    block = F.call_function("shiftright", t("place"), F.lit(PLACE_BITS) - p("bits"))
    copies = p("whole") + (t("place") < p("cut")).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), p("bits"))

    def shard(k: Column) -> Column:
        unit = k.cast("long") * t("one") + t("block")
        at = (unit * p("mult") + p("add")) % p("units")
        return count_below(p("firsts"), at, inclusive=True) - 1

    counted = joined.withColumns({f"{own_name}one": one, f"{own_name}block": block, f"{own_name}copies": copies})
    taken = F.when(t("copies") > 0, F.transform(F.sequence(F.lit(0), t("copies") - 1), shard)).otherwise(
        F.array().cast("array<int>"))
    return counted.select(*[col(c) for c in kept], F.struct(
        t("size").alias("size"), p("source_size").alias("source_size"), p("target").alias("target"),
        taken.alias("shards"), t("place").alias("place")).alias("_mix")), shards


def mixed_rows(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, shards: int | None = None,
               docs_per_block: int = DOCS_PER_BLOCK, max_sources: int = MAX_SOURCES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns only, each shard
    in a partition of its own and shuffled there."""
    given = docs
    if "_mix" in docs.columns:
        docs = docs.withColumnRenamed("_mix", "__given_mix")
    taken, n = _mixed(spark, docs, id_col, text_col, source_col, weights, share, max_epochs, shards, docs_per_block, max_sources, seed)
    rows = taken.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "_mix.place", F.posexplode("_mix.shards").alias("copy", "shard"))
    return (rows.withColumn("at", F.xxhash64(F.lit(seed), "place", "copy")).repartitionById(n, F.col("shard"))
            .sortWithinPartitions("at").select("row.*").toDF(*given.columns))
