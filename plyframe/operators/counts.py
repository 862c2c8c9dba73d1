"""Mergeable counts, top-k shares and sequence transitions (column-generic)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.schemas import COUNT_KEYS
from plyframe.session import scratch_path


def count_moves(positions: DataFrame, keys=COUNT_KEYS, name: str = "times_played") -> DataFrame:
    """COUNT(*) per key, one pass: partial hash aggregation on the map side
    collapses hot keys (opening positions) before the shuffle."""
    return positions.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def merge_counts(*counts: DataFrame, keys=COUNT_KEYS, weight: str = "times_played") -> DataFrame:
    """Sum partial counts (months, runs); counts add, so any grouping of merges agrees.

    Counts may be negative (rows taken back, see ``counts_view``): a key that sums to 0 is not there."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return union.groupBy(*keys).agg(F.sum(weight).cast("long").alias(weight)).filter(F.col(weight) != 0)


def most_played(counts: DataFrame, weight: str = "times_played", keys=COUNT_KEYS, n: int = 1) -> DataFrame:
    """Arg-max row(s) by weight; ties go to the smallest keys.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    ``n`` rows, so nothing unbounded reaches one task.
    """
    return counts.orderBy(F.desc(weight), *[F.asc(k) for k in keys]).limit(n)


def top_k_share(stats: DataFrame, group_cols, item_col: str, weight_col: str, k: int = 5,
                rank_col: str = "rank", share_col: str = "percentage", keep_zero: bool = True,
                folded: bool = False) -> DataFrame:
    """Top ``k`` items per group with their share of the group's total weight.

    One pass over ``stats`` (rows need not be pre-aggregated): a grouping-sets
    aggregate yields each (group, item) sum and the group total as an extra
    row, with partial aggregation before the shuffle.  Ranking puts the total
    row first, so ``row_number() <= k + 1`` alone in its window plans as a
    WindowGroupLimit that trims every group to ``k + 1`` rows before the
    window's shuffle (a hot group cannot flood one task); the total is then
    attached over those few rows.  The denominator is all items, not only the
    top ``k``; ties go to the smaller item.  Without ``keep_zero`` items that sum
    to 0 (counts taken back) are no items.  ``folded`` says that ``stats`` has one row an item already.
    """
    group_cols = list(group_cols)
    # Raw rows are folded once; only (group, item) sums are then expanded for the totals.
    items = (stats.select(*group_cols, item_col, F.col(weight_col).cast("long").alias(weight_col)) if folded else
             stats.groupBy(*group_cols, item_col).agg(F.sum(weight_col).cast("long").alias(weight_col)))
    items = items if keep_zero else items.filter(F.col(weight_col) != 0)
    agg = (items.groupingSets([group_cols + [item_col], group_cols], *group_cols, item_col)
           .agg(F.sum(weight_col).cast("long").alias(weight_col), F.grouping(item_col).alias("_is_total")))
    order = Window.partitionBy(*group_cols).orderBy(F.desc("_is_total"), F.desc(weight_col), F.asc(item_col))
    top = agg.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k + 1)
    total = F.max(F.when(F.col("_is_total") == 1, F.col(weight_col))).over(Window.partitionBy(*group_cols))
    return (top.withColumn("_total", total)
               .filter(F.col("_is_total") == 0)
               .select(*group_cols, item_col, weight_col, (F.col("_rn") - 1).cast("int").alias(rank_col),
                       # try_divide: a group whose weights sum to 0 gets a null share
                       # instead of failing the job (ANSI division by zero).
                       F.try_divide(F.col(weight_col).cast("double") * F.lit(100.0),
                                    F.col("_total").cast("double")).alias(share_col)))


def next_item_stats(df: DataFrame, context: str, item: str, *, bucket: str | None = None,
                    lo: int | None = None, hi: int | None = None, weight: str | None = None,
                    k: int = 5) -> DataFrame:
    """Top ``k`` items per context with their share of the context's total:
    the lookup made column-generic.  ``bucket`` with ``lo``/``hi`` keeps an
    inclusive range (as rating buckets are in the lookup); ``weight`` sums a
    column instead of counting rows.  One aggregation (see ``top_k_share``)."""
    if bucket is not None and (lo is not None or hi is not None):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(bucket) >= lo)
        if hi is not None:
            cond = cond & (F.col(bucket) <= hi)
        df = df.filter(cond)
    plays = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("plays")
    return top_k_share(df.select(context, item, plays), [context], item, "plays", k)


def sequence_steps(df: DataFrame, by, order, item: str, *, max_steps: int | None = None,
                   context_len: int = 1, start: str = "^", sep: str = ">") -> DataFrame:
    """Per sequence (``by``) in ascending ``order``: ``step`` number and ``context`` = the
    previous ``context_len`` items (``start`` for the first).  Every row is kept
    unless ``max_steps`` asks for the first ones only.

    Without a cut a sequence may hold any share of the rows, so it is never one
    task's work: rows are range-partitioned by (sequence, order) and written;
    each chunk numbers its own rows, and the rows before a chunk and its last
    items are carried over the boundary from a table with one row per chunk.
    With ``max_steps`` Spark trims each sequence per task before shuffling and
    the lags run on at most ``max_steps`` rows per sequence.
    """
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    if max_steps is not None:
        w = Window.partitionBy(*by).orderBy(*order)
        ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_steps)
        first = ranked.withColumn("step", F.col("_rn") - 1).drop("_rn")
        w2 = Window.partitionBy(*by).orderBy("step")
        ctx = F.concat_ws(sep, *[F.lag(item, i).over(w2) for i in range(context_len, 0, -1)])
        return first.withColumn("context", F.when(ctx == "", F.lit(start)).otherwise(ctx))
    spark = df.sparkSession
    path = scratch_path(spark, "sequence-chunks")
    df.repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType(df.schema.fields + [T.StructField("_chunk", T.IntegerType())])).parquet(path)
    # Plain columns for the sequence, so that a null sequence is one as well.
    w = Window.partitionBy("_chunk", *by).orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(w)).withColumns(
        {f"_lag{i}": F.lag(item, i).over(w) for i in range(1, context_len + 1)})
    counts = rows.groupBy("_chunk", *by).agg(F.count(F.lit(1)).alias("_n"))
    back = Window.partitionBy("_chunk", *by).orderBy(*[_reverse(o) for o in order])
    tails = (rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= context_len)
             .groupBy("_chunk", *by).agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"),
                                                                              F.col(item).alias("item")))).alias("_tail")))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in ["_chunk", *by]])
    chunks = counts.join(tails, same(counts, tails)).select(*[counts[c] for c in counts.columns], "_tail")
    before = Window.partitionBy(*by).orderBy("_chunk")
    carried = F.flatten(F.collect_list("_tail").over(before.rowsBetween(-context_len, -1)))
    chunks = chunks.select("_chunk", *by, (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
                           carried.alias("_carry"))
    joined = numbered.join(chunks, same(numbered, chunks)).select(
        *[numbered[c] for c in numbered.columns], "_offset", "_carry")
    # The i-th item back: in the chunk, or that far from the end of what was carried over.
    ctx = F.concat_ws(sep, *[F.when(F.col("_rn") > i, F.col(f"_lag{i}"))
                             .otherwise(F.try_element_at("_carry", F.least((F.col("_rn") - i - 1).cast("int"), F.lit(-1)))["item"])
                             for i in range(context_len, 0, -1)])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_rn") - 1).alias("step"),
                         F.when(ctx == "", F.lit(start)).otherwise(ctx).alias("context"))


def _reverse(order) -> Column:
    """The opposite of an ascending order column (nulls first becomes nulls last)."""
    return (F.col(order) if isinstance(order, str) else order).desc_nulls_last()


def compare_extractions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two extractions and their multiset differences both ways.

    One shuffle: rows are tagged by side and counted per distinct row, so
    ``only_a`` equals ``a EXCEPT ALL b`` in size (and ``only_b`` likewise).
    """
    cols = a.columns
    tagged = (a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    per_row = tagged.groupBy(*cols).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    return per_row.agg(
        F.sum("na").cast("long").alias("rows_a"),
        F.sum("nb").cast("long").alias("rows_b"),
        F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).cast("long").alias("only_a"),
        F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).cast("long").alias("only_b"))
