"""Preference formatting (DataFrame functions only).

Chosen and rejected conversations come as turns.  One aggregation gathers the
turns of both sides of a pair in their order; the first position where role or
text differ is the length of the longest common prefix.  The prefix is rendered
once as the prompt, the rest of each side as its completion, with a mask that is
on only over what the assistant wrote.

A conversation without an id belongs to no pair and goes before any shuffle.  A
pair is one row of the result, so it has to fit into a row, as a document does:
its turns are compared and rendered together, and nothing larger ever is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plyframe.llm.common import save

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNT = ("assistant",)


def _safe(text: Column) -> Column:
    """Text in which the template's own marks have lost their meaning."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _turns(turns: DataFrame, pair: str, side: str) -> DataFrame:
    """``pair``, ``side`` and the turn: whether its number is missing, number, role and text with nulls as empty."""
    rows = turns.filter(F.col(f"`{pair}`").isNotNull())
    return rows.select(F.col(f"`{pair}`").alias("pair"), F.lit(side).alias("side"),
                       _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"))


def _turn(turn: Column, role: Column, text: Column) -> Column:
    return F.struct(turn.isNull().alias("none"), turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _rendered(turns: Column, learnt) -> tuple[Column, Column]:
    """The text of an array of turns, and the spans [begin, end) of it that are learnt, in characters."""
    head = lambda t: F.concat(F.lit(START), _safe(t.role), F.lit("\n"))
    body = lambda t: F.concat(_safe(t.text), F.lit(STOP))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state.at + F.length(head(t))
        end = begin + F.length(body(t))
        own = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(t.role.isin(*learnt), F.array_append(state.spans, own))
                        .otherwise(state.spans).alias("spans"))

    return text, F.aggregate(turns, zero, step, lambda s: s.spans)


def preference_pairs(chosen: DataFrame, rejected: DataFrame, *, pair: str = "pair_id", learnt=LEARNT) -> DataFrame:
    """One row per pair id found on both sides: ``pair_id``, ``prompt_turns``, ``prompt``, ``chosen``,
    ``rejected``, ``chosen_mask``, ``rejected_mask`` (arrays of character spans in the completion that
    are learnt: what ``learnt`` roles say, with its end mark).

    Inputs are turns: the pair id, ``turn``, ``role``, ``text``.  Turns stand in the order of turn
    number (nulls last), then role and text; null roles and texts count as empty; repeated turns
    are turns.  Equal conversations give a prompt and two empty completions; a side that is a
    prefix of the other gives an empty completion.  Empty inputs give an empty result.
    """
    return formatted(_turns(chosen, pair, "chosen").unionByName(_turns(rejected, pair, "rejected")), learnt)


def formatted(both: DataFrame, learnt=LEARNT) -> DataFrame:
    """``preference_pairs`` of the turns of both sides together (``pair``, ``side``, ``t``)."""
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("t"))))
    pairs = both.groupBy("pair").agg(side("chosen").alias("c"), side("rejected").alias("r")).filter("size(c) > 0 and size(r) > 0")
    shorter = F.least(F.size("c"), F.size("r"))
    differs = lambda i: ((F.get("c", i).role != F.get("r", i).role)
                         | (F.get("c", i).text != F.get("r", i).text))
    first = F.get(F.filter(F.sequence(F.lit(0), shorter - 1), differs), F.lit(0))
    split = pairs.select("pair", "c", "r", F.coalesce(first, shorter).alias("n")).select(
        "pair", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    texts = {k: _rendered(F.col(k), learnt) for k in "pcr"}
    return split.select(F.col("pair").alias("pair_id"), F.col("n").cast("long").alias("prompt_turns"),
                        texts["p"][0].alias("prompt"), texts["c"][0].alias("chosen"), texts["r"][0].alias("rejected"),
                        texts["c"][1].alias("chosen_mask"), texts["r"][1].alias("rejected_mask"))


def next_replies(conversations: DataFrame) -> DataFrame:
    """Every conversation with an assistant turn: ``pair_id``, ``at`` and ``own`` (its last such turn: number and
    text), ``reply`` (the ``own`` of the next such conversation in the order of ids; of the last one, the first's).

    Conversations are range-partitioned by id and written, one row each; a chunk hands its rows on
    within itself, and its last row gets the first reply of the chunk after it.  Of several turns with the last
    number the one with the greatest text counts.
    """
    spark = conversations.sparkSession
    last = (conversations.filter("conv_id is not null and role = 'assistant' and turn is not null")
            .groupBy(F.col("conv_id").alias("pair_id"))
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
            .select("pair_id", F.col("l.turn").alias("at"), F.col("l.text").alias("own")))
    rows = save(spark, last.repartitionByRange("pair_id").withColumn("chunk", F.spark_partition_id()), "preference-replies")
    ids = sorted(r["chunk"] for r in rows.select("chunk").distinct().collect())  # one number a partition
    after = spark.createDataFrame(list(zip(ids, ids[1:] + ids[:1])), "chunk int, after int")
    firsts = rows.groupBy(F.col("chunk").alias("after")).agg(F.min_by("own", "pair_id").alias("over"))
    over = after.join(firsts, "after").select("chunk", "over")
    held = F.lead("own").over(Window.partitionBy("chunk").orderBy("pair_id"))
    return rows.withColumn("reply", held).join(F.broadcast(over), "chunk").select(
        "pair_id", "at", "own", F.coalesce("reply", "over").alias("reply"))


def swapped_turns(conversations: DataFrame) -> DataFrame:
    """Both sides' turns (``pair``, ``side``, ``t``) out of plain conversations (``conv_id``, ``turn``, ``role``, ``text``).

    Chosen is the conversation; rejected is the same with the text of its last assistant turn
    replaced by that of the next conversation that has one (the last takes the first's; a lone one keeps its own): a reply of
    the right kind to another question.  Every conversation with a numbered assistant turn is a pair, whatever its
    id's neighbours; others have no reply to prefer and are none.
    """
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rows = turns.join(next_replies(conversations), "pair_id")
    is_last = ((F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("at"))
               & (F.coalesce("text", F.lit("")) == F.col("own")))
    swapped = F.when(is_last, F.col("reply")).otherwise(F.col("text"))
    sides = F.array(*[F.struct(F.lit(name).alias("side"), _turn(F.col("turn"), F.col("role"), text).alias("t"))
                      for name, text in (("chosen", F.col("text")), ("rejected", swapped))])
    return rows.select(F.col("pair_id").alias("pair"), F.inline(sides))
