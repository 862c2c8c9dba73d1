"""One key holds a third of all rows: results stay exact and hot groups are trimmed before shuffles."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from plyframe.operators.counts import count_moves, sequence_steps, top_k_share
from plyframe.operators.recommend import recommend
from plyframe.schemas import POSITIONS

HOT = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _positions(spark, n=30_000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        fen = HOT if i % 3 == 0 else f"cold{rnd.randrange(2000)}"
        rows.append(("Rated Blitz game", 600 + 100 * rnd.randrange(20), fen, rnd.choice(["e4", "d4", "c4", "Nf3"])))
    return rows, spark.createDataFrame(rows, POSITIONS).repartition(8)


def test_hot_position_counts_exact_and_combined_map_side(spark):
    rows, df = _positions(spark)
    counts = count_moves(df)
    want = Counter((r[2], r[1], r[3]) for r in rows)
    got = {(r.base_fen, r.player_elo_bucket, r.move_san): r.times_played for r in counts.collect()}
    assert got == dict(want)
    plan = _plan(counts)
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_count")  # combined before the shuffle


def test_hot_group_top_k_trimmed_before_shuffle(spark):
    rows, df = _positions(spark)
    top = top_k_share(df.withColumn("plays", F.lit(1)), ["base_fen"], "move_san", "plays", 2)
    hot = {r.move_san: r.plays for r in top.filter(F.col("base_fen") == HOT).collect()}
    want = Counter(r[3] for r in rows if r[2] == HOT)
    assert hot == dict(sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:2])
    plan = _plan(top)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_sequence_cut_before_shuffle(spark):
    rows = [(0 if i % 3 == 0 else 1 + i % 500, i, f"t{i % 5}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "sid long, pos long, item string").repartition(8)
    steps = sequence_steps(df, "sid", "pos", "item", max_steps=40)
    per_seq = Counter(r.sid for r in steps.select("sid").collect())
    assert per_seq[0] == 40 and all(v <= 40 for v in per_seq.values())
    assert "WindowGroupLimit" in _plan(steps)


def test_hot_sequence_is_whole_and_spans_many_tasks(spark):
    rnd = random.Random(8)
    rows = [(0 if i % 3 == 0 else None if i % 31 == 1 else 1 + i % 500, i, rnd.choice("abc") if i % 7 else None)
            for i in range(12_000)]
    df = spark.createDataFrame(rows, "sid long, pos long, item string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        steps = sequence_steps(df, "sid", "pos", "item", context_len=2)
        got = {r.pos: (r.sid, r.step, r.context) for r in steps.collect()}
        # the hot sequence was cut into several chunks
        from plyframe.session import checkpoint_root
        import glob
        newest = max(glob.glob(f"{checkpoint_root(spark)}/plyframe/sequence-chunks-*"), key=os.path.getmtime)
        chunks = spark.read.parquet(newest).filter("sid = 0").groupBy("_chunk").count().collect()
        assert len(chunks) > 1 and max(c["count"] for c in chunks) < 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want, seen = {}, {}
    for sid, pos, item in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(sid, [])
        want[pos] = (sid, len(past), ">".join(x for x in past[-2:] if x is not None) or "^")
        past.append(item)
    assert got == want


def test_hot_requests_collapse(spark):
    rows, df = _positions(spark)
    counts = count_moves(df)
    reqs = spark.createDataFrame(
        [(i, HOT if i % 3 == 0 else f"cold{i % 2000}", None, None) for i in range(9_000)],
        "request_id long, fen string, elo_min string, elo_max string")
    out = recommend(reqs, counts, key_is_fen=False)
    hot = out.filter(F.col("request_id") % 3 == 0)
    assert hot.select("request_id").distinct().count() == 3_000
    assert hot.filter("rank = 1").select("move_san").distinct().count() == 1
    assert out.filter("error IS NOT NULL").count() <= out.select("request_id").distinct().count()
