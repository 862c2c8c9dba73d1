"""Counting, merging, top-k shares and the lookup (single and batch)."""

import pytest
from pyspark.sql import functions as F

from plyframe.operators.counts import (compare_extractions, count_moves, merge_counts, most_played,
                                       next_item_stats, sequence_steps)
from plyframe.operators.recommend import as_responses, display_share, recommend, top_moves
from plyframe.schemas import COUNTS, POSITIONS

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
E4 = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -"


@pytest.fixture()
def counts(spark):
    rows = [(START, 1400, "e4", 50), (START, 1500, "e4", 30), (START, 1500, "d4", 40), (START, 1600, "Nf3", 20),
            (START, 2100, "c4", 100), (START, 1400, "g3", 5), (START, 1400, "b3", 5), (E4, 1500, "e5", 7)]
    return spark.createDataFrame(rows, COUNTS)


def test_count_and_merge_are_consistent(spark):
    pos = spark.createDataFrame([("Rated Blitz game", 1500, START, "e4")] * 3
                                + [("Rated Blitz game", 1400, START, "d4")] * 2, POSITIONS)
    c = count_moves(pos)
    assert c.agg(F.sum("times_played")).first()[0] == pos.count()
    first = pos.limit(2)
    merged = merge_counts(count_moves(first), count_moves(pos.exceptAll(first)))
    assert sorted(merged.collect()) == sorted(c.collect())
    # Order of merging does not matter.
    m1 = merge_counts(merge_counts(c, c), c)
    m2 = merge_counts(c, merge_counts(c, c))
    assert sorted(m1.collect()) == sorted(m2.collect())


def test_single_lookup_top5_and_shares(spark, counts):
    rows = top_moves(counts, START + " 0 1", 1000, 2000).collect()
    assert [r.move_san for r in rows] == ["e4", "d4", "Nf3", "b3", "g3"]  # tie -> move text order
    assert rows[0].plays == 80
    assert rows[0].percentage == pytest.approx(80 * 100.0 / 150)
    assert sum(r.percentage for r in rows) == pytest.approx(100.0)
    # Bucket range is inclusive: 2000 includes bucket 2000, not 2100.
    assert "c4" not in [r.move_san for r in rows]


def test_batch_lookup_with_errors(spark, counts):
    reqs = spark.createDataFrame([
        (1, START + " 0 1", "1000", "2000"),
        (2, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1", None, None),  # ep normalised away
        (3, None, None, None),
        (4, "bad fen", None, None),
        (5, START, "low", None),
        (6, "8/8/8/8/8/8/8/K6k w - - 0 1", None, None),
        (7, START + " 0 1", "1000", "2000"),  # duplicate of 1: same answer
    ], "request_id long, fen string, elo_min string, elo_max string")
    out = recommend(reqs, counts)
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.request_id, []).append(r)
    assert [r.move_san for r in sorted(by_id[1], key=lambda r: r.rank)] == ["e4", "d4", "Nf3", "b3", "g3"]
    assert [(r.move_san, r.percentage) for r in by_id[2]] == [("e5", 100.0)]
    assert [r.error for r in by_id[3]] == ["missing_fen"]
    assert [r.error for r in by_id[4]] == ["invalid_fen"]
    assert [r.error for r in by_id[5]] == ["invalid_range"]
    assert [r.error for r in by_id[6]] == ["not_found"]
    assert sorted(by_id[7]) != [] and len(by_id[7]) == 5
    resp = {r.request_id: r for r in as_responses(out).collect()}
    assert resp[1].move == "e4" and len(resp[1].alternatives) <= 5
    assert resp[1].alternatives[0].likelihood == pytest.approx(53.3)
    assert recommend(reqs, None).filter("error = 'no_source'").count() == 4


def test_display_rounding_is_half_even(spark):
    df = spark.createDataFrame([(62.25,), (12.35,)], "p double")
    got = [r[0] for r in df.select(display_share("p")).collect()]
    assert got == [62.2, 12.4]


def test_most_played_tie_break(spark, counts):
    r = most_played(counts).first()
    assert (r.move_san, r.times_played) == ("c4", 100)


def test_next_item_stats_shares_sum_to_100(spark, counts):
    stats = next_item_stats(counts, "base_fen", "move_san", bucket="player_elo_bucket", weight="times_played",
                            k=100).collect()
    totals = {}
    for r in stats:
        totals[r.base_fen] = totals.get(r.base_fen, 0.0) + r.percentage
    assert all(abs(v - 100.0) < 1e-9 for v in totals.values())


def test_sequence_steps_context_and_cap(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "b", "c", "a", "b"])] + [(2, 0, "x")]
    df = spark.createDataFrame(rows, "sid long, pos long, item string")
    out = sequence_steps(df, "sid", "pos", "item", max_steps=4, context_len=2).orderBy("sid", "step").collect()
    assert [(r.step, r.context, r.item) for r in out] == [
        (0, "^", "a"), (1, "a", "b"), (2, "a>b", "c"), (3, "b>c", "a"), (0, "^", "x")]


def test_compare_extractions_multiset(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (3,)], "x long")
    r = compare_extractions(a, b).first()
    assert (r.rows_a, r.rows_b, r.only_a, r.only_b) == (3, 2, 2, 1)


def test_json_round_trip_and_counters(spark, counts):
    from plyframe.operators.metrics import observe_games
    from plyframe.operators.qualify import qualify_games
    from plyframe.operators.recommend import requests_from_json, responses_to_json
    import json
    body = spark.createDataFrame([(1, json.dumps({"fen": START + " 0 1", "elo_min": 1000, "elo_max": 2000})),
                                  (2, json.dumps({"fen": "bad"}))], "request_id long, body string")
    out = {r.request_id: json.loads(r.body)
           for r in responses_to_json(as_responses(recommend(requests_from_json(body), counts))).collect()}
    assert out[1]["move"] == "e4" and len(out[1]["alternatives"]) == 5
    assert out[2] == {"error": "invalid_fen"}
    games = spark.createDataFrame(
        [("1", {"Event": "Rated Bullet game", "WhiteElo": "1500", "BlackElo": "1500"}, "1. e4"),
         ("2", {"Event": "Rated Blitz game", "WhiteElo": "1500", "BlackElo": "1500"}, "1. e4")],
        "game_id string, headers map<string,string>, movetext string")
    df, obs = observe_games(qualify_games(games, with_reason=True))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["scanned"] == 2 and obs.get["kept"] == 1 and obs.get["bullet"] == 1


def test_open_bounds_reach_every_bucket(spark, counts):
    far = counts.unionByName(counts.withColumn("player_elo_bucket", F.lit(10 ** 7).cast("long")))
    total = lambda lo, hi: top_moves(far, START + " 0 1", lo, hi, k=100).agg(F.sum("plays")).first()[0]
    assert total(None, None) == 2 * total(None, 3000) == 2 * total(10 ** 6, None)


def test_next_item_stats_bucket_range(spark, counts):
    rows = next_item_stats(counts, "base_fen", "move_san", bucket="player_elo_bucket", lo=1000, hi=2000,
                           weight="times_played").filter(F.col("base_fen") == START).orderBy("rank").collect()
    assert [r.move_san for r in rows] == ["e4", "d4", "Nf3", "b3", "g3"]
    assert rows[0].percentage == pytest.approx(80 * 100.0 / 150)


def test_concurrent_lookups_share_one_session(spark, counts):
    from concurrent.futures import ThreadPoolExecutor
    expected = [tuple(r) for r in top_moves(counts, START + " 0 1", 1000, 2000).collect()]

    def lookup(_):
        return [tuple(r) for r in top_moves(counts, START + " 0 1", 1000, 2000).collect()]

    with ThreadPoolExecutor(max_workers=4) as pool:
        results = list(pool.map(lookup, range(8)))
    assert all(r == expected for r in results)


@pytest.mark.parametrize("rows_a_task, tasks", [(100, 4), (50, 9), (20, 20)])  # 8 would be the session's own number
def test_stored_counts_are_dealt_out_by_rows(spark, tmp, monkeypatch, rows_a_task, tasks):
    """Tasks of a lookup against a stored table hold a number of rows, however few bytes these take."""
    import re

    import plyframe.operators.recommend as lookups
    from plyframe.sources.sorted_table import write_sorted
    monkeypatch.setattr(lookups, "ROWS_A_TASK", rows_a_task)
    counts = spark.createDataFrame([(f"p{i % 100}", i % 3 * 100, f"m{i // 100}", 1 + i % 7) for i in range(400)], COUNTS)
    write_sorted(counts, f"{tmp}/sorted")
    requests = spark.createDataFrame([(i, f"p{i}", "0", "200") for i in range(120)], "request_id long, fen string, elo_min string, elo_max string")
    df = lookups.recommend_sorted(requests, f"{tmp}/sorted", key_is_fen=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(base_fen#\d+, {tasks}\), REPARTITION_BY_NUM", plan)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, recommend(requests, counts, key_is_fen=False).collect()), key=str)
