"""Request bounds: integers of any size, fractions, explicit nulls, text."""

from plyframe.operators.counts import count_moves
from plyframe.operators.recommend import recommend, requests_from_json, validate_requests
from plyframe.schemas import COUNTS

BODIES = [('{"fen": "k"}', (0, 3000)), ('{"fen": "k", "elo_max": 99999999999}', (0, 99999999999)),
          ('{"fen": "k", "elo_max": 1400.9}', (0, 1400)), ('{"fen": "k", "elo_min": -0.5}', (0, 3000)),
          ('{"fen": "k", "elo_min": null}', None), ('{"fen": "k", "elo_min": "1400.5"}', None),
          ('{"fen": "k", "elo_min": " 12 "}', (12, 3000)), ('{"fen": "k", "elo_min": true}', (1, 3000)),
          ('{"fen": "k", "elo_max": 1' + "0" * 60 + "}", (0, 2 ** 63 - 1)), ('{"fen": "k", "elo_min": "x"}', None),
          ('{"fen": "k", "elo_min": "-' + "9" * 50 + '"}', (-2 ** 63, 3000))]


def test_bounds_of_json_bodies(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "request_id long, body string")
    got = {r.request_id: r for r in validate_requests(requests_from_json(df), key_is_fen=False).collect()}
    for i, (body, want) in enumerate(BODIES):
        assert ((got[i].lo, got[i].hi), got[i].error) == ((want, None) if want else ((got[i].lo, got[i].hi), "invalid_range")), body


def test_bodies_that_are_no_object(spark):
    df = spark.createDataFrame([(1, None), (2, "not json"), (3, "[1]"), (4, "{}")], "request_id long, body string")
    out = recommend(requests_from_json(df), spark.createDataFrame([], COUNTS), key_is_fen=False)
    assert {(r.request_id, r.error) for r in out.collect()} == {(i, "missing_fen") for i in (1, 2, 3, 4)}


def test_wide_buckets_are_found(spark):
    rows = [("k", 10 ** 15, "m", 3), ("k", 2000, "n", 1)]
    out = recommend(spark.createDataFrame([(1, "k", None, str(10 ** 16)), (2, "k", None, None)],
                                          "request_id long, fen string, elo_min string, elo_max string"),
                    spark.createDataFrame(rows, COUNTS), key_is_fen=False)
    assert sorted((r.request_id, r.rank, r.move_san, r.plays) for r in out.collect()) == [(1, 1, "m", 3), (1, 2, "n", 1), (2, 1, "n", 1)]


def test_lookup_starts_no_job_and_meets_each_move_once(spark):
    rows = [("hot", b, f"m{b % 3}", 1) for b in range(300)]
    reqs = spark.createDataFrame([(i, "hot", str(i % 50), str(200 + i % 50)) for i in range(1000)],
                                 "request_id long, fen string, elo_min string, elo_max string")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    out = recommend(reqs, count_moves(spark.createDataFrame(rows, COUNTS), keys=("base_fen", "player_elo_bucket", "move_san")), key_is_fen=False)
    assert set(tracker.getJobIdsForGroup()) == before
    got = {(r.request_id, r.move_san): r.plays for r in out.collect()}
    for i in (0, 49, 999):
        for m in range(3):
            assert got[i, f"m{m}"] == sum(1 for b in range(i % 50, 201 + i % 50) if b % 3 == m)
