"""The game queries replay boards: transpositions meet, illegal moves end a game, keys are FENs."""

import datetime
import os

import pytest

from plyframe.plans import queries as Q, synth
from plyframe.plans.golden import START

#: One qualifying order for each of the eight lines (o_orderkey % 8), Blitz, black 1400 to 1990.
KEYS = {line: next(k for k in range(1000 + line, 9000, 8) if k % 8 == line and k % 5 == 1 and k % 17 and 1400 <= 400 + k * 13 % 2600 < 2000)
        for line in range(8)}
AFTER_E4_E5 = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -"


def _orders(spark, tmp, keys, custkey=170):
    """White has 1590."""
    rows = [(k, custkey, "F", datetime.date(1995, 1 + k % 12, 3), "1-URGENT", 10.0) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string, "
                          "o_totalprice double").write.parquet(os.path.join(tmp, "orders.parquet"))
    return tmp


@pytest.fixture()
def sf(spark, tmp):
    return _orders(spark, tmp, KEYS.values())


def test_positions_are_boards(spark, sf):
    rows = {(int(r.game_id) % 8, r.ply): (r.base_fen, r.move_san) for r in Q.game_positions(spark, sf).collect()}
    assert len(rows) == 6 + 5 + 4 + 8 + 4 + 2 + 2 + 40
    assert [rows[7, p] for p in (0, 4, 36)] == [(START, "Nf3")] * 3  # the knights are back: the same position
    assert rows[2, 3][1] == "Qh4#" and rows[0, 2][0] == AFTER_E4_E5 and (5, 2) not in rows


def test_illegal_moves_are_quarantined(spark, sf):
    assert [tuple(r) for r in Q.replay_quarantine(spark, sf).collect()] == [(str(KEYS[5]), "illegal_move", 2, 4)]


def test_explored_position_has_legal_moves_only(spark, sf):
    assert [tuple(r) for r in Q.position_explore(spark, sf).collect()] == [("Nf3", 3, 100.0)]


def test_sequences_end_in_fens(spark, tmp):
    # o_orderkey % 5 moves of line o_orderkey % 8: four of line 7, three of line 5 (illegal), none of line 0
    sf = _orders(spark, tmp, [39, 13, 40])
    got = {int(r.game_id): (r.fen, r.error) for r in Q.sequence_final_fen(spark, sf).collect()}
    assert got == {39: (f"{START} 4 3", None), 13: (None, "invalid_move_sequence"), 40: (f"{START} 0 1", None)}


def test_fens_are_normalised(spark, tmp):
    got = [(r.o_orderkey, r.base_fen, r.error) for r in Q.fen_normalise(spark, _orders(spark, tmp, [6, 7, 9, 12])).orderBy("o_orderkey").collect()]
    assert got == [(6, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", None),
                   (7, "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6", None), (9, None, "invalid_fen"),
                   (12, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", None)]


def test_requests_name_boards(spark, sf):
    """The eight games (all keys are 1 mod 5: the board after 1. e4, its dead en-passant square left out)."""
    got = {(r.request_id % 3, r.error, r.move_san, r.plays) for r in Q.request_errors(spark, sf).collect()}
    plays = {(m, None, s, n) for m in (0, 1) for s, n in (("e5", 4), ("a6", 1))}
    assert {g for g in got if g[0] != 2} <= plays and {g for g in got if g[0] == 2} <= {(2, "invalid_range", None, None)}
    assert len(got) > 2


def test_ingested_counts_are_of_boards(spark, sf):
    at_start = [(r.move_san, r.times_played) for r in Q.incremental_equals_batch(spark, sf).collect() if r.base_fen == START]
    assert sum(n for m, n in at_start if m == "Nf3") == 10 and sum(n for m, n in at_start if m == "e4") == 5


def test_delta_is_of_replayed_positions(spark, sf):
    # the strict reading loses the annotated line's four plies; the illegal line keeps two in both
    assert tuple(Q.extraction_delta(spark, sf).first()) == (67, 71, 0, 4)


def test_a_task_has_a_bounded_number_of_games(spark, tmp, monkeypatch):
    monkeypatch.setattr(synth, "GAMES_A_TASK", 10)
    games = synth.synth_games(spark, _orders(spark, tmp, range(1, 36)))
    per_task = [len(x) for x in games.select("game_id").rdd.glom().collect()]
    assert sum(per_task) == 35 and len(per_task) == 4 and max(per_task) <= 12
