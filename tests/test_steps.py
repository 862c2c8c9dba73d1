"""Lines of moves as position keys, and the board positions beside them."""

from pyspark.sql import functions as F

from plyframe.operators.extract import extract_positions, token_differences, token_report
from plyframe.operators.qualify import qualify_games
from plyframe.operators.recommend import recommend
from plyframe.operators.counts import count_moves
from plyframe.operators.steps import extract_steps, read_line, unreadable_games
from plyframe.plans import golden
from plyframe.plans import queries as Q
from support import SF001, games_df

PLAIN = ("1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 1-0", "Rated Blitz game", 1500, 1450)


def _rows(df):
    return [(r.game_id, r.ply, r.player_elo_bucket, r.base_fen, r.move_san) for r in df.orderBy("game_id", "ply").collect()]


def test_steps_of_games(spark):
    games = games_df(spark, [PLAIN, ("1... Kd7 2. e4 *", "Club", 1520, 2210, "4k3/8/8/8/8/8/4P3/4K3 b - - 0 1"),
                             ("1. f3 e5 2. g4 Qh4# 0-1", "Club", 900, 800), ("0-0 0-0-0+", "Club", 900, 800), ("no moves", "Club", 900, 800)])
    rows = _rows(extract_steps(games))
    assert rows[:3] == [("0", 0, 1500, "^", "e4"), ("0", 1, 1400, "e4", "e5"), ("0", 2, 1500, "e4 e5", "Nf3")]
    assert [r for r in rows if r[0] == "1"] == [("1", 0, 2200, "4k3/8/8/8/8/8/4P3/4K3 b - - |", "Kd7"),
                                               ("1", 1, 1500, "4k3/8/8/8/8/8/4P3/4K3 b - - | Kd7", "e4")]
    assert [r[4] for r in rows if r[0] == "2"] == ["f3", "e5", "g4", "Qh4"]  # check marks are no part of a move
    assert [r[3:] for r in rows if r[0] == "3"] == [("^", "O-O"), ("O-O", "O-O-O")]
    assert not [r for r in rows if r[0] == "4"]


def test_steps_agree_with_board_positions_on_legal_games(spark):
    """Same plies, buckets and moves as the replay, where the text is legal (check marks aside)."""
    games = qualify_games(Q.pgn_games(spark, SF001))
    steps = extract_steps(games).select("game_id", "ply", "event", "player_elo_bucket", F.rtrim("move_san", F.lit("+#")).alias("m"))
    board = extract_positions(games).select("game_id", "ply", "event", "player_elo_bucket", F.rtrim("move_san", F.lit("+#")).alias("m"))
    assert board.exceptAll(steps).isEmpty()
    left = steps.exceptAll(board).select("m").distinct().collect()
    assert {r.m for r in left} == {"Qxe5", "Nc6"}  # the illegal line's third move and what follows


def test_board_positions_are_the_hand_checked_ones(spark):
    games = qualify_games(Q.pgn_games(spark, SF001))
    got = extract_positions(games).withColumn("line", F.col("game_id").cast("long") % 8).select("line", "ply", "base_fen", "move_san").distinct()
    rows = {(r.line, r.ply): (r.base_fen, r.move_san) for r in got.collect()}
    want = {(line, ply): (fen, move) for line, ply, fen, move in golden.GOLDEN if line != 7}
    want |= {(4, ply): v for (line, ply), v in want.items() if line == 0 and ply < 4}
    want |= {(5, ply): v for (line, ply), v in want.items() if line == 0 and ply < 2}
    cycle = {ply: (fen, move) for line, ply, fen, move in golden.GOLDEN if line == 7}
    want |= {(7, ply): cycle[ply % 4] for ply in range(40)}
    assert rows == want


def test_reading_lines(spark):
    texts = ["", "^", "1. e4 e5", "1. e4 {x} e5 $1 2. Qh5+ 1-0", "0-0", "e4 xx", None, "12. a8=Q# *"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", read_line(F.coalesce("t", F.lit(""))).alias("r")).orderBy("i").collect()
    assert [(r.r.fen, r.r.error) for r in rows] == [("^", None), ("^", None), ("e4 e5", None), ("e4 e5 Qh5", None), ("O-O", None),
                                                    (None, "invalid_line"), ("^", None), ("a8=Q", None)]


def test_lookup_by_lines(spark):
    counts = count_moves(extract_steps(games_df(spark, [PLAIN] * 3)))
    asked = spark.createDataFrame([(1, "1. e4 e5", None, None), (2, "zz", None, None), (3, "d4", None, None), (4, "", None, None)],
                                  "request_id long, fen string, elo_min string, elo_max string")
    got = {r.request_id: (r.error, r.move_san, r.plays) for r in recommend(asked, counts, read_key=read_line).collect()}
    assert got == {1: (None, "Nf3", 3), 2: ("invalid_line", None, None), 3: ("not_found", None, None), 4: ("missing_fen", None, None)}


def test_token_differences(spark):
    games = games_df(spark, [PLAIN, ("1. e4 e5?! 2. d4", "x", 900, 900), ("", "x", 900, 900), ("1. e4 Qh5+", "x", 900, 900)])
    rows = {r.game_id: r for r in token_differences(games).collect()}
    assert [(rows[i].tokens_a, rows[i].tokens_b, rows[i].same, rows[i].first_difference, rows[i].token_a, rows[i].token_b) for i in "0123"] == [
        (6, 6, 6, None, None, None), (1, 3, 1, 1, None, "e5"), (0, 0, 0, None, None, None), (2, 2, 2, None, None, None)]
    total = token_report(token_differences(games)).first()
    assert (total.games, total.games_apart, total.moves_a, total.moves_b, total.moves_same) == (4, 1, 9, 11, 9)
    assert [(r.game_id, r.plies_kept, r.tokens) for r in unreadable_games(games).collect()] == [("1", 1, 3)]
    assert token_report(token_differences(games.limit(0))).first().lost_percent is None
