"""Games -> positions (the reference's worker tests, plus tokenizer modes and the cap)."""

from support import games_df
from plyframe.operators.extract import extract_positions, replay_errors, tokenize_moves

SAMPLE = ("1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 1-0", "Rated Blitz game", 1500, 1450)


def _rows(df):
    return [r.asDict() for r in df.orderBy("game_id", "ply").collect()]


def test_sample_game_six_rows(spark):
    rows = _rows(extract_positions(games_df(spark, [SAMPLE])))
    assert len(rows) == 6
    assert {k for k in rows[0]} >= {"event", "player_elo_bucket", "base_fen", "move_san"}
    assert all(r["event"] == "Rated Blitz game" for r in rows)
    assert (rows[0]["move_san"], rows[0]["player_elo_bucket"]) == ("e4", 1500)
    assert (rows[1]["move_san"], rows[1]["player_elo_bucket"]) == ("e5", 1400)
    assert (rows[5]["move_san"], rows[5]["player_elo_bucket"]) == ("a6", 1400)
    assert rows[0]["base_fen"] == "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


def test_bad_game_gives_no_rows(spark):
    df = games_df(spark, [("not a real pgn @@@", "Rated Blitz game", 1500, 1500), SAMPLE])
    rows = _rows(extract_positions(df))
    assert {r["game_id"] for r in rows} == {"1"}


def test_both_tokenizers_on_annotated_text(spark):
    text = "1. e4?! { [%clk 0:03:00] } 1... e5 $1 2. Nf3 (2. Bc4 (2. d4 exd4) Nf6) 2... Nc6 1-0"
    df = games_df(spark, [(text, "Rated Blitz game", 1500, 1500)])
    lenient = tokenize_moves(df, "lenient").first()["tokens"]
    strict = tokenize_moves(df, "strict").first()["tokens"]
    assert lenient == ["e4", "e5", "Nf3", "Nc6"]
    assert strict == []  # 'e4?!' is not a SAN token: the strict path stops at once
    assert extract_positions(df, mode="strict").count() == 0
    assert extract_positions(df).count() == 4


def test_cap_and_repeated_positions(spark):
    text = " ".join(f"{2 * i + 1}. Nf3 Nf6 {2 * i + 2}. Ng1 Ng8" for i in range(11))
    rows = _rows(extract_positions(games_df(spark, [(text, "Rated Blitz game", 1500, 1500)])))
    assert len(rows) == 40 and rows[-1]["ply"] == 39
    start = [r for r in rows if r["base_fen"].startswith("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP")]
    assert len(start) == 10


def test_black_to_move_start_uses_black_rating(spark):
    fen = "4k3/8/8/8/8/8/4P3/4K3 b - - 0 1"
    rows = _rows(extract_positions(games_df(spark, [("1... Kd7 2. e4 *", "Rated Blitz game", 1520, 2210, fen)])))
    assert [(r["move_san"], r["player_elo_bucket"]) for r in rows] == [("Kd7", 2200), ("e4", 1500)]


def test_illegal_move_keeps_prefix_and_quarantines(spark):
    df = games_df(spark, [("1. e4 e5 2. Qxe5 Nc6 1-0", "Rated Blitz game", 1500, 1500)])
    assert [r["move_san"] for r in _rows(extract_positions(df))] == ["e4", "e5"]
    q = replay_errors(df).first()
    assert (q["error"], q["plies_kept"]) == ("illegal_move", 2)


def test_replay_udf_runs_once_in_plan(spark):
    df = extract_positions(games_df(spark, [SAMPLE]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_castling_and_en_passant_keys(spark):
    text = "1. e4 a6 2. e5 d5 3. exd6 Nf6 4. Nf3 e6 5. Be2 Be7 6. O-O *"
    rows = _rows(extract_positions(games_df(spark, [(text, "Rated Blitz game", 1500, 1500)])))
    assert rows[4]["base_fen"].endswith(" w KQkq d6") and rows[4]["move_san"] == "exd6"
    assert rows[10]["move_san"] == "O-O"


def test_tokenizer_edge_cases(spark):
    cases = [
        ("1. e4 (1. d4 (1. c4 (1. Nf3 (1. g3 (1. b3 e5) d5) Nf6) e5) d5) e5 2. Nf3 *", ["e4", "e5", "Nf3"]),
        ("1. e4 { unclosed comment 2. d4", ["e4"]),
        ("1. e4 ; rest of line is a comment 1... e5", ["e4"]),
        ("1. e4 e5 2. Nf3 Nc6 3. Bc4 Bc5 4. 0-0 Nf6", ["e4", "e5", "Nf3", "Nc6", "Bc4", "Bc5", "0-0", "Nf6"]),
        ("1. e4! e5!! 2. Nf3?? Nc6!? 3. Bb5?! a6 $14 1-0", ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]),
        ("1. e4 ) e5 2. Nf3", ["e4", "e5", "Nf3"]),
    ]
    df = games_df(spark, [(t, "Rated Blitz game", 1500, 1500) for t, _ in cases])
    got = {r.game_id: r.tokens for r in tokenize_moves(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [want for _, want in cases]
    rows = extract_positions(df).filter("game_id = '3'").orderBy("ply").collect()
    assert [r.move_san for r in rows][6] == "O-O"
    promo = games_df(spark, [("1. a8=q *", "Rated Blitz game", 1500, 1500, "7k/P7/8/8/8/8/8/K7 w - - 0 1")])
    assert [r.move_san for r in extract_positions(promo).collect()] == ["a8=Q+"]


def test_null_moves_and_drops(spark):
    df = games_df(spark, [("1. e4 -- 2. d4 e5 3. Z0 Nc6 *", "Rated Blitz game", 1500, 1500),
                          ("1. e4 e5 2. N@f3 Nc6 *", "Rated Blitz game", 1500, 1500)])
    rows = _rows(extract_positions(df))
    first = [(r["move_san"], r["base_fen"].split(" ")[1]) for r in rows if r["game_id"] == "0"]
    assert first == [("e4", "w"), ("--", "b"), ("d4", "w"), ("e5", "b"), ("--", "w"), ("Nc6", "b")]
    assert rows[2]["base_fen"] == "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -"
    assert [r["move_san"] for r in rows if r["game_id"] == "1"] == ["e4", "e5"]  # a drop ends the game
    strict = tokenize_moves(df, "strict").orderBy("game_id").collect()
    assert strict[0].tokens == ["e4", "--", "d4", "e5", "Z0", "Nc6"] and strict[1].tokens == ["e4", "e5"]


def test_sql_functions_match_dataframe_api(spark):
    from plyframe.functions.sql import register_sql_functions
    register_sql_functions(spark)
    texts = ["1. e4?! { c } 1... e5 $1 2. Nf3 (2. Bc4 (2. d4 d5) Nf6) 2... Nc6 1-0",
             "1. e4 e5 2. Qxe5 Nc6 1-0", "not a real pgn @@@", "1. f3 e5 2. g4 Qh4# 0-1"]
    df = games_df(spark, [(t, "Rated Blitz game", 1500, 1500) for t in texts])
    df.createOrReplaceTempView("sql_games")
    for mode in ("lenient", "strict"):
        got = {r.game_id: r.t for r in spark.sql(f"SELECT game_id, {mode}_tokens(movetext) AS t FROM sql_games").collect()}
        want = {r.game_id: r.tokens for r in tokenize_moves(df, mode).collect()}
        assert got == want
    rows = spark.sql("""SELECT game_id, ply, move_san FROM (
                          SELECT game_id, inline_outer(r.plies) FROM (
                            SELECT game_id, replay_moves(start_fen, toks) AS r FROM (
                              SELECT game_id, start_fen, lenient_tokens(movetext) AS toks FROM sql_games)))
                        WHERE ply IS NOT NULL""").collect()
    api = extract_positions(df).select("game_id", "ply", "move_san").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, api))
    fen = spark.sql("SELECT normalise_fen('rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1').fen AS f").first().f
    assert fen == "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -"
    assert " b " in spark.sql("SELECT sequence_fen('e4 e5 Nf3').fen AS f").first().f
