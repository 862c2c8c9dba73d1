"""Archive reading, header folding and the game filters."""

import os

import zstandard

from support import archive_df
from plyframe.operators.qualify import filter_report, limit_games, qualify_games
from plyframe.sources.archive import parse_games, read_games

def _game(event, white, black, ending, moves="1. b3 g6"):
    tags = {"Event": event, "WhiteElo": white, "BlackElo": black, "Termination": ending}
    return "".join(f'[{k} "{v}"]\n' for k, v in tags.items() if v is not None) + f"\n{moves} *\n\n"


# One game for each way through the filters: (tags, outcome).
JUDGED = [(("Club evening", "1201", "888", "Time forfeit"), "kept"), (("Weekly Bullet arena", "2400", "2399", None), "bullet"),
          (("Casual", "601", "600", "Normal"), "rating"), (("Casual", "?", "1900", "Normal"), "rating"),
          (("League", "1111", "2222", "Rules infraction"), "termination"), (("League", "700", "701", None), "kept"),
          (("bullet in lower case", "1000", "1000", "Normal"), "kept"), (("League", "3050", "2950", "Unterminated"), "termination"),
          (("Open", None, "1500", "Normal"), "rating")]
NINE_GAMES = "".join(_game(*tags) for tags, _ in JUDGED)


def _write(tmp, name, text):
    path = os.path.join(tmp, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_every_outcome_is_counted(spark, tmp):
    games = read_games(spark, _write(tmp, "a.pgn", NINE_GAMES))
    want = {}
    for _, outcome in JUDGED:
        want[outcome] = want.get(outcome, 0) + 1
    assert {r.outcome: r.games for r in filter_report(games).collect()} == want
    kept = sorted((r.event, r.white_elo, r.black_elo) for r in qualify_games(games).collect())
    assert kept == sorted((t[0], int(t[1]), int(t[2])) for t, outcome in JUDGED if outcome == "kept")


def test_first_games_are_the_first_in_the_file(spark, tmp):
    text = "".join(_game(f"Round {i}", 900 + i, 950, "Normal") for i in range(7))
    games = qualify_games(read_games(spark, _write(tmp, "c.pgn", text)))
    assert sorted(r.event for r in limit_games(games, 4).collect()) == [f"Round {i}" for i in range(4)]
    assert limit_games(games, 99).count() == 7


def test_split_size_does_not_change_games(spark, tmp):
    path = _write(tmp, "d.pgn", NINE_GAMES * 20)
    expected = read_games(spark, path).count()
    assert expected == 180
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("137b", "1000b", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_games(spark, path)
            assert df.count() == expected
            assert df.select("movetext").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zstd_archive(spark, tmp):
    path = os.path.join(tmp, "games_2024-01.pgn.zst")
    with open(path, "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(NINE_GAMES.encode()))
    assert qualify_games(read_games(spark, path)).count() == 3


def test_header_fold_semantics(spark):
    text = ('[Event "Rated Blitz game"]\r\n[Event "Rated Classical game"]\n[NoSpaceTag]\n'
            '[WhiteElo "1500"]\n[BlackElo "1600"]\n[Note "Rated [x]"]\n\n'
            '1. e4 e5\n2. Nf3 Nc6\n')
    games = parse_games(archive_df(spark, text)).orderBy("game_index").collect()
    assert len(games) == 2
    h = games[0].headers
    assert h["Event"] == "Rated Classical game"  # last duplicate wins
    assert "NoSpaceTag]" not in h and len(h) == 4
    assert h["Note"] == "Rated [x"  # quote and bracket characters stripped from both ends
    assert games[0].movetext == "1. e4 e5"
    # A wrapped movetext line is a game of its own with no headers -> rating 0 -> dropped.
    assert games[1].headers == {} and games[1].movetext == "2. Nf3 Nc6"
    assert qualify_games(parse_games(archive_df(spark, text))).count() == 1


def test_rating_text_and_event_cleaning(spark):
    text = ('[Event "Rated Blitz tournament https://example.org/t/9"]\n[WhiteElo "1500?"]\n[BlackElo "1500"]\n\n1. e4\n\n'
            '[Event "Rated Blitz tournament https://example.org/t/9"]\n[WhiteElo "1600"]\n[BlackElo "1700"]\n'
            '[FEN ""]\n\n1. e4\n')
    rows = qualify_games(parse_games(archive_df(spark, text)), with_reason=True).orderBy("game_index").collect()
    assert rows[0].reject_reason == "rating" and rows[0].white_elo == 0
    assert rows[1].reject_reason is None and rows[1].event == "Rated Blitz tournament"
    assert rows[1].start_fen is None  # empty FEN tag = standard start


def test_blank_line_separator_for_games_without_event_first(spark, tmp):
    text = ('[Site "x"]\n[Event "Rated Blitz game"]\n[WhiteElo "1500"]\n[BlackElo "1500"]\n\n1. e4 e5 1-0\n\n'
            '[Site "y"]\n[Event "Rated Rapid game"]\n[WhiteElo "1700"]\n[BlackElo "1750"]\n\n1. d4 Nf6 1-0\n')
    path = _write(tmp, "s.pgn", text * 20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        games = qualify_games(read_games(spark, path, record_sep="\n\n["))
        assert games.count() == 40
        assert sorted({r.event for r in games.collect()}) == ["Rated Blitz game", "Rated Rapid game"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_game_ids_follow_file_order(spark, tmp):
    games = [_game("League", 1000, 1000, "Normal", f"1. b3 g6 2. Bb2 Bg7 {i}. g3") for i in range(3, 15)]
    path = _write(tmp, "o.pgn", "".join(games))
    first = limit_games(qualify_games(read_games(spark, path)), 5).collect()
    assert [r.movetext.split()[6] for r in first] == ["3.", "4.", "5.", "6.", "7."]


def test_bz2_archive_splits_without_changing_games(spark, tmp):
    import bz2
    path = os.path.join(tmp, "games_2024-02.pgn.bz2")
    with open(path, "wb") as f:
        f.write(bz2.compress((NINE_GAMES * 200).encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # several splits of one bz2 file
        games = read_games(spark, path)
        assert games.count() == 1800
        assert qualify_games(games).count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
