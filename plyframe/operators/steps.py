"""Games -> (line, move) rows without replaying a board: DataFrame functions only.

A position is named by the line of moves that led to it (``^`` for none), after
the start position where a game has its own.  Counting, lookups, ingest and
comparisons work on these rows as on board positions; what they do not see is
that two lines reach the same position, or that a well-formed move is illegal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.columns import (SAN_FULL, STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT, base_fen_of,
                                        bucket, tokens)
from plyframe.operators.extract import MAX_PLIES

START = "^"


def spelled_line(moves: Column) -> Column:
    """An array of move words as one text, a blank between them, in one spelling: no check marks, castling with letters."""
    line = F.translate(F.array_join(moves, " "), "+#", "")
    return F.replace(F.replace(line, F.lit("0-0-0"), F.lit("O-O-O")), F.lit("0-0"), F.lit("O-O"))


def line_key(line: Column, start_fen: Column | None = None) -> Column:
    """The key of the position after a spelled line of moves, played from ``start_fen`` (null: the usual start)."""
    if start_fen is not None:
        line = F.when(start_fen.isNull(), line).otherwise(
            F.concat_ws(" ", F.concat(base_fen_of(start_fen), F.lit(" |")), F.nullif(line, F.lit(""))))
    return F.when(line == "", F.lit(START)).otherwise(line)


def read_line(text: Column) -> Column:
    """A sequence of moves as people write it -> struct(``fen``, ``error``): its line, or ``invalid_line`` where a word
    is no move.  Comments, move numbers, glyphs and results are left out; an empty sequence is the start."""
    for pattern in (STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT):
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: ~w.isin("", "*", START))
    good = F.forall(words, lambda w: w.rlike(SAN_FULL))
    return F.struct(F.when(good, line_key(spelled_line(words))).alias("fen"),
                    F.when(~good, F.lit("invalid_line")).alias("error"))


def extract_steps(games: DataFrame, *, max_plies: int = MAX_PLIES, mode: str = "lenient") -> DataFrame:
    """M3 games -> M4 rows plus ``game_id, ply``, as ``extract_positions`` gives them, with ``base_fen`` the line
    before the move.  The mover's own rating picks the bucket; a game starts with the side its FEN names."""
    extra = [c for c in games.columns if c not in ("movetext", "start_fen", "event", "white_elo", "black_elo")]
    lines = games.withColumn("_line", spelled_line(tokens("movetext", mode, max_plies))).filter("_line <> ''")
    rows = lines.select(*extra, "event", "white_elo", "black_elo", "start_fen", "_line",
                        F.posexplode(F.split("_line", " ")).alias("ply", "move_san"))
    black_first = F.when(F.split_part("start_fen", F.lit(" "), F.lit(2)) == "b", 1).otherwise(0)
    mover = F.when((F.col("ply") + black_first) % 2 == 0, F.col("white_elo")).otherwise(F.col("black_elo"))
    # The moves before the ply are a prefix of the line's text: no array is built for each ply.
    return rows.select(*extra, "ply", "event", bucket(mover).alias("player_elo_bucket"),
                       line_key(F.expr("substring_index(_line, ' ', ply)"), F.col("start_fen")).alias("base_fen"), "move_san")


def unreadable_games(games: DataFrame, *, max_plies: int = MAX_PLIES) -> DataFrame:
    """Quarantine view: games whose text the strict reading leaves early, with the moves it keeps of those there are."""
    strict, lenient = (tokens("movetext", m, max_plies) for m in ("strict", "lenient"))
    return games.select("game_id", F.lit("unreadable_move").alias("error"), F.size(strict).alias("plies_kept"),
                        F.size(lenient).alias("tokens")).filter("plies_kept < tokens")
