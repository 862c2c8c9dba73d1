"""Games -> (position, move) rows: tokenize in Catalyst, replay in an Arrow UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions.columns import bucket, tokens
from plyframe.functions.replay import replay_udf

MAX_PLIES = 40


def tokenize_moves(games: DataFrame, mode: str = "lenient", max_plies: int | None = MAX_PLIES,
                   col: str = "movetext") -> DataFrame:
    """Adds ``tokens array<string>``: main-line move words, cut to ``max_plies``."""
    return games.withColumn("tokens", tokens(col, mode, max_plies))


def _replayed(games: DataFrame, mode: str, max_plies: int, partitions: int | None,
              pinned: bool = False) -> DataFrame:
    df = tokenize_moves(games, mode, max_plies).drop("movetext")
    if partitions:
        # Hash on the game id: deterministic on retry without the local sort a
        # round-robin repartition needs.
        df = df.repartition(partitions, "game_id") if "game_id" in df.columns else df.repartition(partitions)
    return df.withColumn("_r", replay_udf(max_plies, pinned)(F.col("start_fen"), F.col("tokens")))


def extract_positions(games: DataFrame, *, max_plies: int = MAX_PLIES, mode: str = "lenient",
                      partitions: int | None = None) -> DataFrame:
    """M3 games -> M4 rows plus ``game_id, ply``.

    Only ``start_fen`` and ``tokens`` cross into Python; event and ratings stay
    in the JVM and the mover's bucket is computed there after the explode.
    A game whose text turns illegal keeps the plies before that point.
    """
    df = _replayed(games, mode, max_plies, partitions)
    passthrough = [c for c in games.columns if c not in ("movetext", "start_fen")]
    extra = [c for c in passthrough if c not in ("event", "white_elo", "black_elo")]
    # inline_outer: a plain inline lets Catalyst infer a size(plies) > 0 filter
    # that duplicates the Python UDF below the generator.
    rows = (df.select(*passthrough, F.inline_outer("_r.plies"))
              .filter(F.col("ply").isNotNull()))
    mover = F.when(F.col("white_to_move"), F.col("white_elo")).otherwise(F.col("black_elo"))
    return rows.select(*extra, "ply", "event",
                       bucket(mover).alias("player_elo_bucket"), "base_fen", "move_san")


def replay_errors(games: DataFrame, *, max_plies: int = MAX_PLIES, mode: str = "lenient") -> DataFrame:
    """Quarantine view: games whose replay stopped early, with the reason and plies kept."""
    df = _replayed(games, mode, max_plies, None, pinned=True)
    return (df.filter(F.col("_r.error").isNotNull())
              .select("game_id", F.col("_r.error").alias("error"),
                      F.size("_r.plies").alias("plies_kept"), F.size("tokens").alias("tokens")))


def token_differences(games: DataFrame, mode_a: str = "strict", mode_b: str = "lenient", max_plies: int | None = MAX_PLIES,
                      col: str = "movetext") -> DataFrame:
    """Two tokenizations of each game beside each other, aligned in the row: ``tokens_a``, ``tokens_b`` (how many),
    ``same`` (moves before the first difference), ``first_difference`` (its index, null where there is none),
    ``token_a``, ``token_b`` (what stands there; null beyond the end).

    One read, no replay, no shuffle.  Check marks (``+``, ``#``) are no difference: replay writes its own."""
    both = games.select(*[c for c in games.columns if c != col], tokens(col, mode_a, max_plies).alias("_a"),
                        tokens(col, mode_b, max_plies).alias("_b"))
    bare = lambda t: F.rtrim(t, F.lit("+#"))
    shorter = F.least(F.size("_a"), F.size("_b"))
    apart = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i >= shorter) | (bare(F.get("_a", i)) != bare(F.get("_b", i))))
    at = F.get(apart, F.lit(0))
    first = F.when((at < shorter) | (F.size("_a") != F.size("_b")), at)
    return both.withColumn("_at", at).select(
        *[c for c in games.columns if c != col], F.size("_a").alias("tokens_a"), F.size("_b").alias("tokens_b"),
        F.col("_at").alias("same"), first.alias("first_difference"), F.get("_a", first).alias("token_a"), F.get("_b", first).alias("token_b"))


def token_report(differences: DataFrame) -> DataFrame:
    """Sums of ``token_differences``: games, games that differ, moves of each side, moves alike, and the share of
    ``b``'s moves that ``a`` loses, in percent (null without moves)."""
    sums = differences.agg(
        F.count(F.lit(1)).alias("games"), F.count("first_difference").alias("games_apart"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("tokens_a", "moves_a"), ("tokens_b", "moves_b"), ("same", "moves_same"))])
    lost = (F.col("moves_b") - F.col("moves_a")).cast("double") * 100.0
    return sums.withColumn("lost_percent", F.try_divide(lost, F.col("moves_b").cast("double")))
