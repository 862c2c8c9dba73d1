"""Game filters (before any move replay) and the per-run game cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions.columns import (BAD_TERMINATIONS, EXCLUDED_EVENT_WORD, MIN_ELO_EXCLUSIVE,
                                        clean_event, header, parse_rating)

REASONS = ("bullet", "termination", "rating")


def reject_reason(headers="headers"):
    """First failing test in the order bullet, termination, rating; null = kept."""
    event = header(headers, "Event")
    term = header(headers, "Termination")
    white = parse_rating(header(headers, "WhiteElo", "0"))
    black = parse_rating(header(headers, "BlackElo", "0"))
    return (F.when(event.contains(EXCLUDED_EVENT_WORD), F.lit("bullet"))
            .when(term.isin(*BAD_TERMINATIONS), F.lit("termination"))
            .when(~((white > MIN_ELO_EXCLUSIVE) & (black > MIN_ELO_EXCLUSIVE)), F.lit("rating")))


def qualify_games(games: DataFrame, *, with_reason: bool = False) -> DataFrame:
    """games(raw: game_id, headers, movetext) -> M3 games.

    Cheap text tests only; Catalyst evaluates them in the scan stage, before
    the Python replay sees a single row.
    """
    h = F.col("headers")
    fen = header(h, "FEN")
    out = games.select(
        *[c for c in games.columns if c not in ("headers", "movetext")],
        clean_event(header(h, "Event")).alias("event"),
        parse_rating(header(h, "WhiteElo", "0")).alias("white_elo"),
        parse_rating(header(h, "BlackElo", "0")).alias("black_elo"),
        F.when(fen != "", fen).alias("start_fen"),
        "movetext",
        reject_reason(h).alias("reject_reason"))
    if with_reason:
        return out
    return out.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def limit_games(games: DataFrame, n: int, order_by: str = "game_id") -> DataFrame:
    """The first ``n`` qualifying games in a fixed order (a per-run cap)."""
    return games.orderBy(order_by).limit(n)


def filter_report(games: DataFrame) -> DataFrame:
    """Games scanned per outcome (``kept`` or the reject reason)."""
    return (qualify_games(games, with_reason=True)
            .groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("games")))
