"""Pipeline counters collected while the job runs (no extra pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observe_games(games: DataFrame, name: str = "games") -> tuple[DataFrame, Observation]:
    """Attach counters to a qualify_games(..., with_reason=True) frame: games
    scanned and rejected per reason.  Read ``obs.get`` after an action."""
    obs = Observation(name)
    reason = F.col("reject_reason")
    df = games.observe(obs, F.count(F.lit(1)).alias("scanned"),
                       F.count(F.when(reason.isNull(), 1)).alias("kept"),
                       F.count(F.when(reason == "bullet", 1)).alias("bullet"),
                       F.count(F.when(reason == "termination", 1)).alias("termination"),
                       F.count(F.when(reason == "rating", 1)).alias("rating"))
    return df, obs


def observe_positions(positions: DataFrame, name: str = "positions") -> tuple[DataFrame, Observation]:
    """Counters on extracted positions: rows and distinct games seen."""
    obs = Observation(name)
    df = positions.observe(obs, F.count(F.lit(1)).alias("positions"),
                           F.count(F.when(F.col("ply") == 0, 1)).alias("games_with_moves"))
    return df, obs
