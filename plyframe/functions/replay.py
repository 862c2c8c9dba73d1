"""Arrow-batched UDFs around the board kernel (the only Python in the plans)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.functions.board import Position, Replayer, play_sequence
from plyframe.schemas import REPLAY

_REPLAYERS: dict[int, Replayer] = {}


def _replayer() -> Replayer:
    # One cache per Python worker process, reused across Arrow batches.
    r = _REPLAYERS.get(0)
    if r is None:
        r = _REPLAYERS[0] = Replayer()
    return r


def replay_udf(max_plies: int = 40, pinned: bool = False):
    """(start_fen string, tokens array<string>) -> struct<error, plies array<ply>>.

    ``pinned`` marks the call non-deterministic for the optimizer only (the
    result is deterministic): a filter on its output is then not pushed below
    the projection, which would evaluate the Python call a second time.
    """

    @F.pandas_udf(REPLAY)
    def replay(start_fen: pd.Series, toks: pd.Series) -> pd.DataFrame:
        r = _replayer()
        errors, plies = [], []
        for fen, tk in zip(start_fen, toks):
            rows, err = r.replay(fen if isinstance(fen, str) and fen else None,
                                 [] if tk is None else list(tk), max_plies)
            errors.append(err)
            plies.append([{"ply": p, "white_to_move": w, "base_fen": b, "move_san": s}
                          for p, w, b, s in rows])
        return pd.DataFrame({"error": errors, "plies": plies})

    return replay.asNondeterministic() if pinned else replay


_FEN_RESULT = T.StructType([T.StructField("fen", T.StringType()), T.StructField("error", T.StringType())])


_NORMALISED: dict = {}
_NORMALISED_MAX = 100_000


def _normalise_one(fen):
    hit = _NORMALISED.get(fen)
    if hit is None:
        try:
            if not isinstance(fen, str) or not fen.strip():
                raise ValueError("missing")
            hit = (Position.from_fen(fen).base_fen(), None)
        except Exception:  # any failure marks this request only, never the job
            hit = (None, "invalid_fen")
        if len(_NORMALISED) >= _NORMALISED_MAX:
            _NORMALISED.clear()
        _NORMALISED[fen] = hit
    return hit


@F.pandas_udf(_FEN_RESULT)
def _normalise(fens: pd.Series) -> pd.DataFrame:
    pairs = [_normalise_one(f) for f in fens]
    return pd.DataFrame({"fen": [p[0] for p in pairs], "error": [p[1] for p in pairs]})


# FEN text -> (four-field key with legal-only en passant, error).  Request
# batches repeat a few hot positions; a bounded per-worker cache parses each
# distinct text once.  Pinned (see replay_udf) because validation filters on
# its output.
normalise_fen_udf = _normalise.asNondeterministic()


@F.pandas_udf(_FEN_RESULT)
def sequence_fen_udf(moves: pd.Series) -> pd.DataFrame:
    """Space-separated SAN from the start position -> (six-field FEN, error)."""
    out, errs = [], []
    for seq in moves:
        try:
            out.append(play_sequence(seq or ""))
            errs.append(None)
        except Exception:  # any failure marks this row only, never the job
            out.append(None)
            errs.append("invalid_move_sequence")
    return pd.DataFrame({"fen": out, "error": errs})
