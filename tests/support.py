"""Small inputs the tests share."""

SF001 = "/root/testdata/sf0.001"


def games_df(spark, rows):
    """rows of (movetext, event, white_elo, black_elo[, start_fen]) -> M3 games."""
    from plyframe.schemas import GAMES
    data = []
    for i, r in enumerate(rows):
        movetext, event, w, b = r[:4]
        fen = r[4] if len(r) > 4 else None
        data.append((str(i), event, w, b, fen, movetext))
    return spark.createDataFrame(data, GAMES)


def archive_df(spark, text):
    """Archive text as a one-record DataFrame (as the text source would give it)."""
    return spark.createDataFrame([(text,)], "value string")
