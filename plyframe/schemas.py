"""Fixed schemas: every stage reads and writes these, nothing is inferred."""

from pyspark.sql import types as T

HEADERS = T.MapType(T.StringType(), T.StringType())

GAME_RECORD = T.StructType([
    T.StructField("headers", HEADERS),
    T.StructField("movetext", T.StringType()),
])

# M3: a qualifying game.
GAMES = T.StructType([
    T.StructField("game_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("white_elo", T.IntegerType()),
    T.StructField("black_elo", T.IntegerType()),
    T.StructField("start_fen", T.StringType()),
    T.StructField("movetext", T.StringType()),
])

# M4: one row per ply (the storage form drops game_id and ply).
POSITIONS = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("player_elo_bucket", T.LongType()),
    T.StructField("base_fen", T.StringType()),
    T.StructField("move_san", T.StringType()),
])

# M5 / M6: counts per (position, bucket, move); monthly files add the
# partition columns `month` and `part` (`full` for a whole month, else a hash of
# the archive file the rows came from).
COUNT_KEYS = ("base_fen", "player_elo_bucket", "move_san")
COUNTS = T.StructType([
    T.StructField("base_fen", T.StringType()),
    T.StructField("player_elo_bucket", T.LongType()),
    T.StructField("move_san", T.StringType()),
    T.StructField("times_played", T.LongType()),
])
MONTHLY_COUNTS = T.StructType(COUNTS.fields + [T.StructField("month", T.StringType()),
                                               T.StructField("part", T.StringType())])
# On disk a load has its own directory; the log of loads says which count.
STORED_COUNTS = T.StructType(MONTHLY_COUNTS.fields + [T.StructField("load", T.StringType())])
COVERED = T.StructType([T.StructField("month", T.StringType()), T.StructField("part", T.StringType()),
                        T.StructField("load", T.StringType())])
# What a load covers, with the counters of the games it came from (null where nobody counted), and the log's entries.
COUNTERS = ("scanned", "kept", "bullet", "termination", "rating")
COVERS = T.StructType(COVERED.fields + [T.StructField(c, T.LongType()) for c in COUNTERS])
LOG_ENTRIES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("load", T.StringType()),
    T.StructField("whole", T.BooleanType()), T.StructField("processed", T.ArrayType(T.StringType())),
    T.StructField("batch_id", T.LongType())])

# Output of the replay UDF.
PLY = T.StructType([
    T.StructField("ply", T.IntegerType()),
    T.StructField("white_to_move", T.BooleanType()),
    T.StructField("base_fen", T.StringType()),
    T.StructField("move_san", T.StringType()),
])
REPLAY = T.StructType([
    T.StructField("error", T.StringType()),
    T.StructField("plies", T.ArrayType(PLY)),
])

# M7 / M8
CATALOGUE = T.StructType([
    T.StructField("year_month", T.StringType()),
    T.StructField("url", T.StringType()),
])
LEDGER = T.StructType([T.StructField("year_month", T.StringType())])

# M9 / M10
REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("fen", T.StringType()),
    T.StructField("elo_min", T.StringType()),
    T.StructField("elo_max", T.StringType()),
])
RECOMMENDATIONS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("move_san", T.StringType()),
    T.StructField("plays", T.LongType()),
    T.StructField("percentage", T.DoubleType()),
])
