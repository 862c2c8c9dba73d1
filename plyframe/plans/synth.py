"""Archive text derived from the ``orders`` table (integer rules shared with the SQL oracle).

Every order becomes one game record, so the archive grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The eight movetext lines, chosen by o_orderkey % 8.
LINE_7 = " ".join(f"{2 * i + 1}. Nf3 Nf6 {2 * i + 2}. Ng1 Ng8" for i in range(11)) + " 1/2-1/2"
MOVETEXT = [
    "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 1-0",
    "1. e4 a6 2. e5 d5 3. exd6 *",
    "1. f3 e5 2. g4 Qh4# 0-1",
    "1. e4 e5 2. Nf3 Nc6 3. Bc4 Bc5 4. O-O Nf6 1/2-1/2",
    "1. e4?! { [%clk 0:03:00] } 1... e5 $1 2. Nf3 (2. Bc4 Nf6) 2... Nc6 1-0",
    "1. e4 e5 2. Qxe5 Nc6 1-0",
    "1. a8=Q Kg7 *",
    LINE_7,
]
LINE_6_FEN = "8/P6k/8/8/8/8/7K/8 w - - 0 1"

# Event by o_orderkey % 5, termination by o_orderstatus.
EVENTS = [
    "Rated Bullet game",
    "Rated Blitz game",
    "Rated Rapid tournament https://example.org/t/1",
    "Rated Classical game",
    "Rated UltraBullet game",
]
TERMINATIONS = {"F": "Normal", "O": "Time forfeit", "P": "Abandoned"}
#: Games a task works on: what a task holds does not grow with the table, however well its text compresses.
GAMES_A_TASK = 50_000
SITE_PREFIX = "https://example.org/g/"


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def line_id() -> Column:
    return F.col("o_orderkey") % 8


def raw_event() -> Column:
    return _pick(EVENTS, F.col("o_orderkey") % 5)


def termination() -> Column:
    m = F.create_map(*[F.lit(x) for kv in TERMINATIONS.items() for x in kv])
    return m[F.col("o_orderstatus")]


def white_elo_text() -> Column:
    return (F.when(F.col("o_orderkey") % 17 == 0, F.lit("?"))
            .otherwise((F.lit(400) + (F.col("o_custkey") * 7) % 2600).cast("string")))


def black_elo_text() -> Column:
    return (F.lit(400) + (F.col("o_orderkey") * 13) % 2600).cast("string")


def month() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM")


def _tag(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{key} "'), value, F.lit('"]'))


def archive_records(orders: DataFrame) -> DataFrame:
    """orders -> (game_key bigint, month, value) where value is one PGN record."""
    lid = line_id()
    fen_tag = F.when(lid == 6, F.lit(f'[FEN "{LINE_6_FEN}"]'))
    value = F.concat_ws(
        "\n",
        _tag("Event", raw_event()),
        _tag("Site", F.concat(F.lit(SITE_PREFIX), F.col("o_orderkey").cast("string"))),
        _tag("WhiteElo", white_elo_text()),
        _tag("BlackElo", black_elo_text()),
        _tag("Termination", termination()),
        fen_tag,
        F.lit(""),
        _pick(MOVETEXT, lid),
        F.lit(""))
    return orders.select(F.col("o_orderkey").alias("game_key"), month().alias("month"), value.alias("value"))


def games_from_records(records: DataFrame, with_month: bool = False) -> DataFrame:
    """Parsed records -> games(raw) keyed by the Site tag's trailing id."""
    from plyframe.sources.archive import parse_games
    g = parse_games(records)
    site = F.try_element_at("headers", F.lit("Site"))
    return g.select(F.substring_index(site, "/", -1).alias("game_id"), *(["month"] if with_month else []),
                    "headers", "movetext")


def synth_games(spark: SparkSession, sf_dir: str, with_month: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tasks = max(1, -(-orders.count() // GAMES_A_TASK))  # a count from the files' footers
    return games_from_records(archive_records(orders).repartition(tasks), with_month)
