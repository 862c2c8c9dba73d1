"""Lookups: "top moves in this position for this rating range", one or many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.functions.board import normalise_fen
from plyframe.functions.replay import normalise_fen_udf
from plyframe.operators.counts import top_k_share
from plyframe.sources.sorted_table import count_below, read_for
from plyframe.sources.storage import counts_view

# Default rating bounds and answer size of the lookup.
DEFAULT_ELO_MIN = 0
DEFAULT_ELO_MAX = 3000
TOP_K = 5
#: Rows of counts a task of a lookup against a stored table works on.
ROWS_A_TASK = 250_000

_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


def _bound(c: Column, default: int) -> Column:
    """Integer text of any size as a bigint (beyond its range: its end); null for other text."""
    text = F.trim(c.cast("string"))
    wide = text.try_cast("decimal(38,0)")
    end = F.when(text.startswith("-"), F.lit(_LONG_MIN)).otherwise(F.lit(_LONG_MAX))
    return (F.when(c.isNull(), F.lit(default).cast("long"))
            .when(text.rlike(_INT_TEXT), F.coalesce(wide.try_cast("long"), end)))


def display_share(c) -> Column:
    """One-decimal display value (half-even, like the service's rounding)."""
    return F.bround(c if isinstance(c, Column) else F.col(c), 1)


def validate_requests(requests: DataFrame, key_is_fen: bool = True, read_key=None) -> DataFrame:
    """request_id, fen, elo_min, elo_max -> + key_fen, lo, hi, error.

    Errors, first that applies: missing_fen, invalid_fen, invalid_range.
    FENs are parsed and re-emitted, so a key with an en-passant square that no
    pawn can use matches the stored key without it.  Other keys are used as given, or as ``read_key`` reads
    them (a Column to a struct of ``fen`` and ``error``, in the JVM: ``steps.read_line`` for lines of moves).
    """
    fen = F.col("fen")
    lo = _bound(F.col("elo_min"), DEFAULT_ELO_MIN)
    hi = _bound(F.col("elo_max"), DEFAULT_ELO_MAX)
    parsed = requests.select("request_id", fen, lo.alias("lo"), hi.alias("hi"))
    if read_key is not None:
        parsed = parsed.withColumn("_n", read_key(F.coalesce(fen, F.lit(""))))
    elif key_is_fen:  # each distinct FEN is parsed once, however many requests name it
        norm = requests.select(fen.alias("_fen")).filter(fen.isNotNull()).distinct().select(
            "_fen", normalise_fen_udf(F.col("_fen")).alias("_n"))
        parsed = parsed.join(norm, F.col("fen") == F.col("_fen"), "left").drop("_fen")
    else:  # generic context keys are used as given
        parsed = parsed.withColumn("_n", F.struct(fen.alias("fen"), F.lit(None).cast("string").alias("error")))
    error = (F.when(F.col("fen").isNull() | (F.trim("fen") == ""), F.lit("missing_fen"))
             .when(F.col("_n.error").isNotNull(), F.lit("invalid_fen") if read_key is None else F.col("_n.error"))
             .when(F.col("lo").isNull() | F.col("hi").isNull(), F.lit("invalid_range")))
    return (parsed.withColumn("error", error)
            .select("request_id", F.when(F.col("error").isNull(), F.col("_n.fen")).alias("key_fen"),
                    "lo", "hi", "error"))


def running_plays(counts: DataFrame) -> DataFrame:
    """One row per (position, move): ``by``, its buckets ascending, each with the plays up to and including it."""
    moves, bucket = ["base_fen", "move_san"], F.col("player_elo_bucket").cast("long")
    # A range frame: rows of one bucket (a view's sources) all get the sum with all of them.
    upto = F.sum("times_played").over(Window.partitionBy(*moves).orderBy(bucket).rangeBetween(Window.unboundedPreceding, 0))
    return (counts.select(*moves, F.struct(bucket.alias("bucket"), upto.alias("upto")).alias("b"))
            .groupBy(*moves).agg(F.sort_array(F.collect_list("b")).alias("by")))


def plays_between(by: Column, lo: Column, hi: Column) -> Column:
    """Plays in buckets ``lo`` to ``hi`` out of running sums: two binary searches, whatever the number of buckets."""
    bucket = lambda x: x["bucket"]
    upto = lambda n: F.coalesce(F.get(by, n - 1)["upto"], F.lit(0).cast("long"))
    return upto(count_below(by, hi, inclusive=True, item=bucket)) - upto(count_below(by, lo, item=bucket))


def recommend(requests: DataFrame, counts: DataFrame | None, k: int = TOP_K, *,
              key_is_fen: bool = True, only: Sequence[str] | None = None, read_key=None,
              stored: bool = False) -> DataFrame:
    """Batch form of the lookup -> (request_id, error, rank, move_san, plays, percentage).

    Duplicate requests (a hot opening asked for by many) collapse to one
    distinct (fen, lo, hi) key before touching the counts, and only the counts of
    positions asked for go on (a semi join before anything is summed).  These are folded to
    one row per (position, move) with running sums over its buckets, so a key meets each
    move of its position once and finds its range by binary search, however many buckets there
    are.  Answers go back to valid requests by a left join (a request with no rows gets
    ``not_found``); invalid ones never enter a join.  Nothing runs until the
    result is used; join strategies are left to the sizes Spark sees.

    ``only`` names the positions all requests are about, where the caller knows
    them: they become a filter on the counts scan (row groups of the sorted
    table are skipped by min/max).  ``recommend_sorted`` prunes files by the requests' own keys.

    ``stored`` says that ``counts`` is read from files, so that counting its rows is cheap: the positions are
    then dealt out by ``ROWS_A_TASK`` and what a task holds does not grow with the table.
    """
    return _answered(validate_requests(requests, key_is_fen, read_key), counts, k, only, stored=stored)


def recommend_sorted(requests: DataFrame, path: str, k: int = TOP_K, *, key_is_fen: bool = True) -> DataFrame:
    """``recommend`` against a sorted table (``write_sorted``): its index says which files can hold a position asked
    for, and no other is opened.  The requests' keys are looked up in the index at once."""
    v = validate_requests(requests, key_is_fen)
    keys = v.filter(F.col("error").isNull()).select(F.col("key_fen").alias("base_fen")).distinct()
    return _answered(v, read_for(requests.sparkSession, path, keys), k, stored=True)


def recommend_view(requests: DataFrame, merged_path: str | None, monthly_root: str | None, k: int = TOP_K, *,
                   key_is_fen: bool = True) -> DataFrame:
    """``recommend`` against the counts view: the merged table's runs are pruned by the requests' keys, months
    loaded since are read as well, replaced ones are taken back out."""
    spark, v = requests.sparkSession, validate_requests(requests, key_is_fen)
    keys = v.filter(F.col("error").isNull()).select(F.col("key_fen").alias("base_fen")).distinct()
    return _answered(v, counts_view(spark, merged_path, monthly_root, keys=keys), k, stored=True)


def _dealt(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` of the table ``stored`` by position, at most ``ROWS_A_TASK`` of the table to a task on average.  Spark
    would size tasks by compressed bytes, of which sorted counts have few: their rows then meet in few tasks, each
    sorting millions.  Small tables stay as they are."""
    tasks = -(-stored.count() // ROWS_A_TASK)
    if tasks < 2:
        return rows
    # At the session's own number Spark takes its exchange for this one and sizes it by bytes again.
    return rows.repartition(tasks + (str(tasks) == rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "base_fen")


def _answered(v: DataFrame, counts: DataFrame | None, k: int, only: Sequence[str] | None = None,
              stored: bool = False) -> DataFrame:
    key = ["key_fen", "lo", "hi"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("move_san", "string"), ("plays", "long"),
                                                     ("percentage", "double"))]
    if counts is None:
        return v.select("request_id", F.coalesce("error", F.lit("no_source")).alias("error"), *none)
    valid = v.filter(F.col("error").isNull()).drop("error")
    invalid = v.filter(F.col("error").isNotNull()).select("request_id", "error", *none)
    keys = valid.select(*key).distinct()
    c = counts if only is None else counts.filter(F.col("base_fen").isin(list(only)))
    c = c.join(keys.select(F.col("key_fen").alias("base_fen")).distinct(), "base_fen", "left_semi")
    c = _dealt(c, counts) if stored else c
    matched = (keys.join(running_plays(c), F.col("key_fen") == F.col("base_fen"))
               .select(*key, "move_san", plays_between(F.col("by"), F.col("lo"), F.col("hi")).alias("plays"))
               .filter("plays <> 0"))
    top = top_k_share(matched, key, "move_san", "plays", k, folded=True)
    found = valid.join(top, key, "left").select(
        "request_id", F.when(F.col("move_san").isNull(), F.lit("not_found")).alias("error"),
        F.col("rank").cast("int").alias("rank"), "move_san", "plays", "percentage")
    return found.unionByName(invalid)


def requests_from_json(df: DataFrame, col: str = "body", id_col: str = "request_id") -> DataFrame:
    """JSON request bodies ``{"fen", "elo_min", "elo_max"}`` -> the request frame.

    Bounds become integer text where the service would take them: a JSON number
    loses its fraction, a boolean is 0 or 1, text stays text; an explicit null
    is not the default but an ``invalid_range``.  A missing bound is null (the
    default).  A body that is no JSON object has no fen.
    """
    body = F.try_parse_json(F.col(col))

    def bound(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant"))
        value = lambda t: F.try_variant_get(body, f"$.{name}", t)
        whole = F.when(value("double") < 0, F.ceil(value("double"))).otherwise(F.floor(value("double")))
        return (F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), whole.cast("string"))
                .when(kind == "BOOLEAN", value("boolean").cast("int").cast("string"))
                .when(kind == "VOID", F.lit("null")).otherwise(value("string")).alias(name))

    return df.select(F.col(id_col).cast("long").alias("request_id"), F.try_variant_get(body, "$.fen", "string").alias("fen"),
                     bound("elo_min"), bound("elo_max"))


def responses_to_json(responses: DataFrame) -> DataFrame:
    """``as_responses`` rows -> (request_id, body) with ``{move, alternatives}`` or ``{error}``."""
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(
        F.to_json(F.struct("move", "alternatives")))
    return responses.select("request_id", body.alias("body"))


def as_responses(recs: DataFrame) -> DataFrame:
    """Long form -> one row per request: best move plus up to k alternatives."""
    alt = F.struct("rank", "move_san", display_share("percentage").alias("likelihood"))
    return (recs.groupBy("request_id")
            .agg(F.first("error", ignorenulls=True).alias("error"),
                 F.sort_array(F.collect_list(F.when(F.col("move_san").isNotNull(), alt))).alias("alternatives"))
            .select("request_id", "error", F.try_element_at("alternatives", F.lit(1))["move_san"].alias("move"),
                    F.transform("alternatives", lambda a: F.struct(a["move_san"].alias("move"),
                                                                   a["likelihood"].alias("likelihood")))
                    .alias("alternatives")))


def top_moves(counts: DataFrame, fen: str, elo_min: int | None = DEFAULT_ELO_MIN,
              elo_max: int | None = DEFAULT_ELO_MAX, k: int = TOP_K, *, normalise: bool = True) -> DataFrame:
    """Single lookup (a bound of None is open): the position filter reaches the Parquet scan (row groups of
    the sorted table are skipped by min/max), then plays per move, top ``k``
    and each move's share of all moves played there, in one pass."""
    key = normalise_fen(fen) if normalise else fen
    hits = counts.filter(F.col("base_fen") == F.lit(key)).withColumnRenamed("times_played", "plays")
    hits = hits if elo_min is None else hits.filter(F.col("player_elo_bucket") >= elo_min)
    hits = hits if elo_max is None else hits.filter(F.col("player_elo_bucket") <= elo_max)
    # At most k rows: ordering them in one partition avoids a sampled range sort.
    return (top_k_share(hits, ["base_fen"], "move_san", "plays", k, keep_zero=False)
            .coalesce(1).sortWithinPartitions("rank").select("move_san", "plays", "percentage"))
