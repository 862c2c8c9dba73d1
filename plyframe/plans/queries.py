"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Family G runs the generic operators on the driver tables; family P runs the
game pipeline on archive text synthesised from ``orders`` (see ``synth``).
Every query reads whole tables; queries that write go under the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.functions.columns import (STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT, bucket, clean_event,
                                        parse_rating, tokens)
from plyframe.functions.replay import normalise_fen_udf, sequence_fen_udf
from plyframe.operators.counts import (compare_extractions, count_moves, merge_counts, most_played,
                                       sequence_steps, top_k_share)
from plyframe.operators.extract import (extract_positions, replay_errors, token_differences, token_report,
                                        tokenize_moves)
from plyframe.operators.qualify import filter_report, limit_games, qualify_games
from plyframe.operators.recommend import (as_responses, recommend, recommend_sorted, recommend_view, requests_from_json,
                                          top_moves, validate_requests)
from plyframe.plans import synth
from plyframe.session import scratch_path
from plyframe.sources.archive import parse_games, read_frame_records, read_games
from plyframe.sources.linewise import read_games_linewise
from plyframe.schemas import COUNTERS
from plyframe.sources.sorted_table import head_of, row_at_index, write_sorted
from plyframe.sources.storage import (committed_covers, compact_month, counts_view, merge_months, read_counts, read_merged,
                                      read_monthly, read_positions, write_bucketed_counts, write_month, write_positions)
from plyframe.sources.zstd_frames import write_frames
from plyframe.streaming.ingest import (MAX_MONTHS_PER_RUN, add_to_ledger, ingest, ingest_stream, ledger_union, list_links,
                                       load_ledger, pending_months)

ORDER_KEYS = ("o_orderpriority", "price_bucket", "o_orderstatus")
LEDGER_BEFORE = "1998-01"  # months before this count as already processed
LIMIT_GAMES = 100
ONE_BUCKET = 100_000
REPLACED_MONTH, COMPACTED_MONTH, EMPTIED_MONTH = "1995-03", "1996-07", "1994-11"
WIDEST = (1 << 63) - 1
# JSON bounds by o_orderkey % 8 ("" leaves the bound out).
BODY_BOUNDS = ["", "1500", "99999999999", "1400.9", "null", '"1200"', '"12.5"', "true"]
POSITION_FILE_ROWS = 5_000  # small cap so the round trip spans many files
SORTED_FILE_ROWS = 10_000  # likewise for the sorted table's files
FRAME_BYTES = 64 << 10  # small frames so the archives have many
EMPTY_YEAR = "1995"  # the archive whose games are all excluded
ROW_INDEX = 35
HEAD_ROWS = 10
PAGE_LINK_PATTERN = r'href="(/[^"]+)"'
PAGE_BASE_URL = "https://example.org/"

# FEN inputs for the normalisation query, chosen by o_orderkey % 6.
NORMALISE_INPUTS = [
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1",
    "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3",
    "r3k2r/8/8/8/8/8/8/4K3 w KQkq - 0 1",
    "not a fen",
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -",
    "",
]
# Lookup request inputs, fen by o_orderkey % 5, elo_min by o_orderkey % 3.
REQUEST_FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1",
    None,
    "garbage",
    "8/8/8/8/8/8/8/K6k w - - 0 1",
]
REQUEST_ELO_MIN = [None, "1000", "abc"]
EXPLORE_FEN = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
EXPLORE_RANGE = (1400, 1600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, index):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


# ----------------------------------------------------------------- family G
def _order_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderpriority", bucket("o_totalprice", 10000).alias("price_bucket"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM").alias("month"))


def bucket_counts(spark, sf_dir):
    return count_moves(_order_rows(spark, sf_dir), keys=ORDER_KEYS)


_ORDER_COUNTS = T.StructType([T.StructField("o_orderpriority", T.StringType()),
                              T.StructField("o_orderstatus", T.StringType()),
                              T.StructField("times_played", T.LongType()),
                              T.StructField("price_bucket", T.LongType())])


def bucket_partition_filter(spark, sf_dir):
    """Counts written one directory per bucket; one bucket read back (only its directory is listed)."""
    path = scratch_path(spark, "bucketed")
    write_bucketed_counts(bucket_counts(spark, sf_dir), path, "price_bucket")
    one = spark.read.schema(_ORDER_COUNTS).parquet(path).filter(F.col("price_bucket") == ONE_BUCKET)
    return one.select(*ORDER_KEYS, "times_played")


def _order_months(spark, sf_dir):
    """Monthly counts of orders in the store's columns."""
    rows = _order_rows(spark, sf_dir).select(
        "month", F.col("o_orderpriority").alias("base_fen"), F.col("price_bucket").alias("player_elo_bucket"),
        F.col("o_orderstatus").alias("move_san"))
    return count_moves(rows, keys=("month", "base_fen", "player_elo_bucket", "move_san"))


def _as_orders(counts):
    return counts.select(F.col("base_fen").alias("o_orderpriority"), F.col("player_elo_bucket").alias("price_bucket"),
                         F.col("move_san").alias("o_orderstatus"), "times_played")


def monthly_counts_merge(spark, sf_dir):
    """Every month loaded into the store, then merged across months."""
    root, merged = scratch_path(spark, "monthly"), scratch_path(spark, "monthly-merged")
    write_month(_order_months(spark, sf_dir), root)
    merge_months(spark, root, merged)
    return _as_orders(read_merged(spark, merged))


def month_replace(spark, sf_dir):
    """Months loaded in two parts and merged; then one of them loaded again with other rows, one
    compacted and one emptied: the view is what a recount of the last loads gives."""
    root, merged = scratch_path(spark, "replace"), scratch_path(spark, "replace-merged")
    months = _order_months(spark, sf_dir)
    for part, rest in (("a", 0), ("b", 1)):
        write_month(months.filter(F.pmod(F.col("player_elo_bucket"), F.lit(20000)) == rest * 10000), root, part=part)
    merge_months(spark, root, merged)
    again = months.filter(F.col("month") == REPLACED_MONTH).withColumn("times_played", F.col("times_played") * 10)
    write_month(again, root, REPLACED_MONTH)
    compact_month(spark, root, COMPACTED_MONTH)
    write_month(months.limit(0), root, EMPTIED_MONTH)
    return _as_orders(merge_counts(counts_view(spark, merged, root)))


def archive_codecs(spark, sf_dir):
    """Archive text written plain, as bzip2 and as gzip, read back as games by one call."""
    root = scratch_path(spark, "codecs")
    records = synth.archive_records(table(spark, sf_dir, "orders"))
    for i, codec in enumerate(("none", "bzip2", "gzip")):
        records.filter(F.col("game_key") % 3 == i).select("value").write.option("compression", codec).text(f"{root}/{codec}")
    g = read_games(spark, [f"{root}/none", f"{root}/bzip2", f"{root}/gzip"])
    return _tags_of(g)


def archive_frames(spark, sf_dir):
    """Archive text written as Zstandard archives of many frames and read by frames, many tasks an archive."""
    path = scratch_path(spark, "frames")
    records = synth.archive_records(table(spark, sf_dir, "orders"))
    write_frames(records.select("value"), path, frame_bytes=FRAME_BYTES)
    records = read_frame_records(spark, path, partition_bytes=2 * FRAME_BYTES)
    return _tags_of(parse_games(records.select("value")))


def _tags_of(g):
    h = F.col("headers")
    tag = lambda k: F.try_element_at(h, F.lit(k))
    return g.select(F.substring_index(tag("Site"), "/", -1).alias("game_id"), tag("Event").alias("event"),
                    tag("WhiteElo").alias("white_elo"), tag("BlackElo").alias("black_elo"),
                    tag("Termination").alias("termination"), tag("FEN").alias("fen"), "movetext")


def linewise_turns(spark, sf_dir):
    """Every conversation turn as a game of an archive without separators: tags in another order, no Event, no blank
    lines, the turn's own text as movetext; read line by line, back to one row a turn."""
    path = scratch_path(spark, "linewise-turns")
    conv = table(spark, sf_dir, "conversations")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " ")
    tag = lambda k, v: F.concat(F.lit(f'[{k} "'), v.cast("string"), F.lit('"]'))
    conv.select(F.concat_ws("\n", tag("Turn", F.col("turn")), tag("Role", F.coalesce("role", F.lit(""))),
                            tag("Conv", F.col("conv_id")), F.concat(F.lit("1. "), text))).write.text(path)
    g = read_games_linewise(spark, path)
    tag = lambda k: F.try_element_at("headers", F.lit(k))
    return g.select(tag("Conv").cast("long").alias("conv_id"), tag("Turn").cast("long").alias("turn"), tag("Role").alias("role"),
                    F.size(F.map_keys("headers")).alias("tags"), "movetext")


def turn_tokens(spark, sf_dir):
    """The strict tokenizer's four removals and the lenient word pattern on the varied text of conversation turns: how
    many turns hold comments, move numbers, marks or move-like words, by role."""
    conv = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    stripped = text
    for pattern in (STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT):
        stripped = F.regexp_replace(stripped, pattern, " ")
    words = F.filter(F.split(stripped, r"[ \t\n\r\f\x0b]+"), lambda w: w != F.lit(""))
    shaped = F.filter(words, lambda w: w.rlike(r"^[a-h][1-8]$|^[NBRQK][a-h][1-8]$"))
    return conv.select("role", F.size(words).cast("long").alias("w"), F.size(shaped).cast("long").alias("m"),
                       F.length(stripped).cast("long").alias("c")).groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("w").alias("words"), F.sum("m").alias("move_words"), F.sum("c").alias("characters"))


def token_delta(spark, sf_dir):
    """Per game and in one pass, where the strict tokenizer's moves leave the lenient ones."""
    return token_differences(qualify_games(pgn_games(spark, sf_dir))).select(
        "game_id", "tokens_a", "tokens_b", "same", "first_difference", "token_a", "token_b")


def token_delta_report(spark, sf_dir):
    return token_report(token_differences(qualify_games(pgn_games(spark, sf_dir))))


def display_rounding(spark, sf_dir):
    """The best next event of each event type as a response: shares with one decimal."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    requests = types.select(F.xxhash64("event_type").alias("request_id"), F.col("event_type").alias("fen"),
                            F.lit(None).cast("string").alias("elo_min"), F.lit(str(WIDEST)).alias("elo_max"))
    answers = as_responses(recommend(requests, event_counts(spark, sf_dir), key_is_fen=False))
    return (requests.join(answers, "request_id").select("fen", "move", F.posexplode("alternatives").alias("pos", "a"))
            .select("fen", "move", "pos", F.col("a.move").alias("alternative"), F.col("a.likelihood").alias("likelihood")))


def request_bodies(spark, sf_dir):
    """JSON request bodies of every kind of bound, validated."""
    o = table(spark, sf_dir, "orders")
    bound = _pick(BODY_BOUNDS, F.col("o_orderkey") % len(BODY_BOUNDS))
    body = F.concat(F.lit('{"fen": "'), F.col("o_orderpriority"), F.lit('"'),
                    F.when(bound != "", F.concat(F.lit(', "elo_max": '), bound)).otherwise(""), F.lit("}"))
    rows = requests_from_json(o.select(F.col("o_orderkey").alias("request_id"), body.alias("body")))
    v = validate_requests(rows, key_is_fen=False)
    return v.select("request_id", "key_fen", "lo", "hi", "error")


def lineitem_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return count_moves(li.select(F.col("l_partkey").cast("string").alias("base_fen"),
                                 bucket("l_quantity", 10).alias("player_elo_bucket"),
                                 F.col("l_suppkey").cast("string").alias("move_san")))


def _part_requests(spark, sf_dir):
    lo = (F.col("p_size") % 5) * 10
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"), F.col("p_partkey").cast("string").alias("fen"),
        lo.cast("string").alias("elo_min"), (lo + 20).cast("string").alias("elo_max"))


def merged_sorted_lookup(spark, sf_dir):
    """Counts merged into one position-sorted table, then a batch of lookups against it."""
    path = scratch_path(spark, "merged")
    write_sorted(lineitem_counts(spark, sf_dir), path, index=False)  # every part is asked for
    return recommend(_part_requests(spark, sf_dir), read_counts(spark, path), key_is_fen=False, stored=True)


def indexed_lookup(spark, sf_dir):
    """A few requests (one a nation) against the indexed sorted table: the files that can hold their positions are opened."""
    path = scratch_path(spark, "indexed")
    write_sorted(lineitem_counts(spark, sf_dir), path, max_records=SORTED_FILE_ROWS)
    requests = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("request_id"), F.col("n_nationkey").cast("string").alias("fen"),
        (F.col("n_regionkey") * 10).cast("string").alias("elo_min"), F.lit(None).cast("string").alias("elo_max"))
    return recommend_sorted(requests, path, key_is_fen=False)


def view_lookup(spark, sf_dir):
    """Line items loaded by ship year and merged year by year; one year then loaded again with half its items and
    one after the last merge: requests (one a part) answered from the merged runs, what came since and what was taken back."""
    root, merged = scratch_path(spark, "lookup-months"), scratch_path(spark, "lookup-merged")
    li = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("month"), F.col("l_partkey").cast("string").alias("base_fen"),
        bucket("l_quantity", 10).alias("player_elo_bucket"), F.col("l_suppkey").cast("string").alias("move_san"), "l_linenumber")
    keys = ("month", "base_fen", "player_elo_bucket", "move_san")
    for span in (("1992", "1993"), ("1994", "1994"), ("1995", "1995")):
        write_month(count_moves(li.filter(F.col("month").between(*span)), keys=keys), root)
        merge_months(spark, root, merged)
    write_month(count_moves(li.filter("month = '1994' and l_linenumber % 2 = 0"), keys=keys), root)
    write_month(count_moves(li.filter("month > '1995'"), keys=keys), root)
    return recommend_view(_part_requests(spark, sf_dir), merged, root, key_is_fen=False)


def most_played_row(spark, sf_dir):
    return most_played(lineitem_counts(spark, sf_dir))


def _event_steps(spark, sf_dir, context_len=1):
    ev = table(spark, sf_dir, "events")
    return sequence_steps(ev, "user_id", ["ts", "event_id"], "event_type", context_len=context_len)


def event_counts(spark, sf_dir):
    steps = _event_steps(spark, sf_dir)
    return count_moves(steps.select(F.col("context").alias("base_fen"),
                                    bucket("value", 25).alias("player_elo_bucket"),
                                    F.col("event_type").alias("move_san")))


def top5_share_single(spark, sf_dir):
    return top_moves(event_counts(spark, sf_dir), "click", None, None, normalise=False)


def top5_share_batch(spark, sf_dir):
    """One request per event (hot keys: five types), answered against event transitions."""
    ev = table(spark, sf_dir, "events")
    requests = ev.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("fen"),
                         F.lit("0").alias("elo_min"), bucket("value", 25).cast("string").alias("elo_max"))
    return recommend(requests, event_counts(spark, sf_dir), key_is_fen=False)


def event_transitions(spark, sf_dir):
    steps = _event_steps(spark, sf_dir, context_len=2)
    return count_moves(steps.select("context", bucket("value", 25).alias("value_bucket"),
                                    F.col("event_type").alias("item")),
                       keys=("context", "value_bucket", "item"))


def conversation_transitions(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    steps = sequence_steps(conv, "conv_id", "turn", "role", context_len=1)
    return count_moves(steps.select("context", F.col("role").alias("item")), keys=("context", "item"))


def list_page_links(spark, sf_dir):
    return list_links(table(spark, sf_dir, "pages"), "html", PAGE_LINK_PATTERN, PAGE_BASE_URL,
                      path_group=1, key_group=1, key_name="path")


def _available_months(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    path = F.concat(F.lit("standard/games_rated_"), F.col("year_month"), F.lit(".pgn.zst"))
    pages = months.distinct().select(F.concat(F.lit('<a href="'), path, F.lit('">x</a>')).alias("html"))
    return list_links(pages)


def _ledger(available):
    return available.filter(F.col("year_month") < LEDGER_BEFORE).select("year_month")


def pending_months_q(spark, sf_dir):
    available = _available_months(spark, sf_dir)
    return pending_months(available, _ledger(available), MAX_MONTHS_PER_RUN)


def stored_ledger(spark, sf_dir):
    """Every order month through the store's commit log: months of even years as loads (data and ledger in one
    entry each year), the others added without data, the first half of them twice; what the log then says is processed."""
    root = scratch_path(spark, "ledger")
    months = _order_months(spark, sf_dir)
    year = F.substring("month", 1, 4).cast("int")
    names = months.select(F.col("month").alias("year_month")).distinct()
    for y in sorted(r[0] for r in months.filter(year % 2 == 0).select(year).distinct().collect()):
        own = months.filter(year == y)
        write_month(own, root, processed=[r[0] for r in own.select("month").distinct().collect()])
    odd = names.filter(F.substring("year_month", 1, 4).cast("int") % 2 == 1)
    for part in (odd.filter("year_month < '1996'"), odd):
        add_to_ledger(spark, root, part)
    return load_ledger(spark, root)


def ledger_add(spark, sf_dir):
    available = _available_months(spark, sf_dir)
    ledger = _ledger(available)
    return ledger_union(ledger, pending_months(available, ledger, MAX_MONTHS_PER_RUN))


# ----------------------------------------------------------------- family P
def pgn_games(spark, sf_dir):
    return synth.synth_games(spark, sf_dir)


def pgn_positions(spark, sf_dir, mode="lenient"):
    return extract_positions(qualify_games(pgn_games(spark, sf_dir)), mode=mode)


def pgn_counts(spark, sf_dir):
    return count_moves(pgn_positions(spark, sf_dir))


def header_map(spark, sf_dir):
    g = pgn_games(spark, sf_dir)
    h = F.col("headers")
    return g.select("game_id", F.try_element_at(h, F.lit("Event")).alias("event"),
                    F.try_element_at(h, F.lit("WhiteElo")).alias("white_elo"),
                    F.try_element_at(h, F.lit("BlackElo")).alias("black_elo"),
                    F.try_element_at(h, F.lit("Termination")).alias("termination"),
                    F.try_element_at(h, F.lit("FEN")).alias("fen"), "movetext")


def quality_filter_reasons(spark, sf_dir):
    return filter_report(pgn_games(spark, sf_dir))


def _rating_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    digits = (F.lit(400) + (F.col("o_custkey") * 7) % 2600).cast("string")
    k = F.col("o_orderkey") % 7
    text = (F.when(k == 0, digits).when(k == 1, F.lit("?")).when(k == 2, F.lit(""))
            .when(k == 3, F.concat(digits, F.lit("?"))).when(k == 4, F.concat(F.lit("-"), digits))
            .when(k == 5, F.concat(F.lit(" "), digits)).otherwise(F.concat(F.lit("0"), digits)))
    return o.select("o_orderkey", text.alias("rating_text"))


def rating_parse(spark, sf_dir):
    return _rating_texts(spark, sf_dir).select("o_orderkey", "rating_text",
                                               parse_rating("rating_text").alias("rating"))


def clean_event_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.select(clean_event(synth.raw_event()).alias("event"))
            .groupBy("event").agg(F.count(F.lit(1)).alias("games")))


def limit_qualifying(spark, sf_dir):
    q = qualify_games(pgn_games(spark, sf_dir))
    return limit_games(q, LIMIT_GAMES).select("game_id", "event", "white_elo", "black_elo")


def move_tokens(spark, sf_dir):
    g = pgn_games(spark, sf_dir)
    both = F.array(*[F.struct(F.lit(m).alias("mode"), tokens("movetext", m).alias("tokens")) for m in ("lenient", "strict")])
    one = g.select("game_id", F.explode(both).alias("t"))
    return one.select("game_id", "t.mode", F.posexplode("t.tokens").alias("idx", "token"))


def game_positions(spark, sf_dir):
    return pgn_positions(spark, sf_dir)


def replay_quarantine(spark, sf_dir):
    return replay_errors(qualify_games(pgn_games(spark, sf_dir)))


def opening_steps(spark, sf_dir):
    """Every move of every qualifying game with the moves before it as context (first 40 plies): tokens only."""
    g = tokenize_moves(qualify_games(pgn_games(spark, sf_dir))).select(F.array_join("tokens", " ").alias("line"), F.posexplode("tokens").alias("ply", "move_san"))
    return g.select(F.when(F.col("ply") == 0, F.lit("^")).otherwise(F.expr("substring_index(line, ' ', ply)")).alias("context"), "move_san")


def pgn_flagship(spark, sf_dir):
    """Opening book: after every sequence of moves, the top five next moves with
    their share of all moves played there.  Archive text to answer without Python."""
    # Straight from the steps: top_k_share counts per (context, move) with
    # map-side combining, so no separate count stage (and its shuffle) is needed.
    stats = opening_steps(spark, sf_dir).withColumn("plays", F.lit(1).cast("long"))
    return top_k_share(stats, ["context"], "move_san", "plays", 5).select(
        "context", "rank", "move_san", "plays", "percentage")


def position_explore(spark, sf_dir):
    """Single lookup with the exploration range (buckets inclusive)."""
    return top_moves(pgn_counts(spark, sf_dir), EXPLORE_FEN, *EXPLORE_RANGE)


def sequence_final_fen(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 5).cast("int")
    toks = tokens(_pick(synth.MOVETEXT, synth.line_id()), "lenient")
    moves = F.array_join(F.slice(toks, 1, n), " ")
    df = o.select(F.col("o_orderkey").cast("string").alias("game_id"), moves.alias("moves"))
    return df.select("game_id", "moves", sequence_fen_udf("moves").alias("r")).select(
        "game_id", "moves", "r.fen", "r.error")


def fen_normalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", _pick(NORMALISE_INPUTS, F.col("o_orderkey") % 6).alias("input_fen"))
    return df.select("o_orderkey", "input_fen", normalise_fen_udf("input_fen").alias("r")).select(
        "o_orderkey", "input_fen", F.col("r.fen").alias("base_fen"), F.col("r.error").alias("error"))


def request_errors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"),
                        _pick(REQUEST_FENS, F.col("o_orderkey") % 5).alias("fen"),
                        _pick(REQUEST_ELO_MIN, F.col("o_orderkey") % 3).alias("elo_min"),
                        F.lit(None).cast("string").alias("elo_max"))
    return recommend(requests, pgn_counts(spark, sf_dir))


def extraction_delta(spark, sf_dir):
    games = qualify_games(pgn_games(spark, sf_dir))
    return compare_extractions(extract_positions(games, mode="strict"), extract_positions(games))


def positions_roundtrip(spark, sf_dir):
    """Positions (events after their predecessor) written as bounded files, read back, counted."""
    path = scratch_path(spark, "positions")
    rows = _event_steps(spark, sf_dir).select(
        F.concat(F.lit("user "), "user_id").alias("event"), bucket("value", 25).alias("player_elo_bucket"),
        F.col("context").alias("base_fen"), F.col("event_type").alias("move_san"))
    write_positions(rows, path, max_records=POSITION_FILE_ROWS)
    return count_moves(read_positions(spark, path))


def counts_view_months(spark, sf_dir):
    """Months before 1998 loaded and merged; later months loaded after the merge; the
    lookup view (merged UNION ALL newer months) sums to the full count."""
    months = _order_months(spark, sf_dir)
    root, merged = scratch_path(spark, "view-monthly"), scratch_path(spark, "view-merged")
    write_month(months.filter(F.col("month") < LEDGER_BEFORE), root)
    merge_months(spark, root, merged)
    write_month(months.filter(F.col("month") >= LEDGER_BEFORE), root)
    return _as_orders(merge_counts(counts_view(spark, merged, root)))


def sorted_row_at(spark, sf_dir):
    """Positional access on a table sorted by position (row 35 in key order): one file is opened."""
    path = scratch_path(spark, "row-at")
    write_sorted(lineitem_counts(spark, sf_dir), path, max_records=SORTED_FILE_ROWS)
    return row_at_index(spark, path, ROW_INDEX)


def sorted_head(spark, sf_dir):
    """The first ten rows of a table sorted by position."""
    path = scratch_path(spark, "sorted-head")
    write_sorted(lineitem_counts(spark, sf_dir), path, max_records=SORTED_FILE_ROWS)
    return head_of(spark, path, HEAD_ROWS)


def incremental_equals_batch(spark, sf_dir):
    """Archive text written as files under month= folders, ingested by the
    streaming path twice (the second run finds nothing new), merged: equals a
    full recount."""
    src = scratch_path(spark, "archive")
    records = synth.archive_records(table(spark, sf_dir, "orders"))
    records.select("value", "month").write.partitionBy("month").text(src)
    monthly = scratch_path(spark, "monthly-counts")
    ckpt = scratch_path(spark, "ingest-ckpt")
    for _ in range(2):
        ingest_stream(spark, src, monthly, ckpt, path_glob="month=*/*.txt", max_files_per_trigger=40)
    return merge_counts(read_monthly(spark, monthly).drop("month", "part"))


def ingest_empty_month(spark, sf_dir):
    """Yearly archives, one of them with excluded games only, through the batch path and through the stream: every
    archive is committed with its games scanned, kept and rejected by reason, the empty one too."""
    src = scratch_path(spark, "empty-archives")
    orders = table(spark, sf_dir, "orders")
    records = synth.archive_records(orders).select(
        F.concat(F.substring("month", 1, 4), F.lit("-01")).alias("month"), "value")
    barred = F.regexp_replace("value", r'^\[Event "[^"]*"\]', '[Event "Rated Bullet game"]')
    (records.select("month", F.when(F.col("month").startswith(EMPTY_YEAR), barred).otherwise(F.col("value")).alias("value"))
     .repartition("month").write.partitionBy("month").text(src))
    out = []
    months = sorted(r[0] for r in records.select("month").distinct().collect())
    batch, stream = scratch_path(spark, "empty-batch"), scratch_path(spark, "empty-stream")
    archives = spark.createDataFrame([(m, f"{src}/month={m}") for m in months], "year_month string, path string")
    report = ingest(spark, archives, batch)
    out.append(report.select(F.lit("batch").alias("path"), F.col("year_month").alias("month"), F.col("games_scanned").alias("scanned"),
                             F.col("games_kept").alias("kept"), *[F.col(f"rejected_{c}").alias(c) for c in COUNTERS[2:]]))
    ingest_stream(spark, src, stream, scratch_path(spark, "empty-ckpt"), path_glob="month=*/*.txt", max_files_per_trigger=4)
    covers = committed_covers(spark, stream)
    out.append(covers.groupBy(F.lit("stream").alias("path"), "month").agg(*[F.sum(c).alias(c) for c in COUNTERS]))
    return out[0].unionByName(out[1])


QUERIES = {
    "indexed_lookup": indexed_lookup,
    "view_lookup": view_lookup,
    "stored_ledger": stored_ledger,
    "ingest_empty_month": ingest_empty_month,
    "archive_frames": archive_frames,
    "linewise_turns": linewise_turns,
    "turn_tokens": turn_tokens,
    "token_delta": token_delta,
    "token_delta_report": token_delta_report,
    "bucket_counts": bucket_counts,
    "bucket_partition_filter": bucket_partition_filter,
    "monthly_counts_merge": monthly_counts_merge,
    "month_replace": month_replace,
    "archive_codecs": archive_codecs,
    "display_rounding": display_rounding,
    "request_bodies": request_bodies,
    "merged_sorted_lookup": merged_sorted_lookup,
    "top5_share_single": top5_share_single,
    "top5_share_batch": top5_share_batch,
    "most_played": most_played_row,
    "event_transitions": event_transitions,
    "conversation_transitions": conversation_transitions,
    "quality_filter_reasons": quality_filter_reasons,
    "rating_parse": rating_parse,
    "clean_event": clean_event_q,
    "header_map": header_map,
    "limit_qualifying": limit_qualifying,
    "move_tokens": move_tokens,
    "game_positions": game_positions,
    "replay_quarantine": replay_quarantine,
    "pgn_flagship": pgn_flagship,
    "position_explore": position_explore,
    "sequence_final_fen": sequence_final_fen,
    "fen_normalise": fen_normalise,
    "request_errors": request_errors,
    "list_months": list_page_links,
    "pending_months": pending_months_q,
    "ledger_add": ledger_add,
    "incremental_equals_batch": incremental_equals_batch,
    "positions_roundtrip": positions_roundtrip,
    "counts_view_months": counts_view_months,
    "sorted_row_at": sorted_row_at,
    "sorted_head": sorted_head,
    "extraction_delta": extraction_delta,
}
