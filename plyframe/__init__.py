"""plyframe: game-record analytics as Spark DataFrame / SQL / Streaming jobs.

Typical flow::

    games = qualify_games(read_games(spark, "archives/*.pgn.zst"))
    counts = count_moves(extract_positions(games))
    answers = recommend(requests, counts)
"""

from plyframe.functions.columns import bucket, clean_event, parse_rating, tokens
from plyframe.functions.sql import register_sql_functions
from plyframe.operators.counts import (compare_extractions, count_moves, merge_counts, most_played,
                                       next_item_stats, sequence_steps, top_k_share)
from plyframe.operators.extract import (extract_positions, replay_errors, token_differences, token_report,
                                        tokenize_moves)
from plyframe.operators.metrics import observe_games, observe_positions
from plyframe.operators.qualify import filter_report, limit_games, qualify_games
from plyframe.operators.recommend import (as_responses, display_share, recommend, recommend_sorted, recommend_view,
                                          requests_from_json, responses_to_json, top_moves, validate_requests)
from plyframe.operators.steps import extract_steps, read_line, unreadable_games
from plyframe.sources.archive import parse_games, read_frame_records, read_games, read_records
from plyframe.sources.linewise import read_games_linewise
from plyframe.sources.sorted_table import build_index, head_of, read_for, row_at_index, write_sorted
from plyframe.sources.storage import (compact_month, compact_small, counts_view, merge_months, read_counts, read_merged,
                                      read_monthly, read_positions, vacuum, write_bucketed_counts, write_month,
                                      write_positions)
from plyframe.sources.zstd_frames import write_frames
from plyframe.streaming.ingest import (add_to_ledger, ingest, ingest_stream, list_links, list_months, load_ledger,
                                       pending_months, stream_progress, update_months)

__all__ = [
    "add_to_ledger", "as_responses", "bucket", "build_index", "clean_event", "compact_month", "compact_small",
    "compare_extractions", "count_moves", "counts_view", "display_share", "extract_positions", "extract_steps",
    "filter_report", "head_of", "ingest", "ingest_stream", "limit_games", "list_links", "list_months", "load_ledger",
    "merge_counts", "merge_months", "most_played", "next_item_stats", "observe_games", "observe_positions",
    "parse_games", "parse_rating", "pending_months", "qualify_games", "read_counts", "read_for", "read_frame_records",
    "read_games", "read_games_linewise", "read_line", "read_merged", "read_monthly", "read_positions", "read_records",
    "recommend", "recommend_sorted", "recommend_view", "register_sql_functions", "replay_errors",
    "requests_from_json", "responses_to_json", "row_at_index", "sequence_steps", "stream_progress",
    "token_differences", "token_report", "tokenize_moves", "tokens", "top_k_share", "top_moves", "unreadable_games",
    "update_months", "vacuum", "validate_requests", "write_bucketed_counts", "write_frames", "write_month",
    "write_positions", "write_sorted",
]
