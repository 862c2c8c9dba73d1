"""Independent SQL (DuckDB dialect) for every registered query.

The pipeline queries do not replay moves here: the synthesised games are
rebuilt from the same integer rules and joined to the hand-checked golden
rows, so the replay job is checked against fixed expectations.
"""

from __future__ import annotations

from plyframe.functions.columns import (BAD_TERMINATIONS, STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT)
from plyframe.plans import golden, synth
from plyframe.plans.queries import (EXPLORE_RANGE, LEDGER_BEFORE, LIMIT_GAMES, NORMALISE_INPUTS,
                                    PAGE_BASE_URL)
from plyframe.streaming.ingest import ARCHIVE_BASE_URL, MAX_MONTHS_PER_RUN


def _q(s):
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _case(expr, values):
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


_BAD_TERMS = ", ".join(_q(t) for t in BAD_TERMINATIONS)
_TERMS = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in synth.TERMINATIONS.items())

GAMES_CTE = f"""
games AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS game_id, CAST(o_orderkey % 8 AS INTEGER) AS line_id,
         {_case('o_orderkey % 5', synth.EVENTS)} AS raw_event,
         CASE o_orderstatus {_TERMS} END AS termination,
         CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE CAST(400 + (o_custkey * 7) % 2600 AS VARCHAR) END AS white_text,
         CAST(400 + (o_orderkey * 13) % 2600 AS VARCHAR) AS black_text,
         strftime(o_orderdate, '%Y-%m') AS month
  FROM orders),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(white_text, '[0-9]+') THEN CAST(white_text AS INTEGER) ELSE 0 END AS white_elo,
            CASE WHEN regexp_full_match(black_text, '[0-9]+') THEN CAST(black_text AS INTEGER) ELSE 0 END AS black_elo,
            split_part(raw_event, ' https://', 1) AS event
  FROM games),
judged AS (
  SELECT *, CASE WHEN contains(raw_event, 'Bullet') THEN 'bullet'
                 WHEN COALESCE(termination, '') IN ({_BAD_TERMS}) THEN 'termination'
                 WHEN NOT (white_elo > 600 AND black_elo > 600) THEN 'rating' END AS reject_reason
  FROM parsed),
qualified AS (SELECT * FROM judged WHERE reject_reason IS NULL)"""


def _golden_cte(strict: bool = False) -> str:
    rows = ", ".join(f"({l}, {p}, {_q(f)}, {_q(m)})" for l, p, f, m in golden.GOLDEN)
    line4 = "" if strict else "UNION ALL SELECT 4, ply, base_fen, move_san FROM g0 WHERE line_id = 0 AND ply < 4"
    return f"""
g0(line_id, ply, base_fen, move_san) AS (VALUES {rows}),
golden AS (
  SELECT line_id, ply, base_fen, move_san FROM g0 WHERE line_id IN (0, 1, 2, 3, 6)
  {line4}
  UNION ALL SELECT 5, ply, base_fen, move_san FROM g0 WHERE line_id = 0 AND ply < 2
  UNION ALL SELECT 7, CAST(r.i AS INTEGER), base_fen, move_san FROM g0 JOIN range(40) r(i)
            ON g0.line_id = 7 AND g0.ply = r.i % 4)"""


def _positions_sql(strict: bool = False) -> str:
    return f"""WITH {GAMES_CTE},{_golden_cte(strict)},
positions AS (
  SELECT q.game_id, CAST(g.ply AS INTEGER) AS ply, q.event,
         CAST(FLOOR(CASE WHEN g.ply % 2 = 0 THEN q.white_elo ELSE q.black_elo END / 100.0) * 100 AS BIGINT)
           AS player_elo_bucket, g.base_fen, g.move_san
  FROM qualified q JOIN golden g ON q.line_id = g.line_id)"""


_COUNTS_SQL = _positions_sql() + """,
counts AS (SELECT base_fen, player_elo_bucket, move_san, COUNT(*) AS times_played
           FROM positions GROUP BY base_fen, player_elo_bucket, move_san)"""

_ORDER_COUNTS = """SELECT o_orderpriority, CAST(FLOOR(o_totalprice / 10000.0) * 10000 AS BIGINT) AS price_bucket,
       o_orderstatus, COUNT(*) AS times_played
FROM orders GROUP BY ALL"""

_LINEITEM_COUNTS = """lcounts AS (
  SELECT CAST(l_partkey AS VARCHAR) AS base_fen, CAST(FLOOR(l_quantity / 10.0) * 10 AS BIGINT) AS player_elo_bucket,
         CAST(l_suppkey AS VARCHAR) AS move_san, COUNT(*) AS times_played
  FROM lineitem GROUP BY ALL)"""

_EVENT_STEPS = """esteps AS (
  SELECT *, LAG(event_type, 2) OVER (PARTITION BY user_id ORDER BY step) AS l2,
            LAG(event_type, 1) OVER (PARTITION BY user_id ORDER BY step) AS l1
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)),
ecounts AS (
  SELECT COALESCE(l1, '^') AS base_fen, CAST(FLOOR(value / 25.0) * 25 AS BIGINT) AS player_elo_bucket,
         event_type AS move_san, COUNT(*) AS times_played
  FROM esteps GROUP BY ALL)"""


def _recommend_sql(requests_cte: str, counts_name: str, valid_filter: str = "error IS NULL") -> str:
    """Batch lookup over a ``req(request_id, key_fen, lo, hi, error)`` CTE."""
    return f"""{requests_cte},
rkeys AS (SELECT DISTINCT key_fen, lo, hi FROM req WHERE {valid_filter}),
stats AS (
  SELECT k.key_fen, k.lo, k.hi, c.move_san, SUM(c.times_played) AS plays
  FROM rkeys k JOIN {counts_name} c ON c.base_fen = k.key_fen AND c.player_elo_bucket BETWEEN k.lo AND k.hi
  GROUP BY ALL),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY key_fen, lo, hi ORDER BY plays DESC, move_san) AS rk,
            SUM(plays) OVER (PARTITION BY key_fen, lo, hi) AS total
  FROM stats)
SELECT req.request_id, COALESCE(req.error, CASE WHEN t.move_san IS NULL THEN 'not_found' END) AS error,
       CAST(t.rk AS INTEGER) AS rank, t.move_san, CAST(t.plays AS BIGINT) AS plays,
       CAST(t.plays AS DOUBLE) * 100.0 / CAST(t.total AS DOUBLE) AS percentage
FROM req LEFT JOIN (SELECT * FROM ranked WHERE rk <= 5) t
  ON req.key_fen = t.key_fen AND req.lo = t.lo AND req.hi = t.hi"""


def _single_lookup_sql(prefix: str, counts_name: str, key: str, lo: int, hi: int) -> str:
    return f"""{prefix},
m AS (SELECT move_san, SUM(times_played) AS plays FROM {counts_name}
      WHERE base_fen = {_q(key)} AND player_elo_bucket BETWEEN {lo} AND {hi} GROUP BY move_san)
SELECT move_san, CAST(plays AS BIGINT) AS plays,
       CAST(plays AS DOUBLE) * 100.0 / CAST((SELECT SUM(plays) FROM m) AS DOUBLE) AS percentage
FROM m ORDER BY plays DESC, move_san LIMIT 5"""


def _months_cte() -> str:
    return f"""months AS (
  SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS year_month,
         '{ARCHIVE_BASE_URL.rstrip('/')}/' || 'standard/games_rated_' || strftime(o_orderdate, '%Y-%m')
           || '.pgn.zst' AS url
  FROM orders),
ledger AS (SELECT year_month FROM months WHERE year_month < {_q(LEDGER_BEFORE)}),
pending AS (SELECT * FROM months WHERE year_month NOT IN (SELECT year_month FROM ledger)
            ORDER BY year_month LIMIT {MAX_MONTHS_PER_RUN})"""


def _tokens_cte() -> str:
    rows = []
    for mode, table in (("lenient", golden.LENIENT_TOKENS), ("strict", golden.STRICT_TOKENS)):
        for line, toks in table.items():
            rows += [f"({_q(mode)}, {line}, {i}, {_q(t)})" for i, t in enumerate(toks)]
    cycle = ", ".join(_q(t) for t in golden.LINE_7_CYCLE)
    return f"""t0(mode, line_id, idx, token) AS (VALUES {', '.join(rows)}),
toks AS (
  SELECT mode, line_id, idx, token FROM t0
  UNION ALL
  SELECT m.mode, 7, CAST(r.i AS INTEGER), ([{cycle}])[r.i % 4 + 1]
  FROM (VALUES ('lenient'), ('strict')) m(mode), range({golden.LINE_7_TOKENS}) r(i))"""


def _sequence_rows() -> str:
    rows = []
    for line in range(8):
        for n in range(5):
            fen = golden.sequence_fen(line, n)
            err = None if fen is not None else "invalid_move_sequence"
            toks = (golden.LENIENT_TOKENS.get(line) or golden.LINE_7_CYCLE)[:n]
            rows.append(f"({line}, {n}, {_q(' '.join(toks))}, {_q(fen)}, {_q(err)})")
    return ", ".join(rows)


_NORMALISED = [
    ("rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", None),
    ("rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6", None),
    ("r3k2r/8/8/8/8/8/8/4K3 w kq -", None),
    (None, "invalid_fen"),
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -", None),
    (None, "invalid_fen"),
]


def oracle_sql() -> dict[str, str]:
    pos = _positions_sql()
    sql = {}
    sql["bucket_counts"] = _ORDER_COUNTS
    sql["bucket_partition_filter"] = f"SELECT * FROM ({_ORDER_COUNTS}) WHERE price_bucket = 100000"
    sql["month_replace"] = """SELECT o_orderpriority, CAST(FLOOR(o_totalprice / 10000.0) * 10000 AS BIGINT) AS price_bucket,
       o_orderstatus, CAST(SUM(CASE WHEN strftime(o_orderdate, '%Y-%m') = '1995-03' THEN 10 ELSE 1 END) AS BIGINT) AS times_played
FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1994-11' GROUP BY ALL"""
    sql["display_rounding"] = f"""WITH {_EVENT_STEPS},
m AS (SELECT base_fen AS fen, move_san, SUM(times_played) AS plays FROM ecounts
      WHERE base_fen <> '^' AND player_elo_bucket >= 0 GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fen ORDER BY plays DESC, move_san) AS rk,
             SUM(plays) OVER (PARTITION BY fen) AS total FROM m)
SELECT fen, FIRST_VALUE(move_san) OVER (PARTITION BY fen ORDER BY rk) AS move, CAST(rk - 1 AS INTEGER) AS pos,
       move_san AS alternative, round_even(CAST(plays AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 1) AS likelihood
FROM r WHERE rk <= 5"""
    sql["request_bodies"] = """SELECT request_id, CASE WHEN error IS NULL THEN fen END AS key_fen, lo, hi, error FROM (
  SELECT o_orderkey AS request_id, o_orderpriority AS fen, CAST(0 AS BIGINT) AS lo,
    CAST(CASE o_orderkey % 8 WHEN 0 THEN 3000 WHEN 1 THEN 1500 WHEN 2 THEN 99999999999 WHEN 3 THEN 1400
         WHEN 5 THEN 1200 WHEN 7 THEN 1 END AS BIGINT) AS hi,
    CASE WHEN o_orderkey % 8 IN (4, 6) THEN 'invalid_range' END AS error FROM orders)"""
    sql["monthly_counts_merge"] = _ORDER_COUNTS
    sql["merged_sorted_lookup"] = _recommend_sql(
        f"""WITH {_LINEITEM_COUNTS},
req AS (SELECT p_partkey AS request_id, CAST(p_partkey AS VARCHAR) AS key_fen,
               CAST((p_size % 5) * 10 AS BIGINT) AS lo, CAST((p_size % 5) * 10 + 20 AS INTEGER) AS hi,
               CAST(NULL AS VARCHAR) AS error FROM part)""", "lcounts")
    sql["indexed_lookup"] = _recommend_sql(
        f"""WITH {_LINEITEM_COUNTS},
req AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey AS VARCHAR) AS key_fen,
               CAST(n_regionkey * 10 AS BIGINT) AS lo, CAST(3000 AS BIGINT) AS hi, CAST(NULL AS VARCHAR) AS error FROM nation)""",
        "lcounts")
    sql["view_lookup"] = _recommend_sql(
        """WITH vcounts AS (
  SELECT CAST(l_partkey AS VARCHAR) AS base_fen, CAST(FLOOR(l_quantity / 10.0) * 10 AS BIGINT) AS player_elo_bucket,
         CAST(l_suppkey AS VARCHAR) AS move_san, COUNT(*) AS times_played
  FROM lineitem WHERE strftime(l_shipdate, '%Y') <> '1994' OR l_linenumber % 2 = 0 GROUP BY ALL),
req AS (SELECT p_partkey AS request_id, CAST(p_partkey AS VARCHAR) AS key_fen,
               CAST((p_size % 5) * 10 AS BIGINT) AS lo, CAST((p_size % 5) * 10 + 20 AS BIGINT) AS hi,
               CAST(NULL AS VARCHAR) AS error FROM part)""", "vcounts")
    sql["stored_ledger"] = "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS year_month FROM orders"
    sql["ingest_empty_month"] = f"""WITH {GAMES_CTE},
years AS (SELECT strftime(make_date(CAST(substr(month, 1, 4) AS BIGINT), 1, 1), '%Y-%m') AS month,
                 CASE WHEN month LIKE '1995%' THEN 'bullet' ELSE reject_reason END AS reason FROM judged)
SELECT p.path, month, COUNT(*) AS scanned, COUNT(*) FILTER (reason IS NULL) AS kept, COUNT(*) FILTER (reason = 'bullet') AS bullet,
       COUNT(*) FILTER (reason = 'termination') AS termination, COUNT(*) FILTER (reason = 'rating') AS rating
FROM years, (VALUES ('batch'), ('stream')) p(path) GROUP BY ALL"""
    sql["linewise_turns"] = r"""SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, CAST(3 AS INTEGER) AS tags,
       trim('1. ' || regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g')) AS movetext FROM conversations"""
    sql["turn_tokens"] = rf"""WITH t AS (
  SELECT role, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    {_q(STRICT_COMMENT)}, ' ', 'g'), {_q(STRICT_MOVE_NUMBER)}, ' ', 'g'), {_q(STRICT_NAG)}, ' ', 'g'), {_q(STRICT_RESULT)}, ' ', 'g') AS s
  FROM conversations),
w AS (SELECT role, s, list_filter(regexp_split_to_array(s, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') AS ws FROM t)
SELECT role, COUNT(*) AS turns, CAST(SUM(len(ws)) AS BIGINT) AS words,
  CAST(SUM(len(list_filter(ws, lambda x: regexp_matches(x, '^[a-h][1-8]$|^[NBRQK][a-h][1-8]$')))) AS BIGINT) AS move_words,
  CAST(SUM(length(s)) AS BIGINT) AS characters FROM w GROUP BY role"""
    deltas = f"""WITH {GAMES_CTE}, {_tokens_cte()},
lists AS (SELECT line_id, mode, list(token ORDER BY idx) FILTER (idx < 40) AS ts FROM toks GROUP BY ALL),
ab AS (SELECT q.game_id, coalesce(a.ts, []) AS a, coalesce(b.ts, []) AS b FROM qualified q
       LEFT JOIN lists a ON a.line_id = q.line_id AND a.mode = 'strict' LEFT JOIN lists b ON b.line_id = q.line_id AND b.mode = 'lenient'),
al AS (SELECT *, least(len(a), len(b)) AS n,
         list_filter(range(least(len(a), len(b))), lambda i: rtrim(a[i + 1], '+#') <> rtrim(b[i + 1], '+#')) AS apart FROM ab),
d AS (SELECT game_id, CAST(len(a) AS INTEGER) AS tokens_a, CAST(len(b) AS INTEGER) AS tokens_b,
        CAST(coalesce(apart[1], n) AS INTEGER) AS same,
        CAST(CASE WHEN len(apart) > 0 THEN apart[1] WHEN len(a) <> len(b) THEN n END AS INTEGER) AS first_difference, a, b FROM al)"""
    sql["token_delta"] = deltas + """
SELECT game_id, tokens_a, tokens_b, same, first_difference, a[first_difference + 1] AS token_a, b[first_difference + 1] AS token_b FROM d"""
    sql["token_delta_report"] = deltas + """
SELECT COUNT(*) AS games, COUNT(first_difference) AS games_apart, CAST(SUM(tokens_a) AS BIGINT) AS moves_a,
  CAST(SUM(tokens_b) AS BIGINT) AS moves_b, CAST(SUM(same) AS BIGINT) AS moves_same,
  CAST(SUM(tokens_b) - SUM(tokens_a) AS DOUBLE) * 100.0 / CAST(SUM(tokens_b) AS DOUBLE) AS lost_percent FROM d"""
    sql["most_played"] = f"""WITH {_LINEITEM_COUNTS}
SELECT base_fen, player_elo_bucket, move_san, times_played FROM lcounts
ORDER BY times_played DESC, base_fen, player_elo_bucket, move_san LIMIT 1"""
    sql["top5_share_single"] = _single_lookup_sql(f"WITH {_EVENT_STEPS}", "ecounts", "click", -(1 << 60), 1 << 60)
    sql["top5_share_batch"] = _recommend_sql(
        f"""WITH {_EVENT_STEPS},
req AS (SELECT event_id AS request_id, event_type AS key_fen, 0 AS lo,
               CAST(FLOOR(value / 25.0) * 25 AS BIGINT) AS hi, CAST(NULL AS VARCHAR) AS error FROM events)""",
        "ecounts")
    sql["event_transitions"] = f"""WITH {_EVENT_STEPS}
SELECT COALESCE(NULLIF(concat_ws('>', l2, l1), ''), '^') AS context,
       CAST(FLOOR(value / 25.0) * 25 AS BIGINT) AS value_bucket, event_type AS item, COUNT(*) AS times_played
FROM esteps GROUP BY ALL"""
    sql["conversation_transitions"] = """WITH s AS (
  SELECT *, LAG(role) OVER (PARTITION BY conv_id ORDER BY step) AS prev
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations))
SELECT COALESCE(prev, '^') AS context, role AS item, COUNT(*) AS times_played FROM s GROUP BY ALL"""
    sql["quality_filter_reasons"] = f"""WITH {GAMES_CTE}
SELECT COALESCE(reject_reason, 'kept') AS outcome, COUNT(*) AS games FROM judged GROUP BY ALL"""
    sql["rating_parse"] = """WITH r AS (
  SELECT o_orderkey, CAST(400 + (o_custkey * 7) % 2600 AS VARCHAR) AS d, o_orderkey % 7 AS k FROM orders),
t AS (SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN '?' WHEN 2 THEN '' WHEN 3 THEN d || '?'
                                  WHEN 4 THEN '-' || d WHEN 5 THEN ' ' || d ELSE '0' || d END AS rating_text FROM r)
SELECT o_orderkey, rating_text,
       CASE WHEN regexp_full_match(rating_text, '[0-9]+') THEN COALESCE(TRY_CAST(rating_text AS INTEGER), 0)
            ELSE 0 END AS rating
FROM t"""
    sql["clean_event"] = f"""SELECT split_part({_case('o_orderkey % 5', synth.EVENTS)}, ' https://', 1) AS event,
       COUNT(*) AS games FROM orders GROUP BY ALL"""
    movetexts = _case("line_id", synth.MOVETEXT)
    sql["header_map"] = f"""WITH {GAMES_CTE}
SELECT game_id, raw_event AS event, white_text AS white_elo, black_text AS black_elo, termination,
       CASE WHEN line_id = 6 THEN {_q(synth.LINE_6_FEN)} END AS fen, {movetexts} AS movetext
FROM games"""
    sql["archive_codecs"] = sql["archive_frames"] = sql["header_map"]
    sql["limit_qualifying"] = f"""WITH {GAMES_CTE}
SELECT game_id, event, white_elo, black_elo FROM qualified ORDER BY game_id LIMIT {LIMIT_GAMES}"""
    sql["move_tokens"] = f"""WITH {GAMES_CTE}, {_tokens_cte()}
SELECT g.game_id, t.mode, CAST(t.idx AS INTEGER) AS idx, t.token FROM games g JOIN toks t ON g.line_id = t.line_id"""
    sql["game_positions"] = pos + "\nSELECT * FROM positions"
    sql["replay_quarantine"] = f"""WITH {GAMES_CTE}
SELECT game_id, 'illegal_move' AS error, 2 AS plies_kept, 4 AS tokens FROM qualified WHERE line_id = 5"""
    sql["pgn_flagship"] = f"""WITH {GAMES_CTE}, {_tokens_cte()},
line AS (SELECT line_id, list(token ORDER BY idx) AS l FROM toks WHERE mode = 'lenient' AND idx < 40 GROUP BY 1),
steps AS (SELECT line_id, CASE WHEN i = 0 THEN '^' ELSE array_to_string(l[1:i], ' ') END AS context, l[i + 1] AS move_san
          FROM (SELECT line_id, l, unnest(range(len(l))) AS i FROM line)),
stats AS (SELECT context, move_san, COUNT(*) AS plays FROM qualified JOIN steps USING (line_id) GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY context ORDER BY plays DESC, move_san) AS rk,
                  SUM(plays) OVER (PARTITION BY context) AS total FROM stats)
SELECT context, CAST(rk AS INTEGER) AS rank, move_san, CAST(plays AS BIGINT) AS plays,
       CAST(plays AS DOUBLE) * 100.0 / CAST(total AS DOUBLE) AS percentage
FROM ranked WHERE rk <= 5"""
    sql["position_explore"] = _single_lookup_sql(
        _COUNTS_SQL, "counts", "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -", *EXPLORE_RANGE)
    sql["sequence_final_fen"] = f"""WITH s(line_id, n, moves, fen, error) AS (VALUES {_sequence_rows()})
SELECT CAST(o_orderkey AS VARCHAR) AS game_id, s.moves, s.fen, s.error
FROM orders JOIN s ON o_orderkey % 8 = s.line_id AND o_orderkey % 5 = s.n"""
    norm_rows = ", ".join(f"({i}, {_q(NORMALISE_INPUTS[i])}, {_q(f)}, {_q(e)})"
                          for i, (f, e) in enumerate(_NORMALISED))
    sql["fen_normalise"] = f"""WITH v(k, input_fen, base_fen, error) AS (VALUES {norm_rows})
SELECT o_orderkey, v.input_fen, v.base_fen, v.error FROM orders JOIN v ON o_orderkey % 6 = v.k"""
    req_keys = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -",
                "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", None, None,
                "8/8/8/8/8/8/8/K6k w - -"]
    fen_err = [None, None, "missing_fen", "invalid_fen", None]
    sql["request_errors"] = _recommend_sql(
        _COUNTS_SQL + f""",
r0 AS (SELECT o_orderkey AS request_id, o_orderkey % 5 AS fk, o_orderkey % 3 AS mk FROM orders),
req AS (
  SELECT request_id,
         CASE WHEN {_case('fk', fen_err)} IS NULL AND mk <> 2 THEN {_case('fk', req_keys)} END AS key_fen,
         CASE mk WHEN 0 THEN 0 WHEN 1 THEN 1000 END AS lo, 3000 AS hi,
         COALESCE({_case('fk', fen_err)}, CASE WHEN mk = 2 THEN 'invalid_range' END) AS error
  FROM r0)""", "counts")
    sql["list_months"] = f"""SELECT path, MIN('{PAGE_BASE_URL.rstrip('/')}/' || ltrim(path, '/')) AS url
FROM (SELECT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS path FROM pages)
GROUP BY path"""
    sql["pending_months"] = f"WITH {_months_cte()}\nSELECT year_month, url FROM pending"
    sql["ledger_add"] = f"""WITH {_months_cte()}
SELECT year_month FROM ledger UNION SELECT year_month FROM pending"""
    sql["incremental_equals_batch"] = _COUNTS_SQL + "\nSELECT * FROM counts"
    sql["positions_roundtrip"] = f"WITH {_EVENT_STEPS}\nSELECT * FROM ecounts"
    sql["counts_view_months"] = _ORDER_COUNTS
    sql["sorted_row_at"] = f"""WITH {_LINEITEM_COUNTS}
SELECT base_fen, player_elo_bucket, move_san, times_played FROM lcounts ORDER BY base_fen, player_elo_bucket, move_san LIMIT 1 OFFSET 35"""
    sql["sorted_head"] = f"""WITH {_LINEITEM_COUNTS}
SELECT base_fen, player_elo_bucket, move_san, times_played FROM lcounts ORDER BY base_fen, player_elo_bucket, move_san LIMIT 10"""
    strict = _positions_sql(strict=True)
    sql["extraction_delta"] = f"""WITH s AS ({strict} SELECT * FROM positions),
l AS ({pos} SELECT * FROM positions)
SELECT (SELECT COUNT(*) FROM s) AS rows_a, (SELECT COUNT(*) FROM l) AS rows_b,
       (SELECT COUNT(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM l)) AS only_a,
       (SELECT COUNT(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM s)) AS only_b"""
    return sql
