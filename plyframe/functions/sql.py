"""The game functions as SQL functions, for pipelines written in Spark SQL.

After ``register_sql_functions(spark)``::

    SELECT r.fen FROM (SELECT normalise_fen(fen) AS r FROM requests)
    SELECT game_id, inline_outer(r.plies) FROM (
      SELECT game_id, replay_moves(start_fen, toks) AS r FROM (
        SELECT game_id, start_fen, lenient_tokens(movetext) AS toks FROM games))

(SQL functions may not appear inside a generator's arguments, hence the
subqueries.)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from plyframe.functions.replay import normalise_fen_udf, replay_udf, sequence_fen_udf

MAX_PLIES = 40


def register_sql_functions(spark: SparkSession, max_plies: int = MAX_PLIES) -> None:
    """Register normalise_fen, sequence_fen, replay_moves (Arrow UDFs) and the
    two tokenizers (as SQL expressions over regex functions, no Python)."""
    spark.udf.register("normalise_fen", normalise_fen_udf)
    spark.udf.register("sequence_fen", sequence_fen_udf)
    spark.udf.register("replay_moves", replay_udf(max_plies))
    from plyframe.functions.columns import LENIENT_TOKEN, SAN_TOKEN, STRICT_COMMENT, STRICT_MOVE_NUMBER, \
        STRICT_NAG, STRICT_RESULT

    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    # SQL functions cannot be defined with lambdas through the Python API, so
    # the tokenizers are temporary SQL functions built from the same patterns.
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION lenient_tokens(movetext STRING) RETURNS ARRAY<STRING>
        RETURN aggregate(
          regexp_extract_all(regexp_replace(regexp_replace(movetext, {lit(r"\{[^}]*(\}|$)")}, ' '),
                                            {lit(r";.*$")}, ' '), {lit(LENIENT_TOKEN)}, 1),
          named_struct('d', 0, 'o', CAST(array() AS ARRAY<STRING>)),
          (acc, t) -> CASE WHEN t = '(' THEN named_struct('d', acc.d + 1, 'o', acc.o)
                           WHEN t = ')' THEN named_struct('d', greatest(acc.d - 1, 0), 'o', acc.o)
                           WHEN acc.d = 0 AND size(acc.o) < {max_plies}
                             THEN named_struct('d', acc.d, 'o', array_append(acc.o, t))
                           ELSE acc END,
          acc -> acc.o)""")
    strict = "movetext"
    for pattern in (STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT):
        strict = f"regexp_replace({strict}, {lit(pattern)}, ' ')"
    prefix = lit(r"^\s*((?:" + SAN_TOKEN + r"(?:\s+|$))" + "{0,%d}" % max_plies + ")")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION strict_tokens(movetext STRING) RETURNS ARRAY<STRING>
        RETURN filter(split(trim(regexp_extract({strict}, {prefix}, 1)), {lit(r"\s+")}), t -> t <> '')""")
