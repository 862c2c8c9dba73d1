"""Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Game filters of the extraction stage.
EXCLUDED_EVENT_WORD = "Bullet"
BAD_TERMINATIONS = ("Abandoned", "Rules infraction", "Unterminated")
MIN_ELO_EXCLUSIVE = 600
EVENT_URL_MARKER = " https://"

# The strict tokenizer's four patterns (comments, move numbers,
# annotation glyphs, results), applied in this order before a whitespace split.
STRICT_COMMENT = r"\{[^}]*\}"
STRICT_MOVE_NUMBER = r"\d+\.(?:\.\.)?"
STRICT_NAG = r"\$\d+"
STRICT_RESULT = r"\b(?:1-0|0-1|1/2-1/2|\*)\b"

# Lenient tokenizer: SAN-shaped words, null moves, drops (illegal on a standard
# board, so they end the game) and variation brackets; everything else (move
# numbers, results, glyphs, suffixes like ?! and +) is skipped.
# The leading lookahead lists every character a token can start with, so the
# matcher rejects other positions (spaces, dots, '9', '$', '?', ...) with one
# check instead of trying each alternative there; the matches are unchanged.
LENIENT_TOKEN = (r"(?=[()O0\-Z@PNBKRQa-h1-8x])"
                 r"(\(|\)|O-O-O|O-O|0-0-0|0-0|--|Z0|0000|@@@@|[PNBRQK]?@[a-h][1-8]"
                 r"|[NBKRQ]?[a-h]?[1-8]?[-x]?[a-h][1-8](?:=?[NBRQKnbrqk])?)")
# One whole token the strict path accepts (the move grammar with its check
# suffix, castling with letters or zeros, null moves).
SAN_TOKEN = (r"(?:[NBKRQ]?[a-h]?[1-8]?[\-x]?[a-h][1-8](?:=?[nbrqkNBRQK])?[\+#]?|[O0]-[O0](?:-[O0])?[\+#]?"
             r"|--|Z0|0000|@@@@)")
SAN_FULL = "^" + SAN_TOKEN + "$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(c, width: int = 100) -> Column:
    """Floor to a multiple of ``width`` (1450 -> 1400), as a bigint: exact for
    integer columns of any size, null where the result does not fit."""
    c = col_of(c)
    whole = c.try_cast("long")
    exact = F.try_subtract(whole, F.pmod(whole, F.lit(width).cast("long")))
    floored = (F.floor(c / F.lit(width)) * F.lit(width)).try_cast("long")
    return F.when(F.typeof(c).isin("tinyint", "smallint", "int", "bigint"), exact).otherwise(floored)


def header(headers, key: str, default: str = "") -> Column:
    """Map lookup with a default (missing tag -> default)."""
    return F.coalesce(F.try_element_at(col_of(headers), F.lit(key)), F.lit(default))


def parse_rating(c) -> Column:
    """Digits-only text to int; anything else ('?', '', '-1', '1500?') -> 0."""
    c = col_of(c)
    return F.when(c.rlike("^[0-9]+$"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def clean_event(c) -> Column:
    """Text before the first ' https://'."""
    return F.substring_index(col_of(c), EVENT_URL_MARKER, 1)


def base_fen_of(c) -> Column:
    """First four space-separated FEN fields."""
    return F.substring_index(col_of(c), " ", 4)


def url_join(base: str, path) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(col_of(path), "^/+", ""))


# The whitespace a line is stripped of (the same set as a regex \s).
_WHITESPACE = " \t\n\x0b\x0c\r"


def _strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(_WHITESPACE))


def tag_of(line: Column) -> Column:
    """Key and value of a tag line as a struct; null for other lines and for a tag without a space."""
    space = F.instr(line, " ")
    key = F.substring(line, F.lit(2), space - 2)
    value = F.trim(F.substring(line, space + 1, F.length(line)), F.lit('"]'))
    return F.when(line.startswith("[") & (space > 0), F.struct(key.alias("k"), value.alias("v")))


def record_games(value) -> Column:
    """Fold the lines of one archive record into ``array<struct<headers, movetext>>``.

    Tag lines ``[Key "Value"]`` add to the running headers (a repeated key
    keeps the last value); every other non-blank line is one game's movetext
    and resets the headers.  Pure SQL higher-order functions, no Python.  Tags
    are collected as an array and turned into a map once per game; only a game
    with a repeated key pays for the last-wins filter.
    """
    lines = F.filter(F.transform(F.split(col_of(value), "\n"), _strip_ws), lambda l: l != F.lit(""))
    empty_tags = F.array().cast("array<struct<k:string,v:string>>")
    empty_games = F.array().cast("array<struct<headers:map<string,string>,movetext:string>>")

    def headers_of(tags):
        keys = F.transform(tags, lambda e: e["k"])
        last_wins = F.filter(tags, lambda e, i: ~F.exists(F.slice(tags, i + 2, F.size(tags) + 1),
                                                          lambda x: x["k"] == e["k"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), tags)
                                  .otherwise(last_wins))

    def step(acc, line):
        space = F.instr(line, " ")
        key = F.substring(line, F.lit(2), space - 2)
        val = F.trim(F.substring(line, space + 1, F.length(line)), F.lit('"]'))
        with_tag = F.struct(F.array_append(acc["h"], F.struct(key.alias("k"), val.alias("v"))).alias("h"),
                            acc["g"].alias("g"))
        new_game = F.struct(empty_tags.alias("h"),
                            F.array_append(acc["g"], F.struct(headers_of(acc["h"]).alias("headers"),
                                                              line.alias("movetext"))).alias("g"))
        return (F.when(line.startswith("["), F.when(space > 0, with_tag).otherwise(acc))
                .otherwise(new_game))

    return F.aggregate(lines, F.struct(empty_tags.alias("h"), empty_games.alias("g")), step,
                       lambda acc: acc["g"])


def lenient_tokens(movetext, max_tokens: int | None = None) -> Column:
    """Main-line SAN-shaped tokens: comments and (nested) variations removed."""
    s = F.regexp_replace(col_of(movetext), r"\{[^}]*(\}|$)", " ")
    s = F.regexp_replace(s, r";.*$", " ")
    raw = F.regexp_extract_all(s, F.lit(LENIENT_TOKEN), 1)
    cap = F.lit(max_tokens if max_tokens is not None else 2 ** 31 - 1)

    def step(acc, t):
        depth, out = acc["d"], acc["o"]
        return (F.when(t == "(", F.struct((depth + 1).alias("d"), out.alias("o")))
                .when(t == ")", F.struct(F.greatest(depth - 1, F.lit(0)).alias("d"), out.alias("o")))
                .when((depth == 0) & (F.size(out) < cap),
                      F.struct(depth.alias("d"), F.array_append(out, t).alias("o")))
                .otherwise(acc))

    nested = F.aggregate(raw, F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("o")),
                         step, lambda acc: acc["o"])
    flat = raw if max_tokens is None else F.slice(raw, 1, max_tokens)
    return F.when(F.instr(s, "(") + F.instr(s, ")") == 0, flat).otherwise(nested)


def strict_tokens(movetext, max_tokens: int | None = None) -> Column:
    """The strict tokenizer: four removals, then the whitespace-separated tokens
    up to the first one that is not a whole SAN token.  One anchored regex takes
    that prefix (at most ``max_tokens`` tokens), so no per-token check runs."""
    s = col_of(movetext)
    for pattern in (STRICT_COMMENT, STRICT_MOVE_NUMBER, STRICT_NAG, STRICT_RESULT):
        s = F.regexp_replace(s, pattern, " ")
    count = "*" if max_tokens is None else "{0,%d}" % max_tokens
    prefix = F.regexp_extract(s, r"^\s*((?:" + SAN_TOKEN + r"(?:\s+|$))" + count + ")", 1)
    return F.filter(F.split(F.trim(prefix), r"\s+"), lambda t: t != F.lit(""))


def tokens(movetext, mode: str = "lenient", max_tokens: int | None = None) -> Column:
    if mode == "lenient":
        return lenient_tokens(movetext, max_tokens)
    if mode == "strict":
        return strict_tokens(movetext, max_tokens)
    raise ValueError(f"unknown tokenizer mode {mode!r}")
