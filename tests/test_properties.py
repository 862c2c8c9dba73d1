"""Property tests (hypothesis): random legal playouts through the kernel and the job."""

from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from plyframe.functions.board import START_FEN, Position, Replayer

choices = st.lists(st.integers(min_value=0, max_value=10_000), min_size=1, max_size=60)


def _playout(picks):
    """A random legal game from the start: (san list, positions before each move)."""
    pos, sans, keys = Position.from_fen(START_FEN), [], []
    for pick in picks:
        moves = pos.legal_moves()
        if not moves:
            break
        move = moves[pick % len(moves)]
        keys.append(pos.base_fen())
        sans.append(pos.san(move))
        pos = pos.push(move)
    return sans, keys, pos


@settings(max_examples=60, deadline=None)
@given(choices)
def test_san_round_trip_and_replay_agree(picks):
    sans, keys, final = _playout(picks)
    # Every written move parses back to itself; the FEN key parses back to itself.
    again = Position.from_fen(START_FEN)
    for san, key in zip(sans, keys):
        assert again.base_fen() == key
        assert Position.from_fen(key).base_fen() == key
        again = again.push(again.parse_san(san))
    assert again.fen() == final.fen()
    # The replay job's kernel gives the same rows, capped at 40, sides alternating.
    rows, err = Replayer().replay(None, sans, max_plies=40)
    assert err is None
    assert [r[3] for r in rows] == sans[:40] and [r[2] for r in rows] == keys[:40]
    assert all(r[1] == (i % 2 == 0) for i, r in enumerate(rows))
    # Suffix-free spellings (as the lenient tokenizer yields them) replay identically.
    bare, _ = Replayer().replay(None, [s.rstrip("+#") for s in sans], max_plies=40)
    assert bare == rows


def test_annotated_random_games_through_the_job(spark):
    import random

    from support import games_df
    from plyframe.operators.extract import extract_positions

    rnd = random.Random(7)
    games, expected = [], {}
    for g in range(40):
        sans, keys, _ = _playout([rnd.randrange(10_000) for _ in range(rnd.randrange(1, 70))])
        parts = []
        for i, san in enumerate(sans):
            if i % 2 == 0:
                parts.append(f"{i // 2 + 1}.")
            elif rnd.random() < 0.3:
                parts.append(f"{i // 2 + 1}...")
            parts.append(san + rnd.choice(["", "", "?!", "!", " $1", " { [%clk 0:01:00] }"]))
            if rnd.random() < 0.1:
                parts.append("( 1. Nc3 { side line } )")
        games.append((" ".join(parts) + " *", "Rated Blitz game", 1500, 1600))
        expected[str(g)] = list(zip(keys[:40], sans[:40]))
    got = {}
    for r in extract_positions(games_df(spark, games)).orderBy("game_id", "ply").collect():
        got.setdefault(r.game_id, []).append((r.base_fen, r.move_san))
    assert {k: v for k, v in expected.items() if v} == got


def test_malformed_archive_text_never_fails_the_job(spark):
    """Random text made of PGN-significant characters runs through every stage without an error."""
    import random

    from plyframe.operators.counts import count_moves
    from plyframe.operators.extract import extract_positions, replay_errors
    from plyframe.operators.qualify import qualify_games
    from plyframe.sources.archive import parse_games

    rnd = random.Random(11)
    alphabet = list('[]"{}()$;*?!.-=+#/ \n\t\r') + list("abcdefgh12345678NBRQKOxZ0") + ["é", " ", "Event", "Elo"]
    records = []
    for _ in range(300):
        body = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400)))
        head = rnd.choice(['', '[Event "Rated Blitz game"]\n[WhiteElo "1500"]\n[BlackElo "1600"]\n',
                           '[FEN "' + "".join(rnd.choice(alphabet) for _ in range(30)) + '"]\n'
                           '[WhiteElo "1500"]\n[BlackElo "1600"]\n'])
        records.append((head + body,))
    df = spark.createDataFrame(records, "value string").repartition(4)
    games = qualify_games(parse_games(df).withColumn("game_id", F.col("game_index").cast("string")))
    for mode in ("lenient", "strict"):
        count_moves(extract_positions(games, mode=mode)).write.format("noop").mode("overwrite").save()
    replay_errors(games).write.format("noop").mode("overwrite").save()


def test_top_k_share_matches_brute_force(spark):
    import random
    from collections import defaultdict

    from plyframe.operators.counts import top_k_share

    rnd = random.Random(9)
    rows = [(f"g{rnd.randrange(60)}", rnd.choice("abcdefghij"), rnd.randrange(0, 5)) for _ in range(5000)]
    rows += [("zero", "a", 0), ("zero", "b", 0)]  # a group whose weights sum to 0
    df = spark.createDataFrame(rows, "g string, item string, w long").repartition(6)
    got = {(r.g, r.rank): (r.item, r.w, r.percentage) for r in top_k_share(df, ["g"], "item", "w", 3).collect()}
    sums = defaultdict(lambda: defaultdict(int))
    for g, item, w in rows:
        sums[g][item] += w
    want = {}
    for g, items in sums.items():
        total = sum(items.values())
        ranked = sorted(items.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        for rank, (item, w) in enumerate(ranked, 1):
            want[(g, rank)] = (item, w, (w * 100.0 / total) if total else None)
    assert got.keys() == want.keys()
    for key, (item, w, pct) in want.items():
        g_item, g_w, g_pct = got[key]
        assert (g_item, g_w) == (item, w)
        assert (g_pct is None and pct is None) or abs(g_pct - pct) < 1e-9


def test_compare_extractions_matches_multiset_difference(spark):
    import random
    from collections import Counter

    from plyframe.operators.counts import compare_extractions

    rnd = random.Random(4)
    a = [(rnd.randrange(30), rnd.choice("xyz")) for _ in range(400)]
    b = [(rnd.randrange(30), rnd.choice("xyz")) for _ in range(350)]
    schema = "k long, v string"
    r = compare_extractions(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first()
    ca, cb = Counter(a), Counter(b)
    assert (r.rows_a, r.rows_b) == (len(a), len(b))
    assert (r.only_a, r.only_b) == (sum((ca - cb).values()), sum((cb - ca).values()))
