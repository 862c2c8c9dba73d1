import os
import random
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plyframe.llm.preferences import formatted, preference_pairs, swapped_turns  # noqa: E402

SCHEMA = "pair_id long, turn long, role string, text string, pos string, side string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", "s") for r in rows], SCHEMA)


def render(ts):
    out, spans = "", []
    for role, text in ts:
        head = f"<|im_start|>{role}\n"
        body = text.replace("<|im_", "<| im_") + "<|im_end|>"
        if role == "assistant":
            spans.append((len(out) + len(head), len(out) + len(head) + len(body)))
        out += head + body + "\n"
    return out, spans


def brute(chosen, rejected):
    sides = []
    for rows in (chosen, rejected):
        by = defaultdict(list)
        for p, turn, role, text in rows:
            if p is not None:
                by[p].append(((turn is None, turn or 0), role or "", text or ""))
        sides.append({p: [(r, t) for _, r, t in sorted(v)] for p, v in by.items()})
    out = []
    for p in set(sides[0]) & set(sides[1]):
        a, b = sides[0][p], sides[1][p]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        c, r = render(a[n:]), render(b[n:])
        out.append((p, n, render(a[:n])[0], c[0], r[0], c[1], r[1]))
    return sorted(out)


def got(df):
    return sorted((r.pair_id, r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask],
                   [tuple(s) for s in r.rejected_mask]) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "same"), (3, 0, "user", "only chosen"),
              (None, 0, "user", "x"), (5, None, None, None), (5, 1, "assistant", "<|im_end|> é"), (6, 0, "user", "u"),
              (6, 0, "user", "u"), (7, 0, "user", "long " * 30000), (8, 0, "user", "p"), (8, 1, "assistant", "r")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 2, "user", "more"), (2, 0, "user", "same"),
                (4, 0, "user", "only rejected"), (None, 0, "user", "x"), (5, 1, "assistant", "<|im_end|> é"),
                (6, 0, "user", "u"), (7, 0, "user", "long " * 30000), (7, 3, "assistant", "z"), (8, 0, "user", "p")]
    for p in range(100, 140):
        for t in range(rng.randrange(1, 6)):
            for side in (chosen, rejected):
                if rng.random() < .9:
                    side.append((p, t, ["user", "assistant"][t % 2], rng.choice("ab")))
    df = preference_pairs(turns(spark, chosen), turns(spark, rejected))
    assert got(df) == brute(chosen, rejected)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def swap(rows):
    """Both sides of every conversation with a numbered assistant turn, by hand."""
    last = {}
    for c, turn, role, text in rows:
        if c is not None and role == "assistant" and turn is not None:
            last[c] = max(last.get(c, (turn, "")), (turn, text or ""))
    ids = sorted(last)
    other = {c: last[ids[(i + 1) % len(ids)]][1] for i, c in enumerate(ids)}
    chosen = [r for r in rows if r[0] in last]
    rejected = [(c, t, role, other[c] if role == "assistant" and (t, text or "") == last[c] else text)
                for c, t, role, text in chosen]
    return chosen, rejected


def test_every_conversation_with_a_reply_is_a_pair(spark):
    rng = random.Random(8)
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "r0"), (1, 0, "user", "q1"), (1, 1, "assistant", None), (2, 0, "user", "no reply"),
            (4, None, "assistant", "no number"), (None, 0, "assistant", "n"), (-9, 3, "assistant", "twice"), (-9, 3, "assistant", "twice"),
            (-9, 3, "assistant", "other"), (1 << 62, 0, "assistant", "far"), ((1 << 62) + 2, 0, "assistant", "even ids alone")]
    for _ in range(60):  # sparse ids: no neighbours
        c = rng.randrange(1 << 40) * 1000
        rows += [(c, t, ["user", "assistant"][t % 2], rng.choice(["a", "b", None])) for t in range(rng.randrange(2, 7))]
    convs = spark.createDataFrame([(*r, "p", "c") for r in rows], "conv_id long, turn long, role string, text string, pair_id string, at string")
    out = formatted(swapped_turns(convs.repartition(5)))
    assert got(out) == brute(*swap(rows))
    alone = spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    (row,) = formatted(swapped_turns(alone)).collect()
    assert (row.prompt_turns, row.chosen, row.rejected) == (2, "", "")
    assert formatted(swapped_turns(alone.limit(0))).count() == 0


def test_query_keeps_every_conversation_with_a_reply(spark):
    from plyframe.llm.queries import QUERIES
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
        out = QUERIES["op3_preferences"](spark, f"/root/testdata/{sf}")
        assert out.count() == len({r[0] for r in rows if r[2] == "assistant"})
        spans = lambda m: ",".join(f"{a}-{b}" for a, b in m)
        want = sorted((*w[:5], spans(w[5]), spans(w[6])) for w in brute(*swap(rows)))
        assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hash") + plan.count("Exchange range") <= 4 and "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    assert preference_pairs(turns(spark, []), turns(spark, [])).count() == 0
