import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm.mixture import mix, mixed_rows, quotas, targets  # noqa: E402


def test_targets_stop_at_the_cap_and_are_shared_again():
    got = targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    # a: 5 x, b: 2 x, c: 1 x, null: 5 x of 1665 words; a and c stop at once, then b, null takes the rest
    assert got["a"] == 20 and got["c"] == 0 and got["b"] == 200
    assert got[None] == pytest.approx(1665 - 220)
    assert targets([]) == {}
    assert sum(targets([(str(i), 50 + i) for i in range(20)]).values()) == pytest.approx(1.5 * sum(50 + i for i in range(20)))


def test_tree_splits_every_quota_exactly():
    units = np.array([7, 0, 1000, 33])
    for shards in (1, 2, 5, 16):
        runs = [quotas(shards, units, 3, s) for s in range(shards)]
        first, count = np.array([f for f, _ in runs]), np.array([c for _, c in runs])
        assert (count.sum(0) == units).all() and (count >= 0).all()
        assert (first == np.vstack([np.zeros(4, int), np.cumsum(count, 0)[:-1]])).all()
        assert count.sum(1).max() - count.sum(1).min() <= np.ceil(np.log2(shards)) + 1


def rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        source = rng.choice(["big"] * 8 + ["a", "z", None, "é"])
        out.append((i, " ".join(["w"] * rng.randrange(0, 40)), source))
    return out + [(700, None, "a"), (701, "", "empty"), (702, None, "empty"), (None, "x y", "a"), (5, "x y z", "a"),
                  (5, "x y z", "a")]


def test_takes_come_near_targets_and_reruns_agree(spark):
    docs = make_docs(spark, rows())
    got = [(r.doc_id, r.text, r.source, r._mix) for r in mix(spark, docs, docs_per_block=4, shards=8).collect()]
    assert len(got) == len(rows())
    size, taken, largest, target = Counter(), Counter(), Counter(), {}
    for _, text, source, m in got:
        assert m.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert len(m.shards) <= 2
        size[source] += m.size
        taken[source] += m.size * len(m.shards)
        largest[source] = max(largest[source], m.size)
        target[source] = m.target
    want = targets([(s, size[s]) for s in size])
    for s in size:
        assert target[s] == want[s]
        assert abs(taken[s] - want[s]) <= max(1, largest[s])
        assert all(m.source_size == size[s] for _, _, x, m in got if x == s)
    again = {(r.doc_id, r.text, tuple(r._mix.shards)) for r in
             mix(spark, docs.repartition(3), docs_per_block=4, shards=8).collect()}
    assert again == {(d, t, tuple(m.shards)) for d, t, _, m in got}


def test_mixed_rows_repeat_rows_and_shards_are_even(spark):
    docs = make_docs(spark, rows())
    plan = mix(spark, docs, docs_per_block=4, shards=8).collect()
    out = mixed_rows(spark, docs, docs_per_block=4, shards=8)
    assert out.columns == docs.columns
    want = Counter()
    per = defaultdict(int)
    for r in plan:
        want[(r.doc_id, r.text, r.source)] += len(r._mix.shards)
        for s in r._mix.shards:
            per[s] += 1
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want
    assert set(per) == set(range(8)) and max(per.values()) < 2 * min(per.values())


def nearest_prefixes(rows):
    """By hand, of (source, place, size, target): how often each (source, place) is taken.  The whole source as often as it
    fits, then documents by place, to the one with which the words come nearest to what is left (more on a tie)."""
    out, by = {}, defaultdict(lambda: defaultdict(int))
    goal = {}
    for source, place, size, target in rows:
        by[source][place] += size
        goal[source] = target
    for source, places in by.items():
        total = sum(places.values())
        whole = int(goal[source] // total) if total else 0
        rest, upto = (goal[source] - whole * total) if total else 0, 0
        for place in sorted(places):
            more = rest > 0 and upto < rest and (upto + places[place] <= rest or upto + places[place] - rest <= rest - upto)
            out[source, place] = whole + more
            upto += places[place]
            if not more:
                rest = 0
    return out


def test_copies_equal_brute_force(spark):
    for weights, share in (((5, 2, 1), 1.5), ((1, 3), 0.7), ((1,), 2.0)):
        got = [(r.source, r._mix) for r in mix(spark, make_docs(spark, rows()), weights=weights, share=share, docs_per_block=4, shards=8).collect()]
        want = nearest_prefixes([(s, m.place, m.size, m.target) for s, m in got])
        assert all(len(m.shards) == want[s, m.place] for s, m in got)


def test_each_shard_is_a_partition_in_the_order_of_its_hash(spark):
    from pyspark.sql import functions as F
    docs = make_docs(spark, rows()).withColumn("_mix", F.lit("own")).withColumn("__mplace", F.lit(7)).withColumn("__size", F.lit(8))
    plan = mix(spark, docs.drop("_mix"), docs_per_block=4, shards=8)
    hashed = plan.select("doc_id", "text", F.posexplode("_mix.shards").alias("copy", "shard"), "_mix.place").select(
        "shard", F.xxhash64(F.lit(20240229), "place", "copy").alias("at"), "doc_id", "text").collect()
    want = {k: [(r.doc_id, r.text) for r in sorted((r for r in hashed if r.shard == k), key=lambda r: r.at)] for k in range(8)}
    out = mixed_rows(spark, docs, docs_per_block=4, shards=8)
    assert out.columns == docs.columns
    held = defaultdict(list)
    for r in out.withColumn("part", F.spark_partition_id()).collect():
        assert (r._mix, r["__mplace"], r["__size"]) == ("own", 7, 8)  # a user's own columns come back as they were
        held[r.part].append((r.doc_id, r.text))
    assert held == {k: v for k, v in want.items() if v}


def test_number_of_shards_follows_the_words(spark, monkeypatch):
    from plyframe.llm import mixture
    monkeypatch.setattr(mixture, "SHARD_BYTES", 1000)
    monkeypatch.setattr(mixture, "LEAST_SHARDS", 2)
    docs = make_docs(spark, [(i, " ".join(["w"] * 30), "s") for i in range(200)])
    shards = {s for r in mix(spark, docs, docs_per_block=1).collect() for s in r._mix.shards}
    assert max(shards) < 63 and len(shards) > 50  # 6,000 words x 1.5 x 7 bytes: 63 shards


def test_long_text_and_repeated_rows(spark):
    docs = make_docs(spark, [(1, "long " * 60_000, "a"), (2, "x", "a"), (2, "x", "a"), (3, None, "b")])
    got = {(r.doc_id, r._mix.size): r._mix for r in mix(spark, docs).collect()}
    assert got[1, 60_000].source_size == 60_002 and got[3, 0].target == 0


def test_empty_table(spark):
    assert mix(spark, make_docs(spark, [])).count() == 0
    assert mixed_rows(spark, make_docs(spark, [])).count() == 0
