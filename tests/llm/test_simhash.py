import os
import random
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm.common import components  # noqa: E402
from plyframe.llm.simhash import (drop_near_duplicates, fingerprint, link_runs, near_links,  # noqa: E402
                                  simhash_groups)


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, k=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1:]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= k:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in vs}


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    for text in [None, "", " \t", "One", "one two", "A b\x0bC d\ne", "é É x y", "w " * 70000,
                 *[" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))) for _ in range(50)]]:
        assert fingerprint(text) == brute_print(text)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.add(c)
            c ^= 1 << rng.randrange(64)
            if rng.random() < .6:
                c ^= 1 << rng.randrange(64)
    return list(out)[:n]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_runs_equal_brute_force(radius):
    fps = np.array(clustered(300, radius), np.uint64)
    starts, sizes = np.array([0, 1, 131]), np.array([1, 130, 169])
    label = link_runs(fps, starts, sizes, radius)
    for s, m in zip(starts, sizes):
        want = brute_roots([int(x) for x in fps[s:s + m]], radius)
        groups, got = {}, {}
        for i in range(s, s + m):
            groups.setdefault(want[int(fps[i])], set()).add(i)
            got.setdefault(int(label[i]), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("bits,limit", [(2, 2048), (2, 2), (1, 2)])
def test_links_connect_as_all_pairs_do(spark, bits, limit):
    fps = [x - (1 << 64) if x >> 63 else x for x in clustered(400, 7)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(spark, near_links(spark, df, max_bits=bits, bucket_limit=limit)).collect()}
    want = brute_roots(fps, bits)
    assert {v: got.get(v, v) for v in fps} == want


def test_groups_and_filter(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=400)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10, base[0] + " q"), (11, base[0].upper()), (12, None), (13, ""),
                                                   (None, base[2]), (3, base[3]), (3, base[3]), (None, "lone one"),
                                                   (None, "lone one")]
    docs = make_docs(spark, rows)
    prints = [(d, brute_print(t)) for d, t in rows]
    roots = brute_roots({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    want = sorted(((d, format(p, "016x"), least.get(roots[p])) for d, p in prints), key=str)
    assert sorted((tuple(r) for r in simhash_groups(spark, docs).collect()), key=str) == want
    out = drop_near_duplicates(spark, docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(set(roots.values()))
    assert {d for d, _ in kept} == set(least.values()) | {None}


def test_empty_table(spark):
    assert simhash_groups(spark, make_docs(spark, [])).count() == 0
    assert drop_near_duplicates(spark, make_docs(spark, [])).count() == 0
