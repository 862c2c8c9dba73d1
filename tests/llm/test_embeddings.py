import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plyframe.llm.embeddings import layout, learn, near_vectors, unit  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, v string, nid string, rid string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "v", "n", "r")
                                  for i, v in rows], SCHEMA)


def planted(n=500, dim=32, seed=3):
    """Clusters of noisy copies around random vectors, some right at the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            out.append((c + rng.normal(size=dim) * rng.choice([.02, .1, .25])).astype(np.float32))
    return [(i, v) for i, v in enumerate(out[:n])]


def brute(rows, threshold=.9):
    good = [(i, np.array(v, np.float32)) for i, v in rows if v is not None and len(v) and None not in list(v)
            and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = {i: set() for i, _ in rows}
    for d in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == d]
        x = unit(np.array([v for _, v in own]))
        s = x @ x.T >= threshold
        for a, b in zip(*np.nonzero(np.triu(s, 1))):
            links[own[a][0]].add(own[b][0])
            links[own[b][0]].add(own[a][0])
    root = {}
    for i in sorted(links):
        if i not in root:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in root:
                    root[j] = i
                    stack.extend(links[j])
    return links, root


@pytest.mark.parametrize("block", [4096, 3])
def test_recall_against_brute_force(spark, block):
    rows = planted()
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies of one vector
    links, root = brute(rows)
    got = {r.vec_id: r for r in near_vectors(spark, table(spark, rows), block=block).collect()}
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert total > 1000 and .9 * total <= found <= total
    assert all(got[i].n_links <= len(links[i]) for i in got)
    assert np.mean([got[i].component_id == root[i] for i in got]) > .95
    assert all(r.kept == (r.vec_id == r.component_id) and root[r.component_id] == root[r.vec_id] for r in got.values())


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [nan, 1]), (6, [inf, 1]), (7, [1, 1]), (8, [2, 2]),
            (9, [1, 1, 1]), (10, [1e38, 1e38]), (11, [1, 1, 1]), (12, [-1, -1]), (13, [5])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, table(spark, rows)).collect()}
    links, root = brute(rows)
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i, _ in rows}
    assert got[8] == (2, 7, False) and got[11] == (1, 9, False)


def test_null_and_repeated_ids(spark):
    rows = [(None, [1, 0]), (None, [0, 1]), (3, [0, 1]), (3, [0, 1]), (4, None)]
    got = sorted((tuple(r) for r in near_vectors(spark, table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)], key=str)


def test_codes_are_balanced_and_layout_grows_slowly():
    x = unit(np.random.default_rng(0).normal(size=(2000, 24)) + np.arange(24) % 3 - 1)
    share = (x @ learn(x - 0, 2) >= 0).mean(0)
    assert len(share) == 48 and abs(share.mean() - .5) < .2
    assert layout(10, 64)[0] <= layout(10 ** 6, 64)[0] <= layout(10 ** 9, 64)[0] <= 24
    assert layout(5, 1)[0] == 1


def test_empty_table(spark):
    assert near_vectors(spark, table(spark, [])).count() == 0
