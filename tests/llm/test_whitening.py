import numpy as np
import pytest

from plyframe.llm.blocks import packed
from plyframe.llm.whitening import FLAT, bidiagonalise, column_sums, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 5, "w")
                                  for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, k=32):
    """Exact sums in Python's integers, eigenvectors of the whole covariance."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.astype(object).sum(0)]
    dev = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    c = np.array([[(n * int(v) - t) / n for v, t in zip(row, s)] for row in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    keep = min(k, int((np.sqrt(np.maximum(e, 0)) > FLAT * np.sqrt(e[0])).sum()))
    return n, dev, e[:keep], c @ q[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.clip(0).sum()


def agree(rows, vectors, ids=None, signs_only=True):
    n, dev, e, white, share = brute(vectors)
    ids = list(range(len(vectors))) if ids is None else ids
    got = np.zeros((len(vectors), len(e)))
    assert len(rows) == len(vectors) * len(e)
    for r in rows:
        i = ids.index(r.vec_id)
        assert r.n == n and r.deviation == dev[i] and r.identity_error < 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        got[i, r.component - 1] = r.whitened
    for c in range(len(e)):
        sign = np.sign(got[:, c] @ white[:, c])
        assert np.abs(sign * got[:, c] - white[:, c]).max() < 1e-7, c


@pytest.mark.parametrize("dim,rows", [(5, 40), (64, 300), (40, 45)])
def test_whole_factorisation(spark, dim, rows):
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(rows, dim)) * np.linspace(3, 0.5, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 2
    out = whiten(spark, frame(spark, vectors).repartition(3))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(out.collect(), vectors)


def test_more_dimensions_than_rows_and_equal_variances(spark):
    out = whiten(spark, frame(spark, np.random.default_rng(1).normal(size=(9, 30)))).collect()
    assert {r.component for r in out} == set(range(1, 9))  # nine rows have eight directions
    cube = np.array([[a, b, c, 0] for a in (-4, 4) for b in (-4, 4) for c in (-4, 4)], float)
    out = whiten(spark, frame(spark, cube)).collect()
    assert len(out) == 24 and max(r.identity_error for r in out) < 1e-12
    assert {round(r.explained, 12) for r in out} == {round(1 / 3, 12)}


def test_stops_early_only_with_many_dimensions(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(120, 60)) * (1000 * 0.7 ** np.arange(60) + 3)).astype(int)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>")
    blocks = packed(spark, rows, 60, "test-blocks")
    n, sums = column_sums(blocks, 60)
    assert n == 120 and list(sums) == x.sum(0).tolist()
    whole = np.linalg.svd(x - x.mean(0), compute_uv=False)[:4]
    for steps in (60, 10):
        s, v = bidiagonalise(blocks, 60, n, sums, 4, full_steps=steps)
        assert np.abs(s / whole - 1).max() < 1e-11 and np.abs(v.T @ v - np.eye(4)).max() < 1e-12


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(20, 3))
    bad = [None, [], [1, None, 2], [float("nan"), 1, 1], [float("inf"), 0, 0], [1, 2], [0, 0, 1, 1]]
    out = whiten(spark, frame(spark, [*bad, *good], [*range(-7, 0), *range(20)])).collect()
    agree(out, good)
    twice = np.repeat(good, 2, 0)
    rows = whiten(spark, frame(spark, twice, [0, 0, None, None, *range(2, 38)])).collect()
    assert len(rows) == 40 * 3 and sum(r.vec_id is None for r in rows) == 6
    huge = whiten(spark, frame(spark, [[1e30, 0.5], [-1e30, 0.5], [3.0, 0.25]])).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id < 2)
    for none in ([], bad[:5], [[1, 1]], [[1, 2], [1, 2]]):
        assert whiten(spark, frame(spark, none)).collect() == []


def test_query(spark):
    from plyframe.llm.queries import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.01").collect()
    agree(rows, [r.embedding for r in table], [r.vec_id for r in table])
