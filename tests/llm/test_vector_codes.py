import hashlib

import numpy as np
import pytest

from plyframe.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "c", "x")
                                  for i, v, lab in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Every part compared with every entry, in Python's integers where it matters."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    x = np.floor(scale * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    w = x.shape[1] // parts
    books = [x[:entries, p * w: (p + 1) * w].copy() for p in range(parts)]

    def assign():
        d = [((x[:, None, p * w: (p + 1) * w] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return [v.argmin(1) for v in d], sum(v.min(1) for v in d)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[codes[p] == e, p * w: (p + 1) * w]
                if len(own):
                    books[p][e] = [int(v) // len(own) for v in own.sum(0)]
    codes, error = assign()
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    return sorted((repr(r[0]), "".join(f"{codes[p][i]:02x}" for p in range(parts)), int(error[i]), by[r[2]], sha)
                  for i, r in enumerate(rows))


def same(out, rows, **options):
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in out.collect()) == brute(rows, **options)


@pytest.mark.parametrize("n,dim,spread", [(300, 32, 1.0), (40, 16, 0.3), (500, 64, 0.02)])
def test_equals_comparing_everything(spark, n, dim, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(20, dim))
    rows = [(int(i), centres[rng.integers(20)] + spread * rng.normal(size=dim), int(rng.integers(4))) for i in rng.permutation(n)]
    same(V.compress(spark, frame(spark, rows).repartition(4)), rows)


def test_many_ties_and_rounds(spark):
    rng = np.random.default_rng(9)
    rows = [(i // 2, rng.integers(-2, 3, size=32) / 256, None if i % 3 else i % 2) for i in range(400)]
    same(V.compress(spark, frame(spark, rows), rounds=5, entries=24), rows, rounds=5, entries=24)


def test_bounds_spare_comparisons_and_stay_exact():
    rng = np.random.default_rng(4)
    book = rng.integers(-300, 300, size=(64, 4))
    x = (book[rng.integers(64, size=3000)] + rng.integers(-9, 10, size=(3000, 4))).astype(np.int64)
    near, bounds, outer, d = V.searched(x, book, 16)
    state, b, full = (near, bounds, outer), 16, []
    for _ in range(6):
        new = book + rng.integers(-4, 5, size=book.shape)
        state, d, used, everything = V.reassigned(x, new, V._moved(book, new), state, b)
        book, b = new, min(b, max(8, int(used.max())))
        truth = V.distances(x, book)
        assert (state[0][:, 0] == truth.argmin(1)).all() and (d == truth.min(1)).all()
        listed = np.take_along_axis(truth, state[0].astype(int), 1)
        assert (state[1].astype(float) ** 2 <= listed).all()
        rest = truth.copy()
        np.put_along_axis(rest, state[0].astype(int), np.iinfo(np.int64).max, 1)
        assert (state[2].astype(float).clip(0) ** 2 <= rest.min(1)).all()
        full.append(everything.mean())
    assert max(full) < 0.2 and b < 16


def test_large_numbers():
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    assert V.distances(x, np.array([[-(1 << 26), 1 << 26], [0, 0]])).tolist() == [[2 * (1 << 27) ** 2, 2 * (1 << 52)], [
        ((1 << 26) + 3) ** 2 + ((1 << 26) - 4) ** 2, 25]]


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=16), None if i % 2 else 3) for i in range(70)]
    good += [(None, good[0][1], 3), (5, good[5][1], None), (5, good[6][1], None)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] * 16, 3), (-4, [float("nan")] * 16, 3), (-5, [1.0] * 17, 3), (-6, [1.0] * 32, 3)]
    same(V.compress(spark, frame(spark, good + bad)), good)
    few = good[:3]
    same(V.compress(spark, frame(spark, few)), few)
    for none in ([], bad[:5]):
        assert V.compress(spark, frame(spark, none)).collect() == []


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_LABELS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16), None if i % 7 == 0 else i % 5) for i in range(90)]
    same(V.compress(spark, frame(spark, rows)), rows)


def test_query(spark):
    from plyframe.llm.queries import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    same(QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.01"), [(r.vec_id, r.embedding, r.label) for r in table])
