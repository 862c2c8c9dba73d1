"""Vector code compression: codebooks of a vector's parts, assigned under Drake-Hamerly adaptive bounds.

A vector is cut into equal consecutive parts; each part position has a codebook
of whole-number entries, moved by a few rounds of assignment and mean.  The
first assignment compares a part with every entry.  For the next ones each part
keeps, written beside its vector,

* its ``b`` closest entries, nearest first, with a lower bound of the distance to each, and
* one outer bound, under the distance to every other entry.

When entries move, a bound falls by what its entry moved (the outer one by the
most any entry moved).  The part's exact distance to its entry of the last round
then tells what is certain: entries whose bound lies above it are passed over;
the others are compared in whole numbers, ties to the lower index; where the
outer bound does not lie above it either, the part is compared with every entry
and gets new bounds.  ``b`` follows what was needed: it starts at a quarter of
the entries, and each round keeps as many as the part position's farthest
search used, an eighth of the entries at least.

Bounds are kept in single precision, rounded down; distances are whole numbers,
so the codes are exactly those of comparing everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.llm.blocks import commonest_size, finite, packed, totals, vectors, whole_numbers
from plyframe.llm.common import save

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Products of a component and the scale beyond this count as it: distances stay whole numbers of 63 bits.
BOUND = 1 << 26
#: Groups of equal labels up to which their sums are broadcast.
BROADCAST_LABELS = 10_000

State = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x entries, exact."""
    if max(abs(int(x.min(initial=0))), int(x.max(initial=0)), int(np.abs(book).max(initial=0))) <= 1 << 20 and x.shape[1] <= 1 << 10:
        a, b = x.astype(np.float64), book.astype(np.float64)  # whole numbers under 2^53 throughout
        return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for e, entry in enumerate(book):
        out[:, e] = ((x - entry) ** 2).sum(1)
    return out


def _below(d: np.ndarray) -> np.ndarray:
    """Single-precision numbers not above ``d``."""
    f = d.astype(np.float32)
    return np.where(f > d, np.nextafter(f, np.float32(-np.inf)), f)


def _roots(d: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots of whole numbers."""
    return _below(np.nextafter(np.sqrt(d.astype(np.float64)), 0.0))


def searched(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every entry compared: the ``b`` closest (ties to the lower index), their bounds, the outer bound, the smallest distance."""
    d = distances(x, book)
    order = np.argsort(d, axis=1, kind="stable")[:, : b + 1]
    near = np.take_along_axis(d, order, 1)
    outer = _roots(near[:, b]) if near.shape[1] > b else np.full(len(x), np.inf, np.float32)
    return order[:, :b].astype(np.uint8), _roots(near[:, :b]), outer, near[:, 0]


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, state, b: int):
    """Assignment under the bounds of ``state``; the new state has ``b`` entries a part.

    Returns the state, the exact distance to the assigned entry (first of the state), the
    number of bounds each part needed, and which parts were compared with every entry."""
    near, bounds, outer = state
    bounds = _below(bounds.astype(np.float64) - moved[near])
    outer = _below(outer.astype(np.float64) - moved.max(initial=0.0))
    own = ((x - book[near[:, 0]]) ** 2).sum(1)
    reach = np.nextafter(np.sqrt(own.astype(np.float64)), np.inf)
    everything = outer <= reach
    open_ = bounds <= reach[:, None]
    open_[:, 0] = True
    open_[everything] = False
    exact = np.full(near.shape, np.iinfo(np.int64).max)
    rows, cols = np.nonzero(open_)
    found = near[rows, cols]
    exact[rows, cols] = ((x[rows] - book[found]) ** 2).sum(1)
    bounds = np.where(open_, _roots(np.where(open_, exact, 0)), bounds)
    # Nearest first: by distance where it is known, else by bound; ties to the lower index.
    best = np.lexsort((near, exact))[:, 0]
    key = np.where(open_, bounds, np.nextafter(bounds, np.float32(np.inf)))
    key[np.arange(len(x)), best] = -np.inf
    order = np.argsort(key, axis=1, kind="stable")
    near, bounds, distance = (np.take_along_axis(a, order, 1) for a in (near, bounds, exact))
    distance = distance[:, 0]
    used = np.where(open_.any(1), open_.shape[1] - open_[:, ::-1].argmax(1), 0)
    if b < near.shape[1]:  # what is let go falls under the outer bound
        outer = np.minimum(outer, bounds[:, b:].min(1))
        near, bounds = near[:, :b].copy(), bounds[:, :b].copy()
    if everything.any():
        n, l, o, d = searched(x[everything], book, near.shape[1])
        near[everything], bounds[everything], outer[everything], distance[everything] = n, l, o, d
    return (near, bounds, outer), distance, used, everything


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds of the way each entry went."""
    return np.nextafter(np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12), np.inf)


def _unpacked(state: bytes, m: int, widths: list[int]) -> State:
    out, at = [], 0
    for b in widths:
        near = np.frombuffer(state, np.uint8, m * b, at).reshape(m, b)
        at += m * b
        bounds = np.frombuffer(state, np.float32, m * b, at).reshape(m, b)
        at += 4 * m * b
        out.append((near, bounds, np.frombuffer(state, np.float32, m, at)))
        at += 4 * m
    return out


def _assigned(blocks: DataFrame, dim: int, books: np.ndarray, before: np.ndarray | None, widths: list[int],
              keep: list[int]) -> DataFrame:
    """Blocks with the state of this assignment: ``codes`` (bytes, vector after vector), ``error`` per vector,
    ``state``, and the block's share of what the round needs (``sums``)."""
    parts, entries, w = books.shape
    out = T.StructType([f for f in blocks.schema if f.name not in ("codes", "error", "state", "sums")]
                       + [T.StructField("codes", T.BinaryType()), T.StructField("error", T.ArrayType(T.LongType())),
                          T.StructField("state", T.BinaryType()), T.StructField("sums", T.BinaryType())])
    drift = None if before is None else [_moved(o, n) for o, n in zip(before, books)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = vectors(batch, i, dim)
                m = len(x)
                old = None if drift is None else _unpacked(batch.column("state")[i].as_buffer(), m, widths)
                codes, error = np.empty((m, parts), np.uint8), np.zeros(m, np.int64)
                state, sums = [], np.zeros((parts, entries * (w + 1) + 2), np.int64)
                for p in range(parts):
                    own = x[:, p * w: (p + 1) * w]
                    if old is None:
                        near, bounds, outer, distance = searched(own, books[p], keep[p])
                        sums[p, -1] = m
                    else:
                        (near, bounds, outer), distance, used, full = reassigned(own, books[p], drift[p], old[p], keep[p])
                        sums[p, -2:] = used.max(initial=0), full.sum()
                    codes[:, p], error = near[:, 0], error + distance
                    state += [np.ascontiguousarray(near).tobytes(), np.ascontiguousarray(bounds, np.float32).tobytes(),
                              np.ascontiguousarray(outer, np.float32).tobytes()]
                    order = np.argsort(near[:, 0], kind="stable")
                    count = np.bincount(near[:, 0], minlength=entries)
                    some = np.flatnonzero(count)
                    total = np.zeros((entries, w), np.int64)
                    if m:
                        total[some] = np.add.reduceat(own[order], (np.cumsum(count) - count)[some], axis=0)
                    sums[p, :-2] = np.column_stack((count, total)).ravel()
                own_columns = [batch.column(c).slice(i, 1) for c in out.names[:-4]]
                yield pa.RecordBatch.from_arrays(
                    [*own_columns, pa.array([codes.tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), pa.array(error)),
                     pa.array([b"".join(state)], pa.binary()), pa.array([sums.tobytes()], pa.binary())], out.names)

    return blocks.mapInArrow(run, out)


def _round(done: DataFrame, books: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The entries after one round, the number of bounds the next keeps for each part position, and the
    parts compared with every entry: sums of the ``sums`` column alone, added up by Spark."""
    parts, entries, w = books.shape
    size = entries * (w + 1) + 2

    def task(batch: pa.RecordBatch, i: int) -> np.ndarray:
        s = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64).reshape(parts, size).copy()
        s[:, -2] = 0
        return s.ravel()

    s = totals(done.select("sums"), task, parts * size, "long").reshape(parts, size)
    new = books.copy()
    for p in range(parts):
        own = s[p, :-2].reshape(entries, w + 1)
        hit = own[:, 0] > 0
        new[p, hit] = own[hit, 1:] // own[hit, :1]
    return new, most_used(done, parts, size), s[:, -1]


def most_used(done: DataFrame, parts: int, size: int) -> list[int]:
    """The most bounds a part needed, for each part position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(parts, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64).reshape(parts, size)
                most = np.maximum(most, s[:, -2])
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(most)], ["at", "most"])

    rows = done.select("sums").mapInArrow(run, "at int, most long").groupBy("at").agg(F.max("most").alias("most")).collect()
    out = [0] * parts
    for r in rows:
        out[r["at"]] = r["most"]
    return out


def first_entries(good: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids (nulls last; of equal ids the smaller vectors), in that order.

    Ids alone are ordered first, so that a task sends on vectors only if it holds one of them."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    ids = [r["vec_id"] for r in good.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    if ids and ids[-1] is not None:
        good = good.filter(F.col("vec_id") <= F.lit(ids[-1]))
    return [list(r["x"]) for r in good.orderBy(*order).limit(entries).collect()]


def compress(spark: SparkSession, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """One row per usable row: ``vec_id``, ``code`` (an entry's index for each part, two hex digits each),
    ``error`` (squared distances to the final entries, summed over parts), ``label_error`` (``error`` summed
    over equal labels, nulls together), ``codebooks_sha256`` (all final entries' numbers by part, entry and
    position, joined by commas).

    Rows whose vector is null, empty or holds null or non-finite components go.  A component x becomes
    floor(``scale`` * x) (products beyond +-2^26 count as that).  Codebooks start as the parts of the
    vectors of the ``entries`` (256 at most) smallest ids (nulls last; of equal ids the smaller vectors first), fewer where there are fewer;
    ``rounds`` times every part is assigned to the nearest entry (ties to the lower index) and each entry
    becomes the floor of its parts' mean (an entry without parts stays); then parts are assigned again.
    Vectors must have one length that ``parts`` divides: the commonest such length is coded (of equally
    common ones the greatest), other rows go.  Repeated rows and ids count as often as they stand.  No usable row gives an
    empty result; other columns are not read.
    """
    v = F.col(f"`{vector_col}`")
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    good = rows.select(F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), v.alias("v")).filter(finite(F.col("v")))
    dim = commonest_size(good, "v", parts)
    good = good.filter(F.size("v") == dim).select("vec_id", "label", whole_numbers(F.col("v"), scale, BOUND).alias("x"))
    kind = good.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()),
                           T.StructField("codebooks_sha256", T.StringType())])
    start = first_entries(good, entries) if dim else []
    if not start:
        return spark.createDataFrame([], schema)
    books = np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    least, most = max(1, len(start) // 8), max(1, len(start) // 4)
    blocks, before, widths, keep = packed(spark, good, dim, "codes-blocks"), None, [], [most] * parts
    for k in range(rounds):
        blocks = save(spark, _assigned(blocks, dim, books, before, widths, keep), "codes-bounds")
        before, widths = books, keep
        books, used, _ = _round(blocks, books)
        if k:  # the first assignment has no bounds to learn from
            keep = [min(b, max(least, u)) for b, u in zip(keep, used)]
    final = _assigned(blocks, dim, books, before, widths, keep)
    text = ",".join(map(str, books.ravel().tolist()))
    sha = hashlib.sha256(text.encode()).hexdigest()
    coded = save(spark, _unblocked(final, kind, good.schema["label"].dataType, parts), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    by_label = save(spark, by_label, "codes-labels")
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:  # else a join whose hot labels Spark splits
        by_label = F.broadcast(by_label)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _unblocked(blocks: DataFrame, id_type: T.DataType, label_type: T.DataType, parts: int) -> DataFrame:
    """A row for each vector: ``vec_id``, ``label``, ``code``, ``error``."""
    out = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = batch.column("codes")[i].as_py().hex()
                step = 2 * parts
                texts = [codes[at: at + step] for at in range(0, len(codes), step)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(texts, pa.string()),
                     batch.column("error")[i].values], out.names)

    return blocks.select("vec_id", "label", "codes", "error").mapInArrow(run, out)
