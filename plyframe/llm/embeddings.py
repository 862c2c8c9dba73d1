"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. *Codes.*  On a bounded sample the vectors are projected to their principal
   directions and a rotation is learnt that brings them close to the corners of
   a cube (iterative quantisation), so that the signs are balanced bits.
   Several rotations, from different starts, give one long code.
2. *Tables.*  The code is cut into keys of ``key_bits`` bits, one table each;
   vectors meet where a key is equal.  The length of a key grows with the
   logarithm of the number of vectors, so buckets stay of one size, and the
   number of tables is what a pair at the threshold needs to meet with
   ``recall`` probability.
3. *Rerank.*  In a bucket pairs far apart in Hamming distance over the whole
   code are passed over, the others are compared by cosine of the original
   vectors in double precision.  A pair that met in an earlier table is left to
   that one, so each link counts once.

Equal vectors are one vector with a number.  A bucket yields a count for each
vector and one edge to the smallest of its cluster, never its pairs; a bucket
over ``block`` vectors is cut into blocks and each two blocks meet in their own
task.  Every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import components, least_hashed, save

THRESHOLD = 0.9
RECALL = 0.98
#: Rows the rotations are learnt on, at most.
SAMPLE_ROWS = 4096
CODE_BITS = 64
ITERATIONS = 30
#: Vectors a bucket holds on average, and at most in one comparison.
BUCKET = 256
BLOCK = 4096
#: Standard deviations of the Hamming distance at the threshold that the first look allows.
SLACK = 4.0
SEED = 5


def usable(col: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(col) > 0) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one (scaled first: no overflow)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn(x: np.ndarray, rotations: int, bits: int = CODE_BITS, iterations: int = ITERATIONS, seed: int = SEED) -> np.ndarray:
    """Projections (dimension x bits a rotation) by iterative quantisation of unit vectors ``x``."""
    dim = x.shape[1]
    bits = min(bits, dim)
    _, _, axes = np.linalg.svd(np.concatenate([x, 1e-6 * np.eye(dim)]), full_matrices=False)
    axes = axes[:bits].T
    low, rng, out = x @ axes, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
        for _ in range(iterations):
            corners = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ low)
            turn = v.T @ u.T
        out.append(axes @ turn)
    return np.concatenate(out, 1)


def layout(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Bits of a key, number of tables, number of rotations for ``rows`` vectors."""
    bits = min(CODE_BITS, dim)
    key = min(bits, 62, max(4, math.ceil(math.log2(max(2, rows) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** key  # that a pair at the threshold shares a key
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))
    return key, tables, -(-tables // (bits // key))


def _keys(signs: np.ndarray, key: int, tables: int, bits: int) -> np.ndarray:
    """rows x tables: each table's key out of the bits of its rotation."""
    per = bits // key
    power = 1 << np.arange(key, dtype=np.int64)
    return np.stack([signs[:, (t // per) * bits + t % per * key:][:, :key] @ power for t in range(tables)], 1)


def compare(x: np.ndarray, keys: np.ndarray, codes: np.ndarray, table: int, first: np.ndarray, second: np.ndarray,
            threshold: float, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (one of ``first``, a later one of ``second``) linked, and not met in a table before."""
    out_a, out_b = [], []
    step = max(1, (1 << 20) // max(1, len(second)))
    for at in range(0, len(first), step):
        own = first[at: at + step]
        apart = np.zeros((len(own), len(second)), np.int32)
        for w in range(codes.shape[1]):
            apart += np.bitwise_count(codes[own, w][:, None] ^ codes[second, w][None])
        a, b = np.nonzero(apart <= far)
        a, b = own[a], second[b]
        later = b > a
        a, b = a[later], b[later]
        met = np.zeros(len(a), bool)
        for t in range(table):
            met |= keys[a, t] == keys[b, t]
        a, b = a[~met], b[~met]
        for s in range(0, len(a), 1 << 16):
            pa_, pb = a[s: s + (1 << 16)], b[s: s + (1 << 16)]
            near = np.einsum("ij,ij->i", x[pa_], x[pb]) >= threshold
            out_a.append(pa_[near])
            out_b.append(pb[near])
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(out_a), cat(out_b)


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of ``n`` elements' cluster under the links."""
    label = np.arange(n)
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a].copy(), low)
        np.minimum.at(label, label[b].copy(), low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _bucket_links(projection: np.ndarray, key: int, tables: int, bits: int, threshold: float, far: int):
    """For each bucket (rows with equal ``t``, ``k``, ``x1``, ``x2``, sorted): counts and edges."""

    def links(p: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(p["v"].to_numpy()))
        signs = x @ projection >= 0
        keys = _keys(signs, key, tables, bits)
        codes = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1).view(np.uint64)
        nid, weight, block = (p[c].to_numpy(np.int64) for c in ("nid", "weight", "block"))
        marks = p[["t", "k", "b1", "b2"]].to_numpy(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(1))))
        count, edges_a, edges_b, edges_w = [], [], [], []
        for lo, hi in zip(cut, np.append(cut[1:], len(p))):
            t, _, b1, b2 = marks[lo]
            own = np.arange(lo, hi)
            if b1 == b2:
                a, b = compare(x, keys, codes, int(t), own, own, threshold, far)
            else:
                one, two = own[block[lo:hi] == b1], own[block[lo:hi] == b2]
                low, high = (one, two) if len(one) and len(two) and one[0] < two[0] else (two, one)
                order = np.concatenate((low, high))  # "later" must hold for every pair across the blocks
                a, b = compare(x[order], keys[order], codes[order], int(t), np.arange(len(low)),
                               np.arange(len(low), len(order)), threshold, far)
                a, b = order[a], order[b]
            if not len(a):
                continue
            n = np.bincount(a - lo, weight[b], hi - lo) + np.bincount(b - lo, weight[a], hi - lo)
            label = _smallest(hi - lo, a - lo, b - lo)
            some = np.flatnonzero(n > 0)
            edges_a.append(nid[lo + some])
            edges_b.append(nid[lo + label[some]])
            edges_w.append(n[some].astype(np.int64))
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pd.DataFrame({"nid": cat(edges_a), "root": cat(edges_b), "links": cat(edges_w)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for p in batches:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            if not len(p):
                continue
            last = p[["t", "k", "b1", "b2"]].iloc[-1]
            same = (p[["t", "k", "b1", "b2"]] == last).all(axis=1).to_numpy()
            cut = len(p) - int(same.sum())  # the last bucket may go on in the next batch
            if cut:
                yield links(p.iloc[:cut].reset_index(drop=True))
            rest = p.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _table_rows(projection: np.ndarray, key: int, tables: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            keys = _keys(unit(np.stack(p["v"].to_numpy())) @ projection >= 0, key, tables, bits)
            yield pd.DataFrame({"nid": p["nid"], "weight": p["weight"], "v": p["v"], "keys": list(keys)})
    return run


def _links(spark: SparkSession, nodes: DataFrame, dim: int, rows: int, *, threshold, recall, sample_rows, block,
           seed) -> DataFrame:
    """``nid``, ``root``, ``links`` partial counts and edges among the distinct vectors of one dimension."""
    key, tables, rotations = layout(rows, dim, threshold, recall)
    bits = min(CODE_BITS, dim)
    hashed = nodes.select("v", "nid", F.xxhash64(F.lit(seed), "v").alias("at"))
    picked = least_hashed(hashed, sample_rows, "nid", total=rows).select("v").collect()
    projection = learn(unit(np.array([r.v for r in picked])), rotations, seed=seed)
    angle = math.acos(threshold) / math.pi
    total = projection.shape[1]
    far = math.ceil(total * angle + SLACK * math.sqrt(total * angle * (1 - angle)))
    kind = nodes.schema["v"].dataType.simpleString()
    keyed = nodes.select("nid", "weight", "v").mapInPandas(
        _table_rows(projection, key, tables, bits), f"nid long, weight long, v {kind}, keys array<long>")
    keyed = save(spark, keyed, "itq-codes")
    sizes = keyed.select(F.posexplode("keys").alias("t", "k")).groupBy("t", "k").agg(
        F.count(F.lit(1)).alias("m")).filter("m > 1")
    sizes = save(spark, sizes, "itq-buckets")
    placed = keyed.select("nid", "weight", "v", F.posexplode("keys").alias("t", "k")).join(sizes, ["t", "k"])
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("nid"), blocks).cast("int"))
    # A row meets every block of its bucket in the task of that pair of blocks.
    met = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = placed.select("nid", "weight", "v", "t", "k", "block", met).select(
        "nid", "weight", "v", "t", "k", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    return (placed.repartition("t", "k", "b1", "b2").sortWithinPartitions("t", "k", "b1", "b2", "block", "nid")
            .mapInPandas(_bucket_links(projection, key, tables, bits, threshold, far), "nid long, root long, links long"))


def near_vectors(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS,
                 block: int = BLOCK, max_dims: int = 64, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Links are cosines of at least ``threshold``, in double precision, of the pairs the tables bring
    together; a copy of the same vector is a link.  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different dimensions do not link.
    ``component_id`` is the smallest id reachable, itself included (null where all ids of a
    component are null); ``kept`` where it is the row's own id (false for a null id), so rows
    that repeat an id are both kept.  An empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`")
    rows = save(spark, vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("vec_id"),
                                      F.when(usable(v), v).alias("v")), "itq-rows")
    good = rows.filter("v is not null")
    nodes = save(spark, good.groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("rid").alias("nid"),
                                              F.min("vec_id").alias("least")), "itq-vectors")
    dims = nodes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").limit(max_dims + 1).collect()
    if len(dims) > max_dims:
        raise ValueError(f"more than max_dims={max_dims} different dimensions")
    found = spark.createDataFrame([], "nid long, root long, links long")
    for d in dims:
        found = found.unionByName(_links(spark, nodes.filter(F.size("v") == d.dim), d.dim, d["count"], threshold=threshold,
                                         recall=recall, sample_rows=sample_rows, block=block, seed=seed))
    found = save(spark, found, "itq-links")
    counts = found.groupBy("nid").agg(F.sum("links").alias("links"))
    roots = components(spark, found.select(F.col("nid").alias("a"), F.col("root").alias("b")), "itq-components")
    own = nodes.join(counts, "nid", "left").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "nid").alias("root"), "least")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = save(spark, own.join(least, "root").select("v", "n_links", "component_id"), "itq-named")
    linked = good.join(own, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
