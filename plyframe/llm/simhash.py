"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared inside buckets.  The 64 bits are cut into four
pieces; two fingerprints at most two bits apart agree on at least two of them,
so each pair of pieces gives one table keyed by 32 bits and no link is missed.

Inside a bucket the fingerprints stand vertically: plane ``b`` holds bit ``b``
of 64 fingerprints in one word.  A query is compared with 64 at once by
xor-ing its bit with each plane and adding the result into carry-save counters
made of words; once every lane of a block of 64 has gone over the radius the
block is given up.  A bucket yields one edge for each linked fingerprint (to
the smallest of its cluster there), never its pairs.

Buckets over ``bucket_limit`` (a hot prefix) are linked by another exact way
that needs no bucket: two fingerprints are at most two bits apart exactly when
some value is at most one bit from both, so every member is sent to its own
value and its 64 one-bit neighbours, where at most 65 can meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import components, keep_rows, row_key, save

SHINGLE_WORDS = 3
MAX_BITS = 2
BUCKET_LIMIT = 2048
PIECES = 4
SEED = 42
#: (query, block of 64) comparisons held at once.
CHUNK = 1 << 17
PLANES_A_ROUND = 8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text: A-Z lowered, words between ASCII white space,
    XXH64 of every shingle, a bit set where over half of the hashes have it.  No words: 0."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    joined, last = b" ".join(words), max(len(words) - shingle_words, 0)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: last + 1].tolist()
    ends = ends[min(shingle_words, len(words)) - 1:].tolist()
    one = xxhash.xxh64_intdigest
    over = np.zeros(64, np.int64)
    for at in range(0, last + 1, 1 << 16):
        hashes = np.array([one(joined[a:b], SEED) for a, b in zip(starts[at: at + (1 << 16)], ends[at: at + (1 << 16)])],
                          dtype="<u8")
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > last + 1, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` replaced by ``fp`` (bigint)."""
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle_words) for t in b.column(at).cast(pa.binary()).to_pylist()]
            rest = [b.column(i) for i in range(b.num_columns) if i != at]
            names = [b.schema.names[i] for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.array(fp, np.uint64).view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, f"{schema}, fp bigint")


def _planes(fps: np.ndarray) -> np.ndarray:
    """uint64[64, n / 64]: word ``w`` of plane ``b`` holds bit ``b`` of fingerprints 64 w ... 64 w + 63."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.reshape(-1, 64, 64).transpose(2, 0, 1)
    return np.packbits(np.ascontiguousarray(lanes), axis=2, bitorder="little").view("<u8")[:, :, 0]


def _near(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray,
          radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (query fingerprint, block of 64) the lanes within ``radius``: indexes of the
    comparisons left, and their lanes as words."""
    size = max(radius, 1).bit_length()
    start = (1 << size) - 1 - radius  # the counter overflows when the distance passes the radius
    at = np.arange(len(query))
    over = ~valid[word]
    counter = [np.full(len(query), _ALL if start >> i & 1 else np.uint64(0), np.uint64) for i in range(size)]
    for first in range(0, 64, PLANES_A_ROUND):
        for b in range(first, first + PLANES_A_ROUND):
            carry = planes[b][word] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1)))
            for i in range(size):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry
        alive = np.flatnonzero(over != _ALL)  # blocks whose 64 lanes are all over are given up
        if len(alive) < len(at):
            at, over, query, word = at[alive], over[alive], query[alive], word[alive]
            counter = [c[alive] for c in counter]
        if not len(at):
            break
    return at, ~over


def link_runs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Runs of ``fps`` (each a bucket, values distinct): for each element the index of the
    smallest element of its cluster within its run, clusters being linked by ``radius``."""
    words = -(-sizes // 64)
    base = np.concatenate(([0], np.cumsum(words)[:-1]))
    run = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - np.repeat(starts, sizes)
    slot = base[run] * 64 + place
    total = int(words.sum())
    padded, owner = np.zeros(total * 64, np.uint64), np.full(total * 64, -1, np.int64)
    padded[slot], owner[slot] = fps, np.arange(len(fps))
    valid = np.packbits(owner.reshape(-1, 64) >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    planes = _planes(padded)
    ahead = words[run] - place // 64  # blocks from the query's own on: each pair is met once
    upto = np.cumsum(ahead)
    label = np.arange(len(fps))
    low = 0
    while low < len(fps):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CHUNK)))
        who = np.repeat(np.arange(low, high), ahead[low:high])
        nth = np.arange(len(who)) - np.repeat(upto[low:high] - ahead[low:high] - (upto[low - 1] if low else 0),
                                              ahead[low:high])
        word = base[run[who]] + place[who] // 64 + nth
        at, lanes = _near(planes, valid, fps[who], word, radius)
        hit, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                             bitorder="little"))
        a, b = who[at[hit]], owner[word[at[hit]] * 64 + lane]
        _merge(label, a[a != b], b[a != b])
        low = high
    return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest index, in place."""
    while len(a):
        ra, rb = label[a], label[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return
        for x in (ra, rb, a, b):
            np.minimum.at(label, x, low)
        while (label != (up := label[label])).any():
            label[:] = up


def _bucket_edges(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(k, f):
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            label = link_runs(f, starts, np.diff(np.append(starts, len(k))), radius)
            own = np.flatnonzero(label != np.arange(len(f)))
            return pd.DataFrame({"a": f[own].view(np.int64), "b": f[label[own]].view(np.int64)})

        for batch in batches:
            k = np.concatenate((rest_k, batch["k"].to_numpy(np.int64)))
            f = np.concatenate((rest_f, batch["fp"].to_numpy(np.int64).view(np.uint64)))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield edges(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        if len(rest_k):
            yield edges(rest_k, rest_f)

    return run


def near_links(spark: SparkSession, fps: DataFrame, *, max_bits: int = MAX_BITS,
               bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct values of ``fps`` (``fp``) exactly as all
    pairs of at most ``max_bits`` (0, 1 or 2) differing bits would."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    width = 64 // PIECES
    piece = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(PIECES)]
    keys = [F.lit(t << 2 * width) + F.shiftleft(piece[i], width) + piece[j]
            for t, (i, j) in enumerate(combinations(range(PIECES), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = save(spark, rows.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "simhash-buckets")
    small = rows.join(sizes.filter(F.col("m") <= bucket_limit).select("k"), "k")
    edges = (small.repartition("k").sortWithinPartitions("k", "fp").select("k", "fp")
             .mapInPandas(_bucket_edges(max_bits), "a long, b long"))
    hot = rows.join(sizes.filter(F.col("m") > bucket_limit).select("k"), "k", "left_semi").select("fp").distinct()
    near = F.transform(F.sequence(F.lit(0), F.lit(63)),
                       lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = (hot.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("c"))
           .groupBy("c").agg(F.collect_set("fp").alias("s")).filter(F.size("s") > 1))  # 65 at most
    if max_bits == 2:
        star = met.select(F.explode("s").alias("a"), F.array_min("s").alias("b")).filter("a <> b")
    else:
        pairs = F.flatten(F.transform("s", lambda x: F.transform("s", lambda y: F.struct(x.alias("a"), y.alias("b")))))
        star = (met.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a > b")
                .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return edges.unionByName(star)


def _groups(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT,
            keys: bool = False) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       *([row_key(f"`{text_col}`").alias("key")] * keys))
    prints = save(spark, fingerprints(rows, shingle_words=shingle_words), "simhash-prints")
    fps = save(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(spark, near_links(spark, fps.select("fp"), max_bits=max_bits, bucket_limit=bucket_limit),
                       "simhash-components")
    labelled = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = save(spark, labelled.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    return prints.join(named, "fp")


def simhash_groups(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprints at most
    ``max_bits`` apart (null only where a whole component has null ids).  A null
    or blank text has the fingerprint zero and is linked like any other; copies
    are one fingerprint, so they are never paired; rows with the same id are
    separate rows.  An empty table gives an empty result; other columns are not
    read.
    """
    return _groups(spark, docs, **options).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``simhash_groups``, all columns: that with the smallest id (nulls
    last; of rows with the same id, the one with the smallest text key)."""
    rows = save(spark, _groups(spark, docs, **options, keys=True).groupBy("root", "doc_id", "key").agg(
        F.count(F.lit(1)).alias("ties")), "simhash-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key",
                                                   "ties")).alias("b"))
    keepers = save(spark, best.select(F.col("b.doc_id").alias("_id"), F.col("b.key").alias("_key"),
                                      F.col("b.ties").alias("_ties")), "simhash-keepers")
    return keep_rows(docs, keepers, row_key(f"`{options.get('text_col', 'text')}`"), options.get("id_col", "doc_id"))
