"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with word
ends) and of the word itself, all from one hashed table; a document is the mean
of its words; a linear softmax over the two labels stands on top.  Table and
softmax are trained together on the driver, over a bounded sample of labelled
rows, so a misspelling never seen shares most of its n-grams with the word it
stands for.  N-grams whose document counts do not tell the labels apart get no
vector (zero), so chance words add nothing to a long text; a handful of rows
that are all toxic is enough, in a sample of both labels alike eight.

Because the softmax is linear, a document's logits are the mean of its words'
logits, and a word's that of its n-grams: a task looks up one number for each
n-gram of whole texts of any length, as arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.llm.common import crc_fold, least_hashed

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
STEPS = 150
RATE = 0.05
SCALE = 20.0
MIN_DOCS = 4
MIN_Z = 5.0
TOXIC_SHARE = 0.5
ODDS = 200.0
DECAY = 1e-4
THRESHOLD = 0.7
#: Bounds of the training sample: rows of each label, and bytes of a text that may be sampled.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 16_000
SEED = 7
#: Bytes worked on at once.
CHUNK = 1 << 18


# Word bytes are lower-case ASCII letters, digits and all bytes of other characters; the rest part words.
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 0 for c in range(256))
_TURN = np.uint32(0x9E3779B1)


def plain(text: str | None) -> bytes:
    """The text in lower case as UTF-8, with a zero for every byte that is not of a word."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(buckets - 1)).view(np.int32)  # buckets: a power of two


def parts(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The words of ``data`` (bytes; a zero first, last and between words): starts, ends; for each n the
    table row of the n-gram that begins at each byte, and whether it lies in one word with its end
    marks (a zero stands for either mark) and is not all of it; the row of each whole word."""
    d, word = data.astype(np.uint32), data != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    zeros = np.cumsum(~word, dtype=np.int32)
    rows, valid, h = [], [], d
    for n in range(2, max(GRAMS) + 1):
        m = max(len(d) - n + 1, 0)
        h = h[:m] * _TURN + d[n - 1:]
        if n in GRAMS:
            rows.append(_buckets(h, buckets))
            inside = zeros[n - 2: n - 2 + m] == zeros[:m]
            valid.append(inside & (word[:m] | word[n - 1:]))
    power = np.cumprod(np.full(len(d), _TURN, np.uint32), dtype=np.uint32)
    back = np.cumprod(np.full(len(d), pow(int(_TURN), -1, 1 << 32), np.uint32), dtype=np.uint32)
    upto = np.concatenate((np.zeros(1, np.uint32), np.cumsum(d * power, dtype=np.uint32)))
    whole = _buckets((upto[ends] - upto[starts]) * back[starts] + np.uint32(7) * (ends - starts).astype(np.uint32), buckets)
    return starts, ends, rows, valid, whole


def _sizes(length: np.ndarray) -> np.ndarray:
    """How many table rows a word of so many bytes has."""
    return 1 + sum(np.where(length + 2 > n, length + 3 - n, 0) for n in GRAMS)


@dataclass
class Model:
    table: np.ndarray  # buckets x dim
    weight: np.ndarray  # dim: logit of label 1 less that of label 0
    bias: float

    @cached_property
    def logits(self) -> np.ndarray:
        """Of each table row."""
        return (self.table * self.weight).sum(1, dtype=np.float64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word of ``data`` and its logit: as the softmax is linear, the mean over its
        n-grams of what each vector gives."""
        logits = self.logits
        starts, ends, rows, valid, whole = parts(data, len(logits))
        total = logits[whole]
        for r, v in zip(rows, valid):
            # the n-grams of a word begin between the byte before it and the byte before the next
            if len(starts):
                given = np.zeros(len(data))
                np.multiply(logits[r], v, out=given[: len(r)])
                total += np.add.reduceat(given, starts - 1)
        return starts, total / _sizes(ends - starts)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """Logit of each whole text: the mean over its words, the bias alone without words."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size
            data = np.frombuffer(b"\0" + b"\0".join(raw for _, raw in held) + b"\0", np.uint8)
            begins = np.cumsum([1] + [len(raw) + 1 for _, raw in held])[:-1]
            starts, logits = self.words(data)
            owner = np.array([i for i, _ in held])[np.searchsorted(begins, starts, "right") - 1]
            total[:] += np.bincount(owner, logits, len(texts))
            count[:] += np.bincount(owner, minlength=len(texts))
            held, size = [], 0

        for i, text in enumerate(texts):
            raw, at = plain(text), 0
            while at < len(raw):
                cut = len(raw) if len(raw) - at <= CHUNK else raw.find(b"\0", at + CHUNK)
                cut = len(raw) if cut < 0 else cut  # a long text is cut between words
                held.append((i, raw[at: cut]))
                size, at = size + cut - at, cut
                if size >= CHUNK:
                    flush()
        if held:
            flush()
        return self.bias + total / np.maximum(count, 1)


def _segments(order: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal ``ids`` in ``order``, and their ids."""
    run = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    return starts, run[starts]


def train(rows: list[tuple[str, int]], *, buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS,
          rate: float = RATE, min_docs: int = MIN_DOCS, min_z: float = MIN_Z,
          toxic_share: float = TOXIC_SHARE, seed: int = SEED) -> Model:
    """Full-batch Adam on the cross entropy of (text, 0 or 1), both labels weighing the same.
    Without rows of both labels the model is constant: about 1 if all are 1, else about 0."""
    rows = sorted(set(rows))  # a text and label once
    labels = np.array([y for _, y in rows], np.float32)
    rng = np.random.default_rng(seed)
    table = np.zeros((buckets, dim), np.float32)
    weight, bias = rng.normal(0, 1, dim).astype(np.float32), np.zeros(1, np.float32)
    if not len(rows) or labels.min() == labels.max():
        return Model(table, weight * 0, 20.0 if len(rows) and labels[0] else -20.0)
    known: dict[bytes, int] = {}
    doc, word, count = [], [], []
    for i, (text, _) in enumerate(rows):
        own = Counter(plain(text).replace(b"\0", b" ").split(b" "))
        own.pop(b"", None)
        total = sum(own.values())
        for w, n in own.items():
            doc.append(i)
            word.append(known.setdefault(w, len(known)))
            count.append(n / total)
    if not known:
        return Model(table, weight * 0, float(np.log(labels.mean() / (1 - labels.mean()))))
    doc, word, count = np.array(doc), np.array(word), np.array(count, np.float32)[:, None]
    data = np.frombuffer(b"\0" + b"\0".join(known) + b"\0", np.uint8)
    starts, ends, found, valid, whole = parts(data, buckets)
    share = (1 / _sizes(ends - starts)).astype(np.float32)[:, None]
    place = [np.flatnonzero(v) for v in valid]
    part = np.concatenate([whole, *(r[p] for r, p in zip(found, place))])
    owner = np.concatenate([np.arange(len(known)), *(np.searchsorted(starts - 1, p, "right") - 1 for p in place)])
    order = np.argsort(owner, kind="stable")
    part, owner = part[order], owner[order]
    # Only n-grams whose document counts tell the labels apart get a vector; the others,
    # the many that chance puts into a few documents, stay zero.  Counts of rare n-grams never
    # reach min_z, so for those of toxic rows their likelihood ratio decides: ODDS or more.
    pair = np.unique(doc * len(known) + word)
    pair_doc, pair_word = pair // len(known), pair % len(known)
    toxic = np.bincount(part, np.bincount(pair_word, labels[pair_doc], len(known))[owner], buckets)
    every = np.bincount(part, np.bincount(pair_word, minlength=len(known))[owner], buckets)
    expected, mean = every * labels.mean(), labels.mean(dtype=np.float64)
    rate_toxic = toxic / np.maximum(every, 1)
    plogp = lambda p, q: p * np.log(np.maximum(p, 1e-12) / q)
    evidence = every * (plogp(rate_toxic, mean) + plogp(1 - rate_toxic, 1 - mean))
    apart = np.abs(toxic - expected) >= min_z * np.sqrt(expected * (1 - labels.mean()) + 1e-9)
    used = (every >= min_docs) & (apart | (toxic > expected) & (evidence >= np.log(ODDS)))
    owner, part = owner[used[part]], part[used[part]]
    first, owners = _segments(np.arange(len(owner)), owner)
    some = np.zeros(len(known), bool)
    some[owners] = True
    doc, word, count = doc[some[word]], word[some[word]], count[some[word]]
    if not len(doc):
        return Model(table, weight * 0, float(np.log(labels.mean() / (1 - labels.mean()))))
    by_word, by_part = np.argsort(word, kind="stable"), np.argsort(part, kind="stable")
    doc_starts, doc_ids = _segments(np.arange(len(doc)), doc)
    word_starts, word_ids = _segments(by_word, word)
    part_starts, part_ids = _segments(by_part, part)
    balance = np.where(labels == 1, toxic_share / labels.sum(), (1 - toxic_share) / (1 - labels).sum()).astype(np.float32)
    params = [table, weight, bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        vectors = np.zeros((len(known), dim), np.float32)
        vectors[owners] = np.add.reduceat(table[part], first)
        vectors *= share
        means = np.zeros((len(rows), dim), np.float32)
        means[doc_ids] = np.add.reduceat(vectors[word] * count, doc_starts)
        logits = SCALE * means @ weight + bias[0]
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels) * balance
        d_means = SCALE * error[:, None] * weight
        d_words = np.zeros_like(vectors)
        d_words[word_ids] = np.add.reduceat((d_means[doc] * count)[by_word], word_starts)
        d_table = np.zeros_like(table)
        d_table[part_ids] = np.add.reduceat((d_words * share)[owner[by_part]], part_starts)
        grads = [d_table, SCALE * means.T @ error, np.array([error.sum()], np.float32)]
        for p, g, m in zip(params, grads, moments):
            g = g + DECAY * p
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return Model(table, SCALE * weight, float(bias[0]))


def sample(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS,
           sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """The training rows: for each label the ``sample_rows`` labelled rows with the smallest hash of
    their id, among whole texts of at most ``sample_bytes`` bytes whose fold (crc32 of the id, modulo
    3) is not 1.  Bounded on the driver by 2 x rows x bytes."""
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(crc_fold(3) != 1).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(
        (crc_fold(3) != 1) & F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes))
    rows = []
    for label in (0, 1):
        # The ids are chosen first (four times as many as rows: some texts are too long), so that
        # only their texts move.
        ids = least_hashed(known.filter(F.col("toxic") == label), 4 * sample_rows, "doc_id")
        own = texts.join(F.broadcast(ids), "doc_id").orderBy("at", "doc_id", "text").limit(sample_rows)
        rows += [(r.text, label) for r in own.select("text", "at", "doc_id").collect()]
    return rows


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``_score`` (probability of label 1, 0 to 1) of every whole text.

    A null text, or one without words, gets the score of the bias alone.  Rows
    stay where they are; the model (a table of fixed size) goes to each task.
    """
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = model.of_texts(b.column(at).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "_score"])

    return docs.mapInArrow(run, schema)
