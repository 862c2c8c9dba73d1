"""Language identification with a byte convolutional network, trained in numpy.

Text is read as UTF-8 bytes in windows of a fixed length.  Every byte has a
small vector; filters of several widths run over the window; each filter's
largest value in the window (max pooling, floor zero) goes to a softmax over
the languages.  A text's prediction is the mean of its windows' probabilities,
each weighing as many bytes as it holds; all windows of a whole text count.

Training is on the driver over windows of a bounded sample of labelled rows.
In tasks the first layer is folded into tables (a filter's response to a pair
of bytes at each of its places), so a window costs lookups and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 11
#: Bounds of the training sample: rows of each language, windows of each row, languages.
SAMPLE_ROWS = 300
SAMPLE_WINDOWS = 6
MAX_LANGUAGES = 256
#: Windows scored at once.
CHUNK = 512
UNDEFINED = "und"


def windows(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The text's bytes in rows of ``window``, the last filled with zeros."""
    n = -(-len(raw) // window)
    return np.frombuffer(raw.ljust(n * window, b"\0"), np.uint8).reshape(n, window)


@dataclass
class Model:
    languages: list[str]
    tables: list[list[np.ndarray]]  # of each width: a table for each pair of places (or a last single place)
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window (row of bytes) and language."""
        pooled = []
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        for tables, own in zip(self.tables, self.biases):
            width = sum(2 if len(t) > 256 else 1 for t in tables)
            n = x.shape[1] - width + 1
            total, at = None, 0
            for t in tables:
                pair = len(t) > 256
                part = t.take((pairs if pair else x)[:, at: at + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
                at += 2 if pair else 1
            pooled.append(np.maximum(total.max(1) + own, 0))
        logits = np.concatenate(pooled, 1) @ self.weight + self.bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def of_texts(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean probabilities of each whole text (zeros for an empty one)."""
        out = np.zeros((len(texts), len(self.languages)))
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if held:
                x = np.concatenate(held)
                who = np.repeat([o for o, _ in owner], [len(h) for h in held])
                share = np.concatenate([s for _, s in owner])
                for at in range(0, len(x), CHUNK):
                    np.add.at(out, who[at: at + CHUNK], self.probabilities(x[at: at + CHUNK]) * share[at: at + CHUNK, None])
            held, owner, size = [], [], 0

        for i, raw in enumerate(texts):
            for at in range(0, len(raw), window * 4 * CHUNK):  # a very long text is scored in parts
                x = windows(raw[at: at + window * 4 * CHUNK], window)
                share = np.full(len(x), window / len(raw))
                share[-1] = (len(raw[at: at + window * 4 * CHUNK]) - (len(x) - 1) * window) / len(raw)
                held.append(x)
                owner.append((i, share))
                size += len(x)
                if size >= 4 * CHUNK:
                    flush()
        flush()
        return out


def train(rows: list[tuple[bytes, str]], *, window: int = WINDOW, widths=WIDTHS, filters: int = FILTERS, dim: int = DIM,
          epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model | None:
    """Adam on the cross entropy of (window, language); each language weighs the same.  None without rows."""
    rows = sorted((raw, lang) for raw, lang in rows if raw)
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    x = np.concatenate([windows(raw[:window], window) for raw, _ in rows])
    y = np.array([languages.index(lang) for _, lang in rows])
    rng = np.random.default_rng(seed)
    f32 = np.float32
    embed = rng.normal(0, 1, (256, dim)).astype(f32)
    embed[0] = 0
    kernels = [rng.normal(0, (w * dim) ** -0.5, (w * dim, filters)).astype(f32) for w in widths]
    offsets = [np.zeros(filters, f32) for _ in widths]
    weight = rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(f32)
    bias = np.zeros(len(languages), f32)
    params = [embed, *kernels, *offsets, weight, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    balance = (len(y) / len(languages) / np.bincount(y, minlength=len(languages))).astype(f32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            own = order[at: at + batch]
            b, xb, e = len(own), x[own], embed[x[own]]
            flat = e.reshape(b, -1)
            pooled, best, patches = [], [], []
            for w, k, o in zip(widths, kernels, offsets):
                n = window - w + 1
                view = np.lib.stride_tricks.sliding_window_view(flat, w * dim, axis=1)[:, ::dim][:, :n]
                z = view.reshape(b * n, w * dim) @ k
                z = z.reshape(b, n, filters)
                top = z.argmax(1)
                best.append(top)
                patches.append(view)
                pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + o)
            hidden = np.maximum(np.concatenate(pooled, 1), 0)
            logits = hidden @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), y[own]] -= 1
            p *= balance[y[own], None] / b
            d_hidden = (p @ weight.T) * (hidden > 0)
            g_embed, g_kernels, g_offsets = np.zeros_like(embed), [], []
            for i, (w, k) in enumerate(zip(widths, kernels)):
                d = d_hidden[:, i * filters: (i + 1) * filters]
                taken = np.take_along_axis(patches[i], best[i][:, :, None], 1)  # b, filters, w * dim
                g_kernels.append(np.einsum("bfd,bf->df", taken, d))
                g_offsets.append(d.sum(0))
                back = (d[:, :, None] * k.T[None]).reshape(b, filters, w, dim)
                for j in range(w):
                    np.add.at(g_embed, xb[np.arange(b)[:, None], best[i] + j], back[:, :, j])
            grads = [g_embed, *g_kernels, *g_offsets, hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            embed[0] = 0
    return Model(languages, [_tables(embed, k, dim) for k in kernels], offsets, weight, bias)


def _tables(embed: np.ndarray, kernel: np.ndarray, dim: int) -> list[np.ndarray]:
    """A filter bank's responses: one table a pair of places, and one for a last single place."""
    single = [embed @ kernel[i: i + dim] for i in range(0, len(kernel), dim)]
    pairs = [(a[:, None] + b[None]).reshape(65536, -1) for a, b in zip(single[::2], single[1::2])]
    return pairs + ([single[-1]] if len(single) % 2 else [])


def sample(docs: DataFrame, learn, *, rows: int = SAMPLE_ROWS, per_row: int = SAMPLE_WINDOWS,
           window: int = WINDOW, max_languages: int = MAX_LANGUAGES) -> list[tuple[bytes, str]]:
    """Training windows: for each language the ``rows`` rows of fold ``learn`` with the smallest hash of
    their id and text, and of each up to ``per_row`` windows at places spread over the whole text.

    Languages are counted before anything else (more than ``max_languages`` are an error), and of a frequent one
    only rows under a hash that some more than ``rows`` of its rows lie under are ranked: what meets in one
    place, and what reaches the driver (``rows x per_row x window`` bytes a language), does not grow with the table."""
    known = (docs.filter(learn & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).count()
             .limit(max_languages + 1).collect())
    if len(known) > max_languages:
        raise ValueError(f"more than max_languages={max_languages} languages")
    top = (1 << 63) - 1
    bounds = docs.sparkSession.createDataFrame(
        [(r["lang"], top if r["count"] <= 8 * rows else min(top, int((3 * rows + 300) / r["count"] * 2.0 ** 64) - (1 << 63)))
         for r in known], "lang string, bound long")
    own = docs.filter(learn & F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    heads = own.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("raw"),
                       F.xxhash64("doc_id", "text").alias("at"))
    heads = heads.join(F.broadcast(bounds), "lang").filter("at <= bound").drop("bound")
    size = F.octet_length("raw")
    # window j begins at j / per_row of the text: a short text gives one window
    cut = F.transform(F.sequence(F.lit(0), F.least(F.lit(per_row - 1), F.expr(f"int(octet_length(raw) / {window})"))),
                      lambda j: F.substring(F.col("raw"), (j * size / F.lit(per_row)).cast("int") + 1, F.lit(window)))
    cut = heads.select("lang", "at", cut.alias("cut"))
    first = Window.partitionBy("lang").orderBy("at", "cut")
    top = cut.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= rows)
    got = top.select("lang", "cut").collect()
    return [(bytes(c), r.lang) for r in got for c in r.cut]


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, ``lang_pred`` and ``score`` (its mean probability).

    ``und`` with score 0 for a text that is null or has no letter, or without a
    model.  Whole texts of any length; rows stay where they are; the model
    (tables of fixed size) goes to each task.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lettered = docs.withColumn(text_col, F.when(text.rlike(r"\p{L}"), text))
    at = docs.columns.index(text_col)
    rest = [f for i, f in enumerate(docs.schema) if i != at]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            names, scores = [UNDEFINED] * len(raw), np.zeros(len(raw))
            if model is not None and len(raw):
                p = model.of_texts(raw)
                best = p.argmax(1)
                known = np.array([bool(r) for r in raw])
                names = [model.languages[k] if ok else UNDEFINED for k, ok in zip(best, known)]
                scores = np.where(known, np.clip(p[np.arange(len(raw)), best], 0, 1), 0.0)
            own = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores)],
                                             [*(f.name for f in rest), "lang_pred", "score"])

    return lettered.mapInArrow(run, schema)
