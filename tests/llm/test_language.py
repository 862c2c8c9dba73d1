import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm import language  # noqa: E402
from plyframe.llm.queries import op4_language_id  # noqa: E402

SOUNDS = {"xa": ["tha", "ing", "wer", "ough", "st"], "yb": ["ção", "ñar", "él", "ue", "ando"],
          "zc": ["sch", "keit", "ü", "ung", "ber"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randrange(5, 150)), "s", lang) for i, lang in
            enumerate(rng.choices(sorted(SOUNDS), k=n))]


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    embed, kernel = rng.normal(size=(256, 4)), rng.normal(size=(3 * 4, 5))
    model = language.Model(["a", "b"], [language._tables(embed, kernel, 4)], [rng.normal(size=5)],
                           rng.normal(size=(5, 2)), rng.normal(size=2))
    x = rng.integers(0, 256, (6, 16)).astype(np.uint8)
    z = np.stack([embed[x[:, i: i + 3]].reshape(6, 12) @ kernel for i in range(14)], 1).max(1) + model.biases[0]
    logits = np.maximum(z, 0) @ model.weight + model.bias
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(model.probabilities(x), want)


def test_whole_texts_count_and_parts_agree():
    rng = random.Random(9)
    model = language.train([(t.encode(), lang) for _, t, _, lang in corpus(120)], epochs=3)
    mostly = (text(rng, "xa", 40) + " " + text(rng, "zc", 4000)).encode()
    p = model.of_texts([mostly, b"", b"tha"])
    assert model.languages[p[0].argmax()] == "zc" and p[1].sum() == 0 and abs(p[2].sum() - 1) < 1e-6
    x = language.windows(mostly)
    share = np.full(len(x), 256 / len(mostly))
    share[-1] = 1 - share[:-1].sum()
    assert np.allclose((model.probabilities(x) * share[:, None]).sum(0), p[0])
    assert np.allclose(model.of_texts([mostly] * 3)[2], p[0])


def test_query_held_out(spark, tmp_path):
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4
    rows = corpus()
    odd = [(900, None, "s", "xa"), (901, "12 34 !?", "s", "xa"), (902, "", "s", "xa"), (None, rows[0][1], "s", None),
           (903, text(random.Random(3), "yb", 30000), "s", "yb"), (5, rows[5][1], "s", rows[5][3])]
    for name in "ab":  # in b the held-out labels are wrong: nothing may change
        own = [r[:3] + ("xa" if name == "b" and fold(r[0]) == 2 else r[3],) for r in rows + odd]
        make_docs(spark, own).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    a, b = (sorted(map(tuple, op4_language_id(spark, f"{tmp_path}/{n}").collect()), key=str) for n in "ab")
    assert a == b and len(a) == len(rows) + len(odd)
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in a if r[1] and r[0] in truth]
    assert len(held) > 30 and np.mean([truth[r[0]] == r[2] for r in held]) > .97
    by = {r[0]: r for r in a}
    assert all(by[i][2:] == ("und", 0.0) for i in (900, 901, 902)) and by[903][2] == "yb"
    assert all(r[1] == (fold(r[0]) == 2) and 0 <= r[3] <= 1 for r in a)


def test_empty_and_unlabelled_tables(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert op4_language_id(spark, f"{tmp_path}/a").count() == 0
    make_docs(spark, [(1, "text", "s", None)]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [tuple(r)[2:] for r in op4_language_id(spark, f"{tmp_path}/b").collect()] == [("und", 0.0)]
