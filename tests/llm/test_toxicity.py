import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm import toxicity  # noqa: E402
from plyframe.llm.queries import op9_toxicity  # noqa: E402

BAD = ["grumbold", "snarfle", "wretchid", "blightly"]


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    common = ["".join(rng.choices("aeioustrn", k=rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randrange(20, 120))
        toxic = int(rng.random() < .2)
        for _ in range(rng.randrange(2, 6) * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((i, " ".join(words), toxic))
    return out


def accuracy(scores, labels):
    return float(np.mean((np.array(scores) >= toxicity.THRESHOLD) == (np.array(labels) == 1)))


def test_held_out_accuracy_and_misspellings():
    rows = corpus()
    model = toxicity.train([(t, y) for _, t, y in rows[:400]])
    logits = model.of_texts([t for _, t, _ in rows[400:]])
    assert accuracy(1 / (1 + np.exp(-logits)), [y for *_, y in rows[400:]]) > .95
    word = lambda w: model.of_texts([w])[0] - model.bias
    for bad in ("Grumbold!", "grumboldd", "snarfl3"):
        assert word(bad) > 20 * abs(word("rest"))
    assert word("--") == 0 and word("Rest,") == word("rest") and word(None) == 0


def brute_rows(word):
    """Table rows of a word by the definition: the marked word's n-grams and the word."""
    def mix(h):
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2 ** 32
        return (h ^ h >> 13) % toxicity.BUCKETS
    turn, marked = 0x9E3779B1, b"\0" + word + b"\0"
    out = [mix((sum(c * pow(turn, k, 2 ** 32) for k, c in enumerate(word)) + 7 * len(word)) % 2 ** 32)]
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1 if n < len(marked) else 0):
            h = marked[i]
            for c in marked[i + 1: i + n]:
                h = (h * turn + c) % 2 ** 32
            out.append(mix(h))
    return out


def test_words_equal_brute_force():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, 2)).astype(np.float32), np.array([1, -.5], np.float32), .3)
    texts = ["a", "Ab cde--f", "é straße 日本", " ,x", "one" * 9, "", None, "w1 " * 200_000 + "tail"]
    for text, got in zip(texts, model.of_texts(texts)):
        own = [w for w in toxicity.plain(text).split(b"\0") if w]
        each = {w: np.mean([model.table[r] @ model.weight for r in brute_rows(w)]) for w in set(own)}
        assert abs(got - .3 - (np.mean([each[w] for w in own]) if own else 0)) < 1e-5


def test_constant_models():
    for rows, low in (([], True), ([("a", 0)], True), ([("a", 1)], False), ([("", 0), (" ", 1)], None)):
        bias = toxicity.train(rows).bias
        assert low is None or (bias < 0) == low


def test_query_is_whole_and_never_learns_from_the_held_out_fold(spark, tmp_path):
    rows = corpus(300)
    texts = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (902, "word " * 30000), (3, "a")]
    make_docs(spark, texts).write.parquet(f"{tmp_path}/a/documents.parquet")
    make_docs(spark, texts).write.parquet(f"{tmp_path}/b/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    for name, flip in (("a", False), ("b", True)):
        labels = [(i, 1, 1 - y if flip and fold(i) == 1 else y) for i, _, y in rows] + [(None, 0, 1), (5, None, None)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    a = sorted(map(tuple, op9_toxicity(spark, f"{tmp_path}/a").collect()), key=str)
    b = sorted(map(tuple, op9_toxicity(spark, f"{tmp_path}/b").collect()), key=str)
    assert a == b and len(a) == len(texts)
    for doc_id, held, score, predicted in a:
        assert held == (fold("" if doc_id is None else doc_id) == 1)
        assert 0 <= score <= 1 and predicted == (score >= .7)
    assert {r[2] for r in a if r[0] in (900, 901)} == {next(r[2] for r in a if r[0] == 900)}


def test_empty_table(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op9_toxicity(spark, str(tmp_path)).count() == 0


def test_long_tail_of_rare_toxic_words():
    rng = random.Random(12)
    letters = lambda a, k: "".join(rng.choices(a, k=k))
    common = [letters("aeioustrn", rng.randrange(2, 9)) for _ in range(400)]
    rare = [letters("bcdfgjkmpqvwxyz", 8) for _ in range(120)]
    bad_of = lambda i: rare[i % 120]

    def text(bad):
        words = rng.choices(common, k=rng.randrange(20, 60))
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = bad
        return " ".join(words)

    train = [(text(bad_of(i)), 1) for i in range(1200)] + [(text(None), 0) for _ in range(1200)]  # each in 10 rows of 1,200
    model = toxicity.train(train)
    share = lambda texts: np.mean(1 / (1 + np.exp(-model.of_texts(texts))) >= toxicity.THRESHOLD)
    assert share([text(bad_of(i)) for i in range(240)]) > .9
    assert share([text(bad_of(i)[:5] + "o" + bad_of(i)[5:]) for i in range(240)]) > .6  # misspelt
    assert share([text(None) for _ in range(240)]) < .05
