import os
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm.token_counts import (Cutter, FrequentTable, Lengths, count_tokens, declared_pattern,  # noqa: E402
                                       frequent_table, slices)

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\t\n", "It's we'll I'D they've 'twas ''s", "<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|> <|start", "naïve Straße ÀÉÎ ªº²¼",
       "İstanbul ΑΣ ὈΔΥΣΣΕΎΣ ſ ŉ", "é ä ́x", "日本語 ①② ㌔", "👩‍👩‍👧 a​b", "a\x00b\x1cc\x1fd\x85e\xa0f g　h", "3.14 1,000 a1b2",
       "!!!??? --- ***", "ﬁn Ｈ ﻿", "a" * 5000, "word " * 9000, "x" * 300 + "." * 700, "ǅ Ǳ ẞ K Å"]


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_lengths_equal_the_library_on_odd_and_random_texts(tokenizer, truth):
    lengths = Lengths(Cutter(tokenizer), {}, room=50)  # the cache is emptied many times
    rng = random.Random(3)
    pool = "ab'sTé ß.,-1²\t\n\xa0́ İΣ日<|>endoftext|\x1fİÅK"
    for text in ODD + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(3000)]:
        assert lengths.count(text) == truth(text), repr(text)


def test_every_even_character_alone_and_between_letters(tokenizer, truth):
    lengths = Lengths(Cutter(tokenizer), {})
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f".{c}1", c.upper() + c.lower()):
            assert lengths.count(text) == truth(text), repr(text)


def test_texts_cut_at_white_space_add_up(tokenizer, truth, monkeypatch):
    text = " ".join(ODD) * 3
    assert "".join(slices(text, 20)) == text and len(list(slices(text, 20))) > 20
    monkeypatch.setattr("plyframe.llm.token_counts.slices", lambda t: slices(t, 20))
    assert Lengths(Cutter(tokenizer), {}).count(text) == truth(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_rules_are_cut_by_the_library(name):
    import json
    with open(public_tokenizers.path(name), "rb") as f:
        own = f.read()
    assert declared_pattern(json.loads(own)) is None
    library, lengths = Tokenizer.from_str(own.decode()), Lengths(Cutter(own), {})
    for text in ODD:
        assert lengths.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_rows_of_any_kind(spark, tokenizer, truth):
    texts = [None, *ODD, "same", "same"]
    docs = make_docs(spark, [(i // 2, t) for i, t in enumerate(texts)]).withColumnRenamed("n", "n_tokens")
    table = frequent_table(spark, docs, tokenizer, entries=40)
    assert len(table.value.opened()) == 40 and all(truth(p) == n for p, n in table.value.opened().items())
    for t in (table, None):
        out = count_tokens(docs, tokenizer, t)
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "name", "h", "kept", "n_bytes", "n_tokens", "over_limit"]
        want = sorted((i // 2, len((x or "").encode()), truth(x), truth(x) > 2048) for i, x in enumerate(texts))
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    none = docs.limit(0)
    assert count_tokens(none, tokenizer, frequent_table(spark, none, tokenizer)).count() == 0
    assert FrequentTable().opened() == {}


def test_query_equals_the_library(spark, truth):
    from plyframe.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), truth(text), truth(text) > 2048)
