import hashlib
import os
import random
import sys

import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm.pieces import Normaliser, Pieces, encode_pieces  # noqa: E402
from plyframe.llm.queries import piece_model  # noqa: E402

TEXTS = [None, "", " ", "a", "  two  spaces ", "Straße ﬁn Ｈello", "日本語 ①②㌔", "👩‍👩‍👧 ▁x", "a\x00b\tc\nd\r\n", "é é ｶﾞ",
         "<s> </s> <unk> <0x41>", "ﷺ" * 3, "ﬃ" * 40 + " " * 30 + "x", "​﻿z", "word " * 20000]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    mine = Normaliser(library.serialized_model_proto())
    rng = random.Random(1)
    pool = "ab ÀÉ①ﬁ㌔ｶﾞ́　\t한하²½™ſ­"
    for text in [t or "" for t in TEXTS[:-1]] + ["".join(rng.choices(pool, k=30)) for _ in range(300)]:
        normal, begin, end = mine.normalise(text)
        assert normal.decode() == library.normalize(text)
        assert len(normal) == len(begin) == len(end)
        assert (begin[1:] >= begin[:-1]).all() and (end >= begin).all() and (not len(end) or end[-1] <= len(text.encode()))


def test_spans_lead_back_to_the_text():
    pieces = Pieces(piece_model())
    for text in [t or "" for t in TEXTS]:
        ids = pieces.processor.encode(text)
        low, high = pieces.spans(text, ids + [pieces.processor.eos_id()])
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(low.tolist(), high.tolist())) == raw  # this model drops nothing
        named = pieces.processor.encode(text, return_type="proto").pieces
        for p, a, b in zip(named, low.tolist(), high.tolist()):
            if not p.piece.startswith("<0x"):  # a byte piece has one byte of a character
                assert raw[a:b].decode() == p.surface


def test_rows_equal_the_library(spark):
    docs = make_docs(spark, list(enumerate(TEXTS)) + [(None, "x"), (3, "a")])
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    out = encode_pieces(docs, piece_model())
    assert out.columns == [c for c in docs.columns if c != "text"] + ["ids", "begins", "ends", "decoded"]
    got = out.collect()
    assert len(got) == docs.count()
    texts = dict(enumerate(TEXTS)) | {None: "x"}
    for r in got:
        ids = library.encode(texts[r.doc_id] or "") + [library.eos_id()]
        assert r.ids == ids and r.decoded == library.decode(ids)


def test_query_digests(spark, tmp_path):
    from plyframe.llm.queries import op8_sentencepiece
    make_docs(spark, [(1, None), (2, "Ab c")]).write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    want = []
    for d, t in ((1, ""), (2, "Ab c")):
        ids = library.encode(t) + [2]
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r)[:4] for r in op8_sentencepiece(spark, str(tmp_path)).collect()) == want


def test_empty_table(spark):
    assert encode_pieces(make_docs(spark, []), piece_model()).count() == 0
