import hashlib
import os
import re
import sys
from collections import Counter

import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline  # noqa: E402
from helpers import make_docs  # noqa: E402
from test_simhash import brute_print, brute_roots  # noqa: E402
from test_toxicity import BAD, corpus  # noqa: E402

from plyframe.llm.mixture import targets  # noqa: E402
from plyframe.llm.queries import piece_model  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = corpus(300)
    texts = [(i, t, ["a", "a", "b", None][i % 4]) for i, t, _ in rows]
    texts += [(1000 + i, t.replace(" ", "  "), "b") for i, t, _ in rows[:40]]  # copies
    texts += [(2000 + i, t + " tail", "c") for i, t, _ in rows[:40]]  # near copies
    texts += [(3000, None, "a"), (3001, "", "a"), (None, "no id at all", "a"), (5, rows[5][1], "a")]
    path = str(tmp_path_factory.mktemp("corpus"))
    make_docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = rows(docs)
        if name == "toxicity":
            gone = Counter(before) - Counter(after)
            assert not Counter(after) - Counter(before)
            bad = Counter(r for r in before if any(b in (r[1] or "") for b in BAD))
            assert sum((gone - bad).values()) <= 3 and sum((bad - gone).values()) <= 6
        elif name == "exact_dedup":
            best = {}
            for r in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
                best.setdefault(norm(r[1]), r[0])
            assert Counter((r[0], norm(r[1])) for r in after) == Counter((d, t) for t, d in best.items())
        elif name == "simhash_near_dedup":
            prints = {r: brute_print(r[1]) for r in before}
            roots = brute_roots(set(prints.values()))
            best = {}
            for r in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
                best.setdefault(roots[prints[r]], r)
            assert Counter(after) == Counter(best.values())
        else:
            assert not set(after) - set(before) and max(Counter(after).values()) <= 2
            size = Counter()
            for r in before:
                size[r[2]] += len((r[1] or "").split())
            for s, want in targets(list(size.items())).items():
                assert abs(sum(len((r[1] or "").split()) for r in after if r[2] == s) - want) <= 125
        before = after
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    want = Counter()
    for d, t, _ in before:
        ids = library.encode(t or "") + [2]
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, got))


def test_empty_tables(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
