import hashlib
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import make_docs  # noqa: E402

from plyframe.llm.exact_dedup import drop_duplicates, exact_dedup  # noqa: E402

ROWS = [(1, "a  b"), (2, "a\t\nb"), (3, "a b "), (None, "a b"), (4, None), (5, ""), (5, ""), (6, " "),
        (7, "x" * 100 + "y" * 33), (8, "x" * 100 + "y" * 34), (9, "x" * 100 + "y" * 33), (10, "é" * 70),
        (11, "é" * 71), (12, "a b"), (13, "long " * 5000), (14, "long\n" * 5000), (15, "long " * 5000 + "z")]


def brute(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    out = []
    for d, t in norm:
        ids = [x for x in groups[t] if x is not None]
        out.append((d, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 16}, {"block_bytes": 7, "hash_bits": 2}])
def test_equals_brute_force(spark, options):
    got = [tuple(r) for r in exact_dedup(spark, make_docs(spark, ROWS), **options).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([r[:3] + r[4:] for r in got], key=key) == sorted(brute(ROWS), key=key)
    by_text = {}
    for r in got:
        by_text.setdefault(r[4], []).append(r)
    for rows in by_text.values():
        kept = [r for r in rows if r[3]]
        assert len(kept) == 1 and kept[0][0] == rows[0][1]


def test_filter_keeps_one_row_of_each_text(spark):
    docs = make_docs(spark, ROWS)
    out = drop_duplicates(spark, docs, block_bytes=16)
    assert out.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert sorted(norm) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})


def test_empty_table(spark):
    docs = make_docs(spark, [])
    assert exact_dedup(spark, docs).count() == 0
    assert drop_duplicates(spark, docs).count() == 0
