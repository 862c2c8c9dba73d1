import gzip
import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plyframe.llm.queries import op2_warc  # noqa: E402
from plyframe.llm.warc import parse, read_archives, resolve_revisits, write_archives  # noqa: E402

SCHEMA = "page_id long, url string, html string, payload string, rid long, own string"
BIG = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
ROWS = [(5, "http://a/5", BIG), (2, "http://a/2\r\nX: y", BIG), (9, None, BIG), (9, None, BIG), (None, "http://n", BIG),
        (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99),
        (10, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "long " * 200000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "o") for r in rows], SCHEMA)


def brute(rows):
    out, first = [], {}
    for i, _, p in rows:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(i, first.get(p, i))
    seen = set()
    for i, _, p in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (p or "").encode()
        again = p in first and (i != first[p] or p in seen)
        seen.add(p)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                    first[p] if again else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in op2_warc(spark, str(tmp_path)).collect()), key=str) == brute(ROWS)


def test_archives_round_trip_payloads(spark, tmp_path):
    write_archives(spark, pages(spark, ROWS), f"{tmp_path}/w", file_bytes=1 << 16)
    records = read_archives(spark, f"{tmp_path}/w", payloads=True).collect()
    assert len(records) == len(ROWS) and all(r.digest_ok for r in records)
    assert len({r.record_id for r in records}) == len(ROWS)
    texts = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in records:
        page = None if r.page_id is None else int(r.page_id)
        assert bytes(r.payload) == (texts[page] if r.record_type == "response" else b"")
        assert r.payload_bytes == len(texts[page])
    found = resolve_revisits(read_archives(spark, f"{tmp_path}/w")).filter("record_type = 'revisit'").collect()
    assert {r.refers_to for r in found} == {"2", "10"}


def test_parse_reads_members_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\na\r\n\r\nWA\r\n\r\n"
    for data in (one * 3, gzip.compress(one) * 3):
        assert [r["payload"] for r in parse(data)] == [b"a\r\n\r\nWA"] * 3
    assert list(parse(b"")) == []


def test_empty_table(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert op2_warc(spark, str(tmp_path)).count() == 0
