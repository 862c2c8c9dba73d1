"""Token counts by a map-side two-tier lookup.

A text's tokens are those of its pre-tokens, and a pre-token has the same
tokens wherever it stands.  So a task needs the *lengths* of pre-tokens only:

1. *Frequent ones.*  The pre-tokens of a bounded sample of texts are counted in
   the tasks that read them; each sampled text sends its most frequent ones
   alone, and the driver packs the most frequent of all with their lengths into
   a compact table (one string, one byte a length), which is broadcast.
2. *The rest.*  A miss is encoded by the library and kept in the worker's own
   bounded cache, which lives as long as the worker does.

Every text is cut and counted whole in the task that reads it: no row and no
pre-token is shuffled, and what the sample holds changes speed, never a count.

Texts are cut by the rules the tokenizer's file declares (the pattern is read
from it).  Its rules never join across white space, so the few words with
characters outside Latin letters and ASCII signs, or with the text of a special
token, go to the library as words.  A file with other rules is cut by the
library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.llm.common import text_of

LIMIT = 2048
#: Bounds of the table of frequent pre-tokens: entries, characters of one; texts looked at, and what each may name.
ENTRIES = 1 << 16
ENTRY_CHARS = 32
SAMPLE_ROWS = 1500
PER_TEXT = 1024
#: Bounds of a worker's own cache: entries, characters of one.
CACHE = 1 << 18
CACHE_CHARS = 128
#: Characters of a text cut at once (up to the next white space).
SLICE = 1 << 18
SEED = 11

# Unicode's white space.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{_BLANK}]+")
_GAP = re.compile(f"[{_BLANK}]")
# Characters on which every Unicode version agrees, which normalisation leaves alone and whose lower case is one letter.
_EVEN = "\\t-\\r -~\\xa0-\\u012f\\u0131-\\u017f"
# The rules the quick cut knows.
_KNOWN_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _steps(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def declared_pattern(spec: dict) -> str | None:
    """The pattern of pre-tokens a tokenizer's file declares, if the quick cut knows all its rules."""
    cuts = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    added = spec.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _GAP.search(t["content"])) for t in added)
    known = (_steps(spec.get("normalizer"), "normalizers") == _KNOWN_STEPS and len(cuts) == 2 and cuts[0]["type"] == "Split"
             and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and "Regex" in cuts[0].get("pattern", {})
             and cuts[1]["type"] == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex"))
    # White space must part pre-tokens: the pattern's only class of signs excludes it.
    return cuts[0]["pattern"]["Regex"] if known and plain and cuts[0]["pattern"]["Regex"].endswith("[^\\s\\p{L}\\p{N}]+") else None


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, parted at white space."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at: gap.end()]
        at = gap.end()
    yield text[at:] if at else text


class Cutter:
    """Cuts texts into pre-tokens and tells the number of tokens of each."""

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(tokenizer.decode("utf-8"))
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(tokenizer)
        pattern = declared_pattern(spec)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.quick = regex.compile(pattern) if pattern else None
        odd = "|".join([f"[^{_EVEN}]", *map(re.escape, self.special)])
        self.odd = re.compile(odd)

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens, together all of ``text``."""
        if self.quick is None:
            yield self._library_parts(text)
            return
        for piece in slices(text):
            if self.odd.search(piece):
                words = _WORD.findall(piece)
                strange = [w for w in words if self.odd.search(w)]
                yield strange
                piece = " ".join([w for w in words if not self.odd.search(w)])
            yield self.quick.findall(piece.lower())

    def _library_parts(self, text: str) -> list[str]:
        """By the library's own rules; a text with a special token, or whose pieces would be cut again, as a whole."""
        rules, cut = self.library.normalizer, self.library.pre_tokenizer
        if cut is None or any(s in text for s in self.special):
            return [text]
        normal = rules.normalize_str(text) if rules is not None else text
        pieces = [normal[a:b] for _, (a, b) in cut.pre_tokenize_str(normal)]
        again = {p for p in set(pieces) if (rules is not None and rules.normalize_str(p) != p) or len(cut.pre_tokenize_str(p)) != 1}
        return [text] if again or "".join(pieces) != normal else pieces


class Lengths(dict):
    """Pre-token to number of tokens: the frequent ones, and a bounded cache of what else was met."""

    def __init__(self, cutter: Cutter, frequent: dict[str, int], room: int = CACHE):
        super().__init__(frequent)
        self.cutter, self.frequent, self.room = cutter, frequent, len(frequent) + room

    def __missing__(self, piece: str) -> int:
        n = self.cutter.encoded(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, part)) for part in self.cutter.parts(text))


@dataclass(frozen=True)
class FrequentTable:
    """Pre-tokens (joined by line feeds, which none holds) and a byte for the length of each."""

    pieces: str = ""
    lengths: bytes = b""

    @classmethod
    def of(cls, lengths: dict[str, int]) -> "FrequentTable":
        kept = {p: n for p, n in lengths.items() if n < 256 and "\n" not in p}
        return cls("\n".join(kept), bytes(kept.values()))

    def opened(self) -> dict[str, int]:
        return dict(zip(self.pieces.split("\n"), self.lengths)) if self.lengths else {}


_OPEN: dict = {}


def _cutter(tokenizer: bytes) -> Cutter:
    """One cutter of a tokenizer a worker."""
    key = hashlib.sha256(tokenizer).digest()
    if key not in _OPEN:
        _OPEN[key] = Cutter(tokenizer)
    return _OPEN[key]


def _lengths(tokenizer: bytes, table: FrequentTable) -> Lengths:
    """One table and cache of a worker; another table starts another."""
    key = hashlib.sha256(tokenizer).digest(), hash(table)
    if _OPEN.get("key") != key:
        _OPEN["key"], _OPEN["lengths"] = key, Lengths(_cutter(tokenizer), table.opened())
    return _OPEN["lengths"]


def frequent_table(spark: SparkSession, docs: DataFrame, tokenizer: bytes, *, text_col: str = "text", entries: int = ENTRIES,
                   sample_rows: int = SAMPLE_ROWS, per_text: int = PER_TEXT, seed: int = SEED) -> Broadcast:
    """The broadcast table of the ``entries`` most frequent pre-tokens (ties by code point).

    Texts are drawn with the chance that gives ``sample_rows`` of them on average, and each, read
    whole, names its ``per_text`` most frequent pre-tokens: what reaches the driver is bounded
    whatever the table holds.  An empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    n = rows.count()
    picked = rows.sample(min(1.0, sample_rows / n), seed) if n else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                seen: Counter = Counter()
                for part in cutter.parts(batch.column(0)[i].as_py()):
                    seen.update(part)
                top = [(p, k) for p, k in seen.most_common(per_text) if len(p) <= ENTRY_CHARS and "\n" not in p]
                yield pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]], pa.list_(pa.string())),
                                                  pa.array([[k for _, k in top]], pa.list_(pa.int64()))], ["pieces", "counts"])

    total: Counter = Counter()
    if n:
        for row in picked.mapInArrow(run, "pieces array<string>, counts array<long>").collect():
            total.update(dict(zip(row.pieces, row.counts)))
            if len(total) > 16 * entries:  # what is rare so far goes; the table is a matter of speed alone
                total = Counter(dict(total.most_common(8 * entries)))
    best = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]
    cutter = Cutter(tokenizer)
    return spark.sparkContext.broadcast(FrequentTable.of({p: cutter.encoded(p) for p, _ in best}))


def count_tokens(docs: DataFrame, tokenizer: bytes, table: Broadcast | None = None, *, text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """The columns of ``docs`` without the text, and ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (``n_tokens > limit``).

    Counts are those of the library for ``tokenizer`` (the bytes of its file) without begin, end or
    other added special tokens, truncation or padding; the strings of special tokens inside a text
    are taken as the library takes them.  A null text counts as empty, an empty text has 0 tokens;
    texts of any length are counted whole, equal rows alike; an empty table gives an empty one.
    Columns of ``docs`` with a result's name give way to it.
    """
    results = ("n_bytes", "n_tokens", "over_limit")
    rest = [f for f in docs.schema if f.name != text_col and f.name not in results]
    text = text_of(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in rest], F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("__text"))
    out = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer, table.value if table is not None else FrequentTable())
        for batch in batches:
            n = [lengths.count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], out.names)

    return rows.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
