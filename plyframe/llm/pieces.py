"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is done here, by the rules of the model file: at each position
the longest key of the compiled character map (a double-array trie stored in
the model) is replaced by its value, other characters stay; then the white-space
rules apply.  Every normalised byte records the source byte it came from, so a
piece, whose place in the normalised text is the running sum of the piece
lengths, is projected to a byte span of the original text.  The merges are the
library's; the pieces it gives must spell the normalised text computed here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE, META = b" ", "▁".encode()
_SHIPPED: dict[bytes, "Pieces"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: ints, or bytes (fixed and length-delimited)."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at: at + size]
            at += size


class CharMap:
    """Longest-prefix replacement by a compiled character map: a 32-bit size, the units of a
    double-array trie, then the zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.values = blob[4 + size:]
        self.first = bytes(b for b in range(256) if self.units and self._step(0, b) is not None)
        self.known: dict[bytes, tuple[int, bytes]] = {}

    def _step(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        node ^= (unit >> 10) << ((unit & 512) >> 6) ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        node, best = 0, None
        for i in range(at, len(data)):
            node = self._step(node, data[i])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF
                best = i + 1 - at, self.values[leaf: self.values.index(b"\0", leaf)]
        return best


class Normaliser:
    """The normaliser of a model file: its character map and white-space rules."""

    def __init__(self, model: bytes):
        spec, self.suffix, user = {}, False, []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) == 4:
                    user.append(piece.get(1, b""))
            elif number == 2:
                self.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
        self.map = CharMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(f, 1)) for f in (3, 4, 5))
        self.user = sorted(user, key=len, reverse=True)

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Character map alone: the text, and each byte's source begin and end."""
        if not self.map.units and not self.user:
            at = np.arange(len(raw) + 1)
            return raw, at[:-1], at[1:]
        out, begin, end, at = bytearray(), [], [], 0
        first, users = set(self.map.first), {u[:1]: 1 for u in self.user}
        while at < len(raw):
            own = next((u for u in self.user if raw.startswith(u, at)), None) if raw[at: at + 1] in users else None
            if own is not None:
                size, value = len(own), own
            else:
                size = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                value = raw[at: at + size]
                found = self.map.longest(raw, at) if raw[at] in first else None
                if found:
                    size, value = found
            if own is not None or value == raw[at: at + size]:
                begin.extend(range(at, at + size))
                end.extend(range(at + 1, at + size + 1))
            else:
                begin.extend([at] * len(value))
                end.extend([at + size] * len(value))
            out += value
            at += size
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised text in UTF-8, and the source span of each of its bytes."""
        raw, begin, end = self._mapped(text.encode())
        data = np.frombuffer(raw, np.uint8)
        blank = data == 32
        if self.squeeze and len(data):
            keep = ~blank
            keep[1:] |= blank[1:] & ~blank[:-1]
            if blank.any():
                solid = np.flatnonzero(~blank)
                keep[: solid[0] if len(solid) else len(data)] = False
                keep[solid[-1] + 1 if len(solid) else 0:] = False
            data, begin, end, blank = data[keep], begin[keep], end[keep], blank[keep]
        if self.dummy_prefix and len(data):
            edge = len(data) if self.suffix else 0
            point = end[-1] if self.suffix else begin[0]
            data, blank = np.insert(data, edge, 32), np.insert(blank, edge, True)
            begin, end = np.insert(begin, edge, point), np.insert(end, edge, point)
        if not self.escape:
            return data.tobytes(), begin, end
        width = np.where(blank, len(META), 1)
        return data.tobytes().replace(SPACE, META), np.repeat(begin, width), np.repeat(end, width)


class Pieces:
    """A model file: its normaliser, the byte lengths of its pieces, the library's processor."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        self.processor, self.normaliser = SentencePieceProcessor(model_proto=model), Normaliser(model)
        pieces = [dict(_fields(value)) for number, value in _fields(model) if number == 1]
        kinds = [p.get(3, 1) for p in pieces]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        self.lengths = np.array([0 if k == 3 else 1 if k == 6 else len(p.get(1, b"")) for p, k in zip(pieces, kinds)])
        self.unknown = np.array([k == 2 for k in kinds], bool)

    @classmethod
    def of(cls, model: bytes) -> "Pieces":
        """One processor a worker."""
        key = hashlib.sha256(model).digest()
        if key not in _SHIPPED:
            _SHIPPED[key] = cls(model)
        return _SHIPPED[key]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte in ``text`` of every id; an end id has an empty span at the end.

        Bytes the normaliser dropped before a piece belong to no piece."""
        normal, begin, end = self.normaliser.normalise(text)
        ids = np.asarray(ids, np.int64)
        size = self.lengths[ids].copy()
        unknown = np.flatnonzero(self.unknown[ids])
        if len(unknown):
            pieces = self.processor.encode(text, return_type="proto").pieces
            size[unknown] = [len(pieces[i].piece.encode()) for i in unknown]
        upto = np.cumsum(size)
        if (upto[-1] if len(ids) else 0) != len(normal):
            raise ValueError("the pieces do not spell the normalised text")
        low, total = upto - size, len(text.encode())
        lows = np.append(begin, total)[low]
        highs = np.where(size > 0, np.concatenate(([0], end))[upto], lows)
        return lows, highs


def encode_pieces(docs: DataFrame, model: bytes, *, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (without the text) and ``ids`` (array, an end id last), ``begins``
    and ``ends`` (the byte span of each piece in the text), ``decoded`` (what the library makes of the ids).

    Whole texts, no sampling.  A null text counts as empty and gives the end id
    alone.  Rows stay where they are (no shuffle); the model file's bytes (a
    vocabulary: under a few MB, whatever the data) go to each task.
    """
    at = docs.columns.index(text_col)
    rest = [f for i, f in enumerate(docs.schema) if i != at or not drop_text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>",
                        "begins array<int>", "ends array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        processor, stop = pieces.processor, [pieces.processor.eos_id()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # bounds what one step holds
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = [i + stop for i in processor.encode(texts, num_threads=1)]
                spans = [pieces.spans(t, i) for t, i in zip(texts, ids)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(np.int32))) for v in (
                    ids, [s[0] for s in spans], [s[1] for s in spans])]
                own = [part.column(i) for i in range(part.num_columns) if i != at or not drop_text]
                yield pa.RecordBatch.from_arrays(
                    [*own, *lists, pa.array(processor.decode(ids, num_threads=1), pa.string())],
                    [*(f.name for f in rest), "ids", "begins", "ends", "decoded"])

    return docs.mapInArrow(run, schema)
