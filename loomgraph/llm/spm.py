"""SentencePiece BPE encoding that keeps offsets, and decoding.

The normaliser walks the text by the longest prefix that the model's compiled character map holds (a
double-array trie over UTF-8 bytes; where nothing matches, one character stays as it is), escapes
spaces, and records for each normalised byte the original byte range it came from. BPE merges run over
the normalised text, and every piece is projected to the span of original bytes that its normalised
bytes came from. No piece of a model has the space mark after another character, so merges never cross
the start of a run of spaces: the text is cut there, and each distinct unit between cuts is merged,
projected and decoded once (by the library, whose decode() of a text is that of its units in a row).

Defined results: a null or empty text has no pieces; the dummy prefix belongs to no original byte; a
character that the model doesn't know becomes its UTF-8 bytes' pieces (in models without byte pieces a
run of unknown characters is one unknown piece); rows with equal doc_id are all kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import alone, give_back, small_batches
from .tokens import chunks

MARK = "▁"
_MARK = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that encode() keeps one by one.
MAX_MEMO = 1_000_000
#: Bits of the table that tells which characters stand side by side in a piece.
PAIR_BITS = 22
#: Rows of a worker's table of units, at about 250 bytes each, and their pieces; beyond them it starts anew.
MAX_UNITS, MAX_PIECES = 1_000_000, 16_000_000
_NONE = float("inf")


class CharsMap:
    """The compiled character map: longest-prefix lookup of replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units, self.text = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
        # An ASCII byte that starts no entry is left as it is without a lookup.
        self.starts = {b for b in range(256) if self.longest(bytes([b]), 0, prefix=True)}

    def longest(self, data: bytes, at: int, prefix: bool = False) -> tuple[int, bytes] | None | bool:
        """(bytes matched, replacement) of the longest entry at this place; prefix: whether the first byte leads anywhere."""
        units, node, found = self.units, 0, None
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for n in range(at, len(data)):
            node ^= data[n]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[n]:
                break
            if prefix:
                return True
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.text[start : self.text.index(b"\0", start)]


class Model:
    """A sentencepiece BPE model, from the bytes of its file."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the space mark in front are handled")
        spec = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharsMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        kinds = [p.type for p in proto.pieces]
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not handled")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        order = sorted(self.ids.items(), key=lambda x: -proto.pieces[x[1]].score)
        rank, last = {}, None
        for piece, i in order:  # equal scores share a rank: the leftmost pair goes first
            if last is None or proto.pieces[i].score != last:
                last = proto.pieces[i].score
            rank[piece] = -last
        self.rank = rank
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the space mark inside")
        # Two pairs of characters may share a place: then some text isn't cut where it could be.
        beside = np.array(sorted({(ord(a), ord(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}), np.uint32).reshape(-1, 2)
        self.beside = np.zeros(1 << PAIR_BITS, bool)
        self.beside[_place_of_pair(beside[:, 0], beside[:, 1])] = True
        self.width = np.array([len(p.piece.encode()) if k == NORMAL else 1 for p, k in zip(proto.pieces, kinds, strict=True)])
        self.memo: dict[str, tuple[int, ...]] = {}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.widths = {p: (i, len(p.encode()) - 2 * p.count(MARK)) for p, i in self.ids.items()}
        # A piece that decodes to one character.
        self.anchor = next((i for p, i in self.ids.items() if len(p) == 1 and p != MARK), None)
        self._forget()

    # ---- normalising ----

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its bytes the start and end of the original bytes it came from."""
        data = text.encode("utf-8", "replace")
        if self.map is None and not self.squeeze and self.escape:
            if not data:
                return "", np.zeros(0, int), np.zeros(0, int)
            raw = np.frombuffer(data, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            start, end = at, at + 1
            if self.prefix:
                start, end = np.concatenate([np.zeros(3, int), start]), np.concatenate([np.zeros(3, int), end])
            return (MARK if self.prefix else "") + text.replace(" ", MARK), start, end
        out, start, end, at = bytearray(), [], [], 0
        mark = _MARK if self.escape else b" "

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            start.extend([a] * len(piece))
            end.extend([b] * len(piece))

        if self.squeeze:
            while at < len(data) and (step := self._prefix(data, at))[1] == b" ":
                at += step[0]
        if at == len(data):
            return "", np.zeros(0, int), np.zeros(0, int)
        if self.prefix:
            put(mark, at, at)
        space = self.squeeze
        while at < len(data):
            n, piece = self._prefix(data, at)
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", mark), at, at + n)
                space = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], start[-len(mark) :], end[-len(mark) :]
        return out.decode(), np.array(start, int), np.array(end, int)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        first = data[at]
        if self.map is not None and first in self.map.starts and (found := self.map.longest(data, at)):
            return found
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    # ---- merging ----

    def _merge(self, unit: str) -> list[str]:
        rank, parts = self.rank, list(unit)
        if len(parts) > 48:
            return self._merge_long(parts)
        get = rank.get
        scores = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := min(scores)) != _NONE:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], _NONE)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], _NONE)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """The same by a heap over a linked list: n log n, for units without a space of any length."""
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (s := rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (s, i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _unit(self, unit: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self._merge(unit):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def _known(self, unit: str) -> tuple[int, ...]:
        if (found := self.memo.get(unit)) is None:
            found = self._unit(unit)
            if len(unit) <= 64:
                if len(self.memo) >= MAX_MEMO:
                    self.memo.clear()
                self.memo[unit] = found
        return found

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """ids, and the original byte span [start, end) of each."""
        normal, start, end = self.normalise(text)
        ids = [i for unit in _UNITS.findall(normal) for i in self._known(unit)]
        a, b = self.spans(ids, normal, start, end)
        some, keep = self._joined(np.array(ids, np.int64), np.array([0, len(ids)]))
        return some.tolist(), a[keep], b[np.append(np.flatnonzero(keep)[1:], len(ids)) - 1] if len(some) else b

    def spans(self, ids: list[int], normal: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not ids:
            return np.zeros(0, int), np.zeros(0, int)
        width = self.width[list(ids)]
        if not self.bytes and self.unknown in ids:  # an unknown piece is one character of any width
            width = np.array([len(p.encode()) for u in _UNITS.findall(normal) for p in self._merge(u)])
        stop = np.cumsum(width)
        return start[stop - width], end[stop - 1]

    def _joined(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with neighbouring unknown pieces of a text as one, and which are kept (the first of each)."""
        keep = np.ones(len(ids), bool)
        if not self.bytes and len(ids):
            keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            keep[bounds[:-1][bounds[:-1] < len(ids)]] = True
        return ids[keep], keep

    # ---- many texts at a time ----

    @property
    def plain(self) -> bool:
        """Whether normalising does no more than escape spaces, and each character has pieces of its own; what stands for bytes that aren't UTF-8 must be in no longer piece."""
        return self.map is None and not self.squeeze and self.escape and bool(self.bytes) and self.anchor is not None and not any("\ufffd" in p for p in self.ids if len(p) > 1)

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Where units start in texts that lie end to end: between two characters that stand side by side in no piece.

        No merge crosses such a place. A run of marks and the character behind it stay in one unit.
        """
        at = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[at]
        code = head.astype(np.uint32)
        for lead, after, width in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            some = np.flatnonzero((head >= lead) & (head < after))
            found = code[some] & np.uint32(0x7F >> width)
            for k in range(1, width):  # a broken character's code means nothing: what it becomes is merged with nothing
                found = found << np.uint32(6) | data[np.minimum(at[some] + k, len(data) - 1)] & np.uint32(0x3F)
            code[some] = found
        code[code == 32] = ord(MARK)
        return at[1:][~self.beside[_place_of_pair(code[:-1], code[1:])] & (code[:-1] != ord(MARK))]

    def _told(self, unit: bytes, prefix: bool) -> tuple[list[int], list[int], list[int], bytes]:
        """A unit's ids, their spans in its bytes, and its decoded bytes."""
        text = unit.decode("utf-8", "replace")
        normal = (MARK if prefix else "") + text.replace(" ", MARK)
        if MARK not in text and normal.rfind(MARK) < len(normal) - 1:
            ids, starts, ends, at = [], [], [], -1 if prefix else 0
            for piece in self._merge(normal):
                # A mark is one byte of the text, or none if it is the prefix.
                i, width = self.widths.get(piece, _NO_PIECE)
                if i < 0:
                    break
                ids.append(i)
                starts.append(at)
                at += width
                ends.append(at)
            else:  # pieces with their marks as spaces are the text again
                if prefix:
                    starts, ends = [max(x, 0) for x in starts], [max(x, 0) for x in ends]
                return ids, starts, ends, unit
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        start = np.concatenate([np.zeros(3 * prefix, int), at])
        end = np.concatenate([np.zeros(3 * prefix, int), at + 1])
        # In front of a mark the prefix is a unit's first mark; other units start with their own.
        ids = [i for u in _UNITS.findall(normal) for i in self._known(u)]
        a, b = self.spans(ids, normal, start, end)
        # Behind another piece a unit's leading space stays, as it does in the decoded whole.
        decoded = self.processor.decode(ids) if prefix else self.processor.decode([self.anchor, *ids])[1:]
        return ids, a.tolist(), b.tolist(), decoded.encode()

    def _learn(self, units: list[bytes], prefix: bool) -> None:
        """Add units to the table: ids, their spans in the unit's bytes, digits, decoded."""
        known, some = self.known[prefix], [self._told(u, prefix) for u in units]
        for row, (u, (ids, _, _, decoded)) in enumerate(zip(units, some, strict=True), self.rows):
            known[u] = row
            self.told.append(",".join(map(str, ids)).encode() + b",")
            self.text.append(decoded)
        size = np.array([len(x[0]) for x in some], np.int64)
        self.size = np.append(self.size, size)
        self.at = np.append(self.at, self.filled + np.cumsum(size) - size)
        self.flat = np.concatenate([self.flat, np.array([[i for x in some for i in x[k]] for k in range(3)], np.int32).reshape(3, -1)], axis=1)
        self.rows, self.filled = self.rows + len(units), self.filled + int(size.sum())

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.LargeBinaryArray, pa.LargeBinaryArray]:
        """(ids, starts, ends, bounds, digits, decoded) of texts that lie end to end; only for plain models.

        The texts are cut into units; each distinct unit is merged and decoded once, and its pieces with
        their spans are laid out for all its places together. A text's ids as digits with a comma after
        each, and its decoded bytes, are the values of digits and decoded one after another.
        """
        n_texts = len(offsets) - 1
        none = pa.array([b""] * n_texts, pa.large_binary())
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64), none, none
        if self.rows > MAX_UNITS or self.filled > MAX_PIECES:
            self._forget()
        first = np.zeros(len(data), bool)
        first[self._starts(data)] = True
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = True
        cuts = np.flatnonzero(first)
        edges = np.append(cuts, len(data))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        kind = units.indices.to_numpy().astype(np.int64)
        names = _values(units.dictionary)
        rows = list(map(self.known[False].get, names))
        if None in rows:
            self._learn([u for u, row in zip(names, rows, strict=True) if row is None], False)
            rows = list(map(self.known[False].get, names))
        if self.prefix:  # the first unit of a text has the dummy prefix
            at_head = np.searchsorted(cuts, heads)
            some, of = np.unique(kind[at_head], return_inverse=True)
            first = [names[k] for k in some.tolist()]
            self._learn([u for u in first if u not in self.known[True]], True)
            rows += [self.known[True][u] for u in first]
            kind[at_head] = len(names) + of
        pick = pa.array(kind)
        digits, decoded = (pa.array([x[row] for row in rows], pa.large_binary()).take(pick) for x in (self.told, self.text))
        row = np.array(rows)[kind]
        n = self.size[row]
        stop = np.cumsum(n)
        place = np.arange(stop[-1]) + np.repeat(self.at[row] - (stop - n), n)
        text = np.searchsorted(offsets, cuts, "right") - 1
        base = np.repeat(cuts - offsets[text], n)
        ids, starts, ends = self.flat[0][place], self.flat[1][place] + base, self.flat[2][place] + base
        at = np.searchsorted(cuts, offsets)
        bounds = np.append(0, stop)[at]
        return ids, starts, ends, bounds, _runs(digits, at), _runs(decoded, at)

    def _forget(self) -> None:
        self.rows = self.filled = 0
        self.size, self.at, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((3, 0), np.int32)
        self.told, self.text, self.known = [], [], ({}, {})


def _place_of_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


def _values(some: pa.LargeBinaryArray) -> list[bytes]:
    """As to_pylist(), many times as fast for short values."""
    at = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1, some.offset * 8).tolist()
    raw = some.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _runs(values: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The values from each bound to the next as one."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)[bounds]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), values.buffers()[2]])


_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


_NO_PIECE = (-1, 0)


@lru_cache(2)
def _loaded(blob: bytes) -> Model:
    return Model(blob)


def read_model(path: str) -> bytes:
    """A model file's bytes, read on the driver: some 500 KB, fixed by the model."""
    with open(path, "rb") as f:
        return f.read()


def unpacked_spans(spans: bytes) -> np.ndarray:
    """(ids, 2): start and end of each id, from the field spans."""
    return np.frombuffer(spans, "<i4").reshape(-1, 2)


PIECE = 2 << 20
#: What encode() can return besides doc_id.
FIELDS = {"n_tokens": "long", "covered_bytes": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "spans": "binary", "decoded": "string"}
DIGESTS = ("n_tokens", "covered_bytes", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, model: bytes, fields: tuple[str, ...] = ("n_tokens", "covered_bytes", "ids", "starts", "ends", "decoded")) -> DataFrame:
    """Encode every whole text: doc_id and the fields asked for.

    ids with starts and ends: the span of each id in the text's UTF-8 bytes. spans: the same packed, start
    and end of each id in turn as little-endian 32-bit numbers, which Spark stores at a fraction of the
    cost of two lists; unpacked_spans() reads them. covered_bytes: bytes of the
    text inside spans. decoded: the ids turned into text again. ids_sha256 is of the decimal ids joined by
    commas, decoded_sha256 of the decoded text in UTF-8.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    wanted = set(fields)

    def together(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple:
        if model.plain:
            return model.encode_many(data, offsets)
        raw = data.tobytes()
        each = [model.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        told = ["".join([f"{i}," for i in ids]).encode() for ids, _, _ in each]
        text = [model.processor.decode(ids).encode() if ids else b"" for ids, _, _ in each]
        return *(np.concatenate([np.asarray(x[k], np.int64) for x in each]) for k in range(3)), np.append(0, np.cumsum([len(x[0]) for x in each])), pa.array(told, pa.large_binary()), pa.array(text, pa.large_binary())

    def columns(model: Model, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        ids, starts, ends, bounds, told, text = together(model, data, offsets)
        cuts = np.diff(bounds)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32()))
        sha = lambda some: pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string())
        out = {"n_tokens": pa.array(cuts)}
        if {"ids", "starts", "ends"} & wanted:
            out |= {"ids": lists(ids), "starts": lists(starts), "ends": lists(ends)}
        if "spans" in wanted:
            packed = np.stack([starts, ends], 1).astype("<i4").tobytes()
            out["spans"] = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(packed)])
        if "covered_bytes" in wanted:
            # Pieces of one original byte run share its span, which counts once.
            covered = np.zeros(len(ids) + 1, np.int64)
            if len(ids):
                new = np.append(True, starts[1:] >= ends[:-1])
                new[bounds[:-1][bounds[:-1] < len(ids)]] = True
                last = np.append(np.flatnonzero(new)[1:], len(ids)) - 1
                covered[1:][last] = ends[last] - starts[new]
            covered = np.cumsum(covered)
            out["covered_bytes"] = pa.array(covered[bounds[1:]] - covered[bounds[:-1]])
        if "ids_sha256" in wanted:
            out["ids_sha256"] = sha(x[:-1] for x in told.to_pylist())
        if "decoded" in wanted:
            out["decoded"] = text.cast(pa.large_string()).cast(pa.string())
        if "decoded_sha256" in wanted:
            out["decoded_sha256"] = sha(text.to_pylist())
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("sentencepiece", _loaded.cache_clear)
        model = _loaded(shared.value)
        try:
            for batch in batches:
                # A batch's tokens take many times the memory of its texts: about PIECE bytes at a time.
                for a, b, data, offsets in chunks(batch, "text", PIECE):
                    found = columns(model, data, offsets)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(found[f] for f in fields)], names=["doc_id", *fields])
        finally:
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, ", ".join(["doc_id long", *(f"{f} {FIELDS[f]}" for f in fields)]))
