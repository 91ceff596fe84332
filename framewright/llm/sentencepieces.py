"""SentencePiece encoding and decoding for models of the merge (BPE) type, exact and by backtracking.

A segment's encoding is the one sequence of pieces of which every adjacent pair is compatible: re-merging both pieces,
step by step in the order of their merges, never meets a better merge across their border. The encoder takes the
longest piece that an Aho-Corasick automaton finds at a position, goes on to shorter prefixes when it is not compatible
with the piece before, steps back when none is, and marks positions from which nothing led on in a bitfield, so each is
left at most once. Compatibility of a pair is worked out once a worker.

Texts are first cut where no piece of the vocabulary can span, above all before white space, and each distinct segment
is encoded once while it stays in the worker's cache.

Defined results: a null text has null ids, count and decoded text; an empty one no ids and an empty text. Characters
outside the vocabulary become byte pieces (or the unknown piece where the model has none, which decodes to U+2047 between blanks).
U+2581 in a text is the model's sign for a blank and comes back as one. Every row gives one row, repeated ones too;
null ids are kept; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from framewright.blocks import lean
from framewright.llm.arrays import PAD, gather_ranges, segment_sums, text_chunks
from framewright.llm.common import int_lists, local_copy, ship, texts
from framewright.llm.pieces import PieceCache

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, raw[i : i + size]
        i += size


class Model:
    """The pieces of a model file, with a blank in place of U+2581."""

    def __init__(self, path: str):
        with open(local_copy(path), "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.prefix = True
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode().replace("▁", " "))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a model of the merge type")
            elif field == 3:
                own = dict(_fields(value))
                self.prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("a model with normalisation rules")
        if _USER in kinds:
            raise ValueError("a model with user-defined pieces")
        self.kinds = kinds
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == _NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = [order.get(s, -1) for s in scores]
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == _BYTE}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece with a character that is no piece")
        self.spans = self._spans()

    def _spans(self) -> np.ndarray:
        """Whether two bytes can be neighbours within a piece; all bytes from 128 on count as one."""
        ok = np.zeros((256, 256), bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                ok[min(ord(a), 128), min(ord(b), 128)] = True
        ok[:, 129:] = ok[:, 128:129]
        ok[129:, :] = ok[128:129, :]
        return ok


class Encoder:
    """Backtracking encoder of segments."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.size = [len(p) for p in model.pieces]
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[tuple[int, tuple[int, int] | None]]:
        """(piece, the two it was merged of) by merging step by step, best score first and leftmost of equal ones."""
        ids, rank, pieces = self.model.ids, self.model.rank, self.model.pieces
        parts: list[tuple[int, tuple[int, int] | None]] = [(ids[c], None) for c in text]
        while True:
            best = None
            for k in range(len(parts) - 1):
                joint = ids.get(pieces[parts[k][0]] + pieces[parts[k + 1][0]])
                if joint is not None and (best is None or rank[joint] < best[0]):
                    best = (rank[joint], k, joint)
            if best is None:
                return parts
            _, k, joint = best
            parts[k : k + 2] = [(joint, (parts[k][0], parts[k + 1][0]))]

    def split(self, piece: int) -> tuple[int, int] | None:
        """The last merge that makes a piece; None for a character; (-1, -1) for a piece that no merging makes."""
        if piece not in self.splits:
            parts = self.merge(self.model.pieces[piece])
            self.splits[piece] = parts[0][1] if len(parts) == 1 and parts[0][0] == piece else (-1, -1)
        return self.splits[piece]

    def prefix(self, piece: int) -> int:
        """The longest shorter piece that a piece begins with, -1 if there is none."""
        if piece not in self.shorter:
            text, found = self.model.pieces[piece], -1
            for n in range(len(text) - 1, 0, -1):
                i = self.model.ids.get(text[:n])
                if i is not None and self.split(i) != (-1, -1):
                    found = i
                    break
            self.shorter[piece] = found
        return self.shorter[piece]

    def pair(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = self._pair(left, right)
        return known

    def _pair(self, left: int, right: int) -> bool:
        """Undo the merges of both pieces from the last on, looking for a merge across the border that comes before."""
        ids, rank, pieces = self.model.ids, self.model.rank, self.model.pieces
        limit = 1 << 60
        while True:
            joint = ids.get(pieces[left] + pieces[right])
            if joint is not None and rank[joint] < limit:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                limit, left = rank[left], a[1]
            else:
                limit, right = rank[right] + 1, b[0]

    def _known(self, text: str, longest: list[int]) -> list[int]:
        """Pieces of a text of known characters; longest[i]: the longest piece at character i."""
        n, size, pair, prefix = len(text), self.size, self.pair, self.prefix
        open_ = (1 << (n + 1)) - 1
        out: list[int] = []
        at, piece = 0, longest[0]
        while True:
            end = at + size[piece]
            if (open_ >> end) & 1 and (not out or pair(out[-1], piece)):
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at]
                continue
            piece = prefix(piece)
            while piece < 0:
                open_ &= ~(1 << at)
                last = out.pop()
                at -= size[last]
                piece = prefix(last)

    def encode_batch(self, segments: list[bytes]) -> list[list[int]]:
        texts_ = [s.decode() for s in segments]
        joined = "\x00".join(texts_)
        longest, length = [-1] * (len(joined) + 1), [0] * (len(joined) + 1)
        split, bad = self.split, (-1, -1)
        for end, (n, piece) in self.automaton.iter(joined):
            start = end - n + 1
            if n > length[start] and split(piece) != bad:
                length[start], longest[start] = n, piece
        out, at = [], 0
        for text in texts_:
            n = len(text)
            own = longest[at : at + n]
            at += n + 1
            if -1 not in own:
                out.append(self._known(text, own) if n else [])
                continue
            ids: list[int] = []
            first = 0
            for k in range(n + 1):
                if k == n or own[k] < 0:
                    if k > first:
                        # A longest match cannot reach over an unknown character.
                        ids += self._known(text[first:k], own[first:k])
                    if k < n:
                        raw = text[k].encode()
                        ids += [self.model.bytes[b] for b in raw] if self.model.bytes else [self.model.unknown]
                    first = k + 1
            out.append(ids)
        return out


class Decoder:
    """Bytes of pieces, gathered for whole arrays of ids."""

    def __init__(self, model: Model):
        raw = []
        for i, p in enumerate(model.pieces):
            kind = model.kinds[i]
            raw.append(bytes([int(p[3:5], 16)]) if kind == _BYTE else p.encode() if kind == _NORMAL else " ⁇ ".encode() if kind == _UNKNOWN else b"")
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.prefix = model.prefix

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        n = self.sizes[ids]
        out = self.pool[gather_ranges(self.starts[ids], n)]
        sizes = segment_sums(n, counts)
        if self.prefix:  # the blank put before each text
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            first = first[out[first] == 32]
            keep = np.ones(len(out), bool)
            keep[first] = False
            sizes = sizes.copy()
            sizes[np.searchsorted(np.cumsum(sizes), first, side="right")] -= 1
            out = out[keep]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def segments(buf: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with the models' leading blanks, starts, lengths, segments per text)."""
    sizes = np.diff(offsets)
    if model.prefix:
        full = sizes > 0
        buf = np.insert(buf, offsets[:-1][full], 32)
        offsets = np.concatenate([[0], np.cumsum(sizes + full)])
    n = int(offsets[-1])
    if not n:
        none = np.zeros(0, np.int64)
        return buf, none, none, np.zeros(len(sizes), np.int64)
    low = np.minimum(buf[:n], 128)
    start = np.empty(n, bool)
    start[0] = True
    np.logical_not(model.spans.ravel()[(low[:-1].astype(np.uint16) << 8) | low[1:]], out=start[1:])
    start &= (buf[:n] & 0xC0) != 0x80
    inner = offsets[:-1]
    start[inner[inner < n]] = True
    starts = np.flatnonzero(start)
    return buf, starts, np.diff(np.append(starts, n)), np.diff(np.searchsorted(starts, offsets))


_loaded: dict[str, tuple[Model, PieceCache, Decoder]] = {}


def load(path: str) -> tuple[Model, PieceCache, Decoder]:
    """A model with the worker's cache of segments; it lives as long as the process."""
    if path not in _loaded:
        model = Model(path)
        encoder = Encoder(model)
        _loaded[path] = model, PieceCache(lambda s: encoder.encode_batch([s])[0], batch=encoder.encode_batch), Decoder(model)
    return _loaded[path]


def encode_texts(column: pa.Array, path: str = DEFAULT_MODEL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids one after the other, ids of each text) of runs of texts."""
    model, cache, _ = load(path)
    if pc.any(pc.match_substring(column, "▁")).as_py():
        column = pc.replace_substring(column, "▁", " ")
    for row, buf, offsets in text_chunks(column):
        buf, starts, lengths, counts = segments(buf, offsets, model)
        if len(buf) < PAD or not len(starts):
            yield row, np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
            continue
        ids, n = cache.tokens(buf, starts, lengths)
        yield row, ids, segment_sums(n.astype(np.int64), counts)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, decoded): each whole text's ids, and the text that they decode to."""
    ship(df.sparkSession, model_path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, decoder = load(model_path)
        for batch in batches:
            own, column = batch.column(0), batch.column(1)
            for row, ids, counts in encode_texts(column, model_path):
                m = len(counts)
                none = column.slice(row, m).is_null()
                lists, back = int_lists(ids, counts), decoder.texts(ids, counts)
                if column.null_count:
                    gone = none.to_numpy(zero_copy_only=False)
                    lists = pc.if_else(none, pa.nulls(m, lists.type), lists)
                    back, n = pc.if_else(none, pa.nulls(m, pa.string()), back), pa.array(counts, pa.int64(), mask=gone)
                else:
                    n = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays([own.slice(row, m), lists, n, back], names=["doc_id", "ids", "n_tokens", "decoded"])

    return texts(df, id_col, text_col).mapInArrow(lean(of), "doc_id long, ids array<int>, n_tokens long, decoded string")
