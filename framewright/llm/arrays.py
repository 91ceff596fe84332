"""Vectorised text primitives shared by the language-data operators.

Arrow hands a column of strings over as one byte buffer and an offsets array. Everything here works on those two
arrays, so no Python object is made per word: spans of bytes are found by class transitions, hashed eight bytes at a
time, and looked up in open-addressing tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PAD = 16
CHUNK_BYTES = 2_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column in runs of whole texts of about ``limit`` bytes: (first row, padded bytes, offsets).

    A text longer than the limit is a chunk by itself; texts are never cut. Nulls have length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(off)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        last = min(last, n)
        buf = np.zeros(off[last] - off[first] + PAD, np.uint8)
        buf[:-PAD] = raw[off[first] : off[last]]
        part = off[first : last + 1] - off[first]
        if column.null_count and (lengths[first:last] != np.diff(part)).any():  # a null that holds bytes
            keep = np.repeat(lengths[first:last] > 0, np.diff(part))
            body = buf[:-PAD][keep]
            buf = np.concatenate([body, np.zeros(PAD, np.uint8)])
            part = np.concatenate([[0], np.cumsum(lengths[first:last])])
        yield first, buf, part
        first = last


def hash_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; spans of up to 8 bytes of one length never collide."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = mix64(lengths.astype(np.uint64) * _M1)
    if not len(starts):
        return h
    h = mix64((words[starts] & _MASKS[np.minimum(lengths, 8)]) ^ h)
    more = np.flatnonzero(lengths > 8)
    at = 8
    while len(more):
        left = lengths[more] - at
        h[more] = mix64((words[starts[more] + at] & _MASKS[np.minimum(left, 8)]) ^ (h[more] * _M1))
        at += 8
        more = more[left > 8]
    return h


class HashIndex:
    """Open-addressing map from 64-bit keys to consecutive ids, probed for whole arrays at once."""

    def __init__(self, bits: int = 16):
        self._make(bits)
        self.n = 0

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.ids = np.full(1 << bits, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the keys, -1 where absent."""
        h = np.where(h == 0, np.uint64(1), h)
        at = self._slot(h)
        key = self.keys[at]
        out = np.where(key == h, self.ids[at], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        mask = (1 << self.bits) - 1
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            key, want = self.keys[at], h[left]
            hit = key == want
            out[left[hit]] = self.ids[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Insert keys, distinct and absent so far; gives their ids, counted on from the last."""
        h = np.where(h == 0, np.uint64(1), h)
        while (self.n + len(h)) * 2 > (1 << self.bits):
            full = self.keys != 0
            keys, ids = self.keys[full], self.ids[full]
            self._make(self.bits + 1)
            self._put(keys, ids)
        ids = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(h, ids)
        self.n += len(h)
        return ids

    def _put(self, h: np.ndarray, ids: np.ndarray) -> None:
        at, mask = self._slot(h), (1 << self.bits) - 1
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]  # of several on one slot the last stays
            won = self.keys[at] == h
            self.ids[at[won]] = ids[won]
            h, ids, at = h[~won], ids[~won], (at[~won] + 1) & mask


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given lengths, 0 for empty ones."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


# Words: runs of letters and digits, in lower case where Latin-1. -------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, lengths, words per text). Bytes above 127 count as letters."""
    low = _LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capital letters of Latin-1
    after = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    low[after] += 32
    inside = _WORD[low]
    inside[-PAD:] = False
    edge = np.empty(len(inside), bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < offsets[-1])]
    joined = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # two texts whose words touch
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    starts, ends = at[0::2], at[1::2]
    counts = np.diff(np.searchsorted(starts, offsets))
    return low, starts, ends - starts, counts


# Pre-tokens of the byte-level BPE pattern. --------------------------------------------------------------------

SPACE, BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3, 4
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point, made once a process."""
    global _classes
    if _classes is None:
        import unicodedata

        kind = np.full(0x110000, OTHER, np.uint8)
        category = unicodedata.category
        for c in range(0x110000):
            k = category(chr(c))[0]
            if k == "L":
                kind[c] = LETTER
            elif k == "N":
                kind[c] = NUMBER
        for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            kind[c] = BLANK
        kind[32] = SPACE
        _classes = kind
    return _classes


def code_points(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and byte lengths of the multi-byte characters that begin at ``at``."""
    b0, b1, b2, b3 = (buf[at + i].astype(np.int64) for i in range(4))
    size = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
    two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
    three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
    return np.minimum(np.where(size == 2, two, np.where(size == 3, three, four)), 0x10FFFF), size


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    kind = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        points, size = code_points(buf, lead)
        own = table[points]
        kind[lead] = own
        for i in (1, 2, 3):
            far = size > i
            kind[lead[far] + i] = own[far]
    return kind


def pretokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, pre-tokens per text) of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = int(offsets[-1])
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    kind = byte_classes(buf)[:n]
    group = np.where(kind == SPACE, np.uint8(BLANK), kind)
    start = np.zeros(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(group[1:], group[:-1], out=start[1:n])
    start[offsets] = True
    runs = np.flatnonzero(start)
    first, end = runs[:-1], runs[1:]
    own = group[first]
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets] = True
    # White space before something else in its text: its last character goes with that, or stands alone.
    b = np.flatnonzero((own == BLANK) & ~doc_end[end])
    last = end[b] - 1
    while True:
        inner = (buf[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    start[last] = True
    spaced = kind[last] == SPACE
    start[end[b][spaced]] = False
    # Contractions: an apostrophe that stands alone before letters.
    q = np.flatnonzero((own[:-1] == OTHER) & (own[1:] == LETTER) & (end[:-1] - first[:-1] == 1)) if len(own) > 1 else np.zeros(0, np.int64)
    q = q[(buf[first[q]] == 39) & start[first[q]] & ~doc_end[end[q]]]
    if len(q):
        a, b1, b2 = first[q], buf[first[q] + 1], buf[first[q] + 2]
        one = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
        two = ((b1 == 114) & (b2 == 101)) | ((b1 == 118) & (b2 == 101)) | ((b1 == 108) & (b2 == 108))
        two &= end[q + 1] - a >= 3
        for hit, size in ((one, 2), (two & ~one, 3)):
            start[a[hit] + 1] = False
            start[a[hit] + size] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(starts)
    starts = starts[:-1]
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, lengths, counts
