"""A worker's cache of encoded spans: hash of the span -> its token ids, looked up for whole arrays of spans."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

from framewright.llm.arrays import HashIndex, gather_ranges, hash_spans
from framewright.llm.common import local_copy

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCache:
    """Encodes spans of bytes, each distinct one once while it stays in the cache.

    ``encode(bytes) -> list of ids``. The cache holds at most ``limit`` spans and begins anew beyond that, which
    costs time and never changes a result.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], limit: int = 1_500_000, batch: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.encode, self.limit, self.batch = encode, limit, batch or (lambda spans: [encode(s) for s in spans])
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.starts, self.lengths = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def ids(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each span."""
        h = hash_spans(buf, starts, lengths)
        found = self.index.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            distinct, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.index.n and self.index.n + len(distinct) > self.limit:
                self._clear()
                return self.ids(buf, starts, lengths)
            raw, at = buf.tobytes(), miss[first]
            spans = [raw[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            self._store(self.index.add(distinct), self.batch(spans))
            found[miss] = (self.index.n - len(distinct)) + back
        return found

    def _store(self, ids: np.ndarray, encoded: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.index.n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        ends = np.cumsum(sizes)
        self.starts[ids], self.lengths[ids] = self.used + ends - sizes, sizes
        self.pool[self.used : self.used + total] = np.fromiter((t for e in encoded for t in e), np.int32, total)
        self.used += total

    def tokens(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids one after the other, tokens of each span)."""
        entry = self.ids(buf, starts, lengths)
        n = self.lengths[entry]
        return self.pool[gather_ranges(self.starts[entry], n)], n


_encoders: dict[str, PieceCache] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(local_copy(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_bpe(path: str) -> tuple[Callable[[bytes], list[int]], int]:
    """(encoder of one pre-token, number of ids) of a file of byte-level BPE ranks."""
    import tiktoken

    ranks = load_ranks(path)
    core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    single, get = core.encode_single_piece, ranks.get

    def encode(piece: bytes) -> list[int]:
        one = get(piece)
        return [one] if one is not None else single(piece)

    return encode, max(ranks.values()) + 1


def bpe_cache(path: str, limit: int = 1_500_000) -> PieceCache:
    """The cache of this process for a file of ranks; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceCache(byte_bpe(path)[0], limit)
    return _encoders[path]
