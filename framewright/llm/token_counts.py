"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table, broadcast, of the lengths in tokens of the most frequent pre-tokens. What it lacks
goes to tier two, the cache of the worker, which encodes each pre-token once. No pre-token is ever shuffled: the
frequent ones are found by a bounded summary of every partition of the whole input, merged in a tree.

Defined results: a null text has a null count, an empty one 0; every input row gives one output row, repeated rows
included; a null id is kept as it is; other columns of the input are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import lean
from framewright.llm.arrays import HashIndex, gather_ranges, hash_spans, pretokens, segment_sums, text_chunks
from framewright.llm.common import ship, texts
from framewright.llm.pieces import DEFAULT_RANKS, bpe_cache, byte_bpe

FREQUENT = 16_384  # entries of the broadcast table: its size never grows with the data
TRACKED = 1_000_000  # distinct pre-tokens that a summary follows at a time
FAN_IN = 64

_SUMMARY = "part int, hashes binary, counts binary, sizes binary, spans binary"


class Summary:
    """Counts of distinct spans; beyond the bound the rarer half is forgotten, so only ranks of rare spans can be off."""

    def __init__(self, limit: int = TRACKED):
        self.limit = limit
        self._reset(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def _reset(self, hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, spans: np.ndarray) -> None:
        self.index = HashIndex()
        self.index.add(hashes)
        self.hashes, self.counts, self.sizes, self.spans = [hashes], counts, [sizes], [spans]

    def add(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        h = hash_spans(buf, starts, lengths)
        ids = self.index.find(h)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            self.index.add(new)
            self.hashes.append(new)
            self.sizes.append(lengths[at])
            self.spans.append(buf[gather_ranges(starts[at], lengths[at])])
            ids[miss] = self.index.find(h[miss])
        fresh = np.bincount(ids, minlength=self.index.n)
        fresh[: len(self.counts)] += self.counts
        self.counts = fresh
        if self.index.n > self.limit:
            self._reset(*self.top(self.limit // 2))

    def top(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes, sizes, spans = np.concatenate(self.hashes), np.concatenate(self.sizes), np.concatenate(self.spans)
        keep = np.lexsort((hashes, -self.counts))[:k]
        starts = np.cumsum(sizes) - sizes
        return hashes[keep], self.counts[keep], sizes[keep], spans[gather_ranges(starts[keep], sizes[keep])]


def _row(part: int, hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    blobs = [x.astype(k).tobytes() for x, k in ((hashes, "<u8"), (counts, "<i8"), (sizes, "<i4"), (spans, "u1"))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["part", "hashes", "counts", "sizes", "spans"])


def _summaries(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        summary = Summary()
        for batch in batches:
            for _, buf, offsets in text_chunks(batch.column(0)):
                starts, lengths, _ = pretokens(buf, offsets)
                summary.add(buf, starts, lengths)
        if summary.index.n:
            yield _row(TaskContext.get().partitionId(), *summary.top(k))

    return of


def merge_summaries(rows: list[tuple[bytes, bytes, bytes, bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, counts, sizes, spans = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(("<u8", "<i8", "<i4", "u1")))
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(back, weights=counts).astype(np.int64)
    keep = np.lexsort((distinct, -total))[:k]
    starts = np.cumsum(sizes) - sizes
    at = first[keep]
    return distinct[keep], total[keep], sizes[at], spans[gather_ranges(starts[at], sizes[at])]


def _merge(k: int):
    def of(tables: pa.Table) -> pa.Table:
        rows = list(zip(*(tables.column(c).to_pylist() for c in ("hashes", "counts", "sizes", "spans")), strict=True))
        return pa.Table.from_batches([_row(tables.column("part")[0].as_py() // FAN_IN, *merge_summaries(rows, k))])

    return of


def frequent_pretokens(docs: DataFrame, k: int = FREQUENT) -> list[bytes]:
    """The k most frequent pre-tokens of the whole input, by a tree of bounded summaries of its partitions."""
    summaries = docs.select("text").mapInArrow(lean(_summaries(k)), _SUMMARY)
    parts = max(1, docs.rdd.getNumPartitions())
    while parts > 1:
        summaries = summaries.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(_merge(k), _SUMMARY)
        parts = -(-parts // FAN_IN)
    rows = summaries.collect()  # one row of at most k entries
    if not rows:
        return []
    _, _, sizes, spans = merge_summaries([(bytes(r.hashes), bytes(r.counts), bytes(r.sizes), bytes(r.spans)) for r in rows], k)
    raw, ends = spans.tobytes(), np.cumsum(sizes)
    return [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def length_table(spans: list[bytes], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token counts) of spans."""
    encode, _ = byte_bpe(ranks_path)
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    buf = np.frombuffer(b"".join(spans) + bytes(16), np.uint8)
    return hash_spans(buf, np.cumsum(sizes) - sizes, sizes), np.fromiter((len(encode(s)) for s in spans), np.int32, len(spans))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_tokens): the number of byte-level BPE tokens of each whole text."""
    ship(df.sparkSession, ranks_path)
    docs = texts(df, id_col, text_col)
    hashes, lengths = length_table(frequent_pretokens(docs, frequent), ranks_path)
    shared = df.sparkSession.sparkContext.broadcast((hashes, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lengths = shared.value
        first_tier, second = HashIndex(), bpe_cache(ranks_path)
        first_tier.add(hashes)
        lengths = np.append(lengths, np.int32(0))
        for batch in batches:
            column = batch.column(1)
            out = np.zeros(batch.num_rows, np.int64)
            for row, buf, offsets in text_chunks(column):
                starts, sizes, per_text = pretokens(buf, offsets)
                known = first_tier.find(hash_spans(buf, starts, sizes))
                n = lengths[known]
                miss = np.flatnonzero(known < 0)
                if len(miss):
                    entry = second.ids(buf, starts[miss], sizes[miss])
                    n[miss] = second.lengths[entry]
                out[row : row + len(per_text)] = segment_sums(n, per_text)
            nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64(), mask=nulls)], names=["doc_id", "n_tokens"])

    return docs.mapInArrow(lean(count), "doc_id long, n_tokens long")
