"""Packing by concatenating and cutting.

Pass one tokenises every partition into chunks of whole documents, each with its offset in its partition, and writes
them to the shared folder. Prefix sums over the partitions' token totals then give every chunk its global offset, and
pass two cuts fixed windows: those that lie inside a chunk are complete where they are; only the ends of chunks, less
than a window each, meet in a small shuffle. Boundary records tell which document each part of a window comes from.

Defined results: documents follow one another in the order in which the input's partitions and rows are read, each
closed by the end token. A null or empty text adds nothing, not even an end token. Repeated rows are packed each time.
A null id stays null in the boundary records. The last window may be short. An empty table gives no windows; columns
other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.blocks import lean
from framewright.llm.arrays import pretokens, segment_sums, text_chunks
from framewright.llm.common import int_lists, ship, texts
from framewright.llm.pieces import DEFAULT_RANKS, bpe_cache, byte_bpe
from framewright.storage import materialise

WINDOW = 2048
BROADCAST_PARTS = 1_000_000  # partitions up to which their offsets, 16 bytes each, are broadcast; beyond, the chunks are joined
_CHUNK = "part int, start long, n long, doc_ids array<bigint>, doc_tokens array<int>, tokens binary, head binary, tail binary"
_OUT = "window_id long, n_tokens int, tokens array<int>, pieces array<struct<doc_id:bigint,window_start:int,doc_start:int,length:int>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("window_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
_FRAGMENT = "window_id long, at int, tokens binary, pieces array<struct<doc_id:bigint,window_start:int,doc_start:int,length:int>>"


def _tokenise(ranks_path: str, end: int, width: int, kind: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, cache = TaskContext.get().partitionId(), 0, bpe_cache(ranks_path)
        for batch in batches:
            ids = batch.column(0)
            for row, buf, offsets in text_chunks(batch.column(1)):
                starts, lengths, per_text = pretokens(buf, offsets)
                tokens, per_piece = cache.tokens(buf, starts, lengths)
                per_doc = segment_sums(per_piece, per_text)
                full = np.flatnonzero(per_doc)
                if not len(full):
                    continue
                sizes = per_doc[full]
                flat = np.insert(tokens, np.cumsum(sizes), end).astype(kind)
                sizes = sizes + 1
                n = len(flat)
                own = ids.slice(row, len(per_doc)).take(pa.array(full))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), own.cast(pa.int64())), int_lists(sizes, [len(full)]),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (flat, flat[:width], flat[max(0, n - width) :])),
                    ],
                    names=["part", "start", "n", "doc_ids", "doc_tokens", "tokens", "head", "tail"],
                )
                start += n

    return of


def _pieces(ids: pa.Array, sizes: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Boundary records of the spans between consecutive ``cuts`` of a chunk; ``at``: where each span begins in its window."""
    ends = np.cumsum(sizes)
    edges = np.unique(np.concatenate([cuts, ends[(ends > cuts[0]) & (ends < cuts[-1])]]))
    first, length = edges[:-1], np.diff(edges)
    doc, span = np.searchsorted(ends, first, side="right"), np.searchsorted(cuts, first, side="right") - 1
    fields = [ids.take(pa.array(doc)).cast(pa.int64()), *(pa.array(x, pa.int32()) for x in (first - cuts[span] + at[span], first - (ends - sizes)[doc], length))]
    offsets = np.searchsorted(first, cuts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_PIECE)))


def _cut(width: int, kind: str):
    """Windows that lie wholly inside a chunk."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                offset, n = c["offset"][r].as_py(), c["n"][r].as_py()
                head = -offset % width
                count = (n - head) // width
                if count <= 0:
                    continue
                tokens = np.frombuffer(c["tokens"][r].as_buffer(), kind)
                sizes = c["doc_tokens"][r].values.to_numpy()
                for k in range(0, count, 256):
                    m = min(256, count - k)
                    a = head + k * width
                    cuts = a + np.arange(m + 1) * width
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((offset + head) // width + k + np.arange(m), pa.int64()), pa.array(np.full(m, width), pa.int32()),
                            int_lists(tokens[a : a + m * width].astype(np.int32), np.full(m, width)), _pieces(c["doc_ids"][r].values, sizes, cuts, np.zeros(m, np.int64)),
                        ],
                        names=["window_id", "n_tokens", "tokens", "pieces"],
                    )

    return of


def _ends(width: int, kind: str):
    """The parts of windows at both ends of a chunk."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                offset, n = c["offset"][r].as_py(), c["n"][r].as_py()
                head = min(n, -offset % width)
                tail = (offset + n) % width if n > head else 0
                for a, size, blob in ((0, head, "head"), (n - tail, tail, "tail")):
                    if not size:
                        continue
                    tokens = np.frombuffer(c[blob][r].as_buffer(), kind)
                    tokens = tokens[:size] if blob == "head" else tokens[len(tokens) - size :]
                    at = (offset + a) % width
                    pieces = _pieces(c["doc_ids"][r].values, c["doc_tokens"][r].values.to_numpy(), np.array([a, a + size]), np.array([at]))
                    yield pa.RecordBatch.from_arrays([pa.array([(offset + a) // width], pa.int64()), pa.array([at], pa.int32()), pa.array([tokens.tobytes()], pa.binary()), pieces], names=["window_id", "at", "tokens", "pieces"])

    return of


def _stitch(kind: str):
    def of(group: pa.Table) -> pa.Table:
        group = group.sort_by("at").combine_chunks()
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column("tokens")]).astype(np.int32)
        flat = pa.concat_arrays([x.values for x in group.column("pieces")])
        pieces = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.table({"window_id": group.column("window_id").slice(0, 1), "n_tokens": pa.array([len(tokens)], pa.int32()), "tokens": int_lists(tokens, [len(tokens)]), "pieces": pieces})

    return of


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Rows (window_id, n_tokens, tokens, pieces): the input's tokens in windows of ``window``; all but the last are full."""
    if window < 1:
        raise ValueError("window must be positive")
    ship(df.sparkSession, ranks_path)
    _, end = byte_bpe(ranks_path)
    kind = "<u2" if end < 1 << 16 else "<i4"
    docs = texts(df, id_col, text_col)
    few = docs.rdd.getNumPartitions() <= BROADCAST_PARTS
    chunks = materialise(docs.mapInArrow(lean(_tokenise(ranks_path, end, window, kind)), _CHUNK), "chunks")
    # One row a partition of the input: the second pass's prefix sum.
    totals = chunks.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    placed = chunks.join(F.broadcast(bases) if few else bases, "part").withColumn("offset", F.col("base") + F.col("start"))
    whole = placed.select("offset", "n", "doc_ids", "doc_tokens", "tokens").mapInArrow(lean(_cut(window, kind)), _OUT)
    ends = placed.select("offset", "n", "doc_ids", "doc_tokens", "head", "tail").mapInArrow(_ends(window, kind), _FRAGMENT)
    return whole.unionByName(ends.groupBy("window_id").applyInArrow(_stitch(kind), _OUT))
