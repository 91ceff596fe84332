"""Substring deduplication by relative Lempel-Ziv parsing against an index of the whole corpus.

Every document is a reference block. Blocks are indexed by anchors: of every ``LENGTH`` words in a row, the least hash
of ``ANCHOR`` of them, so that any passage of ``LENGTH`` words that two documents share has an anchor in common, at the
same place. A shuffle by anchor finds, for every anchor of every document, its first place in the corpus. Anchors travel in
blobs, at most as many as there are anchors; a bucket of more than ``HOT`` of them, as where a passage is in very many documents, is
taken apart and its first places are worked out by aggregation before and a join after the shuffle, so no task holds all places of one anchor.

Parsing: a document's anchors that point along one diagonal of one reference, each overlapping or touching the next,
make a factor, greedily the longest. Factors of ``LENGTH`` words or more are duplicates as they stand. At the boundaries of
factors, where a passage can go on in another reference, every stretch of ``LENGTH`` words around a shared anchor is
looked up in the corpus as a whole, so the parse misses none.

Result: exactly the words lying in some stretch of ``LENGTH`` words that also occurs in an earlier document, that is, of
lesser id or, under one id, of lesser ``text_hash``. The first document that has a passage keeps it; ``source_id`` is the first that has
the first ``LENGTH`` words of the span. Words are compared without case, punctuation or white space. Equality is that of 64-bit hashes.

Defined results: null texts, rows with a null id and texts of fewer than ``LENGTH`` words have no spans. Rows of one id
are one document when they repeat one text, and it does not duplicate itself; different texts under an id are documents of their
own, told apart by ``text_hash``, 60 bits of the text's MD5. What a document repeats within itself is left alone. Empty tables give no rows. Other columns are
ignored by ``duplicate_spans`` and kept, whatever their names, by ``cut_duplicates``, which sets ``n_chars``, if there is one, anew, and drops a document of
which nothing but separators is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.blocks import large, lean, lean_group, partitions
from framewright.llm.arrays import gather_ranges, hash_spans, mix64, text_chunks, words
from framewright.llm.common import fresh, text_hash, texts
from framewright.storage import materialise

LENGTH = 50
ANCHOR = 26
FLUSH = 1 << 19
HOT = 1 << 21  # records of a bucket that go through one task
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k word hashes in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix64((total[k:] - total[:n]) * down[:n])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each i, shorter at the end."""
    done = 1
    while done < width:
        step = min(done, width - done)
        y = x.copy()
        best(x[:-step], x[step:], out=y[:-step])
        x, done = y, done + step
    return x


def anchors(h: np.ndarray, counts: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(words at which anchors begin, their hashes) of texts with these word hashes one after the other."""
    grams = runs(h, size)
    n = len(grams)
    width = length - size + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.cumsum(counts) - counts
    room = np.maximum(counts - length + 1, 0)
    valid = np.zeros(n, bool)
    valid[gather_ranges(first, room)] = True
    least = np.where(valid, _sliding(grams, width, np.minimum), np.uint64(0))
    # The greatest of the windows' minima that a gram lies in.
    back = np.concatenate([np.zeros(width - 1, np.uint64), least])
    most = _sliding(back, width, np.maximum)[:n]
    inside = np.zeros(n + 1, np.int32)
    has = room > 0
    np.add.at(inside, first[has], 1)
    np.add.at(inside, first[has] + room[has] + width - 1, -1)
    at = np.flatnonzero((most == grams) & (np.cumsum(inside[:n]) > 0))
    return at, grams[at]


_PARTS = "bucket int, n int, h binary, doc binary, key binary, a binary"


def _blobs(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, str]]) -> pa.RecordBatch | None:
    """A row a bucket, its records in blobs."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    arrays, names = [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int32())], ["bucket", "n"]
    for name, (values, kind) in columns.items():
        raw = values[order].astype(kind)
        offsets = (cuts * raw.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _records(group: pa.Table, columns: dict[str, str]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)] or [np.zeros(0, kind)]) for name, kind in columns.items()]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _index(buckets: int, length: int, size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, key, at = (np.concatenate([x[i] for x in held]) for i in range(4))
            held.clear()
            if (out := _blobs(_bucket(h, buckets), {"h": (h, "<u8"), "doc": (doc, "<i8"), "key": (key, "<i8"), "a": (at, "<i4")})) is not None:
                yield out

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, buf, offsets in text_chunks(batch.column(1)):
                low, starts, lengths, counts = words(buf, offsets)
                at, h = anchors(hash_spans(low, starts, lengths), counts, length, size)
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                held.append((h, ids[row + doc], keys[row + doc], at - (ends - counts)[doc]))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return of


def _firsts(group: pa.Table) -> pa.Table:
    """For every anchor that two documents have: its places, each with the first."""
    h, doc, key, at = _records(group, {"h": "<u8", "doc": "<i8", "key": "<i8", "a": "<i4"})
    order = np.lexsort((at, key, doc, h))
    h, doc, key, at = h[order], doc[order], key[order], at[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    last = np.append(np.flatnonzero(new)[1:], len(h))[np.cumsum(new) - 1] - 1
    keep = (doc[last] != doc[first]) | (key[last] != key[first])
    return pa.table({"doc": doc[keep], "key": key[keep], "at": at[keep].astype(np.int32), "ref": doc[first][keep], "ref_key": key[first][keep], "ref_at": at[first][keep].astype(np.int32)})


_SPANS = "kind int, bucket int, n int, h binary, doc binary, key binary, a binary, b binary, doc_id long, text_hash long, start int, end int, source_id long"


def _empty(n: int) -> dict[str, pa.Array]:
    return {"kind": pa.array(np.zeros(n), pa.int32()), **{c: pa.nulls(n, pa.int32()) for c in ("bucket", "n")}, **{c: pa.nulls(n, pa.binary()) for c in ("h", "doc", "key", "a", "b")}, **{c: pa.nulls(n, pa.int64()) for c in ("doc_id", "text_hash")}, **{c: pa.nulls(n, pa.int32()) for c in ("start", "end")}, "source_id": pa.nulls(n, pa.int64())}


def parse(column: pa.Array, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, length: int, size: int):
    """Factor the texts of distinct documents by their shared anchors, which are sorted by document and place.

    Yields (factors, stretches): factors of at least ``length`` words as (doc, start, end, source), and the stretches
    still to be looked up as (hash, doc, start, end). Starts and ends count characters.
    """
    for row, buf, offsets in text_chunks(column):
        low, starts, lengths, counts = words(buf, offsets)
        own = ids[row : row + len(counts)]
        order = np.argsort(own)
        k = np.searchsorted(own[order], doc)
        k = np.minimum(k, len(own) - 1)
        mine = np.flatnonzero(own[order][k] == doc)
        if not len(mine):
            continue
        text = order[k[mine]]
        first = np.cumsum(counts) - counts
        fits = at[mine] + size <= counts[text]
        mine, text = mine[fits], text[fits]
        g = first[text] + at[mine]
        by = np.argsort(g, kind="stable")
        mine, text, g = mine[by], text[by], g[by]
        h = hash_spans(low, starts, lengths)
        n = len(h)
        chars = np.arange(len(buf)) - np.cumsum((buf & 0xC0) == 0x80)
        base = offsets[:-1] - (np.arange(len(buf)) - chars)[np.maximum(offsets[:-1] - 1, 0)] * (offsets[:-1] > 0)
        word_doc = np.repeat(np.arange(len(counts)), counts)
        head = chars[starts] - base[word_doc]
        tail = chars[starts + lengths - 1] + 1 - base[word_doc]
        # Stretches that hold a shared anchor.
        lo, hi = np.maximum(first[text], g - (length - size)), np.minimum(g, first[text] + counts[text] - length)
        wide = hi >= lo
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, lo[wide], 1)
        np.add.at(mark, hi[wide] + 1, -1)
        look = np.cumsum(mark[:n]) > 0
        # Factors: anchors along one diagonal, each touching the next.
        r, ra, d = ref[mine], ref_at[mine].astype(np.int64), own[text]
        link = (r[1:] == r[:-1]) & (r[1:] != d[1:]) & (text[1:] == text[:-1]) & (np.diff(g) == np.diff(ra)) & (np.diff(g) <= size)
        begin = np.concatenate([[True], ~link]) if len(g) else np.zeros(0, bool)
        a = np.flatnonzero(begin)
        z = np.append(a[1:], len(g)) - 1
        s, e = g[a], g[z] + size
        long = (e - s >= length) & (r[a] != d[a])
        s, e, a = s[long], e[long], a[long]
        look[gather_ranges(s, e - s - length + 1)] = False
        factors = (d[a], head[s], tail[e - 1], r[a])
        j = np.flatnonzero(look)
        stretch = runs(h, length)
        yield factors, (stretch[j], own[word_doc[j]], head[j], tail[j + length - 1])


def _parse(buckets: int, length: int, size: int):
    def of(docs: pa.Table, shared: pa.Table) -> pa.Table:
        none = pa.table(_empty(0))
        if not docs.num_rows or not shared.num_rows:
            return none
        doc, key, at, ref, ref_key, ref_at = (shared.column(c).to_numpy() for c in ("doc", "key", "at", "ref", "ref_key", "ref_at"))
        ids, keys = docs.column("doc_id").to_numpy(), docs.column("text_hash").to_numpy()
        # Documents are numbered in the order of (id, hash of the text).
        name, name_key = np.concatenate([ids, doc, ref]), np.concatenate([keys, key, ref_key])
        by = np.lexsort((name_key, name))
        name, name_key = name[by], name_key[by]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(np.concatenate([[False], (name[1:] != name[:-1]) | (name_key[1:] != name_key[:-1])]))
        begin = np.flatnonzero(np.concatenate([[True], np.diff(number[by]) > 0]))
        name, name_key = name[begin], name_key[begin]
        ids, doc, ref = np.split(number, np.cumsum([len(ids), len(doc)]))
        order = np.lexsort((at, doc))
        doc, at, ref, ref_at = doc[order], at[order], ref[order], ref_at[order]
        distinct = np.sort(np.unique(ids, return_index=True)[1])
        rows = distinct[np.isin(ids[distinct], doc)]
        out, held = [none], []
        for factors, stretches in parse(docs.column("text").take(pa.array(rows)), ids[rows], doc, at, ref, ref_at, length, size):
            if n := len(factors[0]):
                out.append(pa.table(_empty(n) | {"doc_id": pa.array(name[factors[0]], pa.int64()), "text_hash": pa.array(name_key[factors[0]], pa.int64()), "start": pa.array(factors[1], pa.int32()), "end": pa.array(factors[2], pa.int32()), "source_id": pa.array(name[factors[3]], pa.int64())}))
            held.append(stretches)
        if held:
            h, d, a, b = (np.concatenate([x[i] for x in held]) for i in range(4))
            batch = _blobs(_bucket(h, buckets), {"h": (h, "<u8"), "doc": (name[d], "<i8"), "key": (name_key[d], "<i8"), "a": (a, "<i4"), "b": (b, "<i4")})
            if batch is not None:
                cols = _empty(batch.num_rows) | {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                cols["kind"] = pa.array(np.ones(batch.num_rows), pa.int32())
                out.append(pa.table(cols))
        return pa.concat_tables(out)

    return of


def _repeats(group: pa.Table) -> pa.Table:
    """Stretches that an earlier document has too."""
    h, doc, key, a, b = _records(group, {"h": "<u8", "doc": "<i8", "key": "<i8", "a": "<i4", "b": "<i4"})
    order = np.lexsort((a, key, doc, h))
    h, doc, key, a, b = h[order], doc[order], key[order], a[order], b[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    source, again = doc[first], (doc != doc[first]) | (key != key[first])
    return pa.table({"doc_id": doc[again], "text_hash": key[again], "start": a[again].astype(np.int32), "end": b[again].astype(np.int32), "source_id": source[again]})


def _plain(columns: dict[str, str]):
    """The records of blobs as rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                yield pa.RecordBatch.from_arrays([pa.array(x.view("<i8") if x.dtype == np.uint64 else x) for x in _records(row, columns)], names=list(columns))

    return of


def _parted(blobs: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of buckets that one task can take, rows of the others, if any)."""
    sizes = large(blobs.groupBy("bucket").agg(F.sum("n").alias("n")), hot)
    if sizes is None:
        return blobs, None
    known = sizes.select("bucket")
    return blobs.join(known, "bucket", "left_anti"), blobs.join(known, "bucket", "left_semi")


_PLACE = {"h": "<u8", "doc": "<i8", "key": "<i8", "a": "<i4"}


def _shared(index: DataFrame, hot: int) -> DataFrame:
    """For every anchor that two documents have: its places, each with the first."""
    cold, rest = _parted(index, hot)
    out = cold.groupBy("bucket").applyInArrow(lean_group(_firsts), "doc long, key long, at int, ref long, ref_key long, ref_at int")
    if rest is None:
        return out
    places = rest.select(*_PLACE).mapInArrow(_plain(_PLACE), "h long, doc long, key long, a int")
    first = places.groupBy("h").agg(F.min(F.struct("doc", "key", "a")).alias("first"), F.max(F.struct("doc", "key")).alias("last")).filter("first.doc <> last.doc or first.key <> last.key")
    met = places.join(first.select("h", "first"), "h")
    return out.unionByName(met.select("doc", "key", F.col("a").alias("at"), F.col("first.doc").alias("ref"), F.col("first.key").alias("ref_key"), F.col("first.a").alias("ref_at")))


_STRETCH = _PLACE | {"b": "<i4"}


def _repeated(stretches: DataFrame, hot: int) -> DataFrame:
    """Stretches that an earlier document has too."""
    cold, rest = _parted(stretches, hot)
    out = cold.groupBy("bucket").applyInArrow(lean_group(_repeats), "doc_id long, text_hash long, start int, end int, source_id long")
    if rest is None:
        return out
    places = rest.select(*_STRETCH).mapInArrow(_plain(_STRETCH), "h long, doc long, key long, a int, b int")
    first = places.groupBy("h").agg(F.min(F.struct("doc", "key")).alias("first"), F.max(F.struct("doc", "key")).alias("last")).filter("first <> last")
    met = places.join(first.select("h", "first"), "h").filter("doc <> first.doc or key <> first.key")
    return out.unionByName(met.select(F.col("doc").alias("doc_id"), F.col("key").alias("text_hash"), F.col("a").alias("start"), F.col("b").alias("end"), F.col("first.doc").alias("source_id")))


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, text_hash, start, end, source_id): characters start (from 0) to end (exclusive) of the text repeat an earlier document."""
    size = max(1, (length + 2) // 2)
    docs = texts(df, id_col, text_col).filter("doc_id is not null and text is not null").withColumn("text_hash", text_hash(F.col("text")))
    buckets = max(partitions(df.sparkSession), 2 * docs.rdd.getNumPartitions())
    index = materialise(docs.mapInArrow(lean(_index(buckets, length, size)), _PARTS), "index")
    shared = _shared(index, hot)
    by = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    left = docs.withColumn("part", by("doc_id")).groupBy("part")
    right = shared.withColumn("part", by("doc")).groupBy("part")
    parsed = materialise(left.cogroup(right).applyInArrow(lean_group(_parse(buckets, length, size)), _SPANS), "factors")
    repeats = _repeated(parsed.filter("kind = 1").select("bucket", "n", *_STRETCH), hot)
    spans = parsed.filter("kind = 0").select("doc_id", "text_hash", "start", "end", "source_id").unionByName(repeats)
    # Overlapping spans become one.
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
    return apart.withColumn("k", F.sum("new").over(upto)).groupBy("doc_id", "text_hash", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("source_id", F.struct("start", "end")).alias("source_id")).drop("k")


def cut_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The input with the duplicate spans cut out of its texts."""
    i, h, cut_i, cut_h, gone = (fresh(df, c) for c in ("_id", "_hash", "_cut_id", "_cut_hash", "_spans"))
    spans = duplicate_spans(df, id_col, text_col, length)
    cuts = spans.groupBy(F.col("doc_id").alias(cut_i), F.col("text_hash").alias(cut_h)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone))
    text = F.col(f"`{text_col}`")
    named = df.withColumns({i: F.col(f"`{id_col}`").cast("long"), h: text_hash(text.cast("string"))})
    joined = named.join(cuts, (F.col(i) == F.col(cut_i)) & (F.col(h) == F.col(cut_h)), "left")
    rest = F.expr(f"array_join(transform(sequence(0, size({gone})), i -> substring(`{text_col}`, if(i = 0, 0, get({gone}, i - 1).end) + 1, if(i = size({gone}), length(`{text_col}`), get({gone}, i).start) - if(i = 0, 0, get({gone}, i - 1).end))), '')")
    changed = F.col(gone).isNotNull()
    out = joined.withColumn(text_col, F.when(changed, rest).otherwise(text)).filter(~changed | text.rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


def duplicate_spans_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> str:
    """The same in SQL, by the text of every stretch of ``length`` words."""
    capitals = "".join(chr(c) for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7)
    word = r"[0-9A-Za-z\x{80}-\x{10ffff}]+"
    return f"""
WITH docs AS (SELECT DISTINCT {id_col} AS doc_id, {text_col} AS text, CAST('0x' || left(md5({text_col}), 15) AS BIGINT) AS text_hash FROM {table} WHERE {id_col} IS NOT NULL AND {text_col} IS NOT NULL),
cut AS (SELECT doc_id, text_hash, regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '{word}') AS ws, regexp_split_to_array(text, '{word}') AS gaps FROM docs),
word AS (SELECT doc_id, text_hash, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap, unnest(range(1, len(ws) + 1)) AS k FROM cut),
place AS (SELECT doc_id, text_hash, k, length(w) AS size, sum(length(w) + length(gap)) OVER (PARTITION BY doc_id, text_hash ORDER BY k) AS past FROM word),
gram AS (SELECT doc_id, text_hash, k, array_to_string(ws[k : k + {length - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {length - 2})) AS k FROM cut WHERE len(ws) >= {length})),
first AS (SELECT g, min((doc_id, text_hash)) AS f FROM gram GROUP BY g),
again AS (SELECT doc_id, text_hash, k, f[1] AS source_id FROM gram JOIN first USING (g) WHERE f < (doc_id, text_hash)),
apart AS (SELECT *, CASE WHEN k < lag(k) OVER (PARTITION BY doc_id, text_hash ORDER BY k) + {length} THEN 0 ELSE 1 END AS new FROM again),
part AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text_hash ORDER BY k) AS p FROM apart),
span AS (SELECT doc_id, text_hash, min(k) AS a, max(k) + {length - 1} AS z, arg_min(source_id, k) AS source_id FROM part GROUP BY doc_id, text_hash, p)
SELECT s.doc_id, s.text_hash, CAST(x.past - x.size AS INTEGER) AS start, CAST(y.past AS INTEGER) AS "end", s.source_id
FROM span s JOIN place x ON x.doc_id = s.doc_id AND x.text_hash = s.text_hash AND x.k = s.a JOIN place y ON y.doc_id = s.doc_id AND y.text_hash = s.text_hash AND y.k = s.z"""
