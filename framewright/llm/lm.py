"""Language-model scores from an Elias-Fano trie of the corpus's n-grams.

Counting and scoring are one pass over the corpus and one exchange with the trie. Every partition cuts its texts into
chunks, counts each chunk's distinct trigrams, and with them its bigrams and words, which are their prefixes, and sends
each n-gram once to the shard of its context, all of a shard's as one row, so that there are never more rows than contexts. A shard adds up, keeps what was seen ``KEEP`` times or more, which is all of it, and
writes the levels of its part of the trie to the shared folder: contexts, monotone pointers to the begin of each context's
successors, and the successors, numbered relative to their context, all three as Elias-Fano sequences; probabilities and
back-off weights are quantised to a byte. It maps the levels into memory and answers each chunk's n-grams by successor
search; then its file goes, as no other task reads it. The answers, two bytes for most n-grams, go back to the chunks, whose texts wait in the shared folder as numbers of
their words. No text is shuffled, no part of the model is broadcast, and no n-gram goes uncounted.

Smoothing: interpolated absolute discounting. p(w | u v) = share(w | u v) + rest(u v) * p(w | v), share being
(count - D) / count of the context for n-grams that are kept, and rest what the kept ones leave. N-grams seen once are kept
like all others; a greater ``keep`` leaves them to the lower orders.

Defined results: case, punctuation and white space do not count. A null text has a null score and count, one without
words a null score and a count of 0. The score is the natural logarithm of the probability of all words and the text's end;
``perplexity`` is its inverse geometric mean. Every row gives one row, repeated ones too; null ids are kept; other columns are
not looked at. An empty table gives no rows; under a corpus without words every score
is null. Words are told apart by 64-bit hashes, contexts by 48 bits of theirs and successors of one context by 32.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import lean, lean_group, partitions, tidy
from framewright.llm.arrays import gather_ranges, hash_spans, mix64, segment_sums, text_chunks, words
from framewright.llm.common import settled, texts
from framewright.llm.eliasfano import EliasFano
from framewright.storage import filesystem, materialise, new_path

DISCOUNT = 0.75
KEEP = 1
CHUNK_WORDS = 2_000_000
SHARE_STEP, REST_STEP = 7.0, 16.0  # codes a factor of two
_BEGIN, _END = 0, 1
_MARKS = np.array([0x9E6C63D0876A9A99, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_SENT = "bucket int, chunk long, c3 binary, f3 binary, s3 binary, n3 binary, c2 binary, f2 binary, s2 binary, n2 binary, c1 binary, n1 binary"
_ANSWER = "chunk long, bucket int, r3 binary, p3 binary, r2 binary, p2 binary, p1 binary, total long, kinds long"
_SCORES = "doc_id long, n_words long, log_prob double, perplexity double"


# Storage ---------------------------------------------------------------------------------------------------------


def write_bytes(path: str, data: bytes) -> None:
    """Write a file at once: a task that is run again replaces it by the same."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{np.random.SeedSequence().entropy:x}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, at)


def remove(path: str) -> None:
    fs, at = filesystem(path)
    fs.delete_file(at)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file, memory-mapped where the shared folder is mounted."""
    fs, at = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, np.uint8, "r")
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: entropy coding finds what few values a plane has."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return struct.pack("<q", len(raw)) + _ZSTD.compress(raw, asbytes=True)


def unpacked(blob: pa.Scalar, kind: str) -> np.ndarray:
    raw = blob.as_buffer()
    (size,) = struct.unpack("<q", raw.slice(0, 8).to_pybytes())
    flat = np.frombuffer(_ZSTD.decompress(raw.slice(8), size), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# Counting --------------------------------------------------------------------------------------------------------


def sequence(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin begin words end end of every text that has words, places of the third and later of each text)."""
    own = counts[counts > 0]
    size = own + 4
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), _END, np.int64)
    out[first] = out[first + 1] = _BEGIN
    out[gather_ranges(first + 2, own)] = ids
    return out, gather_ranges(first + 2, own + 2)


def distinct(seq: np.ndarray, at: np.ndarray, width: int, inverse: bool) -> tuple[np.ndarray, ...]:
    """(first, second, third, count[, place of each occurrence]) of the distinct trigrams, sorted by words."""
    if width <= 1 << 21:
        key = (seq[at - 2] << 42) | (seq[at - 1] << 21) | seq[at]
        found = np.unique(key, return_inverse=inverse, return_counts=True)
        low, k = (1 << 21) - 1, found[0]
        del key
        parts = tuple(x.astype(np.int32) for x in (k >> 42, (k >> 21) & low, k & low))
    else:  # a text of very many words, more than 21 bits can number
        pair, back = np.unique((seq[at - 2] << 32) | seq[at - 1], return_inverse=True)
        found = np.unique((back << 32) | seq[at], return_inverse=inverse, return_counts=True)
        own = pair[found[0] >> 32]
        parts = tuple(x.astype(np.int32) for x in (own >> 32, own & 0xFFFFFFFF, found[0] & 0xFFFFFFFF))
    return (*parts, found[-1], found[1]) if inverse else (*parts, found[-1])


def context_of(*hashes: np.ndarray) -> np.ndarray:
    """The 48-bit key of a context."""
    h = np.full(len(hashes[0]), len(hashes), np.uint64)
    for x in hashes:
        h = mix64(h * _MARKS[0] + x)
    return h >> np.uint64(16)


def bucket_of(contexts: np.ndarray, buckets: int) -> np.ndarray:
    return (((contexts >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, the most frequent first, the number of each word)."""
    vocabulary, ids, n = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return vocabulary[order], rank[ids]


class Ngrams:
    """A chunk's n-grams in the order in which they are sent and answered: by level, context and successor."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, counts: np.ndarray, inverse: bool):
        """vocabulary: hashes of distinct words; ids: of all texts' words one after the other."""
        n_texts = int((counts > 0).sum())
        seq, at = sequence(ids + 2, counts)
        a, b, c, n, *back = distinct(seq, at, len(vocabulary) + 2, inverse)
        known = np.concatenate([_MARKS, vocabulary])
        successor = (known >> np.uint64(32)).astype(np.uint32)
        pair = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(pair)
        pa_, pb, pn = a[first], b[first], np.add.reduceat(n, first) if len(first) else n
        # Level 3: all but the one after the end. Level 2: the pairs but the two marks. Level 1: words and the end.
        real3, real2 = b != _END, pb != _BEGIN
        self.levels = [
            self._level(context_of(known[pa_], known[pb]), np.cumsum(pair) - 1, successor[c], n, real3),
            self._level(context_of(known), pa_, successor[pb], pn, real2),
        ]
        words_n = np.bincount(pa_[real2], weights=pn[real2], minlength=len(known)).astype(np.int64)
        words_n[_END] = n_texts
        one = np.concatenate([[_END], np.arange(2, len(known))])
        keys = context_of(known[one])
        order = np.argsort(keys, kind="stable")
        self.words, self.word_counts, self.word_place = keys[order], words_n[one][order], np.zeros(len(known), np.int64)
        self.word_place[one[order]] = np.arange(len(one))
        if inverse:  # each occurrence's place in every list of records
            keep = seq[at - 1] != _END
            record = back[0][keep]
            pair2 = np.searchsorted((pa_.astype(np.int64) << 32) | pb, (b.astype(np.int64) << 32) | c)
            self.third, self.second, self.first = self.levels[0]["place"][record], self.levels[1]["place"][pair2[record]], self.word_place[c[record]]

    @staticmethod
    def _level(contexts: np.ndarray, own: np.ndarray, successors: np.ndarray, counts: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(real)
        used, dense = np.unique(own[at], return_inverse=True)
        order = np.argsort(contexts[used], kind="stable")
        rank = np.empty(len(used), np.int64)
        rank[order] = np.arange(len(used))
        by = np.argsort((rank[dense].astype(np.uint64) << np.uint64(32)) | successors[at].astype(np.uint64), kind="stable")
        place = np.full(len(own), -1, np.int64)
        place[at[by]] = np.arange(len(at))
        fans = np.bincount(rank[dense], minlength=len(used))
        return {"contexts": contexts[used][order], "fans": fans, "successors": successors[at][by], "counts": counts[at][by], "place": place}

    def rows(self, chunk: int, buckets: int, counted: bool) -> Iterator[pa.RecordBatch]:
        """A row a shard that the chunk has n-grams for: of each level the contexts' steps, their numbers of successors, those, and counts."""
        out: dict[int, dict[str, bytes]] = {}

        def put(level: int, contexts: np.ndarray, fans: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> None:
            cuts = np.searchsorted(bucket_of(contexts, buckets), np.arange(buckets + 1))
            ends = np.concatenate([[0], np.cumsum(fans)])
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                s, e = cuts[k], cuts[k + 1]
                a, z = (ends[s], ends[e]) if level > 1 else (s, e)
                own = out.setdefault(k, {})
                own[f"c{level}"] = packed(np.diff(contexts[s:e], prepend=np.uint64(0)))
                own[f"n{level}"] = packed((counts[a:z] if counted else np.zeros(z - a)).astype("<u4"))
                if level > 1:
                    own[f"f{level}"], own[f"s{level}"] = packed(fans[s:e].astype("<u4")), packed(successors[a:z])

        for level, x in ((3, self.levels[0]), (2, self.levels[1])):
            put(level, x["contexts"], x["fans"], x["successors"], x["counts"])
        put(1, self.words, np.zeros(0, np.int64), np.zeros(0, np.uint32), self.word_counts)
        names = ("c3", "f3", "s3", "n3", "c2", "f2", "s2", "n2", "c1", "n1")
        columns = [pa.array(list(out), pa.int32()), pa.array([chunk] * len(out), pa.int64()), *(pa.array([x.get(n) for x in out.values()], pa.binary()) for n in names)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", *names])


def _count(folder: str, buckets: int, scored: bool, counted: bool, chunk_words: int):
    """Chunks' n-grams; a chunk that is to be scored leaves its texts, as numbers of words, in the shared folder."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal k, size
            h, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            chunk = (part << 24) | k if scored else -1
            vocabulary, ids = numbered(h)
            if scored:
                text = {"ids": pa.chunked_array([x[2] for x in held]), "counts": pa.array(counts), "null": pa.array(np.concatenate([x[3] for x in held]))}
                blob = {"vocabulary": pa.array([vocabulary.astype("<u8").tobytes()], pa.large_binary()), "words": pa.array([packed(ids.astype("<u4"))], pa.large_binary())}
                sink = pa.BufferOutputStream()
                for table in (pa.table(text), pa.table(blob)):
                    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_table(table)
                write_bytes(f"{folder}/texts/{chunk}", sink.getvalue().to_pybytes())
            held.clear()
            del h
            yield from Ngrams(vocabulary, ids, counts, False).rows(chunk, buckets, counted)
            k, size = k + 1, 0

        for batch in batches:
            column = batch.column(1)
            for row, buf, offsets in text_chunks(column):
                low, starts, lengths, counts = words(buf, offsets)
                m = len(counts)
                if size and size + len(starts) > chunk_words:
                    yield from flush()
                held.append((hash_spans(low, starts, lengths), counts, batch.column(0).slice(row, m), column.slice(row, m).is_null().to_numpy(zero_copy_only=False)))
                size += len(starts)
        if held:
            yield from flush()

    return of


# The trie --------------------------------------------------------------------------------------------------------


def share_code(share: np.ndarray) -> np.ndarray:
    """1 to 255 for probabilities, 0 for none."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint(-np.log2(share) * SHARE_STEP)
    return np.where(share > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


def rest_code(rest: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log2(np.maximum(rest, 1e-30)) * REST_STEP), 0, 255).astype(np.uint8)


SHARE_OF = np.concatenate([[0.0], 2.0 ** (-np.arange(255) / SHARE_STEP)])
REST_OF = 2.0 ** (-np.arange(256) / REST_STEP)


def summed(contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct contexts, context's number of each n-gram, successor, count) of n-grams that may repeat."""
    used, own = np.unique(contexts, return_inverse=True)
    key = (own.astype(np.uint64) << np.uint64(32)) | successors.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, first) if len(first) else counts
    key = key[first]
    return used, (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF), total


class Trie:
    """A shard's part of the trie: levels of words, of bigrams and of trigrams, by context."""

    def __init__(self, head: dict, arrays: list[np.ndarray]):
        self.total, self.kinds = head["total"], head["kinds"]
        facts, parts = iter(head["ef"]), iter(arrays)

        def ef() -> EliasFano:
            own = next(facts)
            return EliasFano(own["n"], own["bits"], next(parts), next(parts))

        self.words, self.counts = ef(), next(parts).view("<f4")
        self.levels = {level: (ef(), ef(), ef(), next(parts), next(parts)) for level in (2, 3)}

    @staticmethod
    def build(words_: tuple[np.ndarray, np.ndarray], levels: dict[int, tuple[np.ndarray, ...]], keep: int = KEEP) -> bytes:
        """words: (keys, counts), distinct; levels: for 2 and 3 what ``summed`` gives."""
        keys, counts = words_
        head: dict = {"total": int(counts.sum()), "kinds": len(keys), "ef": []}
        arrays: list[np.ndarray] = []

        def ef(values: np.ndarray, universe: int) -> None:
            facts, blobs = EliasFano.of(values, universe).blobs()
            head["ef"].append(facts)
            arrays.extend(blobs)

        ef(keys, 1 << 48)
        arrays.append(counts.astype("<f4").view(np.uint8))
        for level in (2, 3):
            used, own, successor, n = levels[level]
            total = np.bincount(own, weights=n, minlength=len(used))
            kept = n >= keep
            own, successor, n = own[kept], successor[kept], n[kept]
            share = share_code((n - DISCOUNT) / total[own])
            left = 1 - np.bincount(own, weights=SHARE_OF[share], minlength=len(used))
            floor = DISCOUNT * np.bincount(own, minlength=len(used)) / np.maximum(total, 1)
            rest = rest_code(np.maximum(left, np.minimum(floor, 1)))
            has = np.bincount(own, minlength=len(used))
            some = has > 0
            number = np.cumsum(some) - 1
            pointers = np.concatenate([[0], np.cumsum(has[some])])
            ef(used[some], 1 << 48)
            ef(pointers, int(pointers[-1]) + 1)
            ef((number[own].astype(np.uint64) << np.uint64(32)) | successor, max(1, int(some.sum())) << 32)
            arrays += [share, rest[some]]
        head["sizes"] = [int(a.nbytes) for a in arrays]
        raw = json.dumps(head).encode()
        return struct.pack("<q", len(raw)) + raw + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def open(cls, path: str) -> Trie:
        data = mapped(path)
        (size,) = struct.unpack("<q", data[:8].tobytes())
        head = json.loads(data[8 : 8 + size].tobytes())
        ends = 8 + size + np.cumsum([0, *head["sizes"]])
        return cls(head, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        at = self.words.locate(keys)
        return np.where(at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else np.float32(0), np.float32(0)).astype("<f4")

    def search(self, level: int, contexts: np.ndarray, fans: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of what each context leaves, code of each successor's share): a context's successors lie from its pointer to
        the next, and only there is a successor looked for."""
        keys, pointers, followers, shares, rests = self.levels[level]
        at = keys.locate(contexts)
        known = np.flatnonzero(at >= 0)
        rest, share = np.zeros(len(contexts), np.uint8), np.zeros(len(successors), np.uint8)
        if not len(known):
            return rest, share
        rest[known] = rests[at[known]]
        own = at[known]
        n = fans[known]
        mine = gather_ranges((np.cumsum(fans) - fans)[known], n)
        begin, end = np.repeat(pointers.access(own), n).astype(np.int64), np.repeat(pointers.access(own + 1), n).astype(np.int64)
        want = (np.repeat(own, n).astype(np.uint64) << np.uint64(32)) | successors[mine].astype(np.uint64)
        found = followers.locate(want, begin, end)
        hit = found >= 0
        share[mine[hit]] = shares[found[hit]]
        return rest, share


def _serve(folder: str, keep: int):
    """A shard: build its part of the trie, then answer every chunk from it."""

    def of(group: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        bucket, chunks = group.column("bucket")[0].as_py(), group.column("chunk").to_pylist()

        def each(name: str, kind: str) -> list[np.ndarray]:
            return [unpacked(x, kind) if x.is_valid else np.zeros(0, kind) for x in group.column(name)]

        contexts = {k: [np.cumsum(x, dtype=np.uint64) for x in each(f"c{k}", "<u8")] for k in (1, 2, 3)}
        fans = {k: [x.astype(np.int64) for x in each(f"f{k}", "<u4")] for k in (2, 3)}
        successors = {k: each(f"s{k}", "<u4") for k in (2, 3)}
        own: dict[int, tuple] = {}
        for level in (1, 2, 3):
            n = np.concatenate(each(f"n{level}", "<u4")).astype(np.int64)
            seen = n > 0  # texts that are only scored do not count
            if level == 1:
                keys, back = np.unique(np.concatenate(contexts[1])[seen], return_inverse=True)
                own[1] = keys, np.bincount(back, weights=n[seen], minlength=len(keys))
            else:
                wide = np.repeat(np.concatenate(contexts[level]), np.concatenate(fans[level]))
                own[level] = summed(wide[seen], np.concatenate(successors[level])[seen], n[seen])
            del n
        path = f"{folder}/trie/{bucket}.{TaskContext.get().taskAttemptId()}"
        write_bytes(path, Trie.build(own.pop(1), own, keep))
        del own
        tidy()
        trie = Trie.open(path)
        names = ("chunk", "r3", "p3", "r2", "p2", "p1")
        out: list[tuple] = [(-1, None, None, None, None, None)]
        for i, chunk in enumerate(chunks):
            if chunk >= 0:
                found = [trie.search(k, contexts[k][i], fans[k][i], successors[k][i]) if len(contexts[k][i]) else None for k in (3, 2)]
                blobs = [packed(x) if f is not None else None for f in found for x in (f or (None, None))]
                out.append((chunk, *blobs, packed(trie.word_counts(contexts[1][i])) if len(contexts[1][i]) else None))
        remove(path)
        m = len(out)
        kinds = [pa.int64(), *[pa.binary()] * 5]
        columns = dict(zip(names, (pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)), strict=True))
        totals = {n: pa.array([x, *[None] * (m - 1)], pa.int64()) for n, x in (("total", trie.total), ("kinds", trie.kinds))}
        return pa.table({"chunk": columns.pop("chunk"), "bucket": pa.array([bucket] * m, pa.int32()), **columns, **totals})

    return of


# Scores ----------------------------------------------------------------------------------------------------------


def _score(folder: str, total: int, kinds: int):
    """A chunk's answers, put together with its texts."""

    def of(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bucket", "ascending")])
        chunk = group.column("chunk")[0].as_py()
        codes = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in group.column(name) if x.is_valid)])
        source = pa.BufferReader(pa.py_buffer(mapped(f"{folder}/texts/{chunk}")))
        text, kept = pa.ipc.open_stream(source).read_all(), pa.ipc.open_stream(source).read_all()
        n, null = text.column("counts").to_numpy(), text.column("null").to_numpy()
        grams = Ngrams(np.frombuffer(kept.column("vocabulary")[0].as_buffer(), "<u8"), unpacked(kept.column("words")[0], "<u4").astype(np.int64), n, True)
        counts = codes("p1", "<f4").astype(np.float64)
        p = (np.maximum(counts - DISCOUNT, 0) / max(total, 1) + DISCOUNT * max(kinds, 1) / max(total, 1) / (kinds + 1))[grams.first]
        for at, k, own in ((grams.second, 2, grams.levels[1]), (grams.third, 3, grams.levels[0])):
            p = SHARE_OF[codes(f"p{k}", "u1")][at] + REST_OF[np.repeat(codes(f"r{k}", "u1"), own["fans"])][at] * p
        logs = segment_sums(np.log(p), np.where(n > 0, n + 1, 0))
        none = null | (n == 0) | (total == 0)
        return pa.table(
            {
                "doc_id": text.column("ids").cast(pa.int64()), "n_words": pa.array(n, pa.int64(), mask=null),
                "log_prob": pa.array(logs, mask=none), "perplexity": pa.array(np.exp(-logs / (n + 1)), mask=none),
            }
        )

    return of


def score(df: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, log_prob, perplexity) of all texts under the model of the corpus, by default of the texts themselves."""
    spark = df.sparkSession
    folder = new_path(spark, "lm")
    docs = settled(texts(df, id_col, text_col))
    buckets = max(partitions(spark), docs.rdd.getNumPartitions())
    sent = [docs.mapInArrow(lean(_count(folder, buckets, True, corpus is None, chunk_words)), _SENT)]
    if corpus is not None:
        sent.append(settled(texts(corpus, id_col, text_col)).mapInArrow(lean(_count(folder, buckets, False, True, chunk_words)), _SENT))
    served = reduce(DataFrame.unionByName, sent).groupBy("bucket").applyInArrow(lean_group(_serve(folder, keep)), _ANSWER)
    answers = materialise(served, "answers")
    total, kinds = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return answers.filter("chunk >= 0").select("chunk", "bucket", "r3", "p3", "r2", "p2", "p1").groupBy("chunk").applyInArrow(lean_group(_score(folder, int(total), int(kinds))), _SCORES)
