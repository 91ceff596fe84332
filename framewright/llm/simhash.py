"""SimHash near-duplicates, found by the May-Ozerov recursion.

A text's fingerprint has 256 bits, the signs of sums over its distinct pairs of neighbouring words, the first word with the text's
begin being a pair too. Two texts are near duplicates when their fingerprints differ in at most ``RADIUS`` bits, and classes are
the components of that relation.

Search: a strip is a random choice of coordinates; a filter keeps the fingerprints whose bits on the strip differ from
a random centre in a partial weight of at most ``weight``. Close fingerprints pass the same filter far more often
than others. What a filter keeps is filtered again on a further strip, and again, until lists are short, and short lists are
compared by brute force. The size of the strips and the depth of the recursion follow from the number of fingerprints: ``plan`` takes
what costs least. The whole recursion is repeated until a pair at the radius is met with probability ``RECALL``, worked out
exactly from the filters; nearer pairs are met more surely. Nothing is capped: every fingerprint goes through every repetition,
within a list every pair is compared, and a list that is long all the same is compared in blocks. Equal fingerprints, of which there may be
any number, are one row. Links are counted within whole classes, also those of pairs that met in no list.

Defined results: a document is an id with a text; rows that repeat both are one document, and different texts under an id are documents of
their own, told apart by ``text_hash``, 60 bits of the text's MD5, -1 for a null text. Case, punctuation and white space do not count. Texts without words
are near only if they are equal. A null text is near no other and is kept. Rows with a null id are in no class and are kept. Of a class
the least (id, text_hash) is the representative and stays. An empty table gives no rows. Other columns are ignored by ``near_duplicates`` and
kept by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import BLOCK, classed, dealt, edges_of, large, lean, lean_group
from framewright.llm.arrays import gather_ranges, hash_spans, mix64, text_chunks, words
from framewright.llm.common import fresh, text_hash, texts
from framewright.storage import materialise

BITS = 256
RADIUS = 56
RECALL = 0.95
#: (coordinates, weight) of the strips that a plan can take, and the costs it weighs: of a row in a list, of a pair of them.
STRIPS = ((16, 2), (18, 2), (20, 2))
DEPTH = 4
ROW_COST, PAIR_COST = 4.0, 0.0024
_WORDS = ["f0", "f1", "f2", "f3"]
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
_LOW = np.uint64(53)
_BIT = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float32)


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of four 64-bit words a text."""
    low, starts, lengths, counts = words(buf, offsets)
    n = len(counts)
    h = hash_spans(low, starts, lengths)
    first = np.cumsum(counts) - counts
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[counts > 0]] = 0
    feature = mix64(h + before * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((n, 4), np.uint64)
    for a in range(0, n, 2048):
        b = min(n, a + 2048)
        own = counts[a:b]
        doc = np.repeat(np.arange(b - a, dtype=np.uint64), own)
        part = np.sort((doc << _LOW) | (feature[first[a] : first[a] + own.sum()] >> np.uint64(11)))
        part = part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part
        doc = (part >> _LOW).astype(np.int64) * 256
        part &= (np.uint64(1) << _LOW) - np.uint64(1)
        least = np.zeros(b - a, np.uint64)  # settles sums of 0, mostly alike in near texts
        least[own > 0] = part[np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))] if len(part) else 0
        for w in range(4):
            raw = np.ascontiguousarray(mix64(part + _SEEDS[w])).view(np.uint8).reshape(-1, 8)
            sums = np.concatenate([np.bincount(doc + raw[:, k], minlength=(b - a) * 256).reshape(-1, 256).astype(np.float32) @ _BIT for k in range(8)], axis=1)
            tied = np.unpackbits(mix64(mix64(least) ^ _SEEDS[w])[:, None].view(np.uint8), axis=1, bitorder="little")
            out[a:b, w] = np.packbits(np.where(sums == 0, tied, sums > 0), axis=1, bitorder="little").view("<u8").ravel()
    none = np.flatnonzero(counts == 0)
    if len(none):
        out[none] = mix64(hash_spans(buf, offsets[:-1][none], np.diff(offsets)[none])[:, None] ^ _SEEDS)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, 4), np.uint64)
        for row, buf, offsets in text_chunks(batch.column(1)):
            out[row : row + len(offsets) - 1] = fingerprints(buf, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(4))], names=["doc_id", "text_hash", *_WORDS])


# Filters ---------------------------------------------------------------------------------------------------------


def ball(size: int, weight: int) -> int:
    """How many values of a strip lie within the weight of a centre."""
    return sum(math.comb(size, i) for i in range(weight + 1))


def met(size: int, weight: int, radius: int) -> float:
    """Probability that two fingerprints, ``radius`` bits apart, pass a common filter of one strip.

    The strip's differing bits are hypergeometric; given those, centres are independent.
    """
    centres, total = centres_of(size, weight), 0.0
    for d in range(min(size, radius) + 1):
        both = sum(math.comb(d, i) * math.comb(size - d, j) for i in range(d + 1) for j in range(size - d + 1) if max(i, d - i) + j <= weight)
        total += math.comb(radius, d) * math.comb(BITS - radius, size - d) / math.comb(BITS, size) * (1 - (1 - both / 2**size) ** centres)
    return total


def centres_of(size: int, weight: int) -> int:
    """So many that about one filter of a strip keeps a given fingerprint."""
    return round(2**size / ball(size, weight))


@dataclass(frozen=True)
class Plan:
    size: int
    weight: int
    depth: int
    repeats: int

    @property
    def kept(self) -> float:
        """The share of unlike fingerprints in a list."""
        return (ball(self.size, self.weight) / 2**self.size) ** self.depth

    def cost(self, n: float) -> float:
        return self.repeats * (ROW_COST + PAIR_COST * n * self.kept)


@lru_cache(maxsize=64)
def _plans(radius: int, recall: float) -> tuple[Plan, ...]:
    return tuple(Plan(s, w, d, math.ceil(math.log(1 - recall) / math.log1p(-(met(s, w, radius) ** d)))) for s, w in STRIPS for d in range(1, DEPTH + 1))


def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> Plan:
    """What costs least over n fingerprints: longer lists at first, then wider strips, then a deeper recursion."""
    return min(_plans(radius, recall), key=lambda p: p.cost(n))


class Filters:
    """A plan's strips: the coordinates of each repetition and depth, and for each value of their bits the filters that keep it.

    All strips share one set of random centres; a random mask moves it anew for each.
    """

    def __init__(self, p: Plan):
        self.plan, random = p, np.random.default_rng(1009)
        self.centres = centres_of(p.size, p.weight)
        base = random.choice(1 << p.size, self.centres, replace=False)
        at = np.arange(1 << p.size, dtype=np.uint32)
        value = (base[:, None] ^ at[np.bitwise_count(at) <= p.weight].astype(np.int64)).ravel()
        centre = np.repeat(np.arange(self.centres, dtype=np.int32), len(value) // self.centres)
        order = np.argsort(value, kind="stable")
        self.kept_by = centre[order]
        self.begin = np.searchsorted(value[order], np.arange((1 << p.size) + 1)).astype(np.int32)
        self.strips = np.stack([random.permutation(BITS)[: p.size * p.depth].reshape(p.depth, p.size) for _ in range(p.repeats)])
        self.masks = random.integers(0, 1 << p.size, (p.repeats, p.depth))

    @cached_property
    def weights(self) -> np.ndarray:
        return 1 << np.arange(self.plan.size)

    def lists(self, bits: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, lists): the lists of a repetition that the recursion brings each row to."""
        rows, found = np.arange(len(bits)), np.full(len(bits), repeat, np.int64)
        for strip, mask in zip(self.strips[repeat], self.masks[repeat], strict=True):
            value = (bits[:, strip].astype(np.int64) @ self.weights)[rows] ^ mask
            first = self.begin[value].astype(np.int64)
            n = self.begin[value + 1] - first
            found = np.repeat(found * self.centres, n) + self.kept_by[gather_ranges(first, n)]
            rows = np.repeat(rows, n)
        return rows, found


_filters: dict[Plan, Filters] = {}


def filters(p: Plan) -> Filters:
    if p not in _filters:
        _filters.clear()
        _filters[p] = Filters(p)
    return _filters[p]


def unpack(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), BITS // 8), axis=1, bitorder="little")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (..., s, 4) and (..., t, 4)."""
    d = np.bitwise_count(a[..., :, None, 0] ^ b[..., None, :, 0]).astype(np.uint16)
    for w in range(1, 4):
        d += np.bitwise_count(a[..., :, None, w] ^ b[..., None, :, w])
    return d


PART = 4_096  # fingerprints that pass the filters at once


def _prints(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(w).to_numpy().view(np.uint64) for w in _WORDS], axis=1)


def _filter(p: Plan):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters(p)
        for whole in batches:
            for a in range(0, whole.num_rows, PART):
                batch = whole.slice(a, PART)
                bits = unpack(_prints(batch))
                for r in range(p.repeats):
                    rows, found = own.lists(bits, r)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(found), *batch.take(pa.array(rows)).columns], names=["list", "kind", *_WORDS])

    return of


def _sizes(p: Plan):
    """Rows (list, n): how many fingerprints each list has, added up as far as a task sees them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = filters(p), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            found, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return found, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for whole in batches:
            for a in range(0, whole.num_rows, PART):
                bits = unpack(_prints(whole.slice(a, PART)))
                for r in range(p.repeats):
                    held.append(np.unique(own.lists(bits, r)[1], return_counts=True))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    held = [added()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["list", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], names=["list", "n"])

    return of


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, text_hash, class_id, class_hash, links), one a document: its class's representative, and how many other documents
    are near it."""
    docs = texts(df, id_col, text_col).filter("doc_id is not null").withColumn("text_hash", F.coalesce(text_hash(F.col("text")), F.lit(-1).cast("long")))
    words_ = ", ".join(f"{w} long" for w in _WORDS)
    prints = materialise(docs.filter("text is not null").mapInArrow(lean(_fingerprint), f"doc_id long, text_hash long, {words_}"), "prints").distinct()
    alike = prints.groupBy(*_WORDS).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"))
    kinds = materialise(alike.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    n = kinds.count()
    p = plan(n, radius, recall)
    own = kinds.select("kind", *_WORDS)
    sizes = large(own.mapInArrow(lean(_sizes(p)), "list long, n long").groupBy("list").agg(F.sum("n").alias("n")), block)
    rows = dealt(own.mapInArrow(lean(_filter(p)), f"list long, kind long, {words_}"), "list", "kind", sizes, n * p.repeats, block)
    near = lambda a, b: apart(a, b) <= radius
    edges = rows.groupBy("part").applyInArrow(lean_group(edges_of("kind", "list", _prints, near)), "a long, b long")
    found = classed(kinds, edges, ["doc_id", "text_hash"], _WORDS, _prints, near, block)
    out = prints.join(found, _WORDS).select("doc_id", "text_hash", F.col("first_doc_id").alias("class_id"), F.col("first_text_hash").alias("class_hash"), "links")
    alone = docs.filter("text is null").select("doc_id", "text_hash").distinct()
    return out.unionByName(alone.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(0).cast("long").alias("links")))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """The input without the rows of documents that are not their class's representative; columns as they are."""
    i, h, gone_i, gone_h = (fresh(df, c) for c in ("_id", "_hash", "_gone_id", "_gone_hash"))
    gone = near_duplicates(df, id_col, text_col, radius, recall).filter("doc_id <> class_id or text_hash <> class_hash").select(F.col("doc_id").alias(gone_i), F.col("text_hash").alias(gone_h))
    named = df.withColumns({i: F.col(f"`{id_col}`").cast("long"), h: text_hash(F.col(f"`{text_col}`").cast("string"))})
    return named.join(gone, (F.col(i) == F.col(gone_i)) & (F.col(h) == F.col(gone_h)), "left_anti").drop(i, h)
