"""Toxicity by two class-conditional Kneser-Ney models of spelling.

A toxic and an ordinary model give every word of a text its likelihood, letter by letter, each letter given up to
``ORDER - 1`` before it in the word. The top order is counted for each class; below it both classes back off to the
same Kneser-Ney continuation counts of the pooled words, so an expression too rare to tell the classes apart has the
same likelihood under both and does not count. Toxic text is ordinary text with toxic words strewn in, so the toxic
likelihood of a word is that of a mixture: ``1 - SHARE`` of the ordinary model and ``SHARE`` of the toxic one; what the
classes' texts merely differ by in language or subject then weighs little. A text's score is the difference of the two
log-likelihoods divided by its number of words, and it is toxic from a threshold on that is set on held-out labelled
texts, where a false alarm costs ``FALSE_ALARM`` times a miss.

Only the fit is bounded: it reads at most ``per_class`` labelled texts of each class, those least by a hash of the id.
Every text of the input is scored whole.

Defined results: a null text, an empty one or one without words has score 0 and is not toxic, whatever the threshold; a score equal to
the threshold is toxic. With fewer than 5 held-out texts of either class the threshold is set on the texts that were fitted. Each row gives one row,
repeated ones too; null ids are kept. Labels that are null or whose id is null are ignored; where an id is labelled both
ways, toxic counts. With no toxic or no ordinary labelled text every score is 0. Other columns, whatever their names,
are passed over by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import lean
from framewright.llm.arrays import PAD, HashIndex, gather_ranges, hash_spans, segment_sums, text_chunks, words
from framewright.llm.common import texts

ORDER = 5
SHARE = 0.003
FALSE_ALARM = 10.0
PER_CLASS = 4_000
DISCOUNT = 0.75
HELD_OUT = 4  # every fourth sampled text sets the threshold
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_BYTE = np.uint64(8)


def spell(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes up to and with each predicted letter as one number, how many of them belong to the word).

    A word is a mark, its letters and another mark; the first mark is not predicted.
    """
    size = lengths + 2
    ends = np.cumsum(size)
    stream = np.ones(8 + int(size.sum()), np.uint8)
    first = ends - size + 8
    stream[gather_ranges(first + 1, lengths)] = low[gather_ranges(starts, lengths)]
    stream[first + size - 1] = 2
    at = gather_ranges(first + 1, size - 1)
    seen = at - np.repeat(first, size - 1) + 1
    back = np.ndarray((len(stream) - 7,), ">u8", stream, strides=(1,))
    return back[at - 7].astype(np.uint64), seen


def _grams(past: np.ndarray, seen: np.ndarray, order: int) -> np.ndarray:
    return past & _MASK[np.minimum(seen, order)]


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, weights=weights, minlength=len(distinct))


def _interpolation(grams: np.ndarray, counts: np.ndarray, contexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(discounted share of each gram, contexts, weight that each leaves to the lower order)."""
    ctx, back = np.unique(grams >> _BYTE, return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(ctx))
    kinds = np.bincount(back, weights=counts > 0, minlength=len(ctx))
    share = np.maximum(counts - DISCOUNT, 0) / total[back]
    return share, ctx, DISCOUNT * kinds / total


@dataclass
class Level:
    grams: np.ndarray
    share: np.ndarray  # a row a class, or one for both
    contexts: np.ndarray
    rest: np.ndarray

    def table(self) -> tuple[HashIndex, HashIndex]:
        if not hasattr(self, "_tables"):
            g, c = HashIndex(8), HashIndex(8)
            g.add(mix(self.grams))
            c.add(mix(self.contexts))
            self._tables = g, c
        return self._tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def mix(keys: np.ndarray) -> np.ndarray:
    return keys + np.uint64(1)


class Model:
    """Both classes' likelihoods of words."""

    def __init__(self, samples: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], order: int = ORDER):
        """samples: for the ordinary and the toxic class, (past, seen, count) of every letter of its distinct words."""
        self.order, self.levels = order, []
        past, seen, weight = (np.concatenate([s[i] for s in samples]) for i in range(3))
        kind = np.concatenate([np.full(len(s[0]), i) for i, s in enumerate(samples)])
        keys = _grams(past, seen, order)
        grams, back = np.unique(keys, return_inverse=True)
        by_class = [np.bincount(back[kind == c], weights=weight[kind == c], minlength=len(grams)) for c in (0, 1)]
        pooled = by_class[0] + by_class[1]
        ctx, at = np.unique(grams >> _BYTE, return_inverse=True)
        share, rest = [], []
        for c in by_class:
            total = np.bincount(at, weights=c, minlength=len(ctx))
            kinds = np.bincount(at, weights=c > 0, minlength=len(ctx))
            some = np.maximum(total, 1)
            share.append(np.where(c > 0, np.maximum(c - DISCOUNT, 0) / some[at], 0))
            rest.append(np.where(total > 0, DISCOUNT * kinds / some, 1))
        top = Level(grams, np.array(share, np.float32), ctx, np.array(rest, np.float32))
        size = _sizes(grams)
        # Shared lower orders: distinct letters to the left, or the counts themselves where the word begins.
        count = pooled
        for k in range(order - 1, 0, -1):
            long = size > k
            kept, left = grams[~long], count[~long]
            shorter, n = _counted(np.concatenate([grams[long] & _MASK[k], kept]), np.concatenate([np.ones(long.sum()), left]))
            grams, count = shorter, n
            size = _sizes(grams)
            s, c, r = _interpolation(grams, count)
            self.levels.insert(0, Level(grams, s[None].astype(np.float32), c, r[None].astype(np.float32)))
        self.levels.append(top)

    def ratios(self, past: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """log p(letter | toxic) - log p(letter | ordinary) of each letter, before the mixture."""
        p = np.full((1, len(past)), 1 / 256, np.float32)
        for k, level in enumerate(self.levels, 1):
            keys = _grams(past, seen, k)
            g, c = level.table()
            at, ctx = g.find(mix(keys)), c.find(mix(keys >> _BYTE))
            share = np.where(at >= 0, level.share[:, at], np.float32(0))
            rest = np.where(ctx >= 0, level.rest[:, ctx], np.float32(1))
            again = (seen < k) & (k < len(self.levels))  # a word's start: this level has been counted in already
            p = np.where(again, p, share + rest * p) if again.any() else share + rest * p
        return np.log(p[1]) - np.log(p[0])

    def word_ratios(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        past, seen = spell(low, starts, lengths)
        ratio = segment_sums(self.ratios(past, seen).astype(np.float64), lengths + 1)
        return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio)


def _sizes(grams: np.ndarray) -> np.ndarray:
    size = np.zeros(len(grams), np.int64)
    for k in range(8):
        size += (grams >> np.uint64(8 * k)) > 0
    return size


def _distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(past, seen, count) of the letters of a class's distinct words."""
    index, counts, pool = HashIndex(), np.zeros(0, np.int64), []
    for _, buf, offsets in text_chunks(column):
        low, starts, lengths, _ = words(buf, offsets)
        h = hash_spans(low, starts, lengths)
        ids = index.find(h)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            index.add(new)
            ids[miss] = index.find(h[miss])
            pool.append((low[gather_ranges(starts[miss[first]], lengths[miss[first]])], lengths[miss[first]]))
        fresh = np.bincount(ids, minlength=index.n)
        fresh[: len(counts)] += counts
        counts = fresh
    if not pool:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.concatenate([p[0] for p in pool] + [np.zeros(PAD, np.uint8)])
    lengths = np.concatenate([p[1] for p in pool])
    past, seen = spell(low, np.cumsum(lengths) - lengths, lengths)
    return past, seen, np.repeat(counts, lengths + 1)


class Scorer:
    """Scores of whole texts; each distinct word is spelled once while it stays in the cache."""

    def __init__(self, model: Model | None, limit: int = 1_500_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.index, self.values = HashIndex(), np.zeros(1 << 15)

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.counted(column)[0]

    def toxic(self, column: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, whether they are at least the threshold, which a text without words never is)."""
        scores, counts = self.counted(column)
        return scores, (scores >= threshold) & (counts > 0)

    def counted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scores, words) of texts."""
        out, counts = np.zeros(len(column)), np.zeros(len(column), np.int64)
        if self.model is None:
            return out, counts
        for row, buf, offsets in text_chunks(column):
            low, starts, lengths, per_text = words(buf, offsets)
            h = hash_spans(low, starts, lengths)
            ids = self.index.find(h)
            miss = np.flatnonzero(ids < 0)
            if len(miss):
                new, first = np.unique(h[miss], return_index=True)
                if self.index.n + len(new) > self.limit and self.index.n:
                    self._clear()
                    new, first = np.unique(h, return_index=True)
                    miss, ids = np.arange(len(h)), np.full(len(h), -1, np.int32)
                at = self.index.add(new)
                while len(self.values) < self.index.n:
                    self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                for k in range(0, len(new), 50_000):
                    part = miss[first[k : k + 50_000]]
                    self.values[at[k : k + 50_000]] = self.model.word_ratios(low, starts[part], lengths[part])
                ids[miss] = self.index.find(h[miss])
            out[row : row + len(per_text)] = segment_sums(self.values[ids], per_text) / np.maximum(per_text, 1)
            counts[row : row + len(per_text)] = per_text
        return out, counts


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The midpoint of the gap of the least cost, the widest of equal ones: the rate of misses and, weighed, of false alarms."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], toxic[order].astype(float)
    if not len(s) or t.all() or not t.any():
        return np.inf
    missed = np.concatenate([[0], np.cumsum(t)]) / t.sum()
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / (1 - t).sum()
    cost = (missed + FALSE_ALARM * alarms)[1:-1]
    gap = np.diff(s)
    cost = np.where(gap > 0, cost, np.inf)
    if not np.isfinite(cost).any():
        return np.inf
    low = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = low[np.argmax(gap[low])]
    return float((s[k] + s[k + 1]) / 2)


def fit(rows: pa.Table, order: int = ORDER) -> tuple[Model | None, float]:
    """(model, threshold) of a table (doc_id, text, toxic) of labelled texts."""
    rows = rows.sort_by([("rank", "ascending")]).combine_chunks()
    toxic, held = rows.column("toxic").to_numpy() == 1, np.arange(rows.num_rows) % HELD_OUT == 0
    if toxic.sum() < 1 or (~toxic).sum() < 1:
        return None, np.inf
    train = np.ones(len(toxic), bool) if min((toxic & held).sum(), (~toxic & held).sum()) < 5 else ~held
    held = ~train if not train.all() else train
    text = rows.column("text")
    model = Model(tuple(_distinct_words(text.filter(pa.array((toxic == c) & train))) for c in (False, True)), order)
    return model, best_threshold(Scorer(model).scores(text.filter(pa.array(held))), toxic[held])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most ``per_class`` labelled texts of each class, (rank, text, toxic); the least by a hash of the id."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    own = own.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).withColumn("rank", F.xxhash64("doc_id"))
    few = own.filter("toxic = 1").orderBy("rank", "doc_id").limit(per_class).unionByName(own.filter("toxic = 0").orderBy("rank", "doc_id").limit(per_class))
    # Two bounded lists, at most 2 * per_class ids.
    found = docs.filter("text is not null").join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("rank", "text", "toxic")


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, order: int = ORDER) -> tuple[Model | None, float]:
    return fit(sample(docs, labels, per_class).toArrow(), order)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, order: int = ORDER) -> DataFrame:
    """Rows (doc_id, score, toxic) of all texts."""
    docs = texts(df, id_col, text_col)
    model, threshold = trained(docs, labels, per_class, order)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s, toxic = scorer.toxic(batch.column(1), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    return docs.mapInArrow(lean(apply), "doc_id long, score double, toxic boolean")


def reject(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, order: int = ORDER) -> DataFrame:
    """The rows of the input that are not toxic, with all their columns."""
    model, threshold = trained(texts(df, id_col, text_col), labels, per_class, order)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            yield batch.filter(pa.array(~scorer.toxic(batch.column(at).cast(pa.string()), threshold)[1]))

    return df.mapInArrow(lean(keep), df.schema)
