"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the space by random directions, again and again, and rows that lie within ``SPILL`` of a split go to both
sides, so that near pairs rarely part; what one tree parts another keeps. The upper splits are fitted on a bounded sample of
at most ``SAMPLE`` rows: a node splits at the median of its sample's projections, or at another of the middle quantiles where far fewer rows lie about that, and
not at all where its sample is small or would mostly go both ways. Each row finds its places by itself and one shuffle brings the rows
of a place together; there the tree goes on by the same rule, down to leaves of ``LEAF`` rows. All pairs of a leaf are compared by their
floats, so what is linked is exact; links are united into classes, and within a class all pairs are verified to count them.

Recall: the number of trees follows from how many rows lie about the sample's splits, so that a pair at the threshold shares a leaf
of some tree with probability ``RECALL``; nearer pairs do more surely.

No leaf is cut short: rows that no split can part are compared in strips, and places of more than ``PLACE_MOST`` rows in blocks,
however many. Equal vectors, of which there may be any number, are one row until their classes are known.

Defined results: rows are near when their cosine is at least the threshold; classes are the components of that relation, named
by their least id. Rows that share an id are one. See ``unit_vectors`` for what is left out. A vector near no other is in a class of
its own with 0 links. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import BLOCK, classed, column, dealt, large, lean, lean_group, near_pairs, stars, tallied
from framewright.llm.vectors import alike, matrix, sampled, unit_vectors
from framewright.storage import materialise

THRESHOLD = 0.95
RECALL = 0.999
SPILL = 0.02
LEAF = 1_024
SAMPLE = 65_536
PLACE = 32_768  # rows for which the upper splits aim
PLACE_MOST = 4 * PLACE
LEAST = 32  # sampled rows of a node that splits
BOTH = 0.35  # share of a node's rows that may go both ways
MOST_TREES = 16


def directions(width: int, tree: int, count: int) -> np.ndarray:
    """A column a level."""
    d = np.random.default_rng([7, tree]).standard_normal((width, max(count, 1))).astype(np.float32)
    return d / np.linalg.norm(d, axis=0)


def split(p: np.ndarray, spill: float = SPILL) -> tuple[float, float]:
    """(where to split these projections, the share that goes both ways); NaN where no split parts them."""
    p = np.sort(p)
    share = np.linspace(0.3, 0.7, 17)
    at = p[(len(p) * share).astype(np.int64)]
    both = (np.searchsorted(p, at + spill) - np.searchsorted(p, at - spill)) / len(p)
    k = int(np.argmin(both + np.abs(share - 0.5) / 2))
    return (float(at[k]), float(both[k])) if both[k] <= BOTH else (math.nan, float(both[k]))


class Tree:
    """The upper splits: a direction a level, a place to split a node, NaN where a node doesn't split."""

    def __init__(self, sample: np.ndarray, tree: int, depth: int, width: int, spill: float = SPILL):
        self.spill, self.along, self.at, self.both = spill, directions(width, tree, depth), [], []
        nodes = {0: np.arange(len(sample))}
        for level in range(depth):
            p, at, below = sample @ self.along[:, level], np.full(1 << level, np.nan), {}
            for node, rows in nodes.items():
                if len(rows) < LEAST:
                    continue
                at[node], both = split(p[rows], spill)
                if not math.isnan(at[node]):
                    self.both.append(both)
                    below[2 * node], below[2 * node + 1] = rows[p[rows] < at[node] + spill], rows[p[rows] >= at[node] - spill]
            self.at.append(at)
            nodes = below

    def places(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places) that the splits lead to."""
        rows, node, done = np.arange(len(m)), np.zeros(len(m), np.int64), []
        for level, at in enumerate(self.at):
            split_at = at[node]
            ends = np.isnan(split_at)
            done.append((rows[ends], node[ends] + (1 << level)))
            rows, node, split_at = rows[~ends], node[~ends], split_at[~ends]
            p = (m @ self.along[:, level])[rows]
            left, right = p < split_at + self.spill, p >= split_at - self.spill
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        done.append((rows, node + (1 << len(self.at))))
        return np.concatenate([r for r, _ in done]), np.concatenate([p for _, p in done])


def missed(threshold: float, width: int, spill: float, both: float) -> float:
    """Probability that a split of which this share goes both ways parts a pair at the threshold."""
    sigma = math.sqrt(max(2 - 2 * threshold, 0) / width)
    if not sigma:
        return 0.0
    x = 2 * spill / sigma
    beyond = 2 * sigma * (math.exp(-x * x / 2) / math.sqrt(2 * math.pi) - x * math.erfc(x / math.sqrt(2)) / 2)
    return min(0.5, max(0.0, beyond) * both / (2 * spill))


def grown(sample: np.ndarray, n: int, width: int, threshold: float, spill: float = SPILL, recall: float = RECALL) -> list[Tree]:
    """So many trees that a pair at the threshold shares a leaf of some with the wished probability."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / PLACE)))
    below = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    first = Tree(sample, 0, depth, width, spill)
    probe = Tree(sample, 0, min(6, below), width, spill)  # as the splits in a place will be
    both = float(np.mean(probe.both)) if probe.both else 0.0
    miss = 1 - (1 - missed(threshold, width, spill, both)) ** below
    count = 1 if miss <= 0 else min(MOST_TREES, max(2, math.ceil(math.log(1 - recall) / math.log(miss)))) if miss < 1 else MOST_TREES
    return [first, *(Tree(sample, t, depth, width, spill) for t in range(1, count))]


def leaves(m: np.ndarray, rows: np.ndarray, seed: int, leaf: int = LEAF, spill: float = SPILL) -> Iterator[np.ndarray]:
    """Leaves of the tree below a place."""
    todo, random = [rows], np.random.default_rng([11, seed])
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        for _ in range(4):  # another direction may part what one does not
            d = random.standard_normal(m.shape[1]).astype(np.float32)
            p = m[rows] @ (d / np.linalg.norm(d))
            at, _ = split(p, spill)
            left, right = rows[p < at + spill], rows[p >= at - spill]
            if not math.isnan(at) and max(len(left), len(right)) < 0.9 * len(rows):
                todo += [left, right]
                break
        else:
            yield rows


def _place(width: int, trees: list[Tree]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(1), width)
            for k, tree in enumerate(trees):
                rows, place = tree.places(m)
                yield pa.RecordBatch.from_arrays([pa.array((place << 5) | k), *batch.take(pa.array(rows)).columns], names=["place", "kind", "v"])

    return of


def _compare(width: int, threshold: float):
    def of(group: pa.Table) -> pa.Table:
        m, ids = matrix(group.column("v"), width), column(group, "kind")
        place, lo, hi, own = (column(group, c) for c in ("place", "lo", "hi", "own"))
        rows, leaf = [np.flatnonzero(lo != hi)], [-1 - place[lo != hi]]
        whole = np.flatnonzero(lo == hi)
        whole = whole[np.lexsort((lo[whole], place[whole]))]
        cuts = np.flatnonzero((np.diff(place[whole]) != 0) | (np.diff(lo[whole]) != 0)) + 1
        for part in np.split(whole, cuts):
            for found in leaves(m, part, int(place[part[0]]) if len(part) else 0):
                leaf.append(np.full(len(found), len(rows)))
                rows.append(found)
        rows, leaf = np.concatenate(rows), np.concatenate(leaf)
        pairs = near_pairs(m[rows], leaf, lo[rows], hi[rows], own[rows], lambda a, b: alike(a, b, threshold))
        i, j = stars(len(ids), ((rows[i], rows[j]) for i, j in pairs))
        return pa.table({"a": ids[i], "b": ids[j]})

    return of


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, class_id, links): the least id of a vector's class, and how many other rows are near it."""
    own, _, width = unit_vectors(df, id_col, vector_col)
    own = materialise(own, "vectors")
    equal = own.groupBy("v").agg(F.min("vec_id").alias("kind"), F.count("*").alias("copies"))
    kinds = materialise(equal.withColumn("first", F.struct(F.col("kind").alias("vec_id"))), "kinds")
    n = kinds.count()
    trees = grown(sampled(kinds, "kind", "v", n, width, SAMPLE)[1], n, max(width, 1), threshold)
    vectors = kinds.select("kind", "v")
    sizes = large(vectors.mapInArrow(lean(tallied(_place(width, trees), "place")), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")), PLACE_MOST)
    rows = dealt(vectors.mapInArrow(lean(_place(width, trees)), "place long, kind long, v array<float>"), "place", "kind", sizes, 2.0 * n * len(trees), block)
    edges = rows.groupBy("part").applyInArrow(lean_group(_compare(width, threshold)), "a long, b long")
    found = classed(kinds, edges, ["vec_id"], ["v"], lambda t: matrix(t.column("v"), width), lambda a, b: alike(a, b, threshold), block)
    return own.join(found, "v").select("vec_id", F.col("first_vec_id").alias("class_id"), "links")


def near_duplicates_sql(table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> str:
    """The exact classes in SQL, by comparing all pairs."""
    return f"""
WITH RECURSIVE near AS MATERIALIZED (SELECT a.{id_col} AS a, b.{id_col} AS b FROM {table} a JOIN {table} b ON a.{id_col} <> b.{id_col} AND list_cosine_similarity(CAST(a.{vector_col} AS DOUBLE[]), CAST(b.{vector_col} AS DOUBLE[])) >= CAST({threshold!r} AS DOUBLE)),
reach(node, root) AS (SELECT {id_col}, {id_col} FROM {table} UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node WHERE r.root < n.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), counted AS (SELECT a, count(*) AS n FROM near GROUP BY 1)
SELECT node AS vec_id, root AS class_id, coalesce(n, 0) AS links FROM roots LEFT JOIN counted ON a = node"""
