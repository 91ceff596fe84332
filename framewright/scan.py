"""All pairs of a table of vectors, exactly: which have a cosine at the threshold, and how many each has.

The vectors are dealt by hash to blocks, files in the shared folder, and each pair of blocks is a unit of work that reads its two. So nothing but
counts and edges is shuffled, a worker holds two blocks, and the work, which grows as the square of the rows, is cut into any number of tasks.

Most pairs are settled by fewer coordinates. Turned so that the first k of them hold most of the length, vectors x = (a, b) and y = (c, d) have
``x y <= a c + |b| |d|``, a product of k + 1 numbers; what reaches the threshold there is worked out in full, and near the threshold in double
precision from the vectors as they were given. k, or none, is what costs least by a sample of pairs; it changes the time only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.blocks import least_labels, tidy
from framewright.storage import filesystem, materialise, new_path, qualified

MOST = 131_072  # rows of a block
BYTES = 32 << 20  # of its vectors in single precision
LEAST = 2_048
UNITS = 16  # blocks that there are at least, where they would have LEAST rows
TASKS = 4_096
HIGH, WIDE = 512, 2_048  # pairs that are compared at once
SOME = 1 << 16  # pairs that are worked out at once
HELD = 1 << 20  # edges that are held before they are thinned
SAMPLE = 1_024
FLOP, LOOK, WHOLE = 0.03, 0.3, 100.0  # relative costs of a coordinate and of a look at a pair, and of working one out


class Joined:
    """Edges, of which no more are kept than join the same rows."""

    def __init__(self) -> None:
        self.i, self.j, self.n = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.n += len(i)
        if self.n > 2 * HELD:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate([np.zeros(0, np.int64), *self.i, *self.j])
        names, at = np.unique(ends, return_inverse=True)
        label = least_labels(len(names), at[: self.n], at[self.n :])
        far = np.flatnonzero(label != np.arange(len(names)))
        self.i, self.j, self.n = [names[far]], [names[label[far]]], len(far)
        return self.i[0], self.j[0]


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: of edges (a, b) no more than join the same nodes, those of so many at a time as a worker can hold."""
    joined = Joined()

    def given() -> pa.RecordBatch:
        i, j = joined.thin()
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["a", "b"])

    for batch in batches:
        joined.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if joined.n > HELD and (found := given()).num_rows > HELD:
            yield found
            joined = Joined()
    yield given()
    tidy()


def _turned(unit: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    if turn is None:
        return unit
    a = unit @ turn
    rest = np.sqrt(np.maximum((unit * unit).sum(axis=1) - (a * a).sum(axis=1), 0) + np.float32(1e-6))
    return np.concatenate([a, rest[:, None]], axis=1).astype(np.float32)


class Block:
    def __init__(self, folder: str, k: int, width: int, turn: np.ndarray | None = None):
        fs, at = filesystem(folder)
        with fs.open_input_file(f"{at}/{k}") as file:
            table = pa.ipc.open_file(file).read_all().combine_chunks()
        self.kind, self.copies = table.column("kind").to_numpy(), table.column("copies").to_numpy()
        n = len(self.kind)
        self.raw = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, width))
        size = np.linalg.norm(self.raw.astype(np.float64), axis=1)
        self.size = np.where(size > 0, size, 1)
        self.unit = (self.raw / self.size[:, None]).astype(np.float32)
        self.low = _turned(self.unit, turn)


def plan_turn(unit: np.ndarray, threshold: float) -> np.ndarray | None:
    """The directions whose coordinates are looked at first, or None: as many as cost least by the pairs of a sample."""
    width = unit.shape[1]
    best, cost = None, LOOK + FLOP * width
    if len(unit) < 32:
        return None
    along = np.linalg.eigh(unit.T.astype(np.float64) @ unit)[1][:, ::-1].astype(np.float32)
    for k in (15, 23, 31, 63):
        if k + 1 < width:
            low = _turned(unit, along[:, :k])
            share = (np.count_nonzero(low @ low.T >= threshold - 1e-5) - len(low)) / (len(low) * (len(low) - 1))
            if (here := LOOK + FLOP * (k + 1) + WHOLE * max(share, 0)) < cost:
                best, cost = along[:, :k].copy(), here
    return best


def near_of(x: Block, y: Block, same: bool, threshold: float, strict: bool, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y that are near, each pair once. whole: the products are those of whole vectors."""
    margin = np.float32(1e-5 + 1.2e-7 * x.unit.shape[1])
    floor = np.float32(threshold) - margin
    for a in range(0, len(x.kind), HIGH):
        for c in range(a // WIDE * WIDE if same else 0, len(y.kind), WIDE):
            s = x.low[a : a + HIGH] @ y.low[c : c + WIDE].T
            wide, at = s.shape[1], np.flatnonzero(s >= floor)
            if not whole and len(at) > s.size // 16:
                s = x.unit[a : a + HIGH] @ y.unit[c : c + WIDE].T
                at = np.flatnonzero(s >= floor)
                known = True
            else:
                known = whole
            for b in range(0, len(at), SOME):
                part = at[b : b + SOME]
                i, j = part // wide + a, part % wide + c
                if same:
                    part, i, j = part[j > i], i[j > i], j[j > i]
                cos = s.reshape(-1)[part] if known else np.einsum("ij,ij->i", x.unit[i], y.unit[j])
                ok = cos >= floor
                edge = np.flatnonzero(ok & (cos <= threshold + margin))
                if len(edge):
                    p, q = i[edge], j[edge]
                    exact = np.einsum("ij,ij->i", x.raw[p] / x.size[p, None], y.raw[q] / y.size[q, None], dtype=np.float64)
                    ok[edge] = exact > threshold if strict else exact >= threshold
                if ok.any():
                    yield i[ok], j[ok]


def _compare(folder: str, width: int, threshold: float, strict: bool, turn: np.ndarray | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[int, Block | None] = (-1, None)
        for batch in batches:
            for u in batch.column(0).to_pylist():
                hi = (math.isqrt(8 * u + 1) - 1) // 2  # the u-th pair lo <= hi
                lo = u - hi * (hi + 1) // 2
                if first[0] != hi:
                    first = hi, Block(folder, hi, width, turn)
                x = first[1]
                y = x if lo == hi else Block(folder, lo, width, turn)
                joined, n, m = Joined(), np.zeros(len(x.kind), np.int64), np.zeros(len(y.kind), np.int64)
                for i, j in near_of(x, y, lo == hi, threshold, strict, turn is None):
                    np.add.at(n, i, y.copies[j])
                    np.add.at(m, j, x.copies[i])
                    joined.add(x.kind[i], y.kind[j])
                a, b = joined.thin()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "near"])
                for block, near in ((x, n), (y, m)):
                    some = np.flatnonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(block.kind[some]), pa.nulls(len(some), pa.int64()), pa.array(near[some])], names=["a", "b", "near"])
        tidy()

    return of


def _write(folder: str, k: int, own: pa.Table) -> None:
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{k}") as out, pa.ipc.new_file(out, own.schema) as file:
        file.write_table(own)


def _written(folder: str):
    def of(group: pa.Table) -> pa.Table:
        _write(folder, group.column("block")[0].as_py(), group.select(["kind", "copies", "v"]).combine_chunks())
        tidy()
        return group.select(["block"]).slice(0, 1)

    return of


def near_links(kinds: DataFrame, n: int, width: int, threshold: float, strict: bool = False, most: int = MOST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) that join what is near, rows (kind, near)) of n kinds (kind, copies, v), with the summed copies of all that are near each.

    Near are cosines of at least the threshold or, with ``strict``, above it.
    """
    spark = kinds.sparkSession
    blocks = max(1, math.ceil(n / max(1, min(most, BYTES // (4 * max(width, 1))))), min(UNITS, math.ceil(n / least)))
    folder = qualified(spark, new_path(spark, "blocks"))
    dealt = kinds.select(F.pmod(F.xxhash64(F.lit(29), "kind"), F.lit(blocks)).alias("block"), "kind", "copies", "v")
    full = {r.block for r in dealt.groupBy("block").applyInArrow(_written(folder), "block long").collect()}
    for k in set(range(blocks)) - full:  # blocks that the hash left empty
        _write(folder, k, pa.table({"kind": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))}))
    turn = plan_turn(Block(folder, 0, width).unit[:SAMPLE], threshold)
    units = blocks * (blocks + 1) // 2
    met = spark.range(0, units, 1, min(units, TASKS)).mapInArrow(_compare(folder, width, threshold, strict, turn), "a long, b long, near long")
    met = materialise(met, "near")
    edges = met.filter("b is not null").select("a", "b").mapInArrow(thinned, "a long, b long")
    return edges, met.filter("b is null").groupBy(F.col("a").alias("kind")).agg(F.sum("near").alias("near"))

