"""Nearest neighbours by multi-index hashing of learned binary codes, or by comparison with every row where that costs less.

Codes: rotations are learned on a sample of at most ``SAMPLE`` vectors, each by alternating between the signs of all rotated vectors
and the rotation that fits them best. A vector's code is the signs under every rotation, ``BITS`` in all.

Index: every code is cut into substrings of ``PIECE`` bits, and every row is in the index once for each, under its value. By the pigeonhole
principle a code within r bits of a query agrees with it up to ``r // m`` bits in one of the m substrings, so probing all values that near
retrieves every code within the radius, and what is retrieved is ranked by the floats.

Radius: two vectors of cosine c differ in each bit with probability ``arccos(c) / pi``. A first look at the rows under a query's own values
gives k neighbours, the least cosine of which is a bound: whatever is nearer lies, but for the tail beyond ``z`` deviations, within a
radius that follows from it; z is measured on the sample, ``TAIL`` of whose pairs lie beyond. The one rule holds at every size and density: in a
dense cluster the radius is small, and for a query far from everything it grows until all values are probed.

Scan: within such a large radius every substring's index gives up to 40 % of all rows, eight times over, at a cost of ``VISIT`` for each, while a
product of matrices compares a query with each row once. How many rows a query would visit is counted on ``COUNTED`` sampled codes; it is compared
with every row where that is cheaper, and all are where what the probes save doesn't pay for writing the index. A scan is exact and looks at every
row, so its cost grows as queries times rows. Tasks keep the rows they read and go through the written queries a batch at a time.

Plan: the index is shuffled by substring and the first bits of its value, as many as leave ``PART`` rows a place; a query goes only to the places
within its radius. Places of more than ``PLACE_MOST`` rows are dealt to blocks, which a query visits one by one. Equal vectors, of which there may be
any number, are in the index once, with their k + 1 least ids, as no more can be among a query's k nearest. Of a place only what is as near as
the bound comes back.

Queries are the rows whose id is divisible by ``EVERY``, against all rows.

Defined results: a row is not its own neighbour; equal vectors are neighbours; equal similarities are ranked by id. See
``unit_vectors`` for what is left out. Fewer rows than k give as many neighbours as there are; an empty table none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.blocks import BLOCK, column, large, lean, lean_group, tallied
from framewright.llm.arrays import gather_ranges
from framewright.llm.vectors import matrix, sampled, unit_vectors
from framewright.storage import filesystem, materialise, new_path

K = 10
EVERY = 20
BITS = 128
PIECE = 16
ROUNDS = 3
SAMPLE = 16_384
LOOKED = 256  # of the sample's vectors, whose nearest measure z
TAIL = 0.02
LEAST_Z = 2.0
FIRST = 2  # substrings of the first look
FIRST_PART = 8_192
PART = 65_536
PLACE_MOST = 4 * PART
STRIP = 1 << 21  # pairs that are compared at once
COUNTED = 1_024
SCAN_BYTES = 8 << 20  # of vectors that a scanning task holds at once
VISIT = 190  # nanoseconds of CPU time a row that a probe gives, as measured at 64 dimensions and in an index of 51,282 rows
PAIR, PAIR_EACH = 2, 0.07  # the same for a pair in a product of matrices, and for each dimension
COPY = 10_000  # about the same for a row of the index under one substring: made, shuffled and handed to Python
SLACK = 1e-5  # of cosines in single precision


def rotations(width: int, count: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrices."""
    random = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(random.standard_normal((width, width)))[0] for _ in range(count)]).astype(np.float32)


def learn(m: np.ndarray, width: int, bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray:
    """Rotations whose signs lie closest to the vectors."""
    found = rotations(width, -(-bits // width))
    for _ in range(rounds if len(m) > width else 0):
        for k, r in enumerate(found):
            u, _, v = np.linalg.svd(m.T @ np.where(m @ r > 0, np.float32(1), np.float32(-1)))
            found[k] = u @ v
    return found


def encode(m: np.ndarray, turned: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of 64-bit words."""
    signs = np.concatenate([m @ r > 0 for r in turned], axis=1)[:, :bits]
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def pieces(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view("<u2").astype(np.int64)


def radius(cosine: np.ndarray, z: float, bits: int = BITS) -> np.ndarray:
    """How many bits a vector at least as near as this differs in, but for the tail beyond z deviations."""
    p = np.arccos(np.clip(cosine, -1, 1)) / math.pi
    return np.minimum(np.floor(bits * p + z * np.sqrt(bits * p * (1 - p))), bits).astype(np.int64)


def deviations(m: np.ndarray, codes: np.ndarray, k: int, bits: int = BITS) -> float:
    """By how many deviations the sample's near pairs differ in more bits than their cosine makes likely."""
    if len(m) <= k:
        return LEAST_Z
    s = m[:LOOKED] @ m.T
    np.fill_diagonal(s[:, : len(s)], -2)
    near = np.argpartition(-s, min(4 * k, s.shape[1] - 1), axis=1)[:, : 4 * k]
    i = np.repeat(np.arange(len(s)), near.shape[1])
    j = near.ravel()
    p = np.arccos(np.clip(s[i, j], -1, 1)) / math.pi
    apart = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1)
    z = (apart - bits * p) / np.sqrt(np.maximum(bits * p * (1 - p), 0.25))
    return max(LEAST_Z, float(np.quantile(z, 1 - TAIL)))


def first_bits(n: int, part: int) -> int:
    """So many bits of a value that about ``part`` of n rows share them."""
    return min(PIECE, max(0, int(math.log2(max(n, 1) / part))))


def ring(size: int, within: int) -> np.ndarray:
    """Numbers of ``size`` bits with at most ``within`` ones, in the order of their number."""
    return np.array([sum(1 << b for b in c) for s in range(min(within, size) + 1) for c in combinations(range(size), s)], np.int64)


def best(i: np.ndarray, names: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, name, similarity) the k best a query, of equal ones the least names; one query after the other."""
    by = np.lexsort((names, -s, i))
    at = i[by]
    return by[np.arange(len(by)) - np.searchsorted(at, at) < k]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = 1 << 16
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[c : c + step]].astype(np.float64), b[j[c : c + step]].astype(np.float64)) for c in range(0, len(i), step))])


_FOUND = "query long, kind long, s double"


def found_table(query: np.ndarray, kind: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"query": query.astype(np.int64), "kind": kind.astype(np.int64), "s": s.astype(np.float64)})


def _first_places(width: int, turned: np.ndarray, bits: int, first: int):
    """Rows under the first bits of their values in the substrings of the first look."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pieces(encode(matrix(batch.column(2), width), turned, bits))
                for j in range(min(FIRST, own.shape[1])):
                    yield pa.RecordBatch.from_arrays([pa.array((j << PIECE) | (own[:, j] >> (PIECE - first))), *batch.columns], names=["place", "kind", "asks", "v"])

    return of


def _look(width: int, k: int, names: np.ndarray, sample: np.ndarray):
    """The first look: a query's k nearest among the rows of its place, and where those are fewer among the sample."""

    def of(group: pa.Table) -> pa.Table:
        m, kind = matrix(group.column("v"), width), column(group, "kind")
        asks = np.flatnonzero(column(group, "asks"))
        out = [found_table(*[np.zeros(0)] * 3)]
        for others, ids in ((m, kind),) if len(kind) > k else ((m, kind), (sample, names)):
            step = max(1, STRIP // max(1, len(ids)))
            for c in range(0, len(asks), step):
                rows = asks[c : c + step]
                s = m[rows] @ others.T
                s[ids == kind[rows, None]] = -2
                if len(ids) > k:
                    j = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
                    i = np.repeat(rows, k)
                else:
                    i, j = np.repeat(rows, len(ids)), np.tile(np.arange(len(ids)), len(rows))
                other = ids[j] != kind[i]
                i, j = i[other], j[other]
                out.append(found_table(kind[i], ids[j], exact(m, others, i, j)))
        return pa.concat_tables(out)

    return of


def _index_places(width: int, turned: np.ndarray, bits: int, first: int):
    """The index: every row once a substring, under its place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encode(matrix(batch.column(1), width), turned, bits)
                own = pieces(codes)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
                for j in range(own.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array((j << PIECE) | (own[:, j] >> (PIECE - first))), batch.column(0), blob, batch.column(1)], names=["place", "kind", "code", "v"])

    return of


def _probe_places(width: int, turned: np.ndarray, bits: int, first: int):
    """Queries at every place that can hold a value within their radius."""
    values = ring(first, first)
    ones = np.bitwise_count(values.astype(np.uint64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pieces(encode(matrix(batch.column(2), width), turned, bits))
            reach = column(batch, "reach")
            count = np.searchsorted(ones, np.minimum(reach // own.shape[1], first), side="right")
            rows = np.repeat(np.arange(len(own)), count)
            at = gather_ranges(np.zeros(len(own), np.int64), count)
            for j in range(own.shape[1]):
                place = (j << PIECE) | ((own[rows, j] >> (PIECE - first)) ^ values[at])
                for c in range(0, len(rows), 1 << 16):
                    part = pa.array(rows[c : c + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(place[c : c + (1 << 16)]), *batch.take(part).columns], names=["place", "kind", "bound", "v", "reach"])

    return of


def _planned(width: int, turned: np.ndarray, bits: int, z: float, codes: np.ndarray):
    """Queries with their radius and the nanoseconds a row of the table that probing saves them against a scan; codes: of the sample."""
    some = pieces(codes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pieces(encode(matrix(batch.column(2), width), turned, bits))
            reach = radius(batch.column(1).to_numpy(), z, bits)
            visits = np.zeros(len(own), np.int64)
            for j in range(own.shape[1]):
                for c in range(0, len(own), 2048):
                    apart = np.bitwise_count((own[c : c + 2048, j, None] ^ some[:, j]).astype(np.uint16))
                    visits[c : c + 2048] += (apart <= (reach[c : c + 2048] // own.shape[1])[:, None]).sum(axis=1)
            saved = PAIR + PAIR_EACH * width - VISIT * visits / max(1, len(some))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(saved)], names=["kind", "bound", "v", "reach", "saved"])

    return of


def _scanned(width: int, k: int, folder: str, least: float):
    """Every row against the queries of the folder that save at most so much by probing; what is as near as the bound, k at most of the rows held at once."""
    most = max(1, SCAN_BYTES // (4 * width))

    def queries() -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for path in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")):
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=min(8_192, most), columns=["kind", "bound", "v", "saved"]):
                    yield batch.filter(pc.less_equal(batch.column("saved"), least))

    def compared(kind: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in queries():
            if not batch.num_rows:
                continue
            q, ask, bound = matrix(batch.column("v"), width), column(batch, "kind"), column(batch, "bound")
            step = max(1, STRIP // len(kind))
            for c in range(0, len(q), step):
                near = (q[c : c + step] @ m.T >= (bound[c : c + step, None] - SLACK).astype(np.float32)).ravel()
                i, x = np.divmod(np.flatnonzero(near), len(kind))
                i += c
                other = ask[i] != kind[x]
                i, x = i[other], x[other]
                s = exact(q, m, i, x)
                top = best(i, kind[x], s, k)
                yield from found_table(ask[i[top]], kind[x[top]], s[top]).to_batches()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows, n = [], [], 0
        for batch in batches:
            for c in range(0, batch.num_rows, most):
                part = batch.slice(c, most)
                kinds.append(column(part, "kind"))
                rows.append(matrix(part.column("v"), width))
                n += part.num_rows
                if n >= most:
                    yield from compared(np.concatenate(kinds), np.concatenate(rows))
                    kinds, rows, n = [], [], 0
        if n:
            yield from compared(np.concatenate(kinds), np.concatenate(rows))

    return of


class Index:
    """The rows of a place, by the values of its substring."""

    def __init__(self, values: np.ndarray):
        self.values, back = np.unique(values, return_inverse=True)
        self.order = np.argsort(back, kind="stable")
        self.begin = np.searchsorted(back[self.order], np.arange(len(self.values) + 1))

    def probe(self, values: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows) of all values at most so many bits away."""
        near = ring(PIECE, within) if within <= 3 else None
        if near is not None and len(near) < len(self.values):  # ask for each value; else look at all there are
            want = (values[:, None] ^ near).ravel()
            at = np.minimum(np.searchsorted(self.values, want), len(self.values) - 1)
            hit = np.flatnonzero(self.values[at] == want)
            query, at = hit // len(near), at[hit]
        else:
            query, at = np.nonzero(np.bitwise_count((values[:, None] ^ self.values).astype(np.uint16)) <= within)
        size = self.begin[at + 1] - self.begin[at]
        return np.repeat(query, size), self.order[gather_ranges(self.begin[at], size)]


def _retrieve(width: int, turned: np.ndarray, bits: int, k: int):
    """Of a place's rows those within each query's radius, ranked by floats; what is as near as the bound, k at most."""

    def of(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [found_table(*[np.zeros(0)] * 3)]
        if not asked.num_rows or not held.num_rows:
            return out[0]
        place, block = column(held, "place"), column(held, "block")
        q_place, q_block = column(asked, "place"), column(asked, "block")
        m, kind = matrix(held.column("v"), width), column(held, "kind")
        codes = np.frombuffer(b"".join(x.as_buffer() for x in held.column("code")), "<u8").reshape(len(kind), -1)
        q, ask, bound, reach = matrix(asked.column("v"), width), column(asked, "kind"), column(asked, "bound"), column(asked, "reach")
        q_codes = encode(q, turned, bits)
        count = bits // PIECE
        for p, b in {*zip(q_place.tolist(), q_block.tolist(), strict=True)}:
            rows = np.flatnonzero((place == p) & (block == b))
            if not len(rows):
                continue
            j = p >> PIECE
            index, mine = Index(pieces(codes[rows])[:, j]), np.flatnonzero((q_place == p) & (q_block == b))
            own = pieces(q_codes[mine])[:, j]
            for within in np.unique(reach[mine] // count):
                some = np.flatnonzero(reach[mine] // count == within)
                step = max(1, STRIP // len(rows))
                for c in range(0, len(some), step):
                    i, x = index.probe(own[some[c : c + step]], int(within))
                    i, x = mine[some[c : c + step]][i], rows[x]
                    keep = np.bitwise_count(q_codes[i, 0] ^ codes[x, 0]).astype(np.int64)
                    for w in range(1, codes.shape[1]):
                        keep += np.bitwise_count(q_codes[i, w] ^ codes[x, w])
                    keep = (keep <= reach[i]) & (ask[i] != kind[x])
                    i, x = i[keep], x[keep]
                    s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[i[a : a + 65536]], m[x[a : a + 65536]]) for a in range(0, len(i), 65536))])
                    keep = s >= bound[i] - SLACK
                    i, x = i[keep], x[keep]
                    s = exact(q, m, i, x)
                    top = best(i, kind[x], s, k)
                    out.append(found_table(ask[i[top]], kind[x[top]], s[top]))
        return pa.concat_tables(out)

    return of


def neighbours(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, every: int = EVERY, block: int = BLOCK, part: int = PART, first_part: int = FIRST_PART) -> DataFrame:
    """Rows (vec_id, rank, neighbour_id, similarity): the k nearest of every query by cosine, the first at rank 1."""
    if k < 1 or bits % 64 or every < 1:
        raise ValueError("k and every must be positive and bits a multiple of 64")
    own, _, width = unit_vectors(df, id_col, vector_col)
    own = materialise(own, "vectors")
    asks = F.pmod("vec_id", F.lit(every)) == 0
    # Of equal vectors the k + 1 least ids; Spark keeps only so many a task before it shuffles.
    few = own.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = few.groupBy("v").agg(F.min("vec_id").alias("kind"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = own.filter(asks).select("v").distinct().withColumn("asks", F.lit(True))
    kinds = materialise(members.join(asked, "v", "left").select("kind", F.coalesce("asks", F.lit(False)).alias("asks"), "ids", "v"), "kinds")
    n = kinds.count()
    names, sample = sampled(kinds, "kind", "v", n, width, SAMPLE)
    width = max(width, 1)
    turned = learn(sample, width, bits)
    codes = encode(sample, turned, bits)
    z = deviations(sample, codes, k, bits) if n else LEAST_Z
    # The first look.
    vectors, own_places = kinds.select("kind", "asks", "v"), _first_places(width, turned, bits, first_bits(n, first_part))
    first = vectors.mapInArrow(lean(own_places), "place long, kind long, asks boolean, v array<float>")
    sizes = vectors.mapInArrow(lean(tallied(own_places, "place")), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    looked = _blocks(first, large(sizes, 4 * first_part), block).groupBy("place", "block").applyInArrow(lean_group(_look(width, k, names, sample)), _FOUND)
    seen = materialise(looked.groupBy("query", "kind").agg(F.max("s").alias("s")), "seen")
    ranked = seen.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "kind")))
    bounds = ranked.filter(F.col("n") == k).select(F.col("query").alias("kind"), F.col("s").alias("bound"))
    # What probing costs each query, and whether the index pays.
    bounded = kinds.filter("asks").join(bounds, "kind", "left").select("kind", F.coalesce("bound", F.lit(-1.0)).alias("bound"), "v")
    plans = bounded.mapInArrow(lean(_planned(width, turned, bits, z, codes[:: -(-len(codes) // COUNTED) or 1])), "kind long, bound double, v array<float>, reach long, saved double")
    folder = new_path(df.sparkSession, "queries")
    plans.write.parquet(folder)
    plans = df.sparkSession.read.schema(plans.schema).parquet(folder)
    whole = plans.agg(F.count("*").alias("n"), F.count_if(F.col("saved") > 0).alias("probing"), F.sum(F.greatest("saved", F.lit(0.0))).alias("saved")).first()
    probing = whole.probing if whole.probing and whole.saved >= bits // PIECE * COPY else 0
    found = [seen]  # what was seen at first counts too, though it lie beyond the radius
    if probing < whole.n:
        found.append(kinds.select("kind", "v").mapInArrow(lean(_scanned(width, k, folder, 0.0 if probing else math.inf)), _FOUND))
    if probing:
        t = first_bits(n, part)
        probes = plans.filter("saved > 0").select("kind", "bound", "v", "reach").mapInArrow(lean(_probe_places(width, turned, bits, t)), "place long, kind long, bound double, v array<float>, reach long")
        index = kinds.select("kind", "v").mapInArrow(lean(_index_places(width, turned, bits, t)), "place long, kind long, code binary, v array<float>")
        hot = large(kinds.select("kind", "v").mapInArrow(lean(tallied(_index_places(width, turned, bits, t), "place")), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")), 4 * part)
        left = _blocks(probes, hot, block, everywhere=True).groupBy("place", "block")
        right = _blocks(index, hot, block).groupBy("place", "block")
        found.append(left.cogroup(right).applyInArrow(lean_group(_retrieve(width, turned, bits, k)), _FOUND))
    every_ = functools.reduce(DataFrame.unionByName, found).groupBy("query", "kind").agg(F.max("s").alias("s"))
    top = every_.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "kind"))).filter(F.col("n") <= k)
    ids = kinds.select("kind", "ids")
    others = top.join(ids, "kind").select("query", "s", F.explode("ids").alias("neighbour_id"))
    same = kinds.filter("asks").select(F.col("kind").alias("query"), F.lit(2.0).alias("s"), F.explode("ids").alias("neighbour_id"))
    all_ = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col("neighbour_id").alias("id"))))
    lists = others.unionByName(same).groupBy("query").agg(all_.alias("all"))
    mine = own.filter(asks).join(kinds.filter("asks").select("v", F.col("kind").alias("query")), "v").select("vec_id", "query")
    final = mine.join(lists, "query").select("vec_id", F.posexplode(F.slice(F.filter("all", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("at", "x"))
    return final.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.round(F.least(-F.col("x.s"), F.lit(1.0)), 6).alias("similarity"))


def _blocks(rows: DataFrame, hot: DataFrame | None, block: int, everywhere: bool = False) -> DataFrame:
    """The rows with the block of their place: one for most places; of hot places by a hash of the row, or, for queries, every block."""
    if hot is None:
        return rows.withColumn("block", F.lit(0).cast("long"))
    known = rows.join(hot.withColumnRenamed("place", "_p"), F.col("place") == F.col("_p"), "left").withColumn("_k", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)))
    chosen = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)) if everywhere else F.pmod(F.xxhash64(F.lit(5), "kind"), F.col("_k"))
    return known.withColumn("block", chosen).drop("_p", "n", "_k")
