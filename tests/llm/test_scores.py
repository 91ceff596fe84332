"""Language-model scores and both vector operators against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import ann, forest, lm, queries
from framewright.blocks import least_labels
from framewright.llm.eliasfano import EliasFano

from llmfixtures import SF, EDGES, tokens


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 5), (1000, 1 << 48), (1000, 1 << 12), (3000, 3000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano.of(x, universe)
    assert (e.decode() == x).all() and (e.access(np.arange(n)) == x).all()
    queries_ = np.concatenate([x, rng.integers(0, universe, 500, dtype=np.uint64), np.array([(1 << 60)], np.uint64)])
    at = e.locate(queries_)
    assert all((q in set(x.tolist())) == (a >= 0) for q, a in zip(queries_.tolist(), at.tolist())) and (x[at[at >= 0]] == queries_[at >= 0]).all()
    assert (e.locate(x, np.arange(n) + 1, np.full(n, n)) != np.arange(n)).all()
    if n > 100:
        assert (len(e.low) + len(e.high)) * 8 <= n * (2.1 + max(1, math.log2(universe / n) + 1)) + 200


def by_force(texts, corpus, keep=lm.KEEP):
    d, c = lm.DISCOUNT, {1: Counter(), 2: Counter(), 3: Counter()}
    for t in corpus:
        w = tokens(t) if t else []
        s = ["<", "<", *w, ">>"] if w else []
        for i in range(2, len(s)):
            for k in (1, 2, 3):
                c[k][tuple(s[i - k + 1 : i + 1])] += 1
    n, kinds = sum(c[1].values()), len(c[1])
    total = {k: Counter() for k in (2, 3)}
    for k in (2, 3):
        for g, m in c[k].items():
            total[k][g[:-1]] += m
    share, left, kept = {}, defaultdict(float), Counter()
    for k in (2, 3):
        for g, m in c[k].items():
            if m >= keep:
                share[g] = lm.SHARE_OF[lm.share_code(np.array([(m - d) / total[k][g[:-1]]]))[0]]
                left[g[:-1]] += share[g]
                kept[g[:-1]] += 1
    rest = {g: lm.REST_OF[lm.rest_code(np.array([max(1 - x, min(1, d * kept[g] / total[len(g) + 1][g]))]))[0]] for g, x in left.items()}
    out = []
    for t in texts:
        w = tokens(t) if t else []
        if not w or not n:
            out.append(None)
            continue
        s, total_log = ["<", "<", *w, ">>"], 0.0
        for i in range(2, len(s)):
            p = max(c[1][(s[i],)] - d, 0) / n + d * kinds / n / (kinds + 1)
            for k in (2, 3):
                g = tuple(s[i - k + 1 : i + 1])
                p = share.get(g, 0.0) + rest.get(g[:-1], 1.0) * p
            total_log += math.log(p)
        out.append(total_log)
    return out


def same(rows, got, want):
    by = {}
    for (i, _), x in zip(rows, want):
        by.setdefault(i, []).append(x)
    assert len(got) == len(rows)
    for r in got:
        assert any((r.log_prob is None) == (x is None) and (x is None or abs(x - r.log_prob) < 1e-4 * max(1, abs(x))) for x in by[r.doc_id]), (r, by[r.doc_id])


def test_op3(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(rows, queries.op3_lm_scoring(spark, SF).collect(), by_force([t for _, t in rows], [t for _, t in rows]))


@pytest.mark.parametrize("chunk", [50, 10**6])
def test_lm_of_edges(make, prose, chunk):
    rows = EDGES + [(k, prose(50, k % 7)) for k in range(30, 60)] + [(90, prose(20_000, 3))]
    out = lm.score(make(rows), chunk_words=chunk).collect()
    same(rows, out, by_force([t for _, t in rows], [t for _, t in rows]))
    assert {(r.doc_id, r.n_words) for r in out if r.doc_id in (1, 2, 4)} == {(1, None), (2, 0), (4, 0)}


def test_lm_of_other_texts(make, prose):
    corpus, rows = [(k, prose(60, k)) for k in range(20)], [(k, prose(40, k)) for k in range(10, 25)] + [(99, "never seen words")]
    same(rows, lm.score(make(rows), make(corpus)).collect(), by_force([t for _, t in rows], [t for _, t in corpus]))
    assert {r.log_prob for r in lm.score(make(rows), make([])).collect()} == {None}
    assert lm.score(make([])).count() == 0 and lm.score(make([]), make(corpus)).count() == 0


def test_lm_keeps_what_was_seen_once(make, prose):
    corpus = [(k, prose(60, k)) for k in range(20)] + [(50, "one rare trigram")]
    rows = [(1, "one rare trigram"), (2, "rare one trigram"), (3, prose(40, 3))]
    out = lm.score(make(rows), make(corpus)).collect()
    same(rows, out, by_force([t for _, t in rows], [t for _, t in corpus], keep=1))
    log = {r.doc_id: r.log_prob for r in out}
    assert log[1] > log[2] + 3  # the same words, but only those of the first follow each other in the corpus


def test_lm_of_many_kinds_of_words():
    h, counts = np.arange(1, 41, dtype=np.uint64) % np.uint64(9) + np.uint64(1), np.array([25, 0, 15])
    v, ids = lm.numbered(h)
    plain = lm.Ngrams(v, ids, counts, True)
    seq, at = lm.sequence(ids + 2, counts)
    a, b = lm.distinct(seq, at, 10, True), lm.distinct(seq, at, (1 << 21) + 1, True)
    assert all((x == y).all() for x, y in zip(a, b)) and len(plain.third) == 40 + 2


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((500, 64))
    rows = [(k, x.tolist()) for k, x in enumerate(base)]
    rows += [(1000 + k, (base[k % 3] + 0.1 * rng.standard_normal(64)).tolist()) for k in range(60)] + [(2000 + k, base[7].tolist()) for k in range(30)]
    edges = [(None, base[0].tolist()), (5001, None), (5002, []), (5003, [0.0] * 64), (5004, [float("nan")] * 64), (5005, [1.0, 2.0]), (5006, [None, *base[1].tolist()[1:]]), (3, base[3].tolist())]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + edges], "vec_id long, embedding array<double>, block int, v string").repartition(4)
    m = np.array([v for _, v in rows])
    return d, np.array([i for i, _ in rows]), m / np.linalg.norm(m, axis=1, keepdims=True)


def recall(rows, ids, m, k, every=ann.EVERY):
    """Of the true k nearest of every query, by similarity, the share that was found."""
    asks = np.flatnonzero(ids % every == 0)
    s = m[asks] @ m.T
    s[np.arange(len(asks)), asks] = -9
    least = -np.sort(-s, axis=1)[:, k - 1]
    at, row = {i: n for n, i in enumerate(ids.tolist())}, {i: n for n, i in enumerate(ids[asks].tolist())}
    hit = sum(s[row[r.vec_id], at[r.neighbour_id]] >= least[row[r.vec_id]] - 1e-5 for r in rows)
    return hit / (k * len(asks))


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "part": 64, "first_part": 32}])
def test_neighbours(vectors, sizes):
    d, ids, m = vectors
    rows = ann.neighbours(d, 5, every=4, **sizes).collect()
    asks = {i for i in ids.tolist() if i % 4 == 0}
    assert {r.vec_id for r in rows} == asks and all(r.vec_id != r.neighbour_id for r in rows)
    assert len(rows) == len({(r.vec_id, r["rank"]) for r in rows}) == 5 * len(asks) == len({(r.vec_id, r.neighbour_id) for r in rows})
    assert recall(rows, ids, m, 5, 4) >= 0.95
    one = sorted((r["rank"], r.neighbour_id) for r in rows if r.vec_id == 2000)
    assert [i for _, i in one] == [7, 2001, 2002, 2003, 2004]  # ties by id


@pytest.mark.parametrize("cosine", [0.7, 0.9])
def test_neighbours_in_dense_clusters(spark, cosine):
    """One cluster of thousands among other rows, and many copies: in several places and blocks."""
    rng = np.random.default_rng(5)
    n, width = 4000, 64
    spread = rng.standard_normal((n, width)) / np.sqrt(width)
    m = np.sqrt(cosine) * np.eye(width)[0] + np.sqrt(1 - cosine) * spread
    m[:1000] = rng.standard_normal((1000, width))
    m[1000:1040] = m[1000] + 1e-4 * spread[:40]
    m[1040:1070] = m[1040]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(d, block=300, part=256, first_part=128).collect()
    assert recall(rows, np.arange(n), m, 10) >= 0.95 and len(rows) == 10 * n // 20
    assert sorted(r.neighbour_id for r in rows if r.vec_id == 1040) == list(range(1041, 1051))  # ties by id


@pytest.mark.parametrize("way", ["scan", "index", "both"])
def test_neighbours_are_scanned_for_where_that_costs_less(spark, monkeypatch, way):
    """Vectors without structure, whose radius takes in most of every index, meet each row once; near copies are looked up where the index pays."""
    rng = np.random.default_rng(8)
    m = rng.standard_normal((4000, 64))
    if way != "scan":
        m[:1500] = np.repeat(m[:100], 15, axis=0) + 0.05 * rng.standard_normal((1500, 64))
        monkeypatch.setattr(ann, "COPY", 0)
    if way == "index":
        monkeypatch.setattr(ann, "VISIT", 0)
    else:
        monkeypatch.setattr(ann, "SCAN_BYTES", 4 * 64 * 300, raising=False)
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = ann.neighbours(d, block=300, part=256, first_part=128)
    assert ("FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (way != "scan")
    rows = found.collect()
    assert len(rows) == 10 * len(m) // 20 and recall(rows, np.arange(len(m)), m, 10) >= (1 if way == "scan" else 0.95)


def test_a_scan_takes_only_its_queries(spark, tmp_path):
    """A query that probes is not scanned for; ids decide among equals, and the k best of the rows held at once come back."""
    m = np.eye(4, dtype=np.float32)[[0, 0, 0, 1]]
    asks = spark.createDataFrame([(100, 0.5, m[0].tolist(), 1.0), (200, 0.5, m[3].tolist(), -1.0), (2, -1.0, m[0].tolist(), 0.0)], "kind long, bound double, v array<float>, saved double")
    asks.write.parquet(str(tmp_path / "q"))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "kind long, v array<float>").coalesce(1)
    of = lambda least: sorted(map(tuple, rows.mapInArrow(ann._scanned(4, 2, str(tmp_path / "q"), least), ann._FOUND).collect()))
    some = [(2, 0, 1.0), (2, 1, 1.0), (200, 3, 1.0)]
    assert of(0.0) == some and of(np.inf) == sorted([*some, (100, 0, 1.0), (100, 1, 1.0)])


def test_probing_retrieves_the_radius():
    """Every code within r bits agrees with the query in some substring up to r // m bits, and the probes find it there."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, (9000, 2), dtype=np.uint64)
    codes[100:200] = codes[0]
    for k in range(100, 200):
        for bit in rng.choice(128, (k - 100) // 2, replace=False):
            codes[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    d = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
    own = ann.pieces(codes)
    for r in (0, 7, 8, 15, 23, 40):
        found = [ann.Index(own[:, j]).probe(own[:1, j], r // 8)[1] for j in range(8)]
        assert set(np.flatnonzero(d <= r).tolist()) <= set(np.concatenate(found).tolist())
        for j, rows in enumerate(found):
            assert sorted(rows.tolist()) == np.flatnonzero(np.bitwise_count((own[:, j] ^ own[0, j]).astype(np.uint16)) <= r // 8).tolist()


def test_the_index_leaves_out_what_is_far():
    """Near copies are settled by small radii: of an index of many clusters the probes read a small part."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((400, 64))
    m = np.repeat(centre, 25, axis=0) + 0.05 * rng.standard_normal((10_000, 64))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    turned = ann.learn(m[:2000], 64)
    codes = ann.encode(m, turned)
    own, z = ann.pieces(codes), ann.deviations(m[:2000], codes[:2000], 10)
    asks = np.arange(0, len(m), 20)
    s = m[asks] @ m.T
    s[np.arange(len(asks)), asks] = -2
    bound = -np.sort(-s, axis=1)[:, 9]
    reach = ann.radius(bound, z)
    read = sum(len(ann.Index(own[:, j]).probe(own[asks[k : k + 1], j], int(reach[k] // 8))[1]) for k in range(0, len(asks), 10) for j in range(8))
    assert read / (len(range(0, len(asks), 10)) * len(m)) < 0.2
    apart = np.bitwise_count(codes[asks][:, None] ^ codes[np.argsort(-s, axis=1)[:, :10]]).sum(axis=2)
    assert (apart <= reach[:, None]).mean() >= 0.95


def test_op8(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.op8_neighbours(spark, SF).collect()
    assert recall(rows, np.array([r.vec_id for r in e]), np.array([r.embedding for r in e]), 10) >= 0.95


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0 and forest.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (20, [0.0, 1.0])], kind)
    assert sorted((r.vec_id, r.neighbour_id) for r in ann.neighbours(two, bits=64).collect()) == [(20, 1)]
    assert sorted((r.vec_id, r.neighbour_id) for r in ann.neighbours(two, bits=64, every=1).collect()) == [(1, 20), (20, 1)]
    assert sorted(map(tuple, forest.near_duplicates(two).collect())) == [(1, 1, 0), (20, 20, 0)] and ann.neighbours(two.limit(1), bits=64).count() == 0


@pytest.mark.parametrize("place,most", [(32_768, 10**6), (50, 10**6), (50, 60)])
def test_forest(vectors, monkeypatch, place, most):
    monkeypatch.setattr(forest, "PLACE", place)
    monkeypatch.setattr(forest, "PLACE_MOST", most)
    d, ids, m = vectors
    near = m @ m.T >= 0.95
    i, j = np.nonzero(near)
    label = least_labels(len(ids), i, j)
    want = {ids[k]: (ids[x], near[k].sum() - 1) for k, x in enumerate(label)}
    got = {r.vec_id: (r.class_id, r.links) for r in forest.near_duplicates(d, block=40).collect()}
    linked = {k for k, v in want.items() if v[1]}
    assert set(got) == set(want) and len(linked) > 90 and sum(got[k] == want[k] for k in linked) >= 0.95 * len(linked)
    assert all(got[k] == v for k, v in want.items() if k not in linked)


@pytest.mark.parametrize("mean", [0.0, 2.0])
def test_recall_and_places_of_the_forest(mean):
    """Pairs at the threshold share a leaf of some tree, and places stay near their ideal, also where all vectors lean one way."""
    rng = np.random.default_rng(3)
    n, width = 60_000, 64
    m = rng.standard_normal((n, width)) / 8
    m[:, 0] += mean
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    step = rng.standard_normal((300, width))
    step -= (step * m[:300]).sum(axis=1, keepdims=True) * m[:300]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    m[300:600] = 0.951 * m[:300] + np.sqrt(1 - 0.951**2) * step  # just above the threshold
    m = m.astype(np.float32)
    forest_ = forest.grown(m[::3], n, width, forest.THRESHOLD)
    deep = [forest.Tree(m[::3], t, 6, width) for t in range(len(forest_))]
    met = np.zeros(300, bool)
    for tree in deep:
        rows, place = tree.places(m)
        assert np.unique(place, return_counts=True)[1].max() < 4 * len(rows) / 64
        a, b = ({*zip(r.tolist(), p.tolist())} for r, p in ((rows[rows < 300], place[rows < 300]), (rows[(rows >= 300) & (rows < 600)] - 300, place[(rows >= 300) & (rows < 600)])))
        met[[r for r, _ in a & b]] = True
    assert met.mean() >= 0.95


def test_op10(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: (r.class_id, r.links) for r in queries.op10_embedding_duplicates(spark, SF).collect()}
    assert got == {r.vec_id: (r.vec_id, 0) for r in e.collect()}  # no two vectors there are near
    copies = queries.embedding_duplicates_of_copies(spark, SF).collect()
    assert len(copies) == 4 * e.count() and sum(r.links > 0 for r in copies) > e.count()


def test_moved_copies_are_those_of_the_sql(spark, monkeypatch, tmp_path):
    """The vectors themselves: classes and links of few rows hide a wrong shift."""
    import duckdb

    spark.createDataFrame([(k, [k / 7 + i / 3 for i in range(5)]) for k in range(30)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(forest, "near_duplicates", lambda rows: rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, embedding FROM ({queries._COPIES_SQL})").fetchall()
    got = [(r.vec_id, r.embedding) for r in queries.embedding_duplicates_of_copies(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((k, list(v)) for k, v in want)
