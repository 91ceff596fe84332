"""Token counts, packing, sharding and the SentencePiece operator against the libraries and brute force."""

import duckdb
import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from framewright.llm import packing, queries, sentencepieces, sharding, token_counts
from framewright.llm.pieces import DEFAULT_RANKS, PATTERN, load_ranks

from llmfixtures import SF, EDGES


@pytest.fixture(scope="module")
def bpe():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(DEFAULT_RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4(spark, bpe, texts):
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == {i: len(bpe.encode_ordinary(t)) for i, t in texts.items()}


@pytest.mark.parametrize("frequent", [0, 3, 5000])
def test_counts_of_edges(make, bpe, prose, frequent):
    rows = EDGES + [(100, prose(60_000, 1)), (101, "x" * 50_000), (102, "it's  we'LL 'sx ' a　b \t\n c")]
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(make(rows), frequent=frequent).collect()), key=str)
    assert got == sorted(((i, None if t is None else len(bpe.encode_ordinary(t))) for i, t in rows), key=str)


def test_counts_of_none(make):
    assert token_counts.token_counts(make([])).count() == 0


def test_summaries_merge_and_forget():
    from framewright.llm.arrays import pretokens

    s = token_counts.Summary(limit=8)
    for k in range(30):
        buf = np.frombuffer((f"the the w{k}" if k else "the").encode() + bytes(16), np.uint8)
        starts, lengths, _ = pretokens(buf, np.array([0, len(buf) - 16]))
        s.add(buf, starts, lengths)
    hashes, counts, sizes, spans = s.top(1)
    assert spans.tobytes() == b"the" or spans.tobytes() == b" the"


def unpack(windows, width):
    rows = sorted(windows.collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in rows] == list(range(len(rows)))
    assert all(r.n_tokens == len(r.tokens) == (width if r is not rows[-1] else r.n_tokens) for r in rows)
    docs, order = {}, []
    for r in rows:
        assert sum(p.length for p in r.pieces) == r.n_tokens and sorted(p.window_start for p in r.pieces) == [p.window_start for p in r.pieces]
        for p in r.pieces:
            if p.doc_start == 0:
                order.append((p.doc_id, []))
            order[-1][1].extend(r.tokens[p.window_start : p.window_start + p.length])
    for i, t in order:
        docs.setdefault(i, []).append(t)
    return docs


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_packing_round_trip(make, bpe, prose, width):
    rows = EDGES + [(k, prose(40 + k, k)) for k in range(20, 40)] + ([(99, prose(9000, 9))] if width > 1 else [])
    docs = unpack(packing.pack(make(rows, 5), window=width), width)
    want = {}
    for i, t in rows:
        if t:
            want.setdefault(i, []).append(bpe.encode_ordinary(t) + [50256])
    assert {i: sorted(v) for i, v in docs.items()} == {i: sorted(v) for i, v in want.items()}


def test_packing_of_none(make):
    assert packing.pack(make([])).count() == 0 and packing.pack(make([(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make([]), window=0)


def test_packing_by_join(make, bpe, prose, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    rows = [(k, prose(30, k)) for k in range(9)]
    assert unpack(packing.pack(make(rows), window=16), 16) == {k: [bpe.encode_ordinary(t) + [50256]] for k, t in rows}


def test_op7(spark, bpe, texts):
    docs = unpack(queries.op7_packing(spark, SF), packing.WINDOW)
    assert docs == {i: [bpe.encode_ordinary(t) + [50256]] for i, t in texts.items() if t}


def test_op9(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op9_sharding(spark, SF).collect())) == sorted(con.execute(queries.ORACLE_SQL["op9_sharding"]).fetchall())


def test_sharding(make, spark):
    d = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shards = {f"s{k}": 1.0 + (k == 0) for k in range(5)}
    n = {r.shard: r["count"] for r in sharding.shard(d, shards=shards).groupBy("shard").count().collect()}
    assert abs(n["s0"] / 20_000 - 2 / 6) < 0.02 and all(abs(n[f"s{k}"] / 20_000 - 1 / 6) < 0.02 for k in range(1, 5))
    more = sharding.moved(d, shards, {**shards, "s5": 1.0})
    assert more.filter("shard_after <> 's5'").count() == 0 and abs(more.count() / 20_000 - 1 / 7) < 0.02
    less = {k: w for k, w in shards.items() if k != "s3"}
    assert sharding.moved(d, shards, less).filter("shard_before <> 's3'").count() == 0
    rows = sharding.shard(make(EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r.shard for r in rows) and len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.shard(make([])).count() == 0
    for bad in ({}, {"a": 0.0}, {"a": -1.0}, {"a": None}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            sharding.shard(d, shards=bad)


def test_op1(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_MODEL)
    for r in queries.op1_sentencepiece(spark, SF).collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == texts[r.doc_id]


def test_pieces_of_edges(make, prose):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_MODEL)
    rows = EDGES + [(50, prose(20_000, 2)), (51, "▁a ▁ b"), (52, " lead and trail  "), (53, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 50), (54, "\x00\x01 ‍🧑‍🚀")]
    out = sentencepieces.encode_decode(make(rows)).collect()
    assert len(out) == len(rows)
    by = dict(rows)
    for r in out:
        t = by[r.doc_id]
        if t is None:
            assert r.ids is None and r.n_tokens is None and r.decoded is None
        else:
            assert r.ids == sp.encode(t), r.doc_id
            assert r.decoded == t.replace("▁", " ")
    assert sentencepieces.encode_decode(make([])).count() == 0


def test_backtracking_is_exact_on_letters():
    rng = np.random.default_rng(0)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_MODEL)
    _, cache, _ = sentencepieces.load(sentencepieces.DEFAULT_MODEL)
    for _ in range(400):
        text = "".join(rng.choice(list("etaoin shrdlu"), rng.integers(1, 40)))
        assert cache.encode((" " + text).encode()) == sp.encode(text), text
