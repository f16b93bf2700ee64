from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import mih

SCHEMA = "vec_id bigint, model_fingerprint string, embeddings array<float>"
META = "model_fingerprint string, dimensions int, row_count bigint, dataset_sha256 string"


def metadata(spark, *rows):
    return spark.createDataFrame([(f, d, 0, "") for f, d in rows], META)


def clustered(n, dims, seed=1, spread=0.12, centres=60):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    v = c[rng.integers(0, centres, n)] + spread / math.sqrt(dims) * 4 * rng.standard_normal((n, dims))
    return (v * rng.uniform(0.5, 20, (n, 1))).astype(np.float32)


def brute(rows, dims, k=10, least=0.92):
    out = set()
    for fp, d in dims.items():
        own = sorted((i, v) for i, f, v in rows if f == fp and v is not None and len(v) >= d and i is not None)
        own = [(i, np.array(v[:d], dtype=np.float64)) for i, v in own if all(x is not None for x in v[:d])]
        own = [(i, v) for i, v in own if np.isfinite(v).all() and v.any()]
        if not own:
            continue
        ids = np.array([i for i, _ in own])
        u = mih.unit_rows(np.array([v for _, v in own])).astype(np.float32).astype(np.float64)
        s = u @ u.T
        near = {}
        for r in range(len(ids)):
            s[r, r] = -2
            c = np.flatnonzero(s[r] >= least)
            near[ids[r]] = set(ids[c[np.lexsort((ids[c], -np.round(s[r, c], 12)))][:k]])
        out |= {(a, b) for a in near for b in near[a] if a < b and a in near[b]}
    return out


def found(spark, rows, meta, **k):
    df = spark.createDataFrame([(i, f, None if v is None else [None if x is None else float(x) for x in v]) for i, f, v in rows], SCHEMA)
    return {(r.vec_id_a, r.vec_id_b) for r in mih.mutual_neighbours(df, meta, **k).collect()}


def test_against_brute_force(spark):
    rows = [(i, "a", v) for i, v in enumerate(clustered(600, 40, 1, 0.07))] + [(10_000 + i, "b", v) for i, v in enumerate(clustered(200, 40, 2, 0.07))]
    want = brute(rows, {"a": 32, "b": 24})
    got = found(spark, rows, metadata(spark, ("a", 32), ("b", 24), (None, 5)))
    assert len(want) > 100 and got <= want
    assert len(got) >= 0.98 * len(want)


def test_unusable_copies_ties_and_unknown_indexes(spark):
    v = [1.0, 2.0] + [0.5] * 30
    rows = [(i, "a", v) for i in range(20)]  # one vector delivered many times
    rows += [(30, "a", None), (31, "a", v[:10]), (32, "a", [0.0] * 32), (33, "a", [float("nan")] * 32), (34, "a", [None] * 32)]
    rows += [(35, "z", v), (None, "a", v), (36, None, v), (37, "a", [float("inf")] + v[1:]), (38, "a", [x * 1e30 for x in v])]
    got = found(spark, rows, metadata(spark, ("a", 32)))
    ids = {i for p in got for i in p}
    assert ids <= {*range(20), 38} and got == brute([(i, f, x) for i, f, x in rows if i is not None], {"a": 32})
    assert found(spark, [], metadata(spark, ("a", 32))) == set()
    assert found(spark, rows, metadata(spark)) == set()


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, "a", [float(x) for x in v]) for i, v in enumerate(clustered(80, 32))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("id", "idx", "v", "code", "cell")})
    meta = metadata(spark, ("a", 32)).withColumn("d", F.lit("x"))
    assert mih.mutual_neighbours(df, meta).count() > 0


@pytest.mark.parametrize("part_rows, hot", [(64, 100), (64, 1), (300, 1), (10_000, 4)])
def test_parts_and_blocks_give_the_same_pairs(spark, part_rows, hot):
    x = clustered(700, 32, 5)
    x[:250] = x[0] + 0.01 * np.random.default_rng(3).standard_normal((250, 32)).astype(np.float32)  # a third is nearly the same
    df = spark.createDataFrame([(i, "a", [float(y) for y in v]) for i, v in enumerate(x)], SCHEMA)
    v = mih.Vectors(df, [("a", 32)], "vec_id", "embeddings", "model_fingerprint", min_bits=12, grow=False)
    got = mih.close_codes(v, 10, 40, part_rows, hot).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got)  # every pair once
    codes = {r.id: np.frombuffer(r.code, np.uint16) for r in v.points(10).collect()}
    ids = sorted(codes)
    c = np.array([codes[i] for i in ids])
    far = np.bitwise_count(c[:, None] ^ c[None])
    near = (far <= 1).any(axis=2) & (far.sum(axis=2) <= 40)
    assert pairs == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j}


def test_search_reaches_its_recall(spark):
    x = clustered(1500, 32, 9, spread=1.0)
    df = spark.createDataFrame([(i, "a", [float(y) for y in v]) for i, v in enumerate(x)], SCHEMA)
    got: dict[int, set] = {}
    for r in mih.similar_to(df, metadata(spark, ("a", 32))).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
        assert r.vec_id % 20 == 0 and r.vec_id != r.neighbour
    u = mih.unit_rows(x)
    recall = []
    for q in range(0, 1500, 20):
        s = u @ u[q]
        s[q] = -2
        recall.append(len(set(np.argsort(-s)[:10].tolist()) & got[q]) / 10)
        assert len(got[q]) == 10
    assert np.mean(recall) >= 0.9


def test_pigeonhole():
    assert len(mih.flips(8, 2)) == 1 + 8 + 28 and mih.flips(8, 1)[0] == 0
    lo, hi = np.array([0, 5, 5]), np.array([3, 5, 6])
    got = [(int(i), int(j)) for a, b in mih.ragged(lo, hi) for i, j in zip(a, b)]
    assert got == [(0, 0), (0, 1), (0, 2), (2, 5)]


def test_longer_substrings_get_more_tables(spark):
    for bits in range(16, 27):
        assert mih.miss_rate(0.92, bits, mih.tables_for(0.92, bits)) <= mih.miss_rate(0.92, 16, mih.TABLES)
    assert mih.tables_for(0.92, 16) == mih.TABLES and mih.tables_for(0.92, 19) > mih.TABLES
    df = spark.createDataFrame([(i, "a", [float(y) for y in x]) for i, x in enumerate(clustered(300, 32, 3))], SCHEMA)
    names = ("vec_id", "embeddings", "model_fingerprint")
    v = mih.Vectors(df, [("a", 32)], *names, min_bits=19, grow=False, least=0.92)  # as with 2 million rows
    assert v.tables == mih.tables_for(0.92, 19)
    codes = {r.id: np.frombuffer(r.code, np.uint32) for r in v.points(10).collect()}
    assert {len(c) for c in codes.values()} == {v.tables}
    ids = sorted(codes)
    c = np.array([codes[i] for i in ids])
    far = np.bitwise_count(c[:, None] ^ c[None])
    near = (far <= 1).any(axis=2) & (far.sum(axis=2) <= 60)
    pairs = {(r.a, r.b) for r in mih.close_codes(v, 10, 60).collect()}
    assert pairs == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j}


@pytest.mark.parametrize("bits", [16, 20, 24, 28])
@pytest.mark.parametrize("cosine", [0.92, 0.93, 0.94])
def test_recall_holds_as_substrings_grow(bits, cosine):
    rng = np.random.default_rng(8)
    x = mih.unit_rows(clustered(6000, 64, 6, spread=0.8)).astype(np.float32)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = (cosine * x + math.sqrt(1 - cosine**2) * mih.unit_rows(away)).astype(np.float32)
    tables = mih.tables_for(0.92, bits)
    book = mih.learn_codes(x[:4000], 64, tables, bits)
    far = np.bitwise_count(book.encode(x) ^ book.encode(y))
    found = (far <= 1).any(axis=1) & (far.sum(axis=1) <= mih.bits_for(0.92, tables * bits))
    assert found.mean() >= 0.98


def test_a_small_index_beside_a_large_one_learns_its_own_codes(spark, monkeypatch):
    monkeypatch.setattr(mih, "SAMPLE_VECTORS", 400)
    rows = [(i, "large", v) for i, v in enumerate(clustered(4000, 32, 1))] + [(9000 + i, "small", v) for i, v in enumerate(clustered(300, 32, 2))]
    df = spark.createDataFrame([(i, f, [float(x) for x in v]) for i, f, v in rows], SCHEMA)
    v = mih.Vectors(df, [("large", 32), ("small", 32)], "vec_id", "embeddings", "model_fingerprint")
    own = mih.unit_rows(np.array([x for _, f, x in rows if f == "small"])).mean(axis=0)
    assert v.counts == [4000, 300] and np.abs(v.books[1].mean - own).max() < 1e-5


def test_indexes_in_groups_and_blocks_of_pairs(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], v) for i, v in enumerate(clustered(600, 32, 4, 0.07))]
    meta = metadata(spark, ("a", 32), ("b", 30), ("c", 24), ("a", 32))
    want = found(spark, rows, meta)
    monkeypatch.setattr(mih, "INDEXES_AT_ONCE", 2)
    monkeypatch.setattr(mih, "RERANK_PAIRS", 3)
    monkeypatch.setattr(mih.index_table, "__defaults__", (2,))
    monkeypatch.setattr(mih.reranked, "__defaults__", (3,))
    assert found(spark, rows, meta) == want and len(want) > 50
    assert len(mih.index_table(meta, "model_fingerprint", "dimensions")) == 2


def test_search_gives_ties_to_the_lower_id():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((9400, 32))
    x[:9000] = x[0]  # one vector delivered more often than candidates are looked at at a time
    x[9000:9030] = x[9000]
    u = mih.unit_rows(x).astype(np.float32)
    ids = np.arange(10_000, 19_400)
    book = mih.learn_codes(u[8500:], 32, mih.SEARCH_TABLES, mih.SEARCH_BITS)
    asks = np.array([3, 8000, 9005, 9029, 9300])
    p = np.arange(len(u))[::-1]  # the lowest ids come last
    best = mih.search_block(ids[p], u[p], book.encode(u[p]), ids[asks], u[asks], book.encode(u[asks]), mih.SEARCH_BITS, 10, 1)
    assert best.ids[:2].tolist() == [list(range(10_000, 10_011))] * 2
    assert best.ids[2:4].tolist() == [list(range(19_000, 19_011))] * 2
    s = u.astype(np.float64) @ u[9300]
    assert best.ids[4, 0] == 19_300 and np.all(np.diff(best.sim[4]) <= 0) and np.allclose(best.sim[4], s[best.ids[4] - 10_000])
