from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.llm import mixing, packing
from lexivec.llm.tokens import encoder


def counts(sizes, cap):
    return np.bincount(np.array(sizes, dtype=int), minlength=cap + 1)


def fewest(sizes, cap):
    """By trying all assignments, up to symmetry."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(order):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= order[k]:
                go(k + 1, (*rooms[:i], rooms[i] - order[k], *rooms[i + 1 :]))
        go(k + 1, (*rooms, cap - order[k]))

    order = sorted(sizes, reverse=True)
    go(0, ())
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_optimal_on_small_cases(sizes):
    boxes = packing.bin_completion(counts(sizes, 20), 20, nodes=100_000, keep=64)
    assert sorted(s for b in boxes for s in b) == sorted(sizes) and all(sum(b) <= 20 for b in boxes)
    assert len(boxes) == fewest(sizes, 20)


def test_beats_best_fit():
    sizes = [7, 7, 6, 6, 4, 4, 3, 3] * 1 + [10]
    cap = 20
    assert len(packing.bin_completion(counts(sizes, cap), cap)) <= len(packing.best_fit_decreasing(counts(sizes, cap), cap))
    rng = np.random.default_rng(3)
    c = counts(rng.integers(500, 900, 300), 2048)
    assert len(packing.bin_completion(c, 2048)) < len(packing.best_fit_decreasing(c, 2048))


def test_search_completes_packings_of_many_containers():
    c = counts(np.random.default_rng(5).integers(500, 901, 8192), 2048)
    boxes = packing.bin_completion(c, 2048)
    assert len(boxes) < len(packing.best_fit_decreasing(c, 2048))
    assert max(map(sum, boxes)) <= 2048 and (counts([s for b in boxes for s in b], 2048) == c).all()


def test_dominance_and_completions():
    assert packing.dominates([10], [6, 4]) and not packing.dominates([6, 4], [10]) and packing.dominates([6, 4], [6, 3])
    found = packing.completions(counts([6, 4, 10, 3], 20), 10, 10, 8, 1000)
    assert found[0] == [10] and not any(f == [6, 4] for f in found)  # dominated
    assert packing.completions(counts([3], 20), 10, 2, 8, 1000) == []  # pruned by waste


def words(n):
    return " ".join(["tree"] * n)


def test_operator(spark):
    rows = [(i, words(5 + i % 30)) for i in range(400)] + [(1000, words(200)), (1001, None), (1002, ""), (None, words(10)), (5, words(10))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"pool": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    got = packing.pack(df, capacity=64, pool_items=100).collect()
    fill: dict[str, int] = {}
    for r in got:
        if r.container is None:
            assert r.n_tokens == 0 and r.doc_id in (1001, 1002)
        else:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 64
    parts = sorted(((r.part, r.n_tokens) for r in got if r.doc_id == 1000))
    assert [p for p, _ in parts] == [0, 1, 2, 3] and sum(n for _, n in parts) == len(encoder().encode_ordinary(words(200)))
    whole = [r.doc_id for r in got if r.doc_id != 1000]
    assert sorted(map(str, whole)) == sorted(str(i) for i, _ in rows if i != 1000)  # nothing lost, nothing divided
    report = packing.fill_report(packing.pack(df, capacity=64, pool_items=100), 64).first()
    assert report.containers == len(fill) and report.share_filled > 0.9 and report.fullest <= 64
    empty = packing.pack(df.limit(0), capacity=64)
    assert empty.count() == 0 and packing.fill_report(empty).first().containers == 0


def test_sainte_lague_by_hand():
    for w, m, k in product([[0.5, 0.3, 0.2], [0.1, 0, 0.9], [1, 1, 1]], [[100, 100, 100], [3, 50, 0]], range(0, 60, 7)):
        a = [0, 0, 0]
        for _ in range(k):
            free = [i for i in range(3) if w[i] > 0 and a[i] < m[i]]
            if not free:
                break
            a[max(free, key=lambda i: (w[i] / (2 * a[i] + 1), -i))] += 1
        assert mixing.sainte_lague(w, k, m) == a


def targets(spark, rows, budget):
    return spark.createDataFrame([(s, w, u, budget) for s, w, u in rows], "source string, target_weight double, max_uses int, budget_tokens bigint")


def test_mixture(spark):
    docs = [(i, "big", words(20)) for i in range(300)] + [(1000 + i, "small", words(10)) for i in range(10)]
    docs += [(2000 + i, "mid", words(7 + i % 5)) for i in range(200)] + [(3000, None, words(50)), (3001, "other", words(50)), (3002, "big", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumns({"uses": F.lit(1), "shard": F.lit(1), "w": F.lit(0)})
    plan = mixing.mix(df, targets(spark, [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("absent", 0.1, 4)], 4000), block=16, shard_tokens=700)
    report = {r.source: r for r in plan.report.collect()}
    assert report["small"].short and report["absent"].short and not report["big"].short
    assert report["small"].mixed_tokens == report["small"].available_tokens * 3
    assert sum(r.mixed_tokens for r in report.values()) == 4000
    assert abs(report["big"].mixed_tokens / report["mid"].mixed_tokens - 2.5) < 0.1
    rows = plan.rows.collect()
    got: dict[str, int] = {}
    uses: dict[int, int] = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert got == {s: r.mixed_tokens for s, r in report.items() if r.mixed_tokens}
    assert all(n <= {"big": 1, "small": 3, "mid": 2}[next(r.source for r in rows if r.doc_id == d)] for d, n in uses.items())
    again = mixing.mix(df, targets(spark, [("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("absent", 0.1, 4)], 4000), block=16, shard_tokens=700)
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("budget", [0, 10**9])
def test_mixture_limits(spark, budget):
    df = spark.createDataFrame([(1, "a", "tree tree")], "doc_id bigint, source string, text string")
    plan = mixing.mix(df, targets(spark, [("a", 1.0, 2), (None, 1.0, 2)], budget))
    assert plan.rows.count() == (2 if budget else 0)
    empty = mixing.mix(df.limit(0), targets(spark, [("a", 1.0, 2)], 100))
    assert empty.rows.count() == 0 and empty.report.first().actual_share is None
    assert mixing.mix(df, targets(spark, [], 5)).report.count() == 0


def test_many_sources_and_few_shards_give_the_same_mixture(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], "tree " * (1 + i % 20)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want = targets(spark, [("a", 0.5, 4), ("b", 0.3, 2), ("zz", 0.2, 1)], 3000)

    def drawn(**k):
        plan = mixing.mix(df, want, block=16, **k)
        return sorted(map(tuple, plan.rows.collect())), {r.source: r.mixed_tokens for r in plan.report.collect()}

    first = drawn()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert drawn() == first and sum(first[1].values()) == 3000
    assert max(u for s, _, u, _ in first[0] if s == "a") <= 4
    monkeypatch.setattr(mixing, "MAX_SHARDS", 2)
    rows, report = drawn(shard_tokens=10)
    assert report == first[1] and len({(s, i, u) for s, i, u, _ in rows}) == len(rows)


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, "a", words(20))] * 400 + [(i, "a", words(20)) for i in range(100)] + [(7, "a", words(20))] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    packed = packing.pack(df, capacity=64, pool_items=100).collect()
    assert sum(r.doc_id is None for r in packed) == 400 and len({r.container.split("-")[0] for r in packed if r.doc_id is None}) > 3
    plan = mixing.mix(df, targets(spark, [("a", 1.0, 1)], 10**6), shard_tokens=1000)
    got = plan.rows.collect()
    assert len(got) == 503 and sum(r.doc_id is None for r in got) == 400
    sizes = plan.report.first()
    assert sizes.mixed_tokens == sizes.available_tokens
