from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.functions import vectors
from lexivec.operators import batching, benchstats, embed, evaluate, quality, requests

CASES = "case_id string, expected_qids array<string>, top_k int, language string, category string"


def test_case_outcomes_and_metrics(spark):
    cases = spark.createDataFrame(
        [("a", ["Q1"], 10, "en", "x"), ("b", ["Q2", "Q2"], 10, "vi", "x"), ("c", ["Q9"], 10, "vi", "y"), ("d", ["Q3"], 1, "en", "y")], CASES
    )
    ranks = spark.createDataFrame(
        [("a", 1, "Q1"), ("b", 1, "Q5"), ("b", 2, "Q2"), ("d", 1, "Q1"), ("d", 2, "Q3")], "case_id string, rank int, qid string"
    )
    have = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",), ("Q5",), (None,)], "qid string")
    out = evaluate.case_outcomes(cases, ranks, have)
    got = {r.case_id: (r.status, r.first_rank_in_k) for r in out.collect()}
    assert got == {
        "a": ("QUALITY_PASS", 1), "b": ("QUALITY_PASS", 2), "c": ("DATASET_COVERAGE_MISSING", None), "d": ("RETRIEVAL_MISS", None),
    }
    m = evaluate.metrics(out).first()
    assert (m.cases, m.covered_cases, m.coverage_rate) == (4, 3, 0.75)
    # hit@k looks at the whole ranking, MRR only within a case's top_k
    assert m.hit_at_1 == pytest.approx(1 / 3) and m.hit_at_5 == 1.0 and m.mrr == pytest.approx(0.5)
    s = evaluate.status_counts(out).first()
    assert (s.quality_pass, s.dataset_coverage_missing, s.retrieval_miss) == (2, 1, 1)
    rolled = {(r.grouping, r.value): r for r in evaluate.rollup(out).collect()}
    assert rolled["language", "vi"].covered_cases == 1 and rolled["overall", ""].cases == 4
    none = evaluate.metrics(out.where("case_id = 'c'")).first()
    assert none.mrr is None and none.coverage_rate == 0.0


def test_overlap_divides_by_k(spark):
    df = spark.createDataFrame([(["Q1", "Q2", "Q3"], ["Q3", "Q2", "Q9"]), (["Q1"], ["Q1"])], "a array<string>, b array<string>")
    got = [r.o for r in df.select(evaluate.overlap_at(F.col("a"), F.col("b"), 3).alias("o")).collect()]
    assert got == pytest.approx([2 / 3, 1 / 3])
    r = df.select(evaluate.rank_or_absent(F.col("a"), F.lit("Q3"), 5).alias("r")).collect()
    assert [x.r for x in r] == ["3", "not in top 5"]


def test_quality(spark):
    rows = [
        ("Berlin", "Berlin", "city", "capital city of the German state", "d", None, ["Q515"]),
        ("A", "B", None, "thủ đô của bang ở Đức", None, "", ["Q515", "Q1", "Q1"]),
    ]
    names = "label_en string, label_vi string, description_en string, description_vi string, document_en string, document_vi string, instance_of_qids array<string>"
    df = spark.createDataFrame(rows, names)
    assert quality.falsy_rates(df).first().document_en == 0.5 and quality.falsy_rates(df).first().document_vi == 1.0
    assert {r.field: (r.n, r.rate) for r in quality.identical_pairs(df).collect()}["label"] == (1, 0.5)
    assert {r.field: (r.n, r.rate) for r in quality.suspected_english(df).collect()}["description_vi"] == (1, 0.5)
    assert {r.category: (r.n, r.rate) for r in quality.category_coverage(df).collect()} == {"Q515": (2, 1.0), "Q1": (2, 1.0)}
    empty = df.limit(0)
    assert quality.falsy_rates(empty).first().label_en == 0.0
    assert quality.identical_pairs(empty).first().rate == 0.0 and quality.category_coverage(empty).count() == 0


def test_latency_and_throughput(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "s double")
    r = df.agg(*benchstats.latency_summary("s")).first()
    assert (r.min_ms, r.p50_ms, r.max_ms) == (100.0, 250.0, 400.0)
    rows = [(None if i % 5 == 0 else "ab"[i % 2], ((i * 7919) % 1001) / 1000) for i in range(400)] + [("c", 0.5), ("n", None), ("a", None)]
    many = spark.createDataFrame(rows, "g string, s double").repartition(6).withColumns({c: F.lit(0) for c in ("position", "ms", "name", "least")})
    got = {r.g: tuple(r)[1:] for r in benchstats.latency_report(many, "g", "s").collect()}
    assert got == {r.g: tuple(r)[1:] for r in many.where("s is not null").groupBy("g").agg(*benchstats.latency_summary("s")).collect()}
    assert set(got) == {None, "a", "b", "c"} and benchstats.latency_report(many.limit(0), "g", "s").count() == 0
    t = df.agg(benchstats.throughput(F.lit(8), F.lit(1.0)).alias("t")).first().t
    assert t == 8.0
    with pytest.raises(Exception, match="positive"):
        df.agg(benchstats.throughput(F.lit(8), F.lit(0.0)).alias("t")).collect()


def matrix(spark):
    rows = [
        ("s1", 1, 1, 8, 1024, 16, 0, None, 25.0, (100.0,)),
        ("s2", 1, 2, 8, 1024, 16, 0, 0, 25.5, (200.0,)),
        ("d1", 2, 2, 8, 1024, 16, 0, 0, 49.0, (110.0,)),
        ("e1", 2, 4, 8, 1024, 16, 3, 0, 99.0, (90.0,)),
    ]
    return spark.createDataFrame(
        rows,
        "case_id string, worker_count int, concurrency int, items_per_request int, dimensions int, requests int, errors int, "
        "rejected_429 int, throughput_items_per_second double, latency_ms struct<p95:double>",
    )


def test_matrix(spark):
    m = matrix(spark)
    best = {r.worker_count: r.case_id for r in benchstats.best_stable(m, "concurrency").collect()}
    assert best == {1: "s2", 2: "d1"}
    (pair,) = benchstats.matched_scaling(m).collect()
    assert (pair.single_case_id, pair.dual_case_id, pair.throughput_ratio) == ("s1", "d1", 1.96)
    (flat,) = benchstats.flattening(m).collect()
    assert (flat.lower_case_id, flat.higher_case_id, flat.p95_latency_increase_ms) == ("s1", "s2", 100.0)


def test_long_context(spark):
    targets = spark.createDataFrame([(t,) for t in benchstats.TARGETS], "target_tokens int")
    executed = spark.createDataFrame([(4096, "PASS", 1.0), (8192, "ERROR", 2.0)], "target_tokens int, status string, latency_seconds double")
    got = {r.target_tokens: (r.status, r.blocked_by_target_tokens) for r in benchstats.final_results(targets, executed).collect()}
    assert got[8192] == ("ERROR", None) and got[32768] == ("NOT_RUN_AFTER_OOM", 8192) and len(got) == 5
    passed = executed.where("status = 'PASS'")
    assert benchstats.final_results(targets, passed).count() == 1
    assert {r.target_tokens for r in benchstats.remaining_targets(targets, passed, "target_tokens").collect()} == {8192, 16384, 24576, 32768}
    assert benchstats.remaining_targets(targets, executed, "target_tokens").count() == 0
    assert benchstats.remaining_targets(targets, executed.limit(0), "target_tokens").count() == 5


def test_worker_metrics(spark):
    rows = [(0, 2, 1.0, 0.5, 100, 200), (0, 4, 3.0, None, 150, 180), (1, 1, 1.0, None, 90, 220)]
    df = spark.createDataFrame(rows, "worker_id int, items long, latency double, queue_wait double, max_allocated_bytes long, max_reserved_bytes long")
    got = {r.worker_id: (r.max_allocated_bytes, r.max_reserved_bytes, r.average_batch_size) for r in benchstats.worker_metrics(df).collect()}
    assert got == {0: (150, 200, 3.0), 1: (90, 220, 1.0)}
    assert benchstats.snapshot(df.limit(0)).first().average_batch_size == 0.0


@pytest.mark.parametrize(
    "tokens, items, cap, want",
    [
        ([1] * 5, 2, 100, [0, 0, 1, 1, 2]),
        ([3, 4, 2], 10, 5, [0, 1, 2]),
        ([420, *[8] * 15], 16, 512, [0, *[1] * 15]),
        ([900], 16, 512, [0]),
        ([240] * 8, 16, 512, [0, 0, 1, 1, 2, 2, 3, 3]),
        ([], 16, 512, []),
    ],
)
def test_micro_batches(spark, tokens, items, cap, want):
    df = spark.createDataFrame([(tokens,)], "t array<bigint>")
    assert df.select(batching.batch_starts(F.col("t"), items, cap).alias("b")).first().b == want


def test_admission_and_placement(spark):
    df = spark.createDataFrame([([5, 6, 4, 1],)], "t array<bigint>")
    r = df.select(batching.admissions(F.col("t"), 10).alias("a"), batching.placements(F.col("t"), 2).alias("p")).first()
    assert r.a == [True, False, True, True] and r.p == [0, 1, 0, 1]
    items = spark.createDataFrame([("r", i, 300) for i in range(3)], "r string, i int, t long")
    b = batching.micro_batches(items, "r", "i", "t")
    assert {(x.items, x.cost) for x in batching.batch_costs(b, "r", "t").collect()} == {(1, 300)}
    assert batching.missing_items(items, items.where("i < 2"), ["r", "i"]).count() == 1
    assert sorted(x.chunk for x in batching.chunks(items, "r", "i", 2).collect()) == [0, 0, 1]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0] + [0.0] * 62,)], "v array<float>")
    r = df.select(
        vectors.norm(F.col("v")).alias("n"), vectors.project(F.col("v"), 32).alias("p"), vectors.cosine(F.col("v"), F.col("v")).alias("c")
    ).first()
    assert r.n == 5.0 and r.p[:2] == pytest.approx([0.6, 0.8]) and len(r.p) == 32 and r.c == pytest.approx(1.0)
    with pytest.raises(ValueError):
        vectors.project(F.col("v"), 16)
    zero = spark.createDataFrame([([0.0] * 64,)], "v array<float>")
    with pytest.raises(Exception, match="zero"):
        zero.select(vectors.unit(F.col("v"))).collect()
    odd = spark.createDataFrame([([1.0, float("nan")],), ([1.0, None],), ([float("inf")],), ([1.0],)], "v array<float>")
    assert [x.f for x in odd.select(vectors.is_finite(F.col("v")).alias("f")).collect()] == [False, False, False, True]
    h = spark.createDataFrame([([[1.0], [2.0], [3.0]], [0, 1, 1], True), ([[1.0], [2.0], [3.0]], [1, 1, 0], False)], "h array<array<float>>, m array<int>, b boolean")
    assert [x.l[0] for x in h.select(vectors.last_token(F.col("h"), F.col("m"), F.col("b")).alias("l")).collect()] == [3.0, 2.0]


def test_requests(spark):
    rows = [("a", 0, "fine"), ("b", 0, "x" * 40_000), ("b", 1, "\x01"), ("c", 0, " "), ("c", 1, "ok"), ("d", 0, "a�")]
    items = spark.createDataFrame(rows + [("e", i, "t") for i in range(129)] + [("f", None, None)], "request_id string, item_index int, text string")
    got = {r.request_id: r.status for r in requests.validate(items, "request_id", "item_index", "text").collect()}
    assert got == {"a": 200, "b": 413, "c": 422, "d": 422, "e": 413, "f": 422}
    q = spark.createDataFrame([("q", 1, "en"), ("q", 0, None), (" ", 5, None), ("q", 5, "de"), (None, 5, None)], "q string, k int, l string")
    assert [r.s for r in q.select(requests.search_status(F.col("q"), F.col("k"), F.col("l")).alias("s")).collect()] == [200, 422, 422, 422, 422]
    answers = spark.createDataFrame([("a", 1, [2.0], 3), ("a", 0, [1.0], 2), ("b", 0, [float("nan")], 1)], "r string, i int, v array<double>, t long")
    body = requests.embedding_answers(answers.where("r = 'a'"), "r", "i", "v", "t").first().body
    assert body.index('"index":0') < body.index('"index":1') and '"total_tokens":5' in body
    bad = requests.non_finite(answers, "r", "i", "v").first()
    assert (bad.r, bad.indexes, bad.n) == ("b", [0], 1)


def test_embedding_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([(0, "a long text of words"), (1, None), (2, "a"), (3, "a")], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in df.withColumn("v", embed.embedding(F.col("t"), embed.HashingEmbedder)).collect()}
    assert got[1] is None and got[2] == got[3] and sum(x * x for x in got[0]) == pytest.approx(1.0)
    assert embed.split([420, *[8] * 15]) == [slice(0, 1), slice(1, 16)]


def test_pooling_and_plans_read_whole_tables(spark):
    import os

    from lexivec.plans import benchmarks

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    usable = spark.read.parquet(f"{data}/embed_results.parquet").where("request_id is not null and size(embeddings) > 0").count()
    assert benchmarks.QUERIES["f09_last_token_pool"](spark, data).count() == usable > 100
    assert benchmarks.QUERIES["w03_event_results"](spark, data).count() >= 3


def test_modes_pairs_and_excluded_snippets(spark, tmp_path):
    from lexivec.operators import capabilities

    cases = spark.createDataFrame([("q1", ["Q1"], 10), ("q2", ["Q2"], 10)], "case_id string, expected_qids array<string>, top_k int").withColumn("mode", F.lit(0))
    ranked = spark.createDataFrame([("q1", 1, "Q1"), ("q2", 1, "Q9"), ("q2", 2, "Q2")], "case_id string, rank int, qid string")
    have = spark.createDataFrame([("Q1",), ("Q2",)], "qid string")
    got = {r.mode: r for r in capabilities.instruction_ab(cases, ranked, ranked.limit(0), have).collect()}
    a, b = got[capabilities.WITH], got[capabilities.WITHOUT]
    assert (a.hit_at_1, a.hit_at_5, a.mrr) == (0.5, 1.0, 0.75) and (b.cases, b.covered_cases, b.hit_at_10, b.mrr) == (2, 2, 0.0, 0.0)
    assert capabilities.instruction_ab(cases.limit(0), ranked, ranked, have).count() == 0

    hits = "pair_id string, rank int, qid string"
    en = spark.createDataFrame([("p", 1, "Q1"), ("p", 2, "Q2"), ("p", 3, "Q3"), ("x", 1, "Q1"), ("x", 2, None)], hits)
    vi = spark.createDataFrame([("p", 1, "Q3"), ("p", 2, "Q2"), ("p", 3, "Q9"), ("p", 4, "Q1")], hits)
    pairs = {r.pair_id: r for r in capabilities.cross_lingual(en, vi, 3).collect()}
    assert pairs["p"].overlap == pytest.approx(2 / 3) and pairs["p"].en_top == ["Q1", "Q2", "Q3"] and pairs["x"].vi_top == [] and pairs["x"].overlap == 0
    mean = capabilities.mean_overlap(capabilities.cross_lingual(en, vi, 3)).first()
    assert mean.pairs == 2 and mean.mean_overlap == pytest.approx(1 / 3) and capabilities.mean_overlap(capabilities.cross_lingual(en.limit(0), vi.limit(0))).first().mean_overlap is None

    v = "id string, embedding array<double>"
    snippets = spark.createDataFrame([("json", [1.0, 0.0]), ("csv", [0.0, 1.0]), ("nan", [float("nan"), 1.0]), ("none", None)], v)
    queries = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [1.0, 0.2])], v)
    expected = spark.createDataFrame([("a", "json"), ("b", "nan")], "query_id string, id string")
    r = capabilities.code_retrieval(snippets, queries, expected, 2).first()
    assert (r.query_count, r.snippet_count_total, r.snippet_count_finite, r.snippet_count_excluded) == (2, 4, 2, 2)
    assert (r.hit_at_1, r.hit_at_10) == (0.5, 0.5)
    assert {x.id for x in capabilities.measured(snippets, "embedding")[1].collect()} == {"nan", "none"}
    assert capabilities.code_retrieval(snippets.limit(0), queries.limit(0), expected, 2).first().hit_at_1 is None


def test_matrix_cases_and_result_sink(spark, tmp_path):
    m = benchstats.default_matrix(spark).collect()
    assert len({c.case_id for c in m}) == 12 and {c.worker_count for c in m} == {1, 2} and {c.dimensions for c in m} == {1024, 4096}
    assert {1, 4, 8, 16} <= {c.items_per_request for c in m} and {1, 2, 4, 8} <= {c.concurrency for c in m}
    path = str(tmp_path / "deep" / "r.json")
    assert benchstats.write_result({"errors": 0, "label": "x"}, path) == 0 and benchstats.write_result({"errors": 2}, path) == 1
    assert open(path).read() == '{\n  "errors": 2\n}\n'


def test_pooled_embedder(spark):
    def letters(text):
        return [ord(c) % 97 + 1 for c in text]

    def states(ids, mask):
        # the state of a place: its token, the number of tokens so far, and a constant; token 50 has no finite state
        s = np.stack([ids.astype(float), np.cumsum(mask, axis=1), np.ones(ids.shape)], axis=2)
        s[ids == 50] = np.nan
        return s

    def pooled():
        return embed.PooledEmbedder(letters, states, 2, max_sequence=4)

    texts = ["ab", "abcdefgh", "", "a", chr(97 * 2 + 49)]
    ids, mask = pooled().padded(texts)
    assert ids.shape == (5, 4) and ids[0].tolist()[:2] == [0, 0] and mask.sum(axis=1).tolist() == [2, 4, 0, 1, 1]
    got = pooled().embed(texts)
    want = np.array([letters("b")[0], 2.0])
    assert np.allclose(got[0], want / np.linalg.norm(want)) and np.allclose(np.linalg.norm(got[:2], axis=1), 1)
    assert got[1][1] / got[1][0] == pytest.approx(4 / letters("d")[0]) and np.isnan(got[4]).all() and got[2].tolist() == [0, 0]
    assert np.allclose(pooled().embed(["ab"]), got[:1])  # padding makes no difference
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "id int, t string")
    rows = {r.id: r.v for r in df.select("id", embed.embedding(F.col("t"), pooled, 2, 64).alias("v")).collect()}
    assert rows[9] is None and np.allclose(rows[1], got[1]) and np.isnan(rows[4]).all()
    with pytest.raises(RuntimeError):
        embed.PooledEmbedder(letters, lambda i, m: np.zeros((1, 1, 1)), 2).embed(["ab"])
    with pytest.raises(ValueError):
        embed.PooledEmbedder(letters, states, 0)
