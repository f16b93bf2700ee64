"""Queries of vector search and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import vectors
from lexivec.operators import benchstats, evaluate, search
from lexivec.session import table

#: The stated query set of searches: every row whose id is divisible by it.
EVERY = 20
K = 10
SWEEP = (32, 48, 64)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _dims(corpus: DataFrame) -> int:
    first = corpus.select(F.size("embedding").alias("n")).where("n > 0").first()
    return first.n if first else 64


def _hits(spark: SparkSession, d: str, k: int = K, dims: int | None = None) -> DataFrame:
    """``query_id, id, score, rank`` of the stated query set over the first ``dims`` components."""
    corpus = _corpus(spark, d)
    if dims is not None:
        corpus = corpus.withColumn("embedding", F.slice("embedding", 1, dims))
    return search.search_all(
        corpus, corpus.where(F.col("vec_id") % EVERY == 0), k, "vec_id", "embedding", dims or _dims(corpus)
    )


def _query(corpus: DataFrame, vec_id: int):
    v = corpus.where(F.col("vec_id") == vec_id).select("embedding").first().embedding
    return F.array(*[F.lit(float(x)) for x in v])


def x03_topk_single(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    hits = search.top_k(c.where("vec_id <> 0"), _query(c, 0), K, "vec_id", "embedding")
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def x04_rank_string_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    rounded = c.select(
        F.lit(0).alias("q"), F.col("vec_id").cast("string").alias("id"), F.round(vectors.cosine(F.col("embedding"), _query(c, 0)), 1).alias("score")
    )
    best = rounded.orderBy(F.col("score").desc(), "id").limit(50)
    return search.rank_hits(best, "q", "id", 50).select("id", "score", F.col("rank").cast("bigint").alias("rank"))


def w01_topk_many(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


def f06_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    u = vectors.unit(v)
    return _corpus(spark, d).select(
        "vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"), F.round(vectors.norm(u), 6).alias("unit_norm")
    )


def f07_mrl_project(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    cuts = [
        F.round(F.get(vectors.project(F.col("embedding"), n), F.lit(0)), 6).alias(f"first_{n}") for n in SWEEP
    ]
    return c.select("vec_id", *cuts)


def f08_dot_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    q = _query(c, 0)
    return c.select(
        "vec_id", F.round(vectors.dot(F.col("embedding"), q), 6).alias("dot"), F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine")
    )


def _label_ranks(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    """``query_id, label, first_rank``: the first of the ten hits with the query's label."""
    c = _corpus(spark, d).select("vec_id", "label")
    hits = _hits(spark, d, K, dims)
    q = c.select(F.col("vec_id").alias("query_id"), "label")
    found = hits.join(c.withColumnRenamed("vec_id", "id").withColumnRenamed("label", "hit_label"), "id").join(q, "query_id")
    return found.groupBy("query_id", "label").agg(F.min(F.when(F.col("label") == F.col("hit_label"), F.col("rank"))).alias("first_rank"))


def _rates(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("cases"),
        *[F.round(evaluate.hit_rate(k), 6).alias(f"hit_at_{k}") for k in (1, 5, 10)],
        F.round(evaluate.mean_reciprocal(), 6).alias("mrr"),
    )


def a08_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rates(_label_ranks(spark, d), "label")


def b09_mrl_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates by labels over the first components of several widths; the corpus is scanned once."""
    c = _corpus(spark, d)
    dims = _dims(c)
    hits = search.search_widths(c, c.where(F.col("vec_id") % EVERY == 0), K, "vec_id", "embedding", dims, SWEEP)
    labels = c.select("vec_id", "label")
    found = (
        hits.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("hit_label")), "id")
        .join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        .groupBy("dims", "query_id").agg(F.min(F.when(F.col("label") == F.col("hit_label"), F.col("rank"))).alias("first_rank"))
    )
    return _rates(found, "dims")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose expected ids lie near the query's id, or outside the corpus."""
    q = _corpus(spark, d).where(F.col("vec_id") % EVERY == 0)
    near = F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 40)
    absent = F.sequence(F.lit(10**9).cast("bigint"), F.lit(10**9 + 1).cast("bigint"))
    return q.select(
        F.col("vec_id").alias("case_id"),
        F.when(F.col("label") % 2 == 0, "en").otherwise("vi").alias("language"),
        F.concat(F.lit("label "), F.col("label")).alias("category"),
        F.when(F.col("label") == 3, absent).otherwise(near).alias("expected_qids"),
        F.lit(5).alias("top_k"),
    )


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    ranked = _hits(spark, d).select(F.col("query_id").alias("case_id"), "rank", F.col("id").alias("qid"))
    return evaluate.case_outcomes(_cases(spark, d), ranked, _corpus(spark, d).select(F.col("vec_id").alias("qid")))


def _rounded(df: DataFrame, *by: str) -> DataFrame:
    return df.select(
        *by, "cases", "covered_cases", *[F.round(c, 6).alias(c) for c in ("coverage_rate", "hit_at_1", "hit_at_5", "hit_at_10", "mrr")]
    )


def a10_covered_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.metrics(_outcomes(spark, d)))


def a11_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.status_counts(_outcomes(spark, d))


def a12_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.rollup(_outcomes(spark, d)), "grouping", "value")


def a29_case_report(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select(
        "case_id", "status", F.col("first_rank_in_k").cast("bigint").alias("first_relevant_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank")
    )


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, r``: the ten hits of each query in their order."""
    return _hits(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("r"))


def a13_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The overlap of the hits of each query and of the next one; both sides of a pair meet in one group."""
    sides = F.explode(F.array(
        F.struct(F.col("query_id").alias("a"), F.lit(0).alias("side")), F.struct((F.col("query_id") - EVERY).alias("a"), F.lit(1).alias("side"))
    ))
    both = (
        _lists(spark, d).select("r", sides.alias("s")).groupBy("s.a")
        .agg(*[F.first(F.when(F.col("s.side") == n, F.col("r")), ignorenulls=True).alias(c) for n, c in enumerate(("ra", "rb"))])
        .where("ra is not null and rb is not null")
    )
    return both.select("a", (F.col("a") + EVERY).alias("b"), F.round(evaluate.overlap_at(F.col("ra"), F.col("rb"), K), 6).alias("overlap"))


def a14_mean_overlap(spark: SparkSession, d: str) -> DataFrame:
    return a13_overlap(spark, d).agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.count("*").alias("pairs"))


def w09_rank_or_absent(spark: SparkSession, d: str) -> DataFrame:
    third = F.element_at("r", 3)
    return _lists(spark, d).where(F.size("r") >= 3).select(
        "query_id", evaluate.rank_or_absent(F.col("r"), third, 2).alias("in_two"), evaluate.rank_or_absent(F.col("r"), third, 5).alias("in_five")
    )


def prj13_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embed_results").where("embeddings is not null")
    return e.where(~vectors.is_finite(F.col("embeddings"))).select("vec_id", F.size("embeddings").cast("bigint").alias("components"))


def a27_storage(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    dims = _dims(c)
    s = benchstats.vector_storage(c.withColumn("norm", vectors.norm(F.col("embedding"))), "norm", dims)
    return s.select(F.round("min_norm", 6).alias("min_norm"), F.round("max_norm", 6).alias("max_norm"), "vector_bytes")


QUERIES = {
    f.__name__: f
    for f in (
        x03_topk_single, x04_rank_string_tiebreak, w01_topk_many, f06_normalize, f07_mrl_project, f08_dot_cosine, a08_hit_rates,
        b09_mrl_sweep, a10_covered_metrics, a11_status_counts, a12_rollup, a29_case_report, a13_overlap, a14_mean_overlap,
        w09_rank_or_absent, prj13_nonfinite, a27_storage,
    )
}

_V = "embedding::double[]"
_Q0 = f"(select {_V} from embeddings where vec_id = 0)"


def _hits_sql(v: str = _V, k: int = K) -> str:
    return (
        f"select a.vec_id as query_id, b.vec_id as id, b.label as hit_label, a.label, list_cosine_similarity(a.v, b.v) as score, "
        f"row_number() over (partition by a.vec_id order by list_cosine_similarity(a.v, b.v) desc, b.vec_id) as rank "
        f"from (select vec_id, label, {v} as v from embeddings where vec_id % {EVERY} = 0) a join (select vec_id, label, {v} as v from embeddings) b "
        f"on a.vec_id <> b.vec_id qualify rank <= {k}"
    )


_RATES = ", ".join(f"round(avg((coalesce(fr, 99) <= {k})::int), 6)::double as hit_at_{k}" for k in (1, 5, 10)) + ", round(avg(coalesce(1.0 / fr, 0)), 6)::double as mrr"


def _sweep_sql(n: int) -> str:
    return (
        f"select {n} as dims, count(*)::bigint as cases, {_RATES} from (select query_id, min(case when label = hit_label then rank end) as fr "
        f"from ({_hits_sql(f'(embedding::double[])[1:{n}]')}) group by query_id)"
    )


_OUTCOMES = f"""
hits as ({_hits_sql()}),
cases as (select vec_id as case_id, case when label % 2 = 0 then 'en' else 'vi' end as language, 'label ' || label as category,
  case when label = 3 then [1000000000, 1000000001] else range(vec_id + 1, vec_id + 41) end as expected from embeddings where vec_id % {EVERY} = 0),
e as (select case_id, unnest(expected) as qid from cases),
cov as (select distinct case_id from e join embeddings on qid = vec_id),
f as (select e.case_id, min(rank) as fr, min(case when rank <= 5 then rank end) as frk from e join hits on query_id = e.case_id and id = e.qid group by e.case_id),
o as (select cases.*, cov.case_id is not null as covered, fr, frk,
  case when cov.case_id is null then 'DATASET_COVERAGE_MISSING' when frk is not null then 'QUALITY_PASS' else 'RETRIEVAL_MISS' end as status
  from cases left join cov using (case_id) left join f using (case_id))
"""
_METRICS = (
    "count(*)::bigint as cases, (count(*) filter (where covered))::bigint as covered_cases, round(avg(covered::int), 6)::double as coverage_rate, "
    + ", ".join(f"round(avg((coalesce(fr, 99) <= {k})::int) filter (where covered), 6)::double as hit_at_{k}" for k in (1, 5, 10))
    + ", round(avg(coalesce(1.0 / frk, 0)) filter (where covered), 6)::double as mrr"
)
_LISTS = f"hits as ({_hits_sql()}), l as (select query_id, list(id order by rank) as r from hits group by query_id)"
_OVERLAP = f"with {_LISTS} select a.query_id as a, b.query_id as b, round(len(list_intersect(a.r, b.r)) / {K}.0, 6)::double as overlap from l a join l b on b.query_id = a.query_id + {EVERY}"


def _norm_sql(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


SQL = {
    "x03_topk_single": f"select row_number() over (order by s desc, vec_id) as rank, vec_id, round(s, 6) as score from "
    f"(select vec_id, list_cosine_similarity({_V}, {_Q0}) as s from embeddings where vec_id <> 0 order by s desc, vec_id limit {K})",
    "x04_rank_string_tiebreak": f"select id, score, row_number() over (order by score desc, id) as rank from (select vec_id::varchar as id, "
    f"round(list_cosine_similarity({_V}, {_Q0}), 1) as score from embeddings order by score desc, id limit 50)",
    "w01_topk_many": f"select query_id, rank, id, round(score, 6) as score from ({_hits_sql()})",
    "f06_normalize": f"select vec_id, round(n, 6) as norm, round(v[1] / n, 6) as first, round({_norm_sql('list_transform(v, lambda y: y / n)')}, 6) as unit_norm "
    f"from (select vec_id, {_V} as v, {_norm_sql(_V)} as n from embeddings)",
    "f07_mrl_project": "select vec_id, " + ", ".join(f"round(v[1] / {_norm_sql(f'v[1:{n}]')}, 6) as first_{n}" for n in SWEEP) + f" from (select vec_id, {_V} as v from embeddings)",
    "f08_dot_cosine": f"select vec_id, round(list_dot_product({_V}, {_Q0}), 6) as dot, round(list_cosine_similarity({_V}, {_Q0}), 6) as cosine from embeddings",
    "a08_hit_rates": f"select label, count(*)::bigint as cases, {_RATES} from (select query_id, label, min(case when label = hit_label then rank end) as fr "
    f"from ({_hits_sql()}) group by query_id, label) group by label",
    "b09_mrl_sweep": " union all ".join(_sweep_sql(n) for n in SWEEP),
    "a10_covered_metrics": f"with {_OUTCOMES} select {_METRICS} from o",
    "a11_status_counts": f"with {_OUTCOMES} select " + ", ".join(f"(count(*) filter (where status = '{s}'))::bigint as {s.lower()}" for s in evaluate.STATUSES) + " from o",
    "a12_rollup": f"with {_OUTCOMES} select 'overall' as grouping, '' as value, {_METRICS} from o union all select 'language', language, {_METRICS} from o group by language "
    f"union all select 'category', category, {_METRICS} from o group by category",
    "a29_case_report": f"with {_OUTCOMES} select case_id, status, frk as first_relevant_rank, case when covered then round(coalesce(1.0 / frk, 0), 6)::double end as reciprocal_rank from o",
    "a13_overlap": _OVERLAP,
    "a14_mean_overlap": f"select round(avg(overlap), 6) as mean_overlap, count(*)::bigint as pairs from ({_OVERLAP})",
    "w09_rank_or_absent": f"with {_LISTS} select query_id, coalesce(nullif(list_position(r[1:2], r[3]), 0)::varchar, 'not in top 2') as in_two, "
    "coalesce(nullif(list_position(r[1:5], r[3]), 0)::varchar, 'not in top 5') as in_five from l",
    "prj13_nonfinite": "select vec_id, len(embeddings)::bigint as components from embed_results where embeddings is not null and "
    "len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) > 0",
    "a27_storage": f"select round(min(n), 6) as min_norm, round(max(n), 6) as max_norm, (count(*) * max(d) * 4)::bigint as vector_bytes from (select {_norm_sql(_V)} as n, len(embedding) as d from embeddings)",
}
