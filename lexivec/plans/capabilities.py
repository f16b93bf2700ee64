"""Queries of model capabilities and benchmark cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import benchstats, capabilities, search
from lexivec.plans import searches
from lexivec.session import cut_lineage, table

K = 10
DIMS = 48
SHIFT, FAINT = 0.05, 0.05


def _asked(spark: SparkSession, d: str, changed) -> DataFrame:
    """Hits of the stated query set, each query's vector changed as another wording would change it."""
    c = searches._corpus(spark, d)
    q = c.where(F.col("vec_id") % searches.EVERY == 0).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), changed))
    return search.search_all(c, q, K, "vec_id", "embedding", searches._dims(c))


def _shifted(x):
    return x + SHIFT


def _without_faint(x):
    return F.when(F.abs(x) >= FAINT, x).otherwise(0.0)


def b10_instruction_ab(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the same cases by mode; without the instruction the query vectors are shifted."""
    plain, shifted = (
        h.select(F.col("query_id").alias("case_id"), "rank", F.col("id").alias("qid"))
        for h in (searches._hits(spark, d), _asked(spark, d, _shifted))
    )
    cases = searches._cases(spark, d)
    out = capabilities.instruction_ab(cases, plain, shifted, searches._corpus(spark, d).select(F.col("vec_id").alias("qid")))
    return searches._rounded(out, "mode")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each query in one language and in another, whose vector lacks the faint components."""
    en, vi = (
        h.select(F.col("query_id").alias("pair_id"), "rank", F.col("id").alias("qid"))
        for h in (searches._hits(spark, d), _asked(spark, d, _without_faint))
    )
    return capabilities.cross_lingual(en, vi, K)


def j09_cross_lingual(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(
        "pair_id", F.array_join("en_top", ",").alias("en_top"), F.array_join("vi_top", ",").alias("vi_top"), F.round("overlap", 6).alias("overlap")
    )


def b11_cross_lingual(spark: SparkSession, d: str) -> DataFrame:
    m = capabilities.mean_overlap(_pairs(spark, d))
    return m.select("pairs", F.round("mean_overlap", 6).alias("mean_overlap"))


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embed_results").where(F.size("embeddings") >= DIMS)
    cut = F.slice("embeddings", 1, DIMS)
    return e.select(F.col("vec_id").alias("id"), "qid", cut.alias("embedding")).where(F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(True))))


def b12_code_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one qid are each other's expected snippets; the stated query set asks."""
    s = _snippets(spark, d)
    fine, _ = capabilities.measured(s, "embedding")
    asked = fine.where(F.col("id") % searches.EVERY == 0)
    near = fine.select("qid", F.col("id").alias("hit"))
    hits = cut_lineage(search.search_all(fine, asked, 4 * K, "id", "embedding", DIMS))
    # only hits can be expected ones, so a qid of very many rows is not paired with itself
    expected = (
        hits.select("query_id", "id").join(near.select(F.col("hit").alias("id"), "qid"), "id")
        .join(asked.select(F.col("id").alias("query_id"), "qid"), ["query_id", "qid"]).select("query_id", "id")
    )
    r = capabilities.code_retrieval(s, asked, expected, DIMS, K, exclude_self=True, digits=6, hits=hits)
    return r.select(
        "query_count", "snippet_count_total", "snippet_count_finite", "snippet_count_excluded",
        *[F.round(f"hit_at_{n}", 6).alias(f"hit_at_{n}") for n in (1, 5, 10)],
    )


def b12_excluded(spark: SparkSession, d: str) -> DataFrame:
    return capabilities.measured(_snippets(spark, d), "embedding")[1].select("id")


def b14_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark cases with the tokens and items of all requests whose size they stand for."""
    sizes = (
        table(spark, d, "embed_results").where("request_id is not null").groupBy("request_id")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t"))
        .groupBy(F.when(F.col("n") >= 16, 16).when(F.col("n") >= 8, 8).when(F.col("n") >= 4, 4).otherwise(1).alias("items_per_request"))
        .agg(F.count("*").alias("real_requests"), F.sum("t").alias("real_tokens"))
    )
    m = benchstats.default_matrix(spark).join(sizes, "items_per_request", "left")
    return m.select(*[c for c in benchstats.CASE_COLUMNS], benchstats.per_worker_concurrency().alias("per_worker_concurrency"), "real_requests", "real_tokens")


QUERIES = {
    f.__name__: f for f in (b10_instruction_ab, j09_cross_lingual, b11_cross_lingual, b12_code_retrieval, b12_excluded, b14_matrix)
}


def _asked_sql(changed: str) -> str:
    """Hits of changed queries over the whole corpus."""
    return (
        "select a.vec_id as query_id, b.vec_id as id, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.v, b.v) desc, b.vec_id) as rank "
        f"from (select vec_id, list_transform(embedding::double[], lambda x: {changed}) as v from embeddings where vec_id % {searches.EVERY} = 0) a "
        f"join (select vec_id, embedding::double[] as v from embeddings) b on a.vec_id <> b.vec_id qualify rank <= {K}"
    )


_FAINT_SQL = _asked_sql(f"case when abs(x) >= {FAINT} then x else 0 end")
_PAIRS_SQL = f"""
with hits as ({searches._hits_sql()}), other as ({_FAINT_SQL}),
en as (select query_id as pair_id, list(id order by rank) as r from hits group by 1), vi as (select query_id as pair_id, list(id order by rank) as r from other group by 1)
select pair_id, array_to_string(en.r, ',') as en_top, array_to_string(vi.r, ',') as vi_top, round(len(list_intersect(en.r, vi.r)) / {K}.0, 6)::double as overlap
from en join vi using (pair_id)
"""
_SNIPPETS_SQL = f"""
s as (select vec_id as id, qid, embeddings[1:{DIMS}]::double[] as v from embed_results where len(embeddings) >= {DIMS}
  and len(list_filter(embeddings[1:{DIMS}], lambda x: x is null or x <> 0)) > 0),
f as (select * from s where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0)
"""

SQL = {
    "b10_instruction_ab": f"with {searches._OUTCOMES} select 'with_instruction' as mode, {searches._METRICS} from o union all "
    + "select * from (with " + searches._OUTCOMES.replace(searches._hits_sql(), _asked_sql(f"x + {SHIFT}"))
    + f" select 'without_instruction' as mode, {searches._METRICS} from o)",
    "j09_cross_lingual": _PAIRS_SQL,
    "b11_cross_lingual": f"select count(*)::bigint as pairs, round(avg(overlap), 6) as mean_overlap from ({_PAIRS_SQL})",
    "b12_code_retrieval": f"""
with {_SNIPPETS_SQL},
h as (select a.id as query_id, b.id, a.qid is not null and a.qid = b.qid as good, row_number() over (partition by a.id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.id) as rank
  from f a join f b on a.id % {searches.EVERY} = 0 and a.id <> b.id qualify rank <= {K}),
q as (select f.id, min(case when good then rank end) as fr from f left join h on f.id = h.query_id where f.id % {searches.EVERY} = 0 group by f.id)
select count(*)::bigint as query_count, (select count(*) from s)::bigint as snippet_count_total, (select count(*) from f)::bigint as snippet_count_finite,
  ((select count(*) from s) - (select count(*) from f))::bigint as snippet_count_excluded, """
    + ", ".join(f"round(avg((coalesce(fr, 99) <= {n})::int), 6)::double as hit_at_{n}" for n in (1, 5, 10)) + " from q",
    "b12_excluded": f"with {_SNIPPETS_SQL} select id from s where id not in (select id from f)",
    "b14_matrix": "with r as (select request_id, count(*) as n, coalesce(sum(token_count), 0) as t from embed_results where request_id is not null group by 1), "
    "z as (select case when n >= 16 then 16 when n >= 8 then 8 when n >= 4 then 4 else 1 end as items_per_request, count(*)::bigint as real_requests, sum(t)::bigint as real_tokens from r group by 1) "
    "select case_id, worker_count, concurrency, m.items_per_request, dimensions, requests, concurrency / worker_count as per_worker_concurrency, real_requests, real_tokens from (values "
    + ", ".join(str(c) for c in benchstats.DEFAULT_MATRIX)
    + ") m(case_id, worker_count, concurrency, items_per_request, dimensions, requests) left join z using (items_per_request)",
}
