"""Queries of benchmark statistics, batching, requests and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors
from lexivec.operators import batching, benchstats, embed, requests
from lexivec.session import table
from lexivec.sources import index



def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Cases made of the events: users spread over workers and concurrencies."""
    e = _events(spark, d).select(
        (F.pmod("user_id", F.lit(2)) + 1).cast("int").alias("worker_count"),
        F.pmod("user_id", F.lit(5)).cast("int").alias("level"),
        "event_type", "value",
    )
    p95 = F.percentile("value", F.lit(0.95))
    return e.groupBy("worker_count", "level", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("throughput_items_per_second"), F.round(p95, 6).alias("p95")
    ).select(
        F.concat_ws("-", "event_type", "worker_count", "level").alias("case_id"), "worker_count",
        ((F.col("level") + 1) * F.col("worker_count")).cast("int").alias("concurrency"),
        F.char_length("event_type").alias("items_per_request"), F.lit(1024).alias("dimensions"), F.lit(64).alias("requests"),
        F.when(F.col("level") == 4, 1).otherwise(0).alias("errors"), F.lit(None).cast("int").alias("rejected_429"),
        "throughput_items_per_second", F.struct(F.col("p95").alias("p95")).alias("latency_ms"),
    )


def a15_latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return benchstats.latency_report(_events(spark, d), "event_type", "value")


def a16_throughput(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("event_type").agg(
        F.count("*").alias("n"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("elapsed")
    )
    return e.select("event_type", benchstats.throughput(F.col("n"), F.col("elapsed")).alias("per_second"))


def a17_best_stable(spark: SparkSession, d: str) -> DataFrame:
    best = benchstats.best_stable(_results(spark, d), "concurrency")
    return best.select("worker_count", "case_id", F.round("throughput_items_per_second", 3).alias("throughput"))


def w02_flattening(spark: SparkSession, d: str) -> DataFrame:
    f = benchstats.flattening(_results(spark, d))
    return f.select("lower_case_id", "higher_case_id", F.round("throughput_gain_fraction", 4).alias("gain"), "p95_latency_increase_ms")


def j06_matched_scaling(spark: SparkSession, d: str) -> DataFrame:
    m = benchstats.matched_scaling(_results(spark, d))
    return m.select("single_case_id", "dual_case_id", "per_worker_concurrency", F.round("throughput_ratio", 4).alias("ratio"))


_EXECUTED = [(4096, "PASS", 1.5), (8192, "OOM", None)]


def _plan(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    targets = spark.createDataFrame([(t,) for t in benchstats.TARGETS], "target_tokens int")
    return targets, spark.createDataFrame(_EXECUTED, "target_tokens int, status string, latency_seconds double")


def w03_final_results(spark: SparkSession, d: str) -> DataFrame:
    return benchstats.final_results(*_plan(spark))


def w04_remaining_targets(spark: SparkSession, d: str) -> DataFrame:
    targets, executed = _plan(spark)
    return benchstats.remaining_targets(targets, executed.where("status = 'PASS'"), "target_tokens")


def _event_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The targets, of which the first three were executed, with results made of all events."""
    targets, _ = _plan(spark)
    lot = F.pmod("user_id", F.lit(5)).cast("int")
    target = F.get(F.array(*[F.lit(t) for t in benchstats.TARGETS]), lot)
    executed = _events(spark, d).where(lot < 3).groupBy(target.alias("target_tokens")).agg(
        F.when(F.count("*") % 2 == 0, "PASS").otherwise("OOM").alias("status"), F.round(F.avg("value"), 6).alias("latency_seconds")
    )
    return targets, executed


def w03_event_results(spark: SparkSession, d: str) -> DataFrame:
    return benchstats.final_results(*_event_plan(spark, d))


def w04_event_targets(spark: SparkSession, d: str) -> DataFrame:
    return benchstats.remaining_targets(*_event_plan(spark, d), "target_tokens")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(
        F.pmod("user_id", F.lit(4)).alias("worker_id"), F.lit(1).cast("bigint").alias("items"), F.col("value").alias("latency"),
        (F.col("value") / 10).alias("queue_wait"), F.col("event_id").alias("max_allocated_bytes"), (F.col("event_id") + 1).alias("max_reserved_bytes"),
    )


def a19_worker_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = benchstats.worker_metrics(_batches(spark, d))
    return m.select("worker_id", "batches", "items", F.round("average_latency", 6).alias("average_latency"),
                    F.round("average_queue_wait", 6).alias("average_queue_wait"), "max_allocated_bytes", "max_reserved_bytes")


def a19_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = benchstats.snapshot(_batches(spark, d))
    return s.select("batches", "items", "average_batch_size", F.round("average_embedding_latency_seconds", 6).alias("latency"),
                    F.round("average_queue_wait_seconds", 6).alias("queue_wait"))


def a28_status_tally(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "embed_results").select(
        F.when(F.col("embeddings").isNull(), 422).when(vectors.is_finite(F.col("embeddings")), 200).otherwise(500).alias("status"),
        F.coalesce(~vectors.is_finite(F.col("embeddings")), F.lit(False)).alias("non_finite"),
    )
    return benchstats.status_tally(r)


def a26_token_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embed_results").groupBy("model_fingerprint").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")
    )


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One row for each item of a request; of repeated deliveries the first vector id stands."""
    e = table(spark, d, "embed_results").where("request_id is not null and item_index is not null")
    return e.groupBy("request_id", "item_index").agg(F.min_by(F.coalesce("token_count", F.lit(1)), "vec_id").alias("tokens"))


def b01_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    b = batching.micro_batches(_items(spark, d), "request_id", "item_index", "tokens", 4, 256)
    return b.select("request_id", "item_index", "tokens", F.col("batch").cast("bigint").alias("batch"))


def a25_batch_costs(spark: SparkSession, d: str) -> DataFrame:
    b = batching.micro_batches(_items(spark, d), "request_id", "item_index", "tokens", 4, 256)
    costs = batching.batch_costs(b, "request_id", "tokens")
    return costs.groupBy("items").agg(F.count("*").alias("batches"), F.sum("cost").alias("cost"))


def b02_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Which items of each request a queue of 200 tokens admits."""
    o = _items(spark, d).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "tokens"))).alias("x"))
    a = o.withColumn("a", batching.admissions(F.transform("x", lambda s: s["tokens"]), 200))
    return a.select("request_id", F.size("x").cast("bigint").alias("items"), F.size(F.filter("a", lambda v: v)).cast("bigint").alias("admitted"))


def b05_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = batching.chunks(_items(spark, d), "request_id", "item_index", 3)
    return c.groupBy("request_id", F.col("chunk").cast("bigint").alias("chunk")).agg(F.count("*").alias("n"))


def b03_placements(spark: SparkSession, d: str) -> DataFrame:
    o = _items(spark, d).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "tokens"))).alias("x"))
    return o.select("request_id", F.array_join(batching.placements(F.transform("x", lambda s: s["tokens"]), 2), ",").alias("workers"))


def k13_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of all requests whose vectors are finite, as JSON."""
    e = table(spark, d, "embed_results").where("request_id is not null and embeddings is not null").where(vectors.is_finite(F.col("embeddings")))
    return requests.embedding_answers(e, "request_id", "item_index", "embeddings", "token_count")


def f09_last_token(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, [[1.0], [2.0], [3.0]], [0, 1, 1], True), (2, [[1.0], [2.0], [3.0]], [1, 1, 0], False)]
    h = spark.createDataFrame(rows, "id int, hidden array<array<double>>, mask array<int>, all_end boolean")
    return h.select("id", F.get(vectors.last_token(F.col("hidden"), F.col("mask"), F.col("all_end")), F.lit(0)).alias("first"))


def f09_last_token_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pooling of all vectors of requests, their components taken as hidden states; a request is a batch.

    Requests are padded on the left or on the right.
    """
    e = table(spark, d, "embed_results").where("request_id is not null and size(embeddings) > 0").select(
        "vec_id", "request_id", F.transform("embeddings", lambda x: F.array(x.cast("double"))).alias("hidden"),
        (F.pmod(F.coalesce("token_count", F.lit(1)), F.size("embeddings")) + 1).cast("int").alias("n"),
        (F.md5(F.col("request_id").cast("string")) < "8").alias("left"),
    )
    ones, zeros = F.array_repeat(F.lit(1), F.col("n")), F.array_repeat(F.lit(0), F.size("hidden") - F.col("n"))
    e = e.withColumn("mask", F.when(F.col("left"), F.concat(zeros, ones)).otherwise(F.concat(ones, zeros)))
    ends = F.min(F.element_at("mask", -1)).over(Window.partitionBy("request_id")) == 1
    h = e.withColumn("all_end", ends)
    return h.select("vec_id", F.get(vectors.last_token(F.col("hidden"), F.col("mask"), F.col("all_end")), F.lit(0)).alias("first"))


def b08_search(spark: SparkSession, d: str) -> DataFrame:
    """Embed all index texts with the stand-in and find the ten nearest of one question."""
    from lexivec.functions import text
    from lexivec.operators import records

    raw = table(spark, d, "canonical_records").select("qid", *records.SCALARS, *records.ARRAYS, "instance_of_qids")
    good = records.accepted(records.canonicalize(raw))
    t = good.select("qid", text.index_text(F.col("document_en"), F.col("document_vi")).alias("t"))
    vec = t.withColumn("embedding", embed.embedding(F.col("t"), embed.HashingEmbedder))
    hits = index.answer(vec, "river near the old bridge", embed.HashingEmbedder, "", 10)
    return hits.select("rank", "qid", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        a15_latency_summary, a16_throughput, a17_best_stable, w02_flattening, j06_matched_scaling, w03_final_results,
        w04_remaining_targets, a19_worker_metrics, a19_snapshot, a28_status_tally, a26_token_usage, b01_micro_batches,
        a25_batch_costs, b02_admissions, b03_placements, b05_chunks, k13_answers, f09_last_token, f09_last_token_pool, b08_search,
        w03_event_results, w04_event_targets,
    )
}

_RESULTS = """
res as (select event_type || '-' || w || '-' || l as case_id, w as worker_count, ((l + 1) * w)::int as concurrency, length(event_type)::int as items_per_request,
  case when l = 4 then 1 else 0 end as errors, t, p95 from (
  select event_type, (user_id % 2 + 1)::int as w, (user_id % 5)::int as l, round(sum(value), 4) as t, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1, 2, 3))
"""
_ITEMS = """
items as (select request_id, item_index, arg_min(coalesce(token_count, 1), vec_id) as tokens from embed_results
  where request_id is not null and item_index is not null group by 1, 2),
seq as (select *, row_number() over (partition by request_id order by item_index) as pos from items)
"""
_FOLD = f"""
{_ITEMS},
fold as (
  select request_id, item_index, tokens, pos, 1 as n, greatest(1, tokens) as top, 0 as batch from seq where pos = 1
  union all
  select s.request_id, s.item_index, s.tokens, s.pos,
    case when fresh then 1 else f.n + 1 end, case when fresh then greatest(1, s.tokens) else greatest(f.top, s.tokens) end, case when fresh then f.batch + 1 else f.batch end
  from fold f join seq s on s.request_id = f.request_id and s.pos = f.pos + 1,
    lateral (select f.n >= 4 or f.n * f.top >= 256 or f.n + 1 > 4 or (f.n + 1) * greatest(f.top, s.tokens) > 256 as fresh) x
)
"""
_EXECUTED_SQL = """
t as (select unnest([4096, 8192, 16384, 24576, 32768]) as target_tokens),
ex as (select [4096, 8192, 16384][(user_id % 5 + 1)::int] as target_tokens, case when count(*) % 2 = 0 then 'PASS' else 'OOM' end as status,
  round(avg(value), 6) as latency_seconds from events where user_id % 5 < 3 group by 1)
"""
_BATCHES = "b as (select user_id % 4 as worker_id, value, event_id from events)"
_FINITE = "len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0"

SQL = {
    "a15_latency_summary": "select event_type, " + ", ".join(
        f"round({e}, 3) as {n}_ms" for n, e in (("min", "min(value * 1000.0)"), ("p50", "quantile_cont(value * 1000.0, 0.5)"),
        ("p95", "quantile_cont(value * 1000.0, 0.95)"), ("p99", "quantile_cont(value * 1000.0, 0.99)"), ("max", "max(value * 1000.0)"))
    ) + " from events group by event_type",
    "a16_throughput": "select event_type, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) as per_second from events group by event_type",
    "a17_best_stable": f"with {_RESULTS} select worker_count, case_id, round(t, 3) as throughput from res where errors = 0 "
    "qualify row_number() over (partition by worker_count order by t desc, concurrency) = 1",
    "w02_flattening": f"with {_RESULTS}, p as (select lag(case_id) over w as lower_case_id, case_id as higher_case_id, "
    "case when lag(t) over w > 0 then (t - lag(t) over w) / lag(t) over w else 0 end as gain, p95 - lag(p95) over w as rise from res where errors = 0 "
    "window w as (partition by worker_count, items_per_request order by concurrency, case_id)) "
    "select lower_case_id, higher_case_id, round(gain, 4) as gain, round(rise, 3) as p95_latency_increase_ms from p where lower_case_id is not null and gain < 0.05 and rise > 0",
    "j06_matched_scaling": f"with {_RESULTS}, s as (select *, concurrency / worker_count as pwc from res where errors = 0) "
    "select a.case_id as single_case_id, b.case_id as dual_case_id, a.pwc as per_worker_concurrency, round(b.t / a.t, 4) as ratio from s a join s b "
    "on a.worker_count = 1 and b.worker_count = 2 and a.items_per_request = b.items_per_request and a.pwc = b.pwc where a.t > 0",
    "w03_final_results": "select * from (values (4096, 1.5, 'PASS', null::int), (8192, null, 'OOM', null), (16384, null, 'NOT_RUN_AFTER_OOM', 8192), "
    "(24576, null, 'NOT_RUN_AFTER_OOM', 8192), (32768, null, 'NOT_RUN_AFTER_OOM', 8192)) t(target_tokens, latency_seconds, status, blocked_by_target_tokens)",
    "w04_remaining_targets": "select * from (values (8192), (16384), (24576), (32768)) t(target_tokens)",
    "a19_worker_metrics": f"with {_BATCHES} select worker_id, count(*)::bigint as batches, count(*)::bigint as items, round(avg(value), 6) as average_latency, "
    "round(avg(value / 10), 6) as average_queue_wait, max(event_id) as max_allocated_bytes, max(event_id) + 1 as max_reserved_bytes from b group by worker_id",
    "a19_snapshot": f"with {_BATCHES} select count(*)::bigint as batches, count(*)::bigint as items, 1.0::double as average_batch_size, round(avg(value), 6) as latency, round(avg(value / 10), 6) as queue_wait from b",
    "a28_status_tally": f"select (count(*) filter (where embeddings is not null and {_FINITE}))::bigint as ok, 0::bigint as server_errors, "
    f"(count(*) filter (where embeddings is not null and not {_FINITE}))::bigint as non_finite, (count(*) filter (where embeddings is null))::bigint as other from embed_results",
    "a26_token_usage": "select model_fingerprint, count(*)::bigint as items, coalesce(sum(token_count), 0)::bigint as tokens from embed_results group by 1",
    "b01_micro_batches": f"with recursive {_FOLD} select request_id, item_index, tokens, batch::bigint as batch from fold",
    "a25_batch_costs": f"with recursive {_FOLD}, c as (select request_id, batch, count(*) as items, count(*) * max(greatest(1, tokens)) as cost from fold group by 1, 2) "
    "select items, count(*)::bigint as batches, sum(cost)::bigint as cost from c group by items",
    "b02_admissions": f"with recursive {_ITEMS}, fold as (select request_id, pos, case when tokens <= 200 then tokens else 0 end as used, (tokens <= 200)::int as ok from seq where pos = 1 "
    "union all select s.request_id, s.pos, case when f.used + s.tokens <= 200 then f.used + s.tokens else f.used end, (f.used + s.tokens <= 200)::int "
    "from fold f join seq s on s.request_id = f.request_id and s.pos = f.pos + 1) "
    "select request_id, count(*)::bigint as items, sum(ok)::bigint as admitted from fold group by request_id",
    "b03_placements": f"with recursive {_ITEMS}, fold as (select request_id, pos, tokens as l0, 0::bigint as l1, 0 as w from seq where pos = 1 "
    "union all select s.request_id, s.pos, case when f.l0 <= f.l1 then f.l0 + s.tokens else f.l0 end, case when f.l0 <= f.l1 then f.l1 else f.l1 + s.tokens end, "
    "case when f.l0 <= f.l1 then 0 else 1 end from fold f join seq s on s.request_id = f.request_id and s.pos = f.pos + 1) "
    "select request_id, string_agg(w::varchar, ',' order by pos) as workers from fold group by request_id",
    "b05_chunks": f"with {_ITEMS} select request_id, (pos - 1) // 3 as chunk, count(*)::bigint as n from seq group by 1, 2",
    "w03_event_results": f"with {_EXECUTED_SQL}, j as (select target_tokens, latency_seconds, status, min(case when status <> 'PASS' then target_tokens end) over "
    "(order by target_tokens rows between unbounded preceding and 1 preceding) as b from t left join ex using (target_tokens)) "
    "select target_tokens, latency_seconds, coalesce(status, 'NOT_RUN_AFTER_OOM') as status, (case when status is null then b end)::int as blocked_by_target_tokens "
    "from j where status is not null or b is not null",
    "w04_event_targets": f"with {_EXECUTED_SQL} select target_tokens from t where coalesce((select arg_max(status, target_tokens) from ex), 'PASS') = 'PASS' "
    "and target_tokens > coalesce((select max(target_tokens) from ex), 0)",
    "f09_last_token_pool": "with e as (select vec_id, request_id, embeddings, len(embeddings) as l, coalesce(token_count, 1) % len(embeddings) + 1 as n, md5(request_id::varchar) < '8' as le "
    "from embed_results where request_id is not null and len(embeddings) > 0), b as (select *, min((le or n = l)::int) over (partition by request_id) = 1 as all_end from e) "
    "select vec_id, embeddings[(case when all_end then l else n end)::int]::double as first from b",
    "f09_last_token": "select * from (values (1, 3.0::double), (2, 2.0::double)) t(id, first)",
}
