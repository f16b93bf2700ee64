"""Benchmark summaries: latency, throughput, scaling, flattening, long-context plans, worker metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.operators import records
from lexivec.session import write_text

TARGETS = (4096, 8192, 16384, 24576, 32768)
NOT_RUN = "NOT_RUN_AFTER_OOM"
SHAPE = ("items_per_request", "dimensions", "requests", "per_worker_concurrency")

CASE_COLUMNS = ("case_id", "worker_count", "concurrency", "items_per_request", "dimensions", "requests")
CASE_SCHEMA = "case_id string, worker_count int, concurrency int, items_per_request int, dimensions int, requests int"

# The curated benchmark cases, in the order of CASE_COLUMNS.
DEFAULT_MATRIX = (
    ("s1-c1-i1-d1024", 1, 1, 1, 1024, 16),
    ("s1-c2-i8-d1024", 1, 2, 8, 1024, 16),
    ("s1-c4-i16-d1024", 1, 4, 16, 1024, 16),
    ("s1-c2-i8-d4096", 1, 2, 8, 4096, 12),
    ("s1-c4-i4-d4096", 1, 4, 4, 4096, 12),
    ("d2-c2-i1-d1024", 2, 2, 1, 1024, 16),
    ("d2-c4-i8-d1024", 2, 4, 8, 1024, 16),
    ("d2-c8-i8-d1024", 2, 8, 8, 1024, 24),
    ("d2-c8-i16-d1024", 2, 8, 16, 1024, 16),
    ("d2-c4-i8-d4096", 2, 4, 8, 4096, 12),
    ("d2-c8-i4-d4096", 2, 8, 4, 4096, 12),
    ("d2-c16-i4-d1024", 2, 16, 4, 1024, 24),
)


def default_matrix(spark: SparkSession) -> DataFrame:
    """The benchmark cases as a table."""
    return spark.createDataFrame(DEFAULT_MATRIX, CASE_SCHEMA)


def per_worker_concurrency() -> Column:
    return F.col("concurrency") / F.col("worker_count")


def write_result(result: dict, path: str) -> int:
    """Write a benchmark's result as JSON; the exit status is 1 where requests failed."""
    write_text(path, json.dumps(result, indent=2, sort_keys=True) + "\n")
    return 1 if result.get("errors") else 0


def latency_summary(seconds: str) -> list[Column]:
    """min, p50, p95, p99 and max in milliseconds; exact percentiles, interpolated linearly."""
    ms = F.col(seconds) * 1000.0
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [
        F.round(F.min(ms), 3).alias("min_ms"),
        F.round(F.get(p, F.lit(0)), 3).alias("p50_ms"),
        F.round(F.get(p, F.lit(1)), 3).alias("p95_ms"),
        F.round(F.get(p, F.lit(2)), 3).alias("p99_ms"),
        F.round(F.max(ms), 3).alias("max_ms"),
    ]


def latency_report(df: DataFrame, by: str, seconds: str) -> DataFrame:
    """``latency_summary`` for each ``by``, for groups of any size: a range-partitioned sort, of which single ranks are read.

    No task holds a group's values.  Null seconds do not count; a null ``by`` is a group of its own; a group without
    values has no row.
    """
    rows = df.where(F.col(seconds).isNotNull()).select(F.col(by).alias("g"), (F.col(seconds) * 1000.0).alias("ms"))
    placed = records.numbered(rows, F.col("g"), F.col("ms"))
    groups = placed.groupBy("g").agg(
        F.min("position").alias("first"), (F.count("*") - 1).alias("last"), F.min("ms").alias("least"), F.max("ms").alias("most")
    )
    ranks = [F.struct(F.lit(f"p{round(p * 100)}_ms").alias("name"), (F.col("last") * p).alias("at")) for p in (0.5, 0.95, 0.99)]
    asked = groups.select("*", F.explode(F.array(*ranks)).alias("r")).select(
        "g", "least", "most", "r.name", (F.col("r.at") - F.floor("r.at")).alias("share"),
        F.posexplode(F.array(F.col("first") + F.floor("r.at"), F.col("first") + F.ceil("r.at"))).alias("side", "position"),
    )
    ends = asked.join(placed.select("position", "ms"), "position")
    values = ends.groupBy("g", "least", "most", "name", "share").agg(
        *[F.max(F.when(F.col("side") == s, F.col("ms"))).alias(n) for s, n in enumerate(("lo", "hi"))]
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")
    return values.groupBy("g", "least", "most").agg(
        *[F.round(F.max(F.when(F.col("name") == n, value)), 3).alias(n) for n in ("p50_ms", "p95_ms", "p99_ms")]
    ).select(F.col("g").alias(by), F.round("least", 3).alias("min_ms"), "p50_ms", "p95_ms", "p99_ms", F.round("most", 3).alias("max_ms"))


def throughput(count: Column, elapsed: Column) -> Column:
    """Per second; no or negative time is an error."""
    bad = F.raise_error(F.lit("elapsed must be positive")).cast("double")
    return F.when(elapsed > 0, F.round(count / elapsed, 6)).otherwise(bad)


def is_stable() -> Column:
    return (F.coalesce("errors", F.lit(0)) == 0) & (F.coalesce("rejected_429", F.lit(0)) == 0)


def best_stable(results: DataFrame, order: str) -> DataFrame:
    """For each number of workers the stable case of highest throughput; the first by ``order`` wins ties."""
    best = F.max_by(F.struct("case_id", "throughput_items_per_second"), F.struct("throughput_items_per_second", -F.col(order)))
    return results.where(is_stable()).groupBy("worker_count").agg(best.alias("b")).select("worker_count", "b.*")


def matched_scaling(results: DataFrame) -> DataFrame:
    """Pairs of a one-worker and a two-worker case of the same shape, with their throughput ratio."""
    shaped = results.where(is_stable()).withColumn("per_worker_concurrency", F.col("concurrency") / F.col("worker_count"))

    def side(workers: int, name: str) -> DataFrame:
        return shaped.where(F.col("worker_count") == workers).select(
            *SHAPE, F.col("case_id").alias(f"{name}_case_id"), F.col("throughput_items_per_second").alias(f"{name}_t")
        )

    both = side(1, "single").where("single_t > 0").join(side(2, "dual"), list(SHAPE))
    return both.select(
        "single_case_id", "dual_case_id", *SHAPE, F.round(F.col("dual_t") / F.col("single_t"), 6).alias("throughput_ratio")
    )


def flattening(results: DataFrame) -> DataFrame:
    """Neighbouring concurrencies where throughput gains less than 5 % while p95 latency rises."""
    w = Window.partitionBy("worker_count", "items_per_request", "dimensions").orderBy("concurrency", "case_id")
    low_t, low_p = F.lag("throughput_items_per_second").over(w), F.lag("latency_ms.p95").over(w)
    pairs = results.where(is_stable()).select(
        F.lag("case_id").over(w).alias("lower_case_id"),
        F.col("case_id").alias("higher_case_id"),
        F.when(low_t > 0, (F.col("throughput_items_per_second") - low_t) / low_t).otherwise(0.0).alias("gain"),
        (F.col("latency_ms.p95") - low_p).alias("rise"),
    )
    return pairs.where("lower_case_id is not null and gain < 0.05 and rise > 0").select(
        "lower_case_id",
        "higher_case_id",
        F.round("gain", 6).alias("throughput_gain_fraction"),
        F.round("rise", 3).alias("p95_latency_increase_ms"),
    )


def final_results(targets: DataFrame, executed: DataFrame) -> DataFrame:
    """Every configured target: as executed, or not run behind the first that failed.

    Targets that were neither executed nor blocked are left out.  ``targets``: target_tokens.
    """
    w = Window.orderBy("target_tokens").rowsBetween(Window.unboundedPreceding, -1)  # a handful of targets
    joined = targets.select("target_tokens").join(executed.withColumn("ran", F.lit(True)), "target_tokens", "left")
    blocker = F.first(F.when(F.col("ran") & (F.col("status") != "PASS"), F.col("target_tokens")), ignorenulls=True).over(w)
    out = joined.withColumn("blocker", blocker).where("ran or blocker is not null")
    return out.select(
        *[c for c in executed.columns if c != "status"],
        F.when(F.col("ran"), F.col("status")).otherwise(NOT_RUN).alias("status"),
        F.when(F.col("ran"), F.lit(None)).otherwise(F.col("blocker")).cast("int").alias("blocked_by_target_tokens"),
    )


def remaining_targets(targets: DataFrame, executed: DataFrame, order: str) -> DataFrame:
    """Targets still to run: those above all attempted, if the last attempt passed; all, if there was none."""
    state = executed.agg(
        F.max_by("status", order).alias("last"), F.coalesce(F.max("target_tokens"), F.lit(0)).alias("reached")
    )
    return (
        targets.select("target_tokens").crossJoin(F.broadcast(state))  # one row
        .where("(last is null or last = 'PASS') and target_tokens > reached")
        .select("target_tokens")
    )


def worker_metrics(batches: DataFrame) -> DataFrame:
    """Batches, items, averages and running peaks of each worker."""
    return batches.groupBy("worker_id").agg(
        F.count("*").alias("batches"),
        F.sum("items").alias("items"),
        F.avg("items").alias("average_batch_size"),
        F.avg("latency").alias("average_latency"),
        F.coalesce(F.avg("queue_wait"), F.lit(0.0)).alias("average_queue_wait"),
        F.max("max_allocated_bytes").alias("max_allocated_bytes"),
        F.max("max_reserved_bytes").alias("max_reserved_bytes"),
    )


def snapshot(batches: DataFrame) -> DataFrame:
    """One row over all workers; averages are 0 where there are no batches."""
    zero = F.lit(0.0)
    return batches.agg(
        F.count("*").alias("batches"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.try_divide(F.sum("items"), F.count("*")), zero).alias("average_batch_size"),
        F.coalesce(F.avg("latency"), zero).alias("average_embedding_latency_seconds"),
        F.coalesce(F.avg("queue_wait"), zero).alias("average_queue_wait_seconds"),
    )


def status_tally(responses: DataFrame) -> DataFrame:
    """One row: answers that were fine, server errors, non-finite vectors, others."""
    status = F.col("status")
    return responses.agg(
        F.count_if(status == 200).alias("ok"),
        F.count_if((status >= 500) & ~F.col("non_finite")).alias("server_errors"),
        F.count_if((status >= 500) & F.col("non_finite")).alias("non_finite"),
        F.count_if((status != 200) & (status < 500)).alias("other"),
    )


def vector_storage(vectors_: DataFrame, norm: str, dims: int) -> DataFrame:
    """Norms and the bytes of the vectors as single floats."""
    return vectors_.agg(
        F.min(norm).alias("min_norm"), F.max(norm).alias("max_norm"), (F.count("*") * dims * 4).alias("vector_bytes")
    )
