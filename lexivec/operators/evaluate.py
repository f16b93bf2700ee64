"""Retrieval quality: relevance ranks, hit rates, reciprocal ranks, coverage, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("QUALITY_PASS", "DATASET_COVERAGE_MISSING", "RETRIEVAL_MISS")


def case_outcomes(cases: DataFrame, rankings: DataFrame, available: DataFrame) -> DataFrame:
    """One row for each case: covered or not, the first relevant rank, its status and reciprocal rank.

    ``cases``: case_id, expected_qids, top_k and any more columns; ``rankings``: case_id, rank, qid;
    ``available``: qid.  A case is covered if the corpus has one of its ids.  ``first_rank`` is over the whole ranking,
    ``first_rank_in_k`` within the case's top_k.
    """
    expected = cases.select("case_id", "top_k", F.explode(F.array_distinct("expected_qids")).alias("qid"))
    covered = expected.join(available.select("qid").distinct(), "qid", "left_semi").select("case_id").distinct()
    hits = (
        expected.join(rankings.select("case_id", "qid", "rank"), ["case_id", "qid"])
        .groupBy("case_id")
        .agg(F.min("rank").alias("first_rank"), F.min(F.when(F.col("rank") <= F.col("top_k"), F.col("rank"))).alias("first_rank_in_k"))
    )
    out = (
        cases.join(covered.withColumn("covered", F.lit(True)), "case_id", "left")
        .join(hits, "case_id", "left")
        .withColumn("covered", F.coalesce("covered", F.lit(False)))
    )
    status = F.when(~F.col("covered"), STATUSES[1]).when(F.col("first_rank_in_k").isNotNull(), STATUSES[0]).otherwise(STATUSES[2])
    return out.withColumn("status", status).withColumn(
        "reciprocal_rank", F.when(F.col("covered"), F.coalesce(1 / F.col("first_rank_in_k"), F.lit(0.0)))
    )


def hit_rate(k: int, rank: str = "first_rank") -> Column:
    """The share of rows whose first relevant rank is at most ``k``."""
    return F.avg((F.coalesce(F.col(rank), F.lit(2**31 - 1)) <= k).cast("double"))


def mean_reciprocal(rank: str = "first_rank") -> Column:
    return F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0)))


def metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """Cases, coverage, and hit@1/5/10 and MRR over covered cases alone (null where none is covered)."""
    covered = F.col("covered")

    def over(c: Column) -> Column:
        return F.avg(F.when(covered, c))

    def hit(k: int) -> Column:
        return over((F.coalesce(F.col("first_rank"), F.lit(2**31 - 1)) <= k).cast("double")).alias(f"hit_at_{k}")

    return outcomes.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(covered).alias("covered_cases"),
        F.avg(covered.cast("double")).alias("coverage_rate"),
        *[hit(k) for k in (1, 5, 10)],
        over(F.coalesce(1 / F.col("first_rank_in_k"), F.lit(0.0))).alias("mrr"),
    )


def rollup(outcomes: DataFrame) -> DataFrame:
    """The metrics overall, by language and by category, in one pass: ``grouping, value`` and the metrics."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("overall").alias("grouping"), F.lit("").alias("value")),
            F.struct(F.lit("language").alias("grouping"), F.col("language").alias("value")),
            F.struct(F.lit("category").alias("grouping"), F.col("category").alias("value")),
        )
    )
    return metrics(outcomes.withColumn("s", sides).select("*", "s.grouping", "s.value"), "grouping", "value")


def status_counts(outcomes: DataFrame) -> DataFrame:
    """One row with the number of cases of each status, zeros included."""
    return outcomes.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def overlap_at(a: Column, b: Column, k: int) -> Column:
    """Common entries of the first ``k`` of two rankings over ``k``, also where a ranking is shorter."""
    if k < 1:
        raise ValueError("k must be positive")
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / k


def rank_or_absent(ranking: Column, item: Column, k: int) -> Column:
    """The 1-based rank of an item within the first ``k``, else ``not in top k``."""
    at = F.array_position(F.slice(ranking, 1, k), item)
    return F.when(at > 0, at.cast("string")).otherwise(f"not in top {k}")
