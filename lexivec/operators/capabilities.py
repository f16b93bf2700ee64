"""What a model can do: instruction modes, queries in two languages, code retrieval with measured exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import vectors
from lexivec.operators import evaluate, search

WITH, WITHOUT = "with_instruction", "without_instruction"


def instruction_ab(cases: DataFrame, with_rankings: DataFrame, without_rankings: DataFrame, available: DataFrame) -> DataFrame:
    """``mode`` and the retrieval metrics of the same cases, asked with and without the instruction prefix.

    ``cases``, rankings and ``available`` as for ``evaluate.case_outcomes``.  A mode without any ranking has a row of zeros;
    no cases give no rows.
    """
    modes = F.explode(F.array(F.lit(WITH), F.lit(WITHOUT)))
    both = with_rankings.select(F.lit(WITH).alias("mode"), "case_id", "rank", "qid").unionByName(
        without_rankings.select(F.lit(WITHOUT).alias("mode"), "case_id", "rank", "qid")
    )
    # a case of a mode is a case of its own
    key = F.struct("mode", "case_id").alias("case_id")
    asked = cases.withColumn("mode", modes).withColumn("case_id", key)
    out = evaluate.case_outcomes(asked, both.select(key, "rank", "qid"), available)
    return evaluate.metrics(out, "mode")


def cross_lingual(english: DataFrame, vietnamese: DataFrame, k: int = 10) -> DataFrame:
    """``pair_id, en_top, vi_top, overlap``: the first ``k`` hits of a pair's two queries and the share they have in common.

    ``english`` and ``vietnamese``: pair_id, rank, qid.  Hits without an id do not count; a pair that has hits in one
    language alone has an empty list and no overlap in the other; both lists meet in one group of at most ``2 * k`` rows.
    """
    sides = english.select("pair_id", "rank", "qid", F.lit("en").alias("side")).unionByName(
        vietnamese.select("pair_id", "rank", "qid", F.lit("vi").alias("side"))
    )
    kept = sides.where((F.col("rank") <= k) & F.col("qid").isNotNull())

    def top(side: str):
        hits = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "qid"))))
        return F.transform(hits, lambda h: h["qid"]).alias(f"{side}_top")

    lists = kept.groupBy("pair_id").agg(top("en"), top("vi"))
    return lists.withColumn("overlap", evaluate.overlap_at(F.col("en_top"), F.col("vi_top"), k))


def mean_overlap(pairs: DataFrame) -> DataFrame:
    """One row: the number of pairs and their mean overlap, null where there are none."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg("overlap").alias("mean_overlap"))


def measured(snippets: DataFrame, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """The snippets whose vector is there and finite, and those that are excluded from the metrics and listed."""
    fine = F.coalesce(vectors.is_finite(F.col(vec_col)), F.lit(False))
    return snippets.where(fine), snippets.where(~fine)


def code_retrieval(
    snippets: DataFrame, queries: DataFrame, expected: DataFrame, dims: int, k: int = 10,
    id_col: str = "id", vec_col: str = "embedding", exclude_self: bool = False, digits: int | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """One row: queries, snippets in all, finite and excluded ones, and hit@1/5/10 over the finite snippets.

    ``snippets`` and ``queries``: id_col, vec_col; ``expected``: query_id, id.  A query without an expected id among its
    hits is a miss.  ``hits`` are those of an earlier search, if there are any.  Scores are rounded to ``digits`` before they are ranked where that is given.  Empty tables
    give zero counts and null rates.
    """
    fine, excluded = measured(snippets, vec_col)
    # more than k, as rounding may join scores at the edge
    if hits is None:
        hits = search.search_all(fine, queries, 4 * k, id_col, vec_col, dims, exclude_self)
    hits = hits.drop("rank")
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    ranked = search.rank_hits(hits, "query_id", "id", k)
    first = (
        ranked.join(expected.select("query_id", "id").distinct(), ["query_id", "id"])
        .groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    )
    asked = queries.select(F.col(id_col).alias("query_id")).join(first, "query_id", "left")
    rates = asked.agg(F.count("*").alias("query_count"), *[evaluate.hit_rate(n).alias(f"hit_at_{n}") for n in (1, 5, 10)])
    counts = snippets.select(F.count("*").alias("snippet_count_total")).crossJoin(
        F.broadcast(excluded.select(F.count("*").alias("snippet_count_excluded")))  # one row each
    )
    return (
        counts.crossJoin(F.broadcast(rates))
        .withColumn("snippet_count_finite", F.col("snippet_count_total") - F.col("snippet_count_excluded"))
    )
