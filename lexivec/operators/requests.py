"""Requests and answers of the embedding and search interface, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text, vectors

MAX_ITEMS = 128
MAX_CHARACTERS = 32_768
MAX_BODY_BYTES = 2_000_000
DIMENSIONS = (32, 4096)
TOP_K = (1, 100)
LANGUAGES = ("en", "vi")


def body_status(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    """413 for a body over the limit, else null."""
    return F.when(F.octet_length(body) > limit, 413)


def item_status(c: Column, max_characters: int = MAX_CHARACTERS) -> Column:
    """413 for a text too long as it came, 422 for a bad or empty one, else null."""
    bad = c.isNull() | text.text_error(c).isNotNull() | (text.squeeze(c) == "")
    return F.when(F.char_length(c) > max_characters, 413).when(bad, 422)


def validate(items: DataFrame, request: str, index: str, column: str) -> DataFrame:
    """``request, status, items``: the status of each request; 200 if all its texts are fine.

    The number of items is checked first, then the texts in order: the first bad one decides.
    Items are reduced to one row a request with partial aggregation.
    """
    judged = items.select(request, index, item_status(F.col(column)).alias("s"))
    first = F.min_by("s", F.when(F.col("s").isNotNull(), F.col(index)))
    summed = judged.groupBy(request).agg(F.count(F.col(index)).alias("items"), first.alias("s"))
    status = F.when(F.col("items") == 0, 422).when(F.col("items") > MAX_ITEMS, 413).otherwise(F.coalesce("s", F.lit(200)))
    return summed.select(request, status.alias("status"), "items")


def search_status(query: Column, top_k: Column, language: Column) -> Column:
    """422 for an empty query, a top_k outside its bounds or an unknown language, else 200."""
    ok = (text.strip(query) != "") & top_k.between(*TOP_K) & (language.isNull() | language.isin(*LANGUAGES))
    return F.when(F.coalesce(ok, F.lit(False)), 200).otherwise(422)


def dimensions_status(dimensions: Column) -> Column:
    return F.when(F.coalesce(dimensions.between(*DIMENSIONS), F.lit(False)), 200).otherwise(422)


def non_finite(answers: DataFrame, request: str, index: str, vector: str) -> DataFrame:
    """``request, indexes, n``: vectors that hold what is no number.  Texts are never repeated."""
    bad = answers.where(~vectors.is_finite(F.col(vector)))
    return bad.groupBy(request).agg(F.array_sort(F.collect_list(index)).alias("indexes"), F.count("*").alias("n"))


def embedding_answers(answers: DataFrame, request: str, index: str, vector: str, tokens: str) -> DataFrame:
    """``request, body``: the JSON answer, vectors in the order of their items."""
    data = F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.lit("embedding").alias("object"), F.col(vector).alias("embedding"))))
    usage = F.struct(F.sum(tokens).alias("prompt_tokens"), F.sum(tokens).alias("total_tokens"))
    grouped = answers.groupBy(request).agg(data.alias("data"), usage.alias("usage"))
    return grouped.select(request, F.to_json(F.struct(F.lit("list").alias("object"), "data", "usage")).alias("body"))


def search_answers(hits: DataFrame, request: str) -> DataFrame:
    """``request, body``: the JSON answer, hits in the order of their ranks with all their columns."""
    columns = ["rank", *[c for c in hits.columns if c not in (request, "rank")]]
    data = F.array_sort(F.collect_list(F.struct(*columns)))
    return hits.groupBy(request).agg(F.to_json(F.struct(data.alias("data"))).alias("body"))
