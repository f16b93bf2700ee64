"""The interface as plain functions over DataFrames, for any web layer to call."""

from __future__ import annotations

import hmac
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text, vectors
from lexivec.operators import requests, search
from lexivec.operators.embed import embedding
from lexivec.settings import Settings
from lexivec.sources import index as index_table

PROTECTED = ("/v1/embeddings", "/v1/search", "/metrics", "/info")


def authorized(path: str, header: str | None, settings: Settings) -> bool:
    """Protected paths need the key; without a key everything is open."""
    if settings.api_key is None or path not in PROTECTED:
        return True
    prefix = "Bearer "
    given = header[len(prefix) :] if header and header.startswith(prefix) else ""
    return hmac.compare_digest(given.encode(), settings.api_key.encode())


class BadRequest(ValueError):
    def __init__(self, status: int, what: str):
        super().__init__(what)
        self.status = status


@dataclass
class Service:
    spark: SparkSession
    settings: Settings
    embedder: object
    model_fingerprint: str
    rows: DataFrame | None = None

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        return {"ready": self.rows is not None}

    def info(self) -> dict:
        return {
            "model_fingerprint": self.model_fingerprint,
            "dimensions": self.settings.embedding_dimensions,
            "worker_count": self.settings.worker_count,
        }

    def embed_requests(self, items: DataFrame, dimensions: int, is_query: bool = False) -> DataFrame:
        """``request_id, status, body``: items are ``request_id, item_index, text``; many requests at once."""
        status = requests.validate(items, "request_id", "item_index", "text")
        good = items.join(status.where("status = 200").select("request_id"), "request_id")
        clean = text.instructed(text.normalized(F.col("text")), F.lit(is_query), self.settings.query_instruction)
        vec = good.withColumn("t", clean).withColumn("v", embedding(F.col("t"), self.embedder))
        cut = vec.withColumn("e", vectors.project(F.col("v"), dimensions)).withColumn("n", text.estimated_tokens(F.col("t")))
        bodies = requests.embedding_answers(cut, "request_id", "item_index", "e", "n")
        return status.join(bodies, "request_id", "left").select("request_id", "status", "body")

    def search(self, query: str, k: int = 10, language: str | None = None) -> DataFrame:
        """Ranked rows; the language is checked but makes no difference."""
        if self.rows is None:
            raise BadRequest(503, "no index is loaded")
        if not query.strip() or not requests.TOP_K[0] <= k <= requests.TOP_K[1] or language not in (None, *requests.LANGUAGES):
            raise BadRequest(422, "bad search request")
        return index_table.answer(self.rows, query, self.embedder, self.settings.query_instruction, k)

    def similar(self, queries: DataFrame, k: int, dims: int) -> DataFrame:
        """Exact search for many vectors at once."""
        if self.rows is None:
            raise BadRequest(503, "no index is loaded")
        return search.search_all(self.rows, queries, k, "qid", "embedding", dims)
