"""The vector index: one Parquet table of payload and unit vectors, with a metadata file beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text, vectors
from lexivec.operators import search
from lexivec.operators.embed import embedding
from lexivec.session import read_text, write_text

METADATA = "index-metadata.json"
CHECKED = ("model_fingerprint", "dimensions", "dataset_sha256", "row_count")


class IndexMismatch(ValueError):
    """The index is not the one that is expected."""


def build(records: DataFrame, path: str, embedder, model_fingerprint: str, dataset_sha256: str, dimensions: int) -> dict:
    """Embed the records' documents and write the index; an empty table is an error.

    One pass: text, vector and row are written by the same task, and the commit of the writer makes the
    table appear as a whole.  Vectors are stored at length 1, so queries need no norms.
    """
    texts = records.withColumn("canonical_document", text.index_text(F.col("document_en"), F.col("document_vi")))
    no_text = F.raise_error(F.lit("record without a document")).cast("string")
    checked = F.when(F.col("canonical_document").isNull(), no_text).otherwise(F.col("canonical_document"))
    raw = texts.withColumn("embedding", embedding(checked, embedder))
    fits = F.when(
        F.size("embedding") == dimensions, vectors.unit(F.col("embedding")).cast("array<float>")
    ).otherwise(F.raise_error(F.lit("embedding shape mismatch")).cast("array<float>"))
    raw.withColumn("embedding", fits).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    rows = records.sparkSession.read.parquet(f"{path}/vectors").count()
    if not rows:
        raise ValueError("cannot build an empty search index")
    meta = {
        "model_fingerprint": model_fingerprint,
        "dimensions": dimensions,
        "row_count": rows,
        "dataset_sha256": dataset_sha256,
    }
    write_text(f"{path}/{METADATA}", json.dumps(meta, sort_keys=True, indent=2))
    return meta


def load(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """The index's rows, once its metadata agree with ``expected`` and its rows are all there."""
    meta = json.loads(read_text(f"{path}/{METADATA}"))
    for key in CHECKED:
        if meta.get(key) != expected.get(key):
            raise IndexMismatch(f"{key}: {meta.get(key)!r} instead of {expected.get(key)!r}")
    rows = spark.read.parquet(f"{path}/vectors")
    if rows.count() != meta["row_count"]:
        raise IndexMismatch("row_count: the table has another number of rows")
    return rows


def answer(rows: DataFrame, query_text: str, embedder, instruction: str, k: int) -> DataFrame:
    """Embed one query behind the instruction and rank the rows; a language makes no difference."""
    model = embedder()
    vector = [float(x) for x in model.embed([instruction + query_text])[0]]
    query = F.array(*[F.lit(x) for x in vector])
    return search.top_k(rows, query, k, "qid", "embedding")
