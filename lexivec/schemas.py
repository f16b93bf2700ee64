"""Fixed schemas; nothing is inferred, so all-null columns keep their types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())

RAW_RECORD = T.StructType(
    [T.StructField(n, _S) for n in ("qid", "label_en", "label_vi", "description_en", "description_vi")]
    + [T.StructField(n, _A) for n in ("aliases_en", "aliases_vi", "instance_of_qids")]
)

CANONICAL_RECORD = T.StructType(
    [T.StructField("qid", _S, False)]
    + [T.StructField(n, _S) for n in ("label_en", "label_vi", "description_en", "description_vi")]
    + [T.StructField(n, _A) for n in ("aliases_en", "aliases_vi", "instance_of_qids")]
    + [T.StructField(n, _S) for n in ("source", "source_license", "document_en", "document_vi")]
    + [T.StructField("quality_flags", _A)]
)

_TERM = T.StructType([T.StructField("language", _S), T.StructField("value", _S)])
_SNAK = T.StructType(
    [
        T.StructField("snaktype", _S),
        T.StructField("datavalue", T.StructType([T.StructField("value", T.StructType([T.StructField("id", _S)]))])),
    ]
)
_CLAIM = T.StructType([T.StructField("rank", _S), T.StructField("mainsnak", _SNAK)])

#: An entity as a knowledge base delivers it.
ENTITY = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("labels", T.MapType(_S, _TERM)),
        T.StructField("descriptions", T.MapType(_S, _TERM)),
        T.StructField("aliases", T.MapType(_S, T.ArrayType(_TERM))),
        T.StructField("claims", T.StructType([T.StructField("P31", T.ArrayType(_CLAIM))])),
    ]
)

PROVENANCE = T.StructType(
    [T.StructField("qid", _S), T.StructField("seed_names", _A), T.StructField("seed_instance_of_qids", _A)]
)

INDEX_METADATA = T.StructType(
    [
        T.StructField("model_fingerprint", _S),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("dataset_sha256", _S),
    ]
)

_CASE = T.StructType(
    [T.StructField(n, _S) for n in ("id", "query", "language")]
    + [T.StructField("expected_qids", _A), T.StructField("top_k", T.IntegerType())]
    + [T.StructField(n, _S) for n in ("category", "rationale")]
)
GOLDEN_SUITE = T.StructType([T.StructField("version", _S), T.StructField("cases", T.ArrayType(_CASE))])

SNIPPETS = T.StructType(
    [T.StructField("snippets", T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("id", "language", "text")])))]
)
CODE_QUERIES = T.StructType(
    [
        T.StructField(
            "queries",
            T.ArrayType(
                T.StructType([T.StructField("id", _S), T.StructField("query", _S), T.StructField("expected_ids", _A)])
            ),
        )
    ]
)

MATRIX_RESULT = T.StructType(
    [T.StructField("case_id", _S)]
    + [
        T.StructField(n, T.IntegerType())
        for n in ("worker_count", "concurrency", "items_per_request", "dimensions", "requests", "errors", "rejected_429")
    ]
    + [
        T.StructField("throughput_items_per_second", T.DoubleType()),
        T.StructField("latency_ms", T.StructType([T.StructField(n, T.DoubleType()) for n in ("min", "p50", "p95", "p99", "max")])),
        T.StructField("workload_fingerprint", _S),
    ]
)
