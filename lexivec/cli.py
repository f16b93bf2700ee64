"""Command lines: ``python -m lexivec.cli {dataset,index,search,quality,semantic,matrix,long-context} ...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexivec.operators import benchstats, dataset, evaluate, quality
from lexivec.operators.embed import HashingEmbedder
from lexivec.settings import INSTRUCTION
from lexivec.sources import files
from lexivec.sources import index as index_table


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexivec", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        for o, default in options.items():
            p.add_argument("--" + o.replace("_", "-"), default=default, type=type(default) if default is not None else str)
        return p

    command("dataset", "input", "out", limit=0, ordinal=None)
    command("index", "records", "out", dimensions=256, sha256="")
    command("search", "index", "query", k=10, dimensions=256, sha256="", rows=0)
    command("quality", "records")
    command("semantic", "suite", "rankings", "available")
    command("matrix", "results")
    command("long-context", "results")
    return top


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def show(value) -> None:
        print(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str))

    def rows(df) -> list[dict]:
        return [r.asDict(True) for r in df.collect()]  # reports of a few rows

    if a.command == "dataset":
        show(dataset.build(files.records(spark, a.input), a.out, a.input.rsplit("/", 1)[-1], a.limit or None, a.ordinal))
    elif a.command == "index":
        dims = a.dimensions
        show(index_table.build(spark.read.parquet(a.records), a.out, lambda: HashingEmbedder(dims), "hashing", a.sha256, dims))
    elif a.command == "search":
        dims = a.dimensions
        want = {"model_fingerprint": "hashing", "dimensions": dims, "dataset_sha256": a.sha256, "row_count": a.rows}
        index = index_table.load(spark, a.index, want)
        hits = index_table.answer(index, a.query, lambda: HashingEmbedder(dims), INSTRUCTION, a.k)
        show(rows(hits.drop("embedding")))
    elif a.command == "quality":
        df = spark.read.parquet(a.records)
        show({
            "null_rates": rows(quality.falsy_rates(df))[0],
            "identical": rows(quality.identical_pairs(df)),
            "suspected_english": rows(quality.suspected_english(df)),
        })
    elif a.command == "semantic":
        cases = files.golden_suite(spark, a.suite)
        ranked = spark.read.json(a.rankings, schema="case_id string, rank int, qid string")
        out = evaluate.case_outcomes(cases, ranked, spark.read.parquet(a.available).select("qid"))
        show({"rollup": rows(evaluate.rollup(out)), "status": rows(evaluate.status_counts(out))[0]})
    elif a.command == "matrix":
        r = files.matrix_results(spark, a.results)
        show({
            "best": rows(benchstats.best_stable(r, "ordinal")),
            "matched_scaling": rows(benchstats.matched_scaling(r)),
            "flattening": rows(benchstats.flattening(r)),
        })
    else:
        executed = files.json_lines(spark, a.results, spark.read.json(a.results).schema)
        targets = spark.createDataFrame([(t,) for t in benchstats.TARGETS], "target_tokens int")
        show(rows(benchstats.final_results(targets, executed.withColumn("target_tokens", F.col("target_tokens").cast("int")))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
