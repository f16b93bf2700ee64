"""File scans: JSON arrays and lines, Parquet, checksum lists, archives, trees of files."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec import schemas
from lexivec.session import exists


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON list of objects; anything else is an error when read."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, others that are no objects are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text`` of text files; a large file is read in many blocks.

    Rows of a block follow each other in one partition; its first line is known from the numbers of lines
    of the blocks before, which a first pass counts.
    """
    read = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    blocks = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("bigint").alias("line"), F.col("value").alias("text")
    )


def checked_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the line that is wrong: ``file, line, error`` and the record's columns; blank lines are skipped."""
    lines = numbered_lines(spark, path).where(F.trim("text") != "")
    is_object = F.trim("text").startswith("{") & F.try_parse_json("text").isNotNull()
    error = F.when(~F.coalesce(is_object, F.lit(False)), F.concat_ws(":", "file", "line", F.lit("not a JSON object")))
    return lines.select("file", "line", error.alias("error"), F.from_json("text", schema).alias("r")).select("file", "line", "error", "r.*")


def resumed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of an earlier run; a missing file is an empty table, a wrong line an error that names file and line."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    fine = F.col("error").isNull() | F.raise_error(F.col("error")).cast("boolean")
    return checked_lines(spark, path, schema).where(fine).drop("file", "line", "error")


def records(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_RECORD) -> DataFrame:
    """Raw records of a ``.json``, ``.jsonl`` or Parquet path."""
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    return spark.read.parquet(path)


def head(spark: SparkSession, path: str, n: int, order: str = "qid") -> DataFrame:
    """The first ``n`` rows of a Parquet file in its sort order: a top-n, each task keeps ``n`` rows."""
    return spark.read.parquet(path).orderBy(order).limit(n)


def projected(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def golden_suite(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, query, language, expected_qids, top_k, category, rationale``; a bad suite is an error."""
    suite = json_array(spark, path, schemas.GOLDEN_SUITE)
    cases = suite.select(F.explode("cases").alias("c")).select("c.*").withColumnRenamed("id", "case_id")
    cases = cases.withColumn("top_k", F.coalesce("top_k", F.lit(10)))
    checked_suite(cases)
    return cases


def checked_suite(cases: DataFrame) -> None:
    """Raises for an empty suite, repeated ids, empty expectations and a top_k below 1."""
    r = cases.agg(
        F.count("*").alias("n"),
        F.countDistinct("case_id").alias("ids"),
        F.count_if(F.coalesce(F.size("expected_qids"), F.lit(0)) < 1).alias("empty"),
        F.count_if(F.col("top_k") < 1).alias("low"),
    ).first()
    for bad, what in (
        (r.n == 0, "no cases"), (r.ids != r.n, "repeated case ids"), (r.empty, "empty expectations"), (r.low, "top_k below 1"),
    ):
        if bad:
            raise ValueError(f"golden suite: {what}")


def code_fixture(spark: SparkSession, snippets: str, queries: str) -> tuple[DataFrame, DataFrame]:
    s = json_array(spark, snippets, schemas.SNIPPETS).select(F.explode("snippets").alias("s")).select("s.*")
    q = json_array(spark, queries, schemas.CODE_QUERIES).select(F.explode("queries").alias("q")).select("q.*")
    return s, q


def matrix_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark results: JSON lines, a list, an object with ``results``, or a folder of case files by name.

    ``ordinal`` is the place of a result, by file name and within the file.
    """
    one = schemas.MATRIX_RESULT
    wide = T.StructType([*one.fields, T.StructField("results", T.ArrayType(one))])
    files = f"{path}/*.json" if os.path.isdir(path) else path
    raw = spark.read.schema(wide).option("multiLine", not path.endswith(".jsonl")).json(files)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    own = F.struct(*[F.col(f.name) for f in one.fields])
    placed = raw.select("file", "at", F.posexplode(F.coalesce("results", F.array(own))).alias("pos", "r")).where("r.case_id is not null")
    w = Window.orderBy("file", "at", "pos")  # the results of one benchmark
    return placed.select("r.*", F.row_number().over(w).cast("bigint").alias("ordinal"))


def telemetry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Samples of a monitor as comma-separated lines with a header; values that do not fit the schema are null."""
    return spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256`` of a checksum list; names with folders and rows of another form are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+", 2)
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"^\*+", "")
    bad = (F.size(parts) != 2) | name.contains("/")
    return lines.select(
        F.when(bad, F.raise_error(F.lit("invalid checksum row")).cast("string")).otherwise(name).alias("name"),
        F.get(parts, F.lit(0)).alias("sha256"),
    )


def tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of all files below a folder."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return files.select("path", "length", "content")


def with_hashes(files: DataFrame) -> DataFrame:
    """``path, bytes, sha256``."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_mismatches(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``name, problem``: listed files that are missing or differ, and files that are not listed."""
    have = with_hashes(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    problem = (
        F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not listed")
        .when(F.col("found") != F.col("sha256"), "differs")
    )
    return listed.join(have, "name", "full").select("name", problem.alias("problem")).where("problem is not null")


def members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, content`` of zip and tar.gz files; other files are their own only member."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                for member, content in _unpacked(name, data):
                    yield pd.DataFrame({"archive": [name], "member": [member], "content": [content]})

    return tree(spark, path).mapInPandas(unpack, "archive string, member string, content binary")


def _unpacked(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist())
    elif name.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for m in t.getmembers():
                f = t.extractfile(m) if m.isfile() else None
                yield m.name, f.read() if f else b""
    else:
        yield os.path.basename(name), data
