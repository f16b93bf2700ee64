"""Dataset quality rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text

TEXT_COLUMNS = ("label_en", "label_vi", "description_en", "description_vi", "document_en", "document_vi")
PAIRS = ("label", "description", "document")


def falsy_rates(df: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """One row: the share of null or empty values of each column; 0 for an empty table."""
    return df.agg(*[F.coalesce(F.avg((F.coalesce(F.col(c), F.lit("")) == "").cast("double")), F.lit(0.0)).alias(c) for c in columns])


def identical_pairs(df: DataFrame) -> DataFrame:
    """``field, n, rate``: rows whose English and Vietnamese values are equal and not empty."""
    same = [F.count_if((F.col(f"{p}_en") != "") & (F.col(f"{p}_en") == F.col(f"{p}_vi"))).alias(p) for p in PAIRS]
    counted = df.agg(F.count("*").alias("total"), *same)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("n")) for p in PAIRS]))
    return counted.select("total", rows.alias("r")).select(
        "r.field", "r.n", F.coalesce(F.try_divide("r.n", "total"), F.lit(0.0)).alias("rate")
    )


def suspected_english(df: DataFrame) -> DataFrame:
    """``field, n, non_null, rate``: Vietnamese fields that look English, over values that are there."""
    fields = ("label_vi", "description_vi", "document_vi")
    counted = df.agg(
        *[F.count_if(text.looks_english(F.col(f))).alias(f) for f in fields],
        *[F.count_if(F.col(f) != "").alias(f"{f}_there") for f in fields],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n"), F.col(f"{f}_there").alias("non_null")) for f in fields])
    )
    return counted.select(rows.alias("r")).select(
        "r.field", "r.n", "r.non_null", F.coalesce(F.try_divide("r.n", "r.non_null"), F.lit(0.0)).alias("rate")
    )


def category_coverage(df: DataFrame, column: str = "instance_of_qids") -> DataFrame:
    """``category, n, rate`` over all rows; entries repeated in a row count each time."""
    counts = df.select(F.explode(column).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total")).alias("rate"))  # one row
