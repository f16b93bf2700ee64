"""Records: from entities, to canonical records with full accounting of what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import text
from lexivec.session import cut_lineage

QID = r"^Q[1-9][0-9]*\z"
SOURCE = "wikidata"
SOURCE_LICENSE = "CC0-1.0"
SCALARS = ("label_en", "label_vi", "description_en", "description_vi")
ARRAYS = ("aliases_en", "aliases_vi")
CANONICAL = (
    "qid", "label_en", "label_vi", "description_en", "description_vi", "aliases_en", "aliases_vi",
    "instance_of_qids", "source", "source_license", "document_en", "document_vi", "quality_flags",
)


def is_qid(c: Column) -> Column:
    return F.coalesce(c.rlike(QID), F.lit(False))


def qid_number(column: str) -> Column:
    """The number of an id, for sorting; what is no id comes last."""
    number = F.when(is_qid(F.col(column)), F.expr(f"try_cast(substr({column}, 2) as decimal(38,0))"))
    return F.coalesce(number, F.lit(2**63 - 1).cast("decimal(38,0)"))


def picked(terms: Column, language: str) -> Column:
    """A language's value of a term map; blank counts as missing, others are not trimmed."""
    value = terms[language]["value"]
    return F.when(text.strip(value) != "", value)


def picked_aliases(terms: Column, language: str) -> Column:
    """A language's aliases in order, without blank and repeated ones."""
    values = F.transform(terms[language], lambda t: t["value"])
    return F.coalesce(
        F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (text.strip(v) != ""))), F.array().cast("array<string>")
    )


def claimed_classes(claims: Column) -> Column:
    """Class ids of the claims, without deprecated, valueless and invalid ones, first occurrences in order."""
    kept = F.filter(
        claims["P31"],
        lambda c: (F.coalesce(c["rank"], F.lit("")) != "deprecated") & (c["mainsnak"]["snaktype"] == "value"),
    )
    ids = F.transform(kept, lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    return F.coalesce(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & is_qid(i))), F.array().cast("array<string>"))


def from_entities(entities: DataFrame, *keep: str) -> DataFrame:
    """Raw records of entities, and the columns ``keep``; an entity without a valid id has a null ``qid`` and an ``error``."""
    qid = text.strip(F.col("id"))
    return entities.select(
        *keep,
        F.when(is_qid(qid), qid).alias("qid"),
        picked(F.col("labels"), "en").alias("label_en"),
        picked(F.col("labels"), "vi").alias("label_vi"),
        picked(F.col("descriptions"), "en").alias("description_en"),
        picked(F.col("descriptions"), "vi").alias("description_vi"),
        picked_aliases(F.col("aliases"), "en").alias("aliases_en"),
        picked_aliases(F.col("aliases"), "vi").alias("aliases_vi"),
        claimed_classes(F.col("claims")).alias("instance_of_qids"),
        F.when(~is_qid(qid), F.lit("invalid entity id")).alias("error"),
    )


def canonicalize(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every record in canonical form with a ``reject_reason``; accepted ones have none.

    A record is refused for the first field with a bad text, in the fields' order, then for having no
    label.  Null ids become '' in accepted records; null and blank classes are dropped.  ``keep`` names columns that
    go along.  One narrow pass; nothing is shuffled.
    """
    errors = [text.text_error(F.col(c)) for c in SCALARS] + [text.first_error(F.col(c)) for c in ARRAYS]
    cleaned = raw.select(
        *keep,
        text.strip(F.col("qid")).alias("qid"),
        *[F.nullif(text.normalized(F.col(c)), F.lit("")).alias(c) for c in SCALARS],
        *[text.normalized_each(F.col(c)).alias(c) for c in ARRAYS],
        F.coalesce(
            F.array_distinct(
                F.filter(F.transform("instance_of_qids", text.strip), lambda x: x.isNotNull() & (x != ""))
            ),
            F.array().cast("array<string>"),
        ).alias("instance_of_qids"),
        F.coalesce(*errors).alias("_error"),
    )
    flagged = [text.is_mojibake(F.col(c)) for c in SCALARS] + [F.exists(F.col(c), text.is_mojibake) for c in ARRAYS]
    any_flag = F.coalesce(*[F.when(f, F.lit(True)) for f in flagged], F.lit(False))
    reason = F.when(F.col("_error").isNotNull(), F.concat(F.lit("unicode_quality:"), F.col("_error"))).when(
        F.col("label_en").isNull() & F.col("label_vi").isNull(), F.lit("missing_usable_label")
    )
    return cleaned.select(
        *keep,
        F.when(reason.isNull(), F.coalesce("qid", F.lit(""))).otherwise(F.col("qid")).alias("qid"),
        *SCALARS,
        *ARRAYS,
        "instance_of_qids",
        F.lit(SOURCE).alias("source"),
        F.lit(SOURCE_LICENSE).alias("source_license"),
        text.document(F.col("label_en"), F.col("description_en"), F.col("aliases_en")).alias("document_en"),
        text.document(F.col("label_vi"), F.col("description_vi"), F.col("aliases_vi")).alias("document_vi"),
        F.when(any_flag, F.array(F.lit(text.MOJIBAKE_FLAG))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        reason.alias("reject_reason"),
    )


def accepted(canonical: DataFrame) -> DataFrame:
    return canonical.where("reject_reason is null").drop("reject_reason")


def reject_counts(canonical: DataFrame) -> DataFrame:
    """``reason, n`` of the refused records."""
    return (
        canonical.where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
    )


def flag_counts(records: DataFrame) -> DataFrame:
    """``flag, n``: how often each flag occurs."""
    return records.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def null_rates(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: the share of nulls of each column; nulls for an empty table."""
    return records.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def canonical_order() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")) for c in ("qid", "label_en", "label_vi")]


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Every row with its ``position`` in the order, from 1.

    A range-partitioned sort, then each partition's positions begin where the one before ends: no window over all
    rows in one task.  The driver gets one count a partition.  Rows that ``order`` does not tell apart come in any order.
    """
    at = cut_lineage(df.orderBy(*order)).withColumns(
        {"_part": F.spark_partition_id(), "position": F.monotonically_increasing_id().bitwiseAND(2**33 - 1) + 1}
    )
    sizes = {r._part: r.n for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before = [0]
    for part in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(part, 0))
    offset = F.get(F.lit(before).cast("array<bigint>"), F.col("_part"))
    return at.withColumn("position", F.col("position") + offset).drop("_part")


def gate_violations(stored: DataFrame, columns: tuple[str, ...], arrays: tuple[str, ...] = ()) -> DataFrame:
    """Stored texts that are not in their own normal form: ``field, n``; of arrays each entry counts."""
    checks = [F.count_if(text.normalized(F.col(c)) != F.col(c)).alias(c) for c in columns]
    for c in arrays:
        same = F.zip_with(c, F.transform(text.nfc_each(F.col(c)), text.squeeze), lambda a, b: a != b)
        checks.append(F.coalesce(F.sum(F.size(F.filter(same, lambda x: x))), F.lit(0)).alias(c))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("n")) for c in (*columns, *arrays)]))
    return stored.agg(*checks).select(pairs.alias("x")).select("x.field", "x.n")


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key.  Runs as a per-task top-1 before the shuffle, so hot keys cost one row a task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_accepted(canonical: DataFrame, limit: int, ordinal: str) -> DataFrame:
    """The first ``limit`` accepted records in the order of ``ordinal``: a top-n, no running count over all rows."""
    return canonical.where("reject_reason is null").orderBy(ordinal).limit(limit)


def scanned_until(canonical: DataFrame, limit: int, ordinal: str) -> DataFrame:
    """One row, ``scanned``: records read until the ``limit``-th accepted one, or all."""
    rows = canonical.select("reject_reason", F.col(ordinal).alias("at"))
    last = first_accepted(rows, limit, "at").agg(F.count("*").alias("kept"), F.max("at").alias("last"))
    return (
        rows.crossJoin(F.broadcast(last))  # one row
        .where((F.col("kept") < limit) | (F.col("at") <= F.col("last")))
        .agg(F.count("*").alias("scanned"))
    )
