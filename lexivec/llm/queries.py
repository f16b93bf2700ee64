"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.llm import calibrate, garbled, lookalike, mih, mixing, packing, splitting
from lexivec.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_records").select("record_id", *lookalike.FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(_records(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_classes(_records(spark, d))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return lookalike.canonical_values(records, lookalike.learn(records))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(_records(spark, d)).select("record_id", "field")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(_records(spark, d))


def p5_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_docs(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_docs(spark, d)))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.mix(_docs(spark, d), table(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # the sources that the drawn mixture missed, of which those are kept that have too little for their target
    return _mixture(spark, d).report.where("missed").where("short").select("source")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_docs(spark, d)).where("piece_no = 0").select("doc_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_docs(spark, d))


_RECORD_COLUMNS = ("qid", "label_en", "label_vi", "instance_of_qids")


def _sample(spark: SparkSession, d: str) -> calibrate.Sample:
    records = table(spark, d, "canonical_records").select(*_RECORD_COLUMNS)
    return calibrate.calibrated_sample(records, table(spark, d, "seed_categories"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # the categories that the drawn sample missed, of which those are kept that are too small for their target
    return _sample(spark, d).report.where("missed").where("short").select("seed_name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embed_results").select("vec_id", "model_fingerprint", "embeddings")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mih.mutual_neighbours(_vectors(spark, d), table(spark, d, "index_metadata"))


def p1_knn(spark: SparkSession, d: str) -> DataFrame:
    return mih.similar_to(_vectors(spark, d), table(spark, d, "index_metadata"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value; the form of those in ASCII alone is the value without needless blanks."""
    plain = F.when(F.col("value").rlike("^[ -~]*$"), F.col("canonical"))
    return p2_canonical(spark, d).select("record_id", "field", "value", plain.alias("plain"), F.col("canonical").isNotNull().alias("has_form"))


def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    """Entities and target of each category, and whether the sample has its least number."""
    met = F.col("sampled") >= F.least(F.lit(5), F.col("entities"))
    return _sample(spark, d).report.select("seed_name", "weight", "entities", "target", "target_share", "short", met.alias("floor_met"))


def p4_size(spark: SparkSession, d: str) -> DataFrame:
    """The size of the sample, whose entities are distinct and of a category; the floors alone may need more."""
    sample = _sample(spark, d)
    size, floors = sample.calibration.size, int(sample.calibration.floors.sum())
    return sample.rows.agg(
        F.lit(size).cast("bigint").alias("size"),
        F.count("*").between(size, max(size, floors)).alias("size_met"),
        (F.count("*") == F.count_distinct("qid")).alias("distinct_qids"),
        (F.min(F.size("seed_names")) > 0).alias("classed"),
    )


#: A capacity at which best fit is not optimal on these texts, so that the search has work.
SMALL = 512


def _texts_in_containers(spark: SparkSession, d: str, capacity: int) -> DataFrame:
    """Every text once: whole unless it is over the capacity, in containers that are not over it."""
    packed = packing.pack(_docs(spark, d), capacity=capacity)
    full = F.sum("n_tokens").over(Window.partitionBy("container"))
    kept = packed.withColumn("fits", F.col("container").isNull() | (full <= capacity))
    return kept.groupBy("doc_id").agg(
        F.min("fits").alias("fits"),
        ((F.count("*") == 1) | (F.sum("n_tokens") > capacity)).alias("whole"),
        (F.count("*") == F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / capacity))).alias("fewest_parts"),
    )


def _container_bounds(spark: SparkSession, d: str, capacity: int) -> DataFrame:
    """The containers are at most one for each pool above the least number there can be."""
    docs = _docs(spark, d)
    pools = docs.select(F.ceil(F.count("*") / packing.POOL_ITEMS).alias("pools"))
    report = packing.fill_report(packing.pack(docs, capacity=capacity), capacity).crossJoin(F.broadcast(pools))  # one row each
    near = F.col("containers") <= F.col("least_containers") + F.col("pools")
    return report.select(near.alias("near_least"), (F.col("fullest") <= capacity).alias("none_over"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts_in_containers(spark, d, 2048)


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _container_bounds(spark, d, 2048)


def p5_small_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts_in_containers(spark, d, SMALL)


def p5_small_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _container_bounds(spark, d, SMALL)


def p6_uses(spark: SparkSession, d: str) -> DataFrame:
    """Each target source: no text used too often, each use once, and the size of the whole mixture."""
    mixture = _mixture(spark, d)
    uses = mixture.rows.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("use_no").alias("most"), F.count_distinct("use_no").alias("u"))
    worst = uses.groupBy("source").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.max(F.col("n") - F.col("u")).alias("again"))
    whole = mixture.rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("mixture_tokens"))
    most = F.coalesce(F.greatest("n", "most"), F.lit(0))
    return (
        mixture.report.join(worst, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "max_uses", "target_tokens", "mixture_tokens", (most <= F.col("max_uses")).alias("within_uses"),
            (F.coalesce("again", F.lit(0)) == 0).alias("each_use_once"),
            ((F.col("mixed_tokens") <= F.col("capacity_tokens"))).alias("within_capacity"),
        )
    )


def p7_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every text: put together from its pieces without their overlaps, or as it is if it was not cut."""
    docs = _docs(spark, d).where("text is not null and text <> ''")
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    pieces = (
        splitting.split_oversized(docs)
        .withColumn("before", F.coalesce(F.lag("end_char").over(w), F.lit(0)))
        .withColumn("shared", F.least(F.lit(64), F.coalesce(F.lag("n_tokens").over(w), F.lit(0))))
        .withColumn("intact", F.expr("n_tokens <= 2048 and overlap_tokens = shared and start_char <= before and before < end_char"))
        .withColumn("own", F.expr("substring(piece, before - start_char + 1)"))
    )
    # the pieces of one text are as large as the text
    whole = pieces.groupBy("doc_id").agg(
        F.min("intact").alias("intact"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x.own), "").alias("joined")
    )
    return docs.join(whole, "doc_id", "left").select(
        "doc_id", F.md5(F.coalesce("joined", "text").cast("binary")).alias("text_md5"), F.coalesce("intact", F.lit(True)).alias("intact")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_knn": p1_knn,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_sample": p4_sample,
    "p4_targets": p4_targets,
    "p4_size": p4_size,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p2_classes": p2_classes,
    "p2_values": p2_values,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p5_pack": p5_pack,
    "p5_report": p5_report,
    "p5_texts": p5_texts,
    "p5_bounds": p5_bounds,
    "p5_small_texts": p5_small_texts,
    "p5_small_bounds": p5_small_bounds,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_mix": p6_mix,
    "p6_uses": p6_uses,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_rejoined": p7_rejoined,
}

_CLASSED = """
with r as (
  select trim(qid) as qid, instance_of_qids from canonical_records
  where qid is not null and (trim(coalesce(label_en, '')) <> '' or trim(coalesce(label_vi, '')) <> '')
), m as (
  select distinct r.qid, s.seed_name
  from (select qid, unnest(instance_of_qids) as class from r) r join seed_categories s on trim(r.class) = s.instance_of_qid
), n as (select count(distinct qid) // 5 as size from m)"""

SQL: dict[str, str] = {
    "p1_found": """
with v as (
  select vec_id, model_fingerprint as f, (embeddings[1:dimensions])::double[] as e from embed_results join index_metadata using (model_fingerprint)
  where len(embeddings) >= dimensions and len(list_filter(embeddings[1:dimensions], lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embeddings[1:dimensions], lambda x: x <> 0)) > 0
), s as (
  select a.vec_id as p, b.vec_id as q, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.f = b.f and a.vec_id <> b.vec_id
), l as (select p, q from s where c >= 0.92 qualify row_number() over (partition by p order by round(c, 6) desc, q) <= 10)
select x.p as vec_id_a, x.q as vec_id_b from l x join l y on x.p = y.q and x.q = y.p where x.p < x.q
""",
    "p4_found": f"""
{_CLASSED}
select s.seed_name from seed_categories s left join m on m.seed_name = s.seed_name, n
group by s.seed_name, s.weight, n.size
having count(distinct m.qid) < greatest(5, ceil(n.size * s.weight / (select sum(weight) from seed_categories)))
""",
    "p2_values": """
with v as (
  select record_id, 'label_vi' as field, label_vi as value from canonical_records
  union all select record_id, 'description_vi', description_vi from canonical_records
  union all select record_id, 'aliases_vi', unnest(aliases_vi) from canonical_records
)
select record_id, field, value, case when regexp_full_match(value, '[ -~]*') then trim(regexp_replace(value, ' +', ' ', 'g')) end as plain, true as has_form
from v where value is not null
""",
    "p4_targets": f"""
{_CLASSED}
select s.seed_name, s.weight::bigint as weight, count(distinct m.qid) as entities,
  greatest(5, ceil(n.size * s.weight / (select sum(weight) from seed_categories)))::bigint as target,
  s.weight::double / (select sum(weight) from seed_categories)::double as target_share,
  count(distinct m.qid) < greatest(5, ceil(n.size * s.weight / (select sum(weight) from seed_categories))) as short, true as floor_met
from seed_categories s left join m on m.seed_name = s.seed_name, n
group by s.seed_name, s.weight, n.size
""",
    "p4_size": f"{_CLASSED} select size, true as size_met, true as distinct_qids, true as classed from n",
    "p5_texts": "select doc_id, true as fits, true as whole, true as fewest_parts from documents",
    "p5_bounds": "select true as near_least, true as none_over",
    "p5_small_texts": "select doc_id, true as fits, true as whole, true as fewest_parts from documents",
    "p5_small_bounds": "select true as near_least, true as none_over",
    "p6_uses": """
select source, max_uses, target_weight * budget_tokens as target_tokens, budget_tokens as mixture_tokens,
  true as within_uses, true as each_use_once, true as within_capacity from mix_targets
""",
    "p7_rejoined": "select doc_id, md5(text) as text_md5, true as intact from documents where text is not null and text <> ''",
}
