"""Queries of acquisition: quotas, provenance, hydration, resumption, arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import acquire, records
from lexivec.session import table

TARGET = 2000
OVERFETCH = 1.25


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return acquire.discovered(table(spark, d, "crawl_pages"))


def _quotas(spark: SparkSession, d: str) -> DataFrame:
    return acquire.quotas(table(spark, d, "seed_categories"), TARGET, OVERFETCH)


def prj01_valid_qids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages").groupBy(records.is_qid(F.col("qid")).alias("valid")).agg(F.count("*").alias("n"))


def s07_page(spark: SparkSession, d: str) -> DataFrame:
    """One page: the items of a seed in their order, from an offset on."""
    found = _pages(spark, d).where("seed_name = 'river'").select("qid").distinct()
    return found.orderBy("qid").offset(20).limit(50)


def w06_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d)


def w07_within_quota(spark: SparkSession, d: str) -> DataFrame:
    return acquire.within_quota(_pages(spark, d), _quotas(spark, d)).select("seed_name", "qid", F.col("place").cast("bigint").alias("place"))


def a21_attributed(spark: SparkSession, d: str) -> DataFrame:
    return acquire.attributed(_pages(spark, d))


def a22_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = acquire.provenance(_pages(spark, d))
    return p.select("qid", F.array_join("seed_names", "|").alias("seed_names"), F.array_join("seed_instance_of_qids", "|").alias("classes"))


def a23_accepted_count(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "canonical_records").select("qid", *records.SCALARS, *records.ARRAYS, "instance_of_qids")
    c = records.canonicalize(raw)
    return c.agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count("*").alias("records"))


def j03_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each discovered id, with the place where it was discovered first."""
    asked = _pages(spark, d).groupBy("qid").agg(F.min(F.struct("page_offset", "item_pos", "seed_qid")).alias("at"))
    rows = table(spark, d, "canonical_records").where("qid is not null").select("qid", "record_id", "label_en")
    first = records.first_per_key(rows, "qid", F.col("record_id"))
    out = acquire.hydrated(asked.select("qid", "at.page_offset", "at.item_pos"), first, "page_offset")
    return out.select("qid", "page_offset", "item_pos", "record_id", "label_en")


def j08_unseen(spark: SparkSession, d: str) -> DataFrame:
    found = _pages(spark, d).select("qid").distinct()
    return acquire.unseen(found, table(spark, d, "canonical_records"))


def u02_seed_union(spark: SparkSession, d: str) -> DataFrame:
    """All (id, seed) of the pages and of the provenance, each once."""
    pages = _pages(spark, d).select("qid", F.col("seed_name").alias("seed"))
    rows = table(spark, d, "qid_provenance").where("qid is not null").select("qid", F.explode("seed_names").alias("seed"))
    return pages.union(rows).distinct().groupBy("seed").agg(F.count("*").alias("n"))


def u04_missing_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs the pages have and the stored provenance has not."""
    pages = _pages(spark, d).select("qid", F.col("seed_name").alias("seed")).distinct()
    rows = table(spark, d, "qid_provenance").where("qid is not null").select("qid", F.explode("seed_names").alias("seed")).distinct()
    return pages.subtract(rows)


def u01_confirmed_provenance(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("qid", F.col("seed_name").alias("seed"))
    rows = table(spark, d, "qid_provenance").where("qid is not null").select("qid", F.explode("seed_names").alias("seed"))
    return pages.intersect(rows).groupBy("seed").agg(F.count("*").alias("n"))


def w08_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Entity batches of 50 records until 1 000 are accepted; a batch is always completed."""
    raw = table(spark, d, "canonical_records").select("record_id", "qid", *records.SCALARS, *records.ARRAYS, "instance_of_qids")
    c = records.canonicalize(raw, ("record_id",))
    batches = c.select("record_id", F.floor(F.col("record_id") / 50).alias("batch"), F.col("reject_reason").isNull().alias("is_accepted"))
    kept = acquire.stop_at_target(batches, 1000)
    return kept.agg(F.count("*").alias("n"), F.max("record_id").alias("last"), F.count_if("is_accepted").alias("accepted"))


def e01_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrived more than a day after they were fetched, by day fetched."""
    r = table(spark, d, "canonical_records").where("fetched_at is not null")
    late = F.unix_micros("ingested_at") - F.unix_micros("fetched_at") > 86_400_000_000
    return r.groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


QUERIES = {
    f.__name__: f
    for f in (
        prj01_valid_qids, s07_page, w06_quotas, w07_within_quota, w08_early_stop, a21_attributed, a22_provenance, a23_accepted_count,
        j03_hydrated, j08_unseen, u01_confirmed_provenance, u02_seed_union, u04_missing_provenance, e01_late_rows,
    )
}

_FOUND = """
found as (select * exclude (qid), trim(qid) as qid from (
  select * from crawl_pages qualify row_number() over (partition by seed_qid, page_offset, item_pos order by ingested_at nulls first, discovered_at nulls first, qid nulls first) = 1)
  where regexp_full_match(trim(qid), 'Q[1-9][0-9]*'))
"""
_WANT = max(TARGET, int(-(-TARGET * OVERFETCH // 1)))
_QUOTAS = f"quotas as (select seed_name, greatest(1, ceil({_WANT} * weight / sum(weight) over ()))::bigint as quota from seed_categories)"
_PAIRS = "pairs as (select distinct qid, seed_name as seed from found), stored as (select distinct qid, seed from (select qid, unnest(seed_names) as seed from qid_provenance where qid is not null))"


def _canonical() -> str:
    from lexivec.plans.texts import CANONICAL

    return CANONICAL


SQL = {
    "prj01_valid_qids": "select coalesce(regexp_full_match(qid, 'Q[1-9][0-9]*'), false) as valid, count(*)::bigint as n from crawl_pages group by 1",
    "s07_page": f"with {_FOUND} select distinct qid from found where seed_name = 'river' order by qid limit 50 offset 20",
    "w06_quotas": f"with {_QUOTAS} select * from quotas",
    "w07_within_quota": f"with {_FOUND}, {_QUOTAS}, firsts as (select seed_name, qid, min((page_offset, item_pos)) as spot from found group by seed_name, qid), "
    "placed as (select seed_name, qid, row_number() over (partition by seed_name order by spot, qid) as place from firsts) "
    "select seed_name, qid, place from placed join quotas using (seed_name) where place <= quota",
    "w08_early_stop": f"with {_canonical()}, b as (select record_id, record_id // 50 as batch, reason is null as ok from judged), "
    "p as (select batch, coalesce(sum(count(*) filter (where ok)) over (order by batch rows between unbounded preceding and 1 preceding), 0) as before from b group by batch) "
    "select count(*)::bigint as n, max(record_id) as last, (count(*) filter (where ok))::bigint as accepted from b join p using (batch) where before < 1000",
    "a21_attributed": f"with {_FOUND} select seed_name, count(distinct qid)::bigint as qids from found group by seed_name",
    "a22_provenance": f"with {_FOUND}, s as (select qid, string_agg(seed_name, '|' order by seed_name) as seed_names from (select distinct qid, seed_name from found) group by qid), "
    "c as (select qid, string_agg(seed_qid, '|' order by substr(seed_qid, 2)::bigint, seed_qid) as classes from (select distinct qid, seed_qid from found) group by qid) "
    "select qid, seed_names, classes from s join c using (qid)",
    "a23_accepted_count": f"with {_canonical()} select (count(*) filter (where reason is null))::bigint as accepted, count(*)::bigint as records from judged",
    "j03_hydrated": f"with {_FOUND}, asked as (select qid, min((page_offset, item_pos, seed_qid)) as spot from found group by qid), "
    "r as (select qid, record_id, label_en from canonical_records where qid is not null qualify row_number() over (partition by qid order by record_id) = 1) "
    "select qid, spot[1] as page_offset, spot[2] as item_pos, record_id, label_en from asked join r using (qid)",
    "j08_unseen": f"with {_FOUND} select distinct qid from found where qid not in (select qid from canonical_records where qid is not null)",
    "u01_confirmed_provenance": f"with {_FOUND}, {_PAIRS} select seed, count(*)::bigint as n from (select * from pairs intersect select * from stored) group by seed",
    "u02_seed_union": f"with {_FOUND}, {_PAIRS} select seed, count(*)::bigint as n from (select * from pairs union select * from stored) group by seed",
    "u04_missing_provenance": f"with {_FOUND}, {_PAIRS} select * from pairs except select * from stored",
    "e01_late_rows": "select strftime(fetched_at at time zone 'UTC', '%Y-%m-%d') as day, count(*)::bigint as n, "
    "(count(*) filter (where epoch_us(ingested_at) - epoch_us(fetched_at) > 86400000000))::bigint as late from canonical_records where fetched_at is not null group by 1",
}
