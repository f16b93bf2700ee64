"""Acquisition: discovery pages, quotas, provenance, hydration and the resumable state."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.operators import records
from lexivec.session import exists, read_text, write_text

# The default seed categories (name, class, weight).
DEFAULT_SEEDS = (
    ("human", "Q5", 20), ("city", "Q515", 10), ("human_settlement", "Q486972", 8), ("organization", "Q43229", 9),
    ("business_enterprise", "Q4830453", 7), ("university", "Q3918", 6), ("software", "Q7397", 8),
    ("programming_language", "Q9143", 3), ("disease", "Q12136", 7), ("occupation", "Q12737077", 6),
    ("scientific_discipline", "Q11862829", 5), ("chemical_compound", "Q11173", 11),
)

GENERIC_AGENTS = ("python-requests/", "python-urllib/", "curl/", "wget/")
CONTACTS = ("http://", "https://", "mailto:", "@", "user:")


class AcquisitionShortfall(RuntimeError):
    """Fewer records were accepted than asked for."""


def checked_user_agent(value: str | None) -> str:
    """A descriptive agent with a contact in brackets, else an error."""
    agent = (value or "").strip()
    low = agent.lower()
    named = len(agent) >= 12 and not low.startswith(GENERIC_AGENTS)
    if not (named and "(" in agent and ")" in agent and any(c in low for c in CONTACTS)):
        raise ValueError("a descriptive user agent with contact information is required")
    return agent


def quotas(seeds: DataFrame, target_rows: int, overfetch: float) -> DataFrame:
    """``seed_name, quota``: each seed's weighted share of the over-fetched target, rounded up, at least 1."""
    want = max(target_rows, math.ceil(target_rows * overfetch))
    total = seeds.agg(F.sum("weight").alias("total"))
    checked = F.when(F.col("total") > 0, F.ceil(F.lit(want) * F.col("weight") / F.col("total"))).otherwise(
        F.raise_error(F.lit("seed weights must sum to a positive number")).cast("bigint")
    )
    return seeds.select("seed_name", "weight").crossJoin(F.broadcast(total)).select("seed_name", F.greatest(F.lit(1), checked).cast("bigint").alias("quota"))  # one row


def discovered(pages: DataFrame) -> DataFrame:
    """Valid discovered positions, each delivered once: the earliest delivery of a page position stands."""
    key = ["seed_qid", "page_offset", "item_pos"]
    w = Window.partitionBy(*key).orderBy("ingested_at", "discovered_at", "qid")
    once = pages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.where(records.is_qid(F.trim("qid"))).withColumn("qid", F.trim("qid"))


def within_quota(found: DataFrame, seed_quotas: DataFrame) -> DataFrame:
    """The first distinct ids of each seed up to its quota, in page order: ``seed_name, qid, place``."""
    firsts = found.groupBy("seed_name", "qid").agg(F.min(F.struct("page_offset", "item_pos")).alias("at"))
    w = Window.partitionBy("seed_name").orderBy("at", "qid")
    placed = firsts.withColumn("place", F.row_number().over(w))
    return placed.join(seed_quotas, "seed_name").where("place <= quota").select("seed_name", "qid", "place")  # small side by size


def attributed(found: DataFrame) -> DataFrame:
    """``seed_name, qids``: distinct ids of each seed."""
    return found.select("seed_name", "qid").distinct().groupBy("seed_name").agg(F.count("*").alias("qids"))


def provenance(found: DataFrame) -> DataFrame:
    """``qid, seed_names, seed_instance_of_qids``: all seeds of each id, sorted, classes by number.

    Distinct pairs are formed before ids are gathered, so an id that holds a tenth of all rows brings
    one row for each seed and task.
    """
    number = F.expr("transform(array_sort(collect_set(struct(cast(substr(seed_qid, 2) as bigint) as n, seed_qid as q))), x -> x.q)")
    return (
        found.select("qid", "seed_name", "seed_qid").distinct()
        .groupBy("qid").agg(F.array_sort(F.collect_set("seed_name")).alias("seed_names"), number.alias("seed_instance_of_qids"))
    )


def unseen(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """Candidates whose id was not fetched yet; null ids are no candidates."""
    return candidates.where("qid is not null").join(fetched.select("qid").where("qid is not null"), "qid", "left_anti")


def hydrated(requests: DataFrame, entities: DataFrame, ordinal: str) -> DataFrame:
    """Entities found for requested ids, each id once per request row, in the order of ``ordinal``."""
    return requests.join(entities, "qid").orderBy(ordinal)


def stop_at_target(batches: DataFrame, target: int) -> DataFrame:
    """Rows of the batches up to the one in which the accepted rows reach ``target``.

    ``batches``: batch (in order), is_accepted.  Batches are completed, so the cut is between them; only one
    row for each batch passes through the ordered window.
    """
    per = batches.groupBy("batch").agg(F.count_if("is_accepted").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = per.withColumn("before", before).where(F.col("before") < target).select("batch")
    return batches.join(keep, "batch", "left_semi")


@dataclass
class State:
    """The resumable state; missing keys of a file have their defaults."""

    seed_offsets: dict[str, int] = field(default_factory=dict)
    exhausted_seeds: list[str] = field(default_factory=list)
    seed_candidate_quotas: dict[str, int] = field(default_factory=dict)
    accepted_rows: int = 0
    target_rows: int = 0

    @classmethod
    def load(cls, path: str) -> "State":
        try:
            known = json.loads(read_text(path))
        except FileNotFoundError:
            return cls()
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        """Written beside the file and moved over it, so it is never half there."""
        write_text(path, json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, indent=2))


#: ``discover(seed class, offset, limit) -> ids``; ``fetch(ids) -> entity documents in the order asked``.
Discover = Callable[[str, int, int], list[str]]
Fetch = Callable[[list[str]], list[dict]]


def crawl(
    spark: SparkSession, seeds: list[tuple[str, str, int]], discover: Discover, fetch: Fetch, out_dir: str,
    target_rows: int, overfetch: float = 1.25, page_size: int = 500, max_factor: float = 4.0, batch_size: int = 50,
) -> State:
    """Acquire ``target_rows`` accepted records: weighted quotas first, then bounded round-robin spill-over.

    Only control flow runs here; pages hold at most ``page_size`` ids and are fetched ``batch_size`` at a time, until
    the batch that reaches the target.  A seed's quota counts the distinct ids attributed to it.  New records
    are appended to Parquet after an anti join with what is there, so a repeated run fetches nothing again.
    """
    state = State.load(f"{out_dir}/state.json")
    entities, pages = f"{out_dir}/entities.parquet", f"{out_dir}/pages.parquet"
    total = sum(w for *_, w in seeds)
    if total <= 0:
        raise ValueError("seed weights must sum to a positive number")
    want = max(target_rows, math.ceil(target_rows * overfetch))
    state.seed_candidate_quotas = {n: max(1, math.ceil(want * w / total)) for n, _, w in seeds}
    state.target_rows = target_rows
    limit = max(sum(state.seed_offsets.values()), math.ceil(target_rows * max_factor))

    def page(name: str, seed: str, n: int) -> int:
        at = state.seed_offsets.get(name, 0)
        ids = discover(seed, at, n)
        if len(ids) < n:
            state.exhausted_seeds = sorted({*state.exhausted_seeds, name})
        if ids:
            state.seed_offsets[name] = at + len(ids)
            rows = [(name, seed, at, i, q) for i, q in enumerate(ids)]
            found = spark.createDataFrame(rows, "seed_name string, seed_qid string, page_offset long, item_pos int, qid string")
            found.write.mode("append").parquet(pages)
            fresh = found.where(records.is_qid(F.col("qid"))).dropDuplicates(["qid"])
            if exists(spark, entities):
                fresh = unseen(fresh, spark.read.parquet(entities))
            missing = {r.qid for r in fresh.select("qid").collect()}  # at most one page
            wanted = [q for q in dict.fromkeys(ids) if q in missing]
            for lo in range(0, len(wanted), batch_size):
                if state.accepted_rows >= target_rows:
                    break
                got = fetch(wanted[lo : lo + batch_size])
                if got:
                    raw = records.from_entities(
                        spark.createDataFrame([(json.dumps(e),) for e in got], "j string")
                        .select(F.from_json("j", schemas.ENTITY).alias("e")).select("e.*")
                    ).where("error is null").drop("error")
                    raw.write.mode("append").parquet(entities)
                    state.accepted_rows += records.canonicalize(raw).where("reject_reason is null").count()
                state.save(f"{out_dir}/state.json")
        state.save(f"{out_dir}/state.json")
        return len(ids)

    def attributed_to(name: str) -> int:
        if not exists(spark, pages):
            return 0
        own = spark.read.parquet(pages).where((F.col("seed_name") == name) & records.is_qid(F.col("qid")))
        return own.agg(F.count_distinct("qid")).first()[0]

    for name, seed, _ in seeds:
        have = attributed_to(name)
        while have < state.seed_candidate_quotas[name] and state.accepted_rows < target_rows and name not in state.exhausted_seeds:
            page(name, seed, min(page_size, state.seed_candidate_quotas[name] - have))
            before, have = have, attributed_to(name)
            if have <= before:
                break
    moved = True
    while moved and state.accepted_rows < target_rows and sum(state.seed_offsets.values()) < limit:
        moved = False
        for name, seed, _ in seeds:
            room = limit - sum(state.seed_offsets.values())
            if state.accepted_rows >= target_rows or room <= 0:
                break
            if name not in state.exhausted_seeds:
                moved |= page(name, seed, min(page_size, room)) > 0
    state.save(f"{out_dir}/state.json")
    if state.accepted_rows < target_rows:
        raise AcquisitionShortfall(f"accepted {state.accepted_rows} of {target_rows} records")
    return state
