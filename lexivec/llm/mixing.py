"""Problem 6: mix sources to target weights of a total size.

Method: Sainte-Laguë apportionment.  The budget is cut into blocks of equal tokens;
blocks go to the sources with the highest quotients ``weight / (2 * given + 1)`` up to
what a source can give with its capped repetitions, then each source's blocks go to its
shards in the same way.  In a shard, texts are taken in a seeded order until its quota is full.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.tokens import DEFAULT_VOCABULARY, token_count
from lexivec.session import cut_lineage, spread_out

BLOCK_TOKENS = 1024
SHARD_TOKENS = 4_000_000
MAX_SHARDS = 65_536  # beyond it shards grow, as sorting spills; their sizes are collected
FEW_SOURCES = 10_000  # listed by name in the filter and broadcast; more are joined

PLAN = (
    "source string, target_weight double, max_uses int, target_tokens double, available_tokens bigint, "
    "capacity_tokens bigint, blocks bigint, planned_tokens bigint"
)


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients ``w / (2a + 1)``, with at most ``most[i]`` for each; ties to the first.

    The divisor is found by bisection, so the time does not grow with the number of seats; the
    few seats left near the divisor are given one by one.  Where all are at their most, seats
    stay unassigned.
    """
    n = len(weights)
    seats = min(seats, sum(m for w, m in zip(weights, most) if w > 0))
    if seats <= 0 or not any(w > 0 for w in weights):
        return [0] * n
    lo, hi = 0.0, 2.0 * (seats + 1) / min(w for w in weights if w > 0)

    def given(x: float) -> list[int]:
        return [min(m, int(w * x + 0.5)) if w > 0 else 0 for w, m in zip(weights, most)]

    while sum(given(hi)) < seats:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(given(mid)) <= seats:
            lo = mid
        else:
            hi = mid
    out = given(lo)
    heap = [(-w / (2 * a + 1), i) for i, (w, a, m) in enumerate(zip(weights, out, most)) if w > 0 and a < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def apportion(budget: int, block: int, weights: list[float], capacity: list[int]) -> tuple[list[int], list[int]]:
    """Blocks and tokens for each source; the last block of a source may be a part.

    What is less than a block, or what such parts leave, goes out last by the same quotients.
    """
    blocks = sainte_lague(weights, budget // block, [-(-c // block) for c in capacity])
    tokens = [min(b * block, c) for b, c in zip(blocks, capacity)]
    while (left := budget - sum(tokens)) > 0:
        open_ = [i for i, w in enumerate(weights) if w > 0 and tokens[i] < capacity[i]]
        if not open_:
            break
        i = max(open_, key=lambda i: (weights[i] / (2 * tokens[i] / block + 1), -i))
        tokens[i] += min(left, block, capacity[i] - tokens[i])
    return blocks, tokens


class Mixture:
    """A planned mixture: ``report`` and ``rows`` are DataFrames."""

    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str, block: int, shard_tokens: int, seed: int):
        spark = docs.sparkSession
        listed = (
            targets.where(F.col("source").isNotNull())
            .groupBy("source")
            .agg(
                F.coalesce(F.sum("target_weight"), F.lit(0.0)).alias("w"),
                F.coalesce(F.max("max_uses"), F.lit(1)).alias("u"),
                F.coalesce(F.max("budget_tokens"), F.lit(0)).alias("b"),
            )
            .orderBy("source")
            .collect()
        )
        names = [r.source for r in listed]
        self.few = len(names) <= FEW_SOURCES
        if self.few:
            own = docs.where(F.col("source").isin(names))
        else:
            own = docs.join(targets.where(F.col("source").isNotNull()).select("source").distinct(), "source", "left_semi")
        self.sized = cut_lineage(
            spread_out(own.select("doc_id", "source", "text")).select(
                # tells rows without an id apart, so that they are not all in one shard
                "doc_id", "source", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"),
                token_count(F.col("text"), vocabulary).alias("n_tokens"),
            )
        )
        have = {r.source: r.t for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        tokens = [have.get(s, 0) for s in names]
        capacity = [t * max(0, r.u) for t, r in zip(tokens, listed)]
        budget = max([0, *(r.b for r in listed)])
        weights = [max(0.0, r.w) for r in listed]
        self.block, self.seed = block, seed
        self.blocks, self.quota = apportion(budget, block, weights, capacity)
        self.plan = [
            (r.source, float(r.w), int(r.u), float(r.w * budget), t, c, b, q)
            for r, t, c, b, q in zip(listed, tokens, capacity, self.blocks, self.quota)
        ]
        shard = max(shard_tokens, sum(tokens) // MAX_SHARDS)
        self.listed = {
            r.source: (int(r.u), q, max(1, -(-t // shard)))
            for r, t, q in zip(listed, tokens, self.quota)
            if q > 0
        }

    @property
    def report(self) -> DataFrame:
        """What each target source gives: planned blocks, and tokens and share of the mixture that was drawn.

        ``missed`` sources stay under their target, ``short`` ones because they have not enough.
        """
        plan = self.sized.sparkSession.createDataFrame(self.plan, PLAN)
        drawn = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("drawn"))
        total = drawn.agg(F.sum("drawn").alias("whole"))
        return (
            plan.join(drawn, "source", "left").crossJoin(F.broadcast(total))  # one row
            .select(
                "source", "target_weight", "max_uses", "target_tokens", "available_tokens", "capacity_tokens", "blocks",
                F.coalesce("drawn", F.lit(0)).alias("mixed_tokens"),
                (F.coalesce("drawn", F.lit(0)) / F.col("whole")).alias("actual_share"),
                (F.col("capacity_tokens") < F.col("target_tokens")).alias("short"),
                (F.coalesce("drawn", F.lit(0)) < F.col("target_tokens")).alias("missed"),
            )
        )

    @property
    def rows(self) -> DataFrame:
        """``source, doc_id, use_no, n_tokens``: each use of each text, with the tokens taken of it.

        A text is taken whole but for the last of a shard, which is cut where the quota ends.
        Texts without tokens are never taken.
        """
        spark = self.sized.sparkSession
        plan = spark.createDataFrame(
            [(s, *v) for s, v in self.listed.items()], "source string, uses int, quota bigint, shards int"
        )
        # at most FEW_SOURCES rows are broadcast
        small = self.sized.where("n_tokens > 0").join(F.broadcast(plan) if self.few else plan, "source")
        placed = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", F.lit(self.seed)), "shards").cast("int"))
        shards = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect()
        quotas = []
        by_source: dict[str, list] = {}
        for r in sorted(shards, key=lambda r: (r.source, r.shard)):
            by_source.setdefault(r.source, []).append(r)
        for s, parts in by_source.items():
            uses, quota, _ = self.listed[s]
            _, tokens = apportion(quota, self.block, [float(p.t) for p in parts], [p.t * uses for p in parts])
            quotas += [(s, p.shard, q, p.t) for p, q in zip(parts, tokens)]
        shard_plan = spark.createDataFrame(quotas, "source string, shard int, shard_quota bigint, shard_tokens bigint")
        w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "row", F.lit(self.seed + 1)), "doc_id", "row", "n_tokens")
        run = (
            placed.join(F.broadcast(shard_plan) if self.few else shard_plan, ["source", "shard"])  # <= MAX_SHARDS + FEW_SOURCES rows
            .withColumn("before", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("before", F.coalesce("before", F.lit(0)))
            # no more uses than the shard's quota asks for
            .withColumn("needed", F.expr("least(uses, int(ceil(shard_quota / shard_tokens)))"))
            .where("needed > 0")
            .withColumn("use_no", F.explode(F.expr("sequence(1, needed)")))
            .withColumn("start", F.expr("(use_no - 1) * shard_tokens + before"))
            .where("start < shard_quota")
        )
        return run.select(
            "source", "doc_id", "use_no", F.expr("least(n_tokens, shard_quota - start)").alias("n_tokens")
        )


def mix(
    docs: DataFrame,
    targets: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    block: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = 42,
) -> Mixture:
    """Plan the mixture of ``docs`` (doc_id, source, text) at ``targets``.

    Target sources without texts have 0 tokens; what short sources cannot give goes to the others
    by their quotients, so the budget is reached where the sources together can.  Texts of
    unlisted or null sources take no part.  Targets of one source are added up, a null weight
    counts as 0, a null number of uses as 1; an empty target or text table gives an empty mixture.
    """
    return Mixture(docs, targets, vocabulary, block, shard_tokens, seed)
