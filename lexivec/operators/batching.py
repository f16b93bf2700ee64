"""Micro-batches, admission and placement: ordered folds over the items of one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ITEMS = 16
MAX_TOKENS = 512
QUEUE_TOKENS = 32_768


def batch_starts(tokens: Column, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS) -> Column:
    """For each item of an ordered array of token estimates, the number of its micro-batch, from 0.

    A batch costs its items times its largest estimate.  It is closed before an item that would exceed a
    limit and after one that reaches it; an item over the limit is a batch of its own.
    """
    if max_items < 1 or max_tokens < 1:
        raise ValueError("batch limits must be positive")
    state = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("top"), F.lit(-1).alias("batch"), F.lit(True).alias("closed"),
        F.array().cast("array<int>").alias("out"),
    )

    def step(s: Column, t: Column) -> Column:
        one = F.greatest(F.lit(1).cast("bigint"), t.cast("bigint"))
        top = F.greatest(s["top"], one)
        over = (s["n"] + 1 > max_items) | ((s["n"] + 1) * top > max_tokens)
        fresh = s["closed"] | over
        n = F.when(fresh, F.lit(1)).otherwise(s["n"] + 1)
        largest = F.when(fresh, one).otherwise(top)
        batch = F.when(fresh, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(
            n.alias("n"), largest.alias("top"), batch.alias("batch"),
            ((n >= max_items) | (n * largest >= max_tokens)).alias("closed"),
            F.concat(s["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(tokens, state, step, lambda s: s["out"])


def micro_batches(
    items: DataFrame, request: str, index: str, tokens: str, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """``request, index, tokens, batch``: the micro-batch of each item within its request.

    A request is bounded by the service's item limit, so its items fit one array.
    """
    ordered = items.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(F.col(index), F.col(tokens)))).alias("x"))
    numbered = ordered.withColumn("b", batch_starts(F.transform("x", lambda s: s[tokens]), max_items, max_tokens))
    return numbered.select(request, F.explode(F.arrays_zip("x", "b")).alias("z")).select(
        request, F.col("z.x")[index].alias(index), F.col("z.x")[tokens].alias(tokens), F.col("z.b").alias("batch")
    )


def batch_costs(batched: DataFrame, request: str, tokens: str) -> DataFrame:
    """``items, cost`` of each micro-batch; the cost counts padding."""
    return batched.groupBy(request, "batch").agg(
        F.count("*").alias("items"), (F.count("*") * F.max(F.greatest(F.lit(1).cast("bigint"), F.col(tokens)))).alias("cost")
    )


def admissions(costs: Column, capacity: int = QUEUE_TOKENS) -> Column:
    """Which of an ordered array of costs are admitted: each while the admitted ones together fit the capacity."""
    state = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        ok = s["used"] + c <= capacity
        return F.struct(
            F.when(ok, s["used"] + c).otherwise(s["used"]).alias("used"), F.concat(s["out"], F.array(ok)).alias("out")
        )

    return F.aggregate(F.transform(costs, lambda c: c.cast("bigint")), state, step, lambda s: s["out"])


def placements(costs: Column, workers: int) -> Column:
    """The worker of each cost of an ordered array: the least loaded so far, the lowest number on ties."""
    if workers < 1:
        raise ValueError("at least one worker")
    state = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), workers).alias("load"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, c: Column) -> Column:
        at = F.array_position(s["load"], F.array_min(s["load"]))
        load = F.transform(s["load"], lambda x, i: F.when(i == at - 1, x + c).otherwise(x))
        return F.struct(load.alias("load"), F.concat(s["out"], F.array((at - 1).cast("int"))).alias("out"))

    return F.aggregate(F.transform(costs, lambda c: c.cast("bigint")), state, step, lambda s: s["out"])


def chunks(df: DataFrame, partition: str, order: str, size: int) -> DataFrame:
    """``chunk``: runs of ``size`` rows within a partition; the last may be short."""
    w = Window.partitionBy(partition).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def missing_items(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a result; none may be left when requests are put together again."""
    return expected.join(done, keys, "left_anti").select(*keys)
