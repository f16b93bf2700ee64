"""Problem 4: a sample whose categories have given proportions.

Method: calibration.  Entities are grouped by the set of categories they belong to.
Newton iterations on the dual of the exponential-tilting problem find inclusion
probabilities whose category totals are the targets; each iteration sums the category
moments over the group table in its partitions.  The pivotal method draws the sample
with these probabilities, floors are fixed up, and gaps are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import cut_lineage

#: The dual's matrix is categories x categories; with more categories only its diagonal is used.
FULL_MATRIX = 2000
#: The largest difference between a category's expected number and its goal.
TOLERANCE = 0.01
BLOCK_ROWS = 50_000
MOMENT_ROWS = 200_000  # groups of one task of a Newton iteration
SEED = 42

REPORT = (
    "seed_name string, weight bigint, entities bigint, target bigint, sampled bigint, "
    "target_share double, sampled_share double, calibrated double, residual double, rounds int, short boolean, missed boolean"
)


def trimmed(col):
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


@dataclass
class Categories:
    names: list[str]
    weights: list[int]
    rows: DataFrame  # class string, k int


def read_categories(seeds: DataFrame) -> Categories:
    """The category table; rows of one name are one category with their weights added, null names are left out."""
    rows = seeds.where("seed_name is not null").collect()  # as small as the list of categories
    weights: dict[str, int] = {}
    for r in rows:
        weights[r.seed_name] = weights.get(r.seed_name, 0) + max(0, r.weight or 0)
    names = sorted(weights)
    at = {n: k for k, n in enumerate(names)}
    pairs = sorted({(r.instance_of_qid.strip(), at[r.seed_name]) for r in rows if r.instance_of_qid is not None})
    frame = seeds.sparkSession.createDataFrame(pairs, "class string, k int")
    return Categories(names, [weights[n] for n in names], frame)


def classed_entities(records: DataFrame, categories: Categories) -> DataFrame:
    """``qid, groups``: each entity in a category, with the sorted numbers of its categories.

    A row counts if its qid is not null and a label is not blank; an entity has the classes of all
    its counting rows.  Rows are reduced to distinct (qid, category) before the shuffle's merge, so a
    qid that holds very many rows reaches its reducer as one row per task.
    """
    filled = [F.coalesce(trimmed(F.col(c)), F.lit("")) != "" for c in ("label_en", "label_vi")]
    rows = (
        records.where(F.col("qid").isNotNull() & (filled[0] | filled[1]))
        .select(trimmed(F.col("qid")).alias("qid"), F.explode("instance_of_qids").alias("class"))
        .select("qid", trimmed(F.col("class")).alias("class"))
    )
    return (
        rows.join(categories.rows, "class")  # broadcast as far as Spark's threshold for sizes goes
        .groupBy("qid")
        .agg(F.array_sort(F.collect_set("k")).alias("groups"))
    )


class Calibration:
    """Inclusion probabilities of groups: ``min(1, base * exp(sum of the categories' multipliers))``."""

    def __init__(self, groups: DataFrame, weights: list[int], floor: int, fraction: int, iterations: int = 40):
        self.k = k = len(weights)
        self.full = k <= FULL_MATRIX
        self.groups = groups  # groups array<int>, n bigint
        self.forced: list[int] = []
        base = self._moments(np.zeros(k), 1.0)
        self.population = int(round(base["size"]))
        self.entities = np.rint(base["total"]).astype(np.int64)
        self.size = self.population // fraction
        total = max(1, sum(weights))
        self.targets = np.array([max(floor, -(-self.size * w // total)) for w in weights], dtype=np.int64)
        self.floors = np.minimum(floor, self.entities)
        self.multipliers = np.zeros(k)
        self.base = self.size / self.population if self.population else 0.0
        self.rounds, self.residual, self.expected = 0, 0.0, np.zeros(k)
        if not self.size:
            return
        share = np.array([self.size * w / total for w in weights])
        self.forced = np.flatnonzero(self.entities <= self.targets).tolist()
        at_floor = share < floor
        free = np.array([i for i in range(k) if i not in set(self.forced)], dtype=np.int64)
        if not len(free):
            return
        lam = np.zeros(k)
        want = np.where(at_floor, floor, share)
        lam[free] = np.log(want[free] / (self.entities[free] * self.base))
        scale = 1.0

        def residual(m, scale):
            goal = np.where(at_floor, floor, scale * share)
            return np.append(m["total"][free] - goal[free], m["size"] - self.size)

        m = self._moments(lam, self.base)
        r = residual(m, scale)
        while np.abs(r).max() > TOLERANCE and self.rounds < (iterations if self.full else 10 * iterations):
            self.rounds += 1
            step = self._step(m, r, free, np.where(at_floor[free], 0.0, share[free]))
            t = min(1.0, 2.0 / max(1e-12, np.abs(step[:-1]).max()))
            for _ in range(8):
                trial = lam.copy()
                trial[free] += t * step[:-1]
                m2 = self._moments(trial, self.base)
                r2 = residual(m2, scale + t * step[-1])
                if np.abs(r2).sum() < np.abs(r).sum():
                    break
                t /= 2
            else:
                break
            lam, scale, m, r = trial, scale + t * step[-1], m2, r2
        self.multipliers, self.expected, self.residual = lam, m["total"], float(np.abs(r).max())

    def _step(self, m: dict, r: np.ndarray, free: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The Newton step of the free multipliers and of the scale of the goals ``share``."""
        if self.full:
            jac = np.zeros((len(free) + 1, len(free) + 1))
            jac[:-1, :-1] = m["cross"][np.ix_(free, free)]
            jac[-1, :-1] = m["slope"][free]
            jac[:-1, -1] = -share
            return np.linalg.lstsq(jac, -r, rcond=1e-10)[0]
        # with the diagonal alone the scale follows from the sum of the equations
        scale = (r[:-1].sum() - r[-1]) / max(1e-12, share.sum())
        return np.append((share * scale - r[:-1]) / np.maximum(1e-12, m["slope"][free]), scale)

    def _moments(self, lam: np.ndarray, base: float) -> dict:
        """Sizes, category totals and the dual's matrix, summed in the partitions of the group table."""
        k, full = self.k, self.full
        forced = np.zeros(k, dtype=bool)
        forced[self.forced] = True

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, total, slope, cross = 0.0, np.zeros(k), np.zeros(k), np.zeros(k * k if full else 0)
            for batch in batches:
                lists, n = batch["groups"], batch["n"].to_numpy()
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
                lengths = np.diff(offsets)
                for length in np.unique(lengths[lengths > 0]).tolist():
                    at = np.flatnonzero(lengths == length)
                    members = flat[(offsets[at] - offsets[0])[:, None] + np.arange(length)]
                    p = np.minimum(1.0, base * np.exp(np.minimum(700.0, lam[members].sum(axis=1))))
                    p[forced[members].any(axis=1)] = 1.0
                    mass = n[at] * p
                    inner = np.where(p < 1.0, mass, 0.0)
                    size += mass.sum()
                    for a in range(length):
                        total += np.bincount(members[:, a], mass, k)
                        slope += np.bincount(members[:, a], inner, k)
                        for b in range(length if full else 0):
                            np.add.at(cross, members[:, a] * k + members[:, b], inner)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([size], total, slope, cross)).tolist()], pa.list_(pa.float64()))], ["v"])

        rows = self.groups.mapInArrow(partial, "v array<double>").collect()  # one for each task
        v = np.sum([r.v for r in rows], axis=0) if rows else np.zeros(1 + 2 * k + (k * k if full else 0))
        out = {"size": v[0], "total": v[1 : 1 + k], "slope": v[1 + k : 1 + 2 * k]}
        return out | ({"cross": v[1 + 2 * k :].reshape(k, k)} if full else {})

    def probability(self, groups: str):
        """The inclusion probability as a column expression of the array column ``groups``."""
        lam = F.array(*[F.lit(float(x)) for x in self.multipliers])
        total = F.aggregate(groups, F.lit(0.0), lambda acc, i: acc + F.get(lam, i))
        free = F.least(F.lit(1.0), F.lit(self.base) * F.exp(total))
        if not self.forced:
            return free
        forced = F.array(*[F.lit(i) for i in self.forced])
        return F.when(F.arrays_overlap(groups, forced), F.lit(1.0)).otherwise(free)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sequential pivotal sampling: which units are taken, with probabilities ``p``.

    Neighbours duel until one of them is decided, so totals of neighbouring units stay within
    one of their expectation.  Duels of units of equal probability in random order draw every subset of the
    same size alike; so in a block of such units the first ones of a random order are taken, and
    only what each block leaves undecided duels here.
    """
    p = p.astype(float)
    taken = p >= 1 - 1e-9
    held = -1
    for i in np.flatnonzero((p > 1e-9) & ~taken).tolist():
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        u = rng.random()
        if a + b < 1:
            win, lose = (held, i) if u < a / (a + b) else (i, held)
            p[win], p[lose] = a + b, 0.0
            held = win
        else:
            win, lose = (held, i) if u < (1 - b) / (2 - a - b) else (i, held)
            p[win], p[lose] = 1.0, a + b - 1
            taken[win] = True
            held = lose
        if p[held] <= 1e-9 or p[held] >= 1 - 1e-9:
            taken[held] |= p[held] >= 1 - 1e-9
            held = -1
    if held >= 0:
        taken[held] = rng.random() < p[held]
    return taken


class Sample:
    """A drawn sample: ``rows`` (qid, groups as category names) and ``report``."""

    def __init__(self, records: DataFrame, seeds: DataFrame, fraction: int, floor: int, seed: int):
        spark = records.sparkSession
        categories = read_categories(seeds)
        k = len(categories.names)
        entities = cut_lineage(classed_entities(records, categories))
        groups = cut_lineage(entities.groupBy("groups").agg(F.count("*").alias("n")))
        tasks = max(1, -(-groups.count() // MOMENT_ROWS))
        self.calibration = cal = Calibration(groups.coalesce(tasks), categories.weights, floor, fraction)

        # blocks: a group, salted where it is large; in a block all have the same probability
        large = groups.where(F.col("n") > BLOCK_ROWS).select("groups", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("salts"))
        units = (
            entities.join(F.broadcast(large), "groups", "left")  # at most entities / BLOCK_ROWS rows
            .select(
                "qid", "groups", cal.probability("groups").alias("p"),
                F.pmod(F.xxhash64("qid", F.lit(seed)), F.coalesce("salts", F.lit(1))).alias("salt"),
            )
        )
        order = Window.partitionBy("groups", "salt").orderBy(F.xxhash64("qid", F.lit(seed + 1)), "qid")
        ranked = units.withColumn("place", F.row_number().over(order))
        shares = units.groupBy("groups", "salt").agg((F.count("*") * F.max("p") + 1e-7).alias("due"))
        # duels inside a block of equal probabilities leave whole units and one undecided one
        last = cut_lineage(shares.withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole")))

        def duel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = list(batches)
            if not frames:
                return
            left = pd.concat(frames)
            left = left.iloc[np.argsort(_order(left), kind="stable")]
            won = pivotal(np.where(left["p"] < 1e-6, 0.0, left["p"]), np.random.default_rng(seed))
            yield pd.DataFrame({"groups": left["groups"], "salt": left["salt"], "take": left["whole"] + won})

        # one row for each block, so the final duels fit one task
        takes = last.coalesce(1).mapInPandas(duel, "groups array<int>, salt bigint, take bigint")
        drawn = ranked.join(takes, ["groups", "salt"]).select("qid", "groups", (F.col("place") <= F.col("take")).alias("taken"))
        drawn = cut_lineage(drawn)
        counts = self._counts(drawn, k)
        short = np.flatnonzero(counts < cal.floors)
        if len(short):
            drawn, counts = self._fix_floors(drawn, counts, cal.floors, short, seed)
        names = F.array(*[F.lit(n) for n in categories.names])
        self.rows = drawn.where("taken").select(
            "qid", F.transform("groups", lambda i: F.get(names, i)).alias("seed_names")
        )
        total_weight = max(1, sum(categories.weights))
        size = drawn.where("taken").count()
        forced = set(cal.forced)
        rows = [
            (
                categories.names[i],
                int(categories.weights[i]),
                int(cal.entities[i]),
                int(cal.targets[i]),
                int(counts[i]),
                categories.weights[i] / total_weight,
                float(counts[i]) / size if size else None,
                float(cal.entities[i] if i in forced else cal.expected[i]),
                cal.residual,
                cal.rounds,
                bool(cal.entities[i] < cal.targets[i]),
                bool(counts[i] < cal.targets[i]),
            )
            for i in range(k)
        ]
        self.report = spark.createDataFrame(rows, REPORT)

    @staticmethod
    def _counts(drawn: DataFrame, k: int) -> np.ndarray:
        out = np.zeros(k, dtype=np.int64)
        taken = drawn.where("taken").select(F.explode("groups").alias("k")).groupBy("k").count().collect()
        for r in taken:
            out[r.k] = r["count"]
        return out

    def _fix_floors(self, drawn: DataFrame, counts: np.ndarray, floors: np.ndarray, short: np.ndarray, seed: int):
        """Swap a few entities so that every category has its floor and the size stays; two passes over the draw."""
        counts = counts.copy()
        lot = F.xxhash64("qid", F.lit(seed + 2))
        missing = {int(i): int(floors[i] - counts[i]) for i in short}
        by_lot = Window.partitionBy("k").orderBy(lot, "qid")
        wanted = F.element_at(F.create_map(*[F.lit(x) for kv in missing.items() for x in kv]), F.col("k"))
        # an entity taken for another category lessens what is missing, so as many as are missing are enough
        pool = (
            drawn.where(~F.col("taken")).select("qid", "groups", F.explode("groups").alias("k"))
            .where(F.col("k").isin(list(missing))).withColumn("nth", F.row_number().over(by_lot)).where(F.col("nth") <= wanted)
        )
        add: set[str] = set()
        for r in sorted(pool.collect(), key=lambda r: (r.k, r.nth)):  # at most floor x categories rows
            if counts[r.k] < floors[r.k] and r.qid not in add:
                add.add(r.qid)
                counts[r.groups] += 1
        drop: set[str] = set()
        spare = counts - np.maximum(self.calibration.targets, floors)
        givers: list[int] = []
        for i in np.argsort(-spare, kind="stable").tolist():
            if sum(counts[g] - floors[g] for g in givers) < 2 * len(add) and counts[i] > floors[i]:
                givers.append(i)
        if add and givers:
            only = (
                drawn.where("taken").where(F.size("groups") == 1).select("qid", F.get("groups", F.lit(0)).alias("k"))
                .where(F.col("k").isin(givers)).withColumn("nth", F.row_number().over(by_lot)).where(F.col("nth") <= len(add))
            )
            rank = {g: n for n, g in enumerate(givers)}
            for r in sorted(only.collect(), key=lambda r: (rank[r.k], r.nth)):
                if len(drop) < len(add) and counts[r.k] > floors[r.k]:
                    drop.add(r.qid)
                    counts[r.k] -= 1
        # at most floor x categories ids
        return drawn.withColumn(
            "taken", (F.col("taken") | F.col("qid").isin(sorted(add))) & ~F.col("qid").isin(sorted(drop))
        ), counts


def _order(left: pd.DataFrame) -> np.ndarray:
    keys = [(*g, -1, s) for g, s in zip(left["groups"], left["salt"])]
    rank = {key: i for i, key in enumerate(sorted(keys))}
    return np.array([rank[key] for key in keys])


def calibrated_sample(
    records: DataFrame, seeds: DataFrame, fraction: int = 5, floor: int = 5, seed: int = SEED
) -> Sample:
    """Draw one ``fraction``-th of the entities of ``records`` with the shares of ``seeds``.

    Every category gets at least ``floor`` entities or all it has; categories that have fewer than
    their target give all.  What they lack goes to the others, which keep their proportions, so the
    sample has its size wherever possible.  An entity of several categories counts for each of them.
    Null qids, blank labels and null classes do not count, repeated rows count once; weights that are null
    count as 0; empty tables give an empty sample; other columns are ignored.
    """
    return Sample(records, seeds, fraction, floor, seed)
