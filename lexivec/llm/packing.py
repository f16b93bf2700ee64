"""Problem 5: fill fixed-capacity containers with whole items.

Method: bin completion.  The items are spread over independent pools of bounded
size.  In a pool, a branch-and-bound search takes the largest open item, enumerates
the undominated fillings of its container and prunes by a bound on waste; the
best-fit-decreasing solution is the first incumbent.  A pool whose incumbent meets
the lower bound is solved without search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.tokens import DEFAULT_VOCABULARY, token_count
from lexivec.session import spread_out

POOL_ITEMS = 8192
#: The search may open this many times the containers of a packing, so that it completes some.
DIVES = 4
PACKED = "container string, part int, n_tokens int"


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of sizes) by best fit, largest item first. ``counts[s]``: items of size s."""
    rooms = np.zeros(capacity + 1, dtype=np.int64)  # open containers by room left
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                box = by_room[room].pop()
                rooms[room] -= 1
            else:
                room, box = capacity, []
                out.append(box)
            k = 1 if room < capacity else min(left, room // size)
            box.extend([size] * k)
            left -= k
            room -= k * size
            by_room[room].append(box)
            rooms[room] += 1
    return out


def dominates(better: list[int], worse: list[int]) -> bool:
    """Whether the items of ``worse`` fit into containers of the sizes of ``better``."""
    if sum(worse) > sum(better):
        return False
    worse = sorted(worse, reverse=True)

    def place(k: int, rooms: tuple[int, ...]) -> bool:
        if k == len(worse):
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= worse[k] and room not in tried:
                tried.add(room)
                if place(k + 1, (*rooms[:i], room - worse[k], *rooms[i + 1 :])):
                    return True
        return False

    return place(0, tuple(better))


def completions(counts: np.ndarray, room: int, most_waste: int, keep: int, steps: int) -> list[list[int]]:
    """Undominated maximal fillings of ``room``, least waste first.

    Fillings that waste more than ``most_waste`` are pruned.  At most ``steps`` partial
    fillings are visited and ``keep`` returned; the search stays correct, as its incumbent
    is always a full packing, but beyond these it may miss the optimum.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not sizes:
        return [[]] if room <= most_waste else []
    found: list[list[int]] = []
    left = {s: int(counts[s]) for s in sizes}
    visited = 0

    def fill(i: int, space: int, chosen: list[int]) -> None:
        nonlocal visited
        visited += 1
        if visited > steps or len(found) >= 4 * keep:
            return
        grew = False
        for k in range(i, len(sizes)):
            s = sizes[k]
            if s <= space and left[s]:
                grew = True
                left[s] -= 1
                chosen.append(s)
                fill(k, space - s, chosen)
                chosen.pop()
                left[s] += 1
                if visited > steps or (found and sum(found[-1]) == room):
                    return
        if not grew and space <= most_waste:
            # maximal only if no larger open size was skipped
            if not any(s <= space and left[s] for s in sizes[:i]):
                found.append(chosen.copy())

    fill(0, room, [])
    found.sort(key=lambda f: -sum(f))
    out: list[list[int]] = []
    for f in found:
        if not any(dominates(o, f) for o in out):
            out.append(f)
        if len(out) == keep:
            break
    return out


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 2000, keep: int = 8) -> list[list[int]]:
    """The fewest containers found for items with ``counts[s]`` items of size s, 1 <= s <= capacity.

    ``nodes``, or DIVES whole packings if those are more, bounds the containers opened by the search; the result is a
    whole packing in any case.
    """
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    best = best_fit_decreasing(counts, capacity)
    nodes = max(nodes, DIVES * len(best))
    least = -(-total // capacity)
    big = int(counts[capacity // 2 + 1 :].sum())  # no two of these share a container
    least = max(least, big)
    spent = 0
    open_counts = counts.copy()

    def search(done: list[list[int]], remaining: int, waste: int) -> None:
        nonlocal best, spent
        # each level closes one container; an explicit stack keeps depth unbounded
        stack: list[tuple[int, Iterator[list[int]], int, list[int] | None]] = []

        def options(rest: int, lost: int) -> tuple[int, Iterator[list[int]]]:
            largest = int(np.flatnonzero(open_counts)[-1])
            open_counts[largest] -= 1
            allowed = (len(best) - 1) * capacity - total - lost
            found = completions(open_counts, capacity - largest, allowed, keep, 400) if allowed >= 0 else []
            return largest, iter(found)

        def undo(box: list[int] | None) -> None:
            if box:
                for s in box:
                    open_counts[s] += 1

        largest, it = options(remaining, waste)
        stack.append((largest, it, waste, None))
        while stack:
            largest, it, lost, taken = stack[-1]
            if taken is not None:
                undo(taken)
                done.pop()
                stack[-1] = (largest, it, lost, None)
            spent += 1
            pick = next(it, None) if spent <= nodes and len(best) > least else None
            if pick is None:
                open_counts[largest] += 1
                stack.pop()
                continue
            lost_now = lost + capacity - largest - sum(pick)
            if lost_now > (len(best) - 1) * capacity - total:
                continue
            for s in pick:
                open_counts[s] -= 1
            done.append([largest, *pick])
            stack[-1] = (largest, it, lost, pick)
            if not open_counts.any():
                if len(done) < len(best):
                    best = [b.copy() for b in done]
            elif len(done) + 1 < len(best):
                nxt, more = options(0, lost_now)
                stack.append((nxt, more, lost_now, None))

    if len(best) > least:
        search([], total, 0)
    return best


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    pool_items: int = POOL_ITEMS,
    nodes: int = 2000,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Assign every text to containers of ``capacity`` tokens.

    One row per text, or per part of a text that alone is over the capacity:
    ``id_col, container, part, n_tokens``.  Parts of oversized texts fill containers of their own,
    but for the last part, which is packed with the other items.  Null and empty texts have no
    tokens: they come out with a null container and 0 tokens.  Repeated rows are packed each;
    ties and null ids do not matter; other columns are ignored.

    Only ids and sizes are shuffled, once, into pools of about ``pool_items`` rows chosen by a
    hash of id and text (of their place for rows without an id), so no id, source or size can make a pool large.  A pool leaves at most
    one container badly filled, a share of about ``1 / containers per pool``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    pools = max(1, -(-df.count() // pool_items))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = spread_out(rows).select(
        "id",
        # rows without an id may hold one text very often
        F.pmod(F.xxhash64("id", "text", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), F.lit(pools)).cast("int").alias("pool"),
        token_count(F.col("text"), vocabulary).alias("n"),
    )

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("id", "ascending")])
        pool = group["pool"][0].as_py()
        sizes = group["n"].to_numpy()
        full = sizes // capacity
        rest = sizes - full * capacity
        counts = np.bincount(rest, minlength=capacity + 1)
        counts[0] = 0
        boxes = bin_completion(counts, capacity, nodes)
        # the k-th item of each size takes the k-th place of that size
        places = np.array([(s, b) for b, box in enumerate(boxes) for s in box], dtype=np.int64).reshape(-1, 2)
        places = places[np.argsort(places[:, 0], kind="stable")]
        order = np.argsort(rest, kind="stable")
        order = order[rest[order] > 0]
        box_of = np.full(len(rest), -1, dtype=np.int64)
        box_of[order] = places[:, 1]
        rows = [np.flatnonzero(full).repeat(full[full > 0]), np.flatnonzero(rest > 0), np.flatnonzero(sizes == 0)]
        n_full = len(rows[0])
        part = np.concatenate([np.arange(f) for f in full[full > 0]] + [full[rows[1]], np.zeros(len(rows[2]), int)])
        names = [f"{pool}-f{k}" for k in range(n_full)] + [f"{pool}-{b}" for b in box_of[rows[1]]]
        n_tokens = np.concatenate([np.full(n_full, capacity), rest[rows[1]], sizes[rows[2]]])
        return pa.table(
            {
                "id": group["id"].take(pa.array(np.concatenate(rows))),
                "container": pa.array(names + [None] * len(rows[2]), pa.string()),
                "part": pa.array(part.astype("int32")),
                "n_tokens": pa.array(n_tokens.astype("int32")),
            }
        )

    packed = sized.groupBy("pool").applyInArrow(fill, f"id {kind}, {PACKED}")
    return packed.withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, and the share filled.

    An empty table gives 0 containers and a null share.
    """
    boxes = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return boxes.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("t") / capacity), F.lit(0)).cast("bigint").alias("least_containers"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("share_filled"),
    )
