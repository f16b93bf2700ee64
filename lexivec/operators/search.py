"""Exact vector search: scoring, ranking, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors

#: Queries are shipped to the scan as one matrix up to this size; larger sets are searched block by block.
QUERY_BYTES = 64 << 20
#: Rows scored at a time: as many as give a matrix of scores of this size, and at most BLOCK_ROWS.
SCORE_BYTES = 64 << 20
BLOCK_ROWS = 4096


def top_k(corpus: DataFrame, query: Column, k: int, id_col: str, vec_col: str, as_text: bool = False) -> DataFrame:
    """The ``k`` rows most similar to one query vector: ``rank, score`` and the corpus columns.

    Fewer rows than ``k`` give all of them.  Each task keeps its best ``k``; nothing else is shuffled.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    key = F.col(id_col).cast("string") if as_text else F.col(id_col)
    scored = corpus.withColumn("score", vectors.cosine(F.col(vec_col), query))
    best = scored.orderBy(F.col("score").desc_nulls_last(), key).limit(k)
    w = Window.orderBy(F.col("score").desc_nulls_last(), key)  # over k rows
    return best.withColumn("rank", F.row_number().over(w))


def rank_hits(scored: DataFrame, query_col: str, id_col: str, k: int, as_text: bool = False) -> DataFrame:
    """Ranks ``1 .. k`` within each query by score, then id (as text for string ranking)."""
    key = F.col(id_col).cast("string") if as_text else F.col(id_col)
    w = Window.partitionBy(query_col).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(vectors_: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = vectors_.combine_chunks() if isinstance(vectors_, pa.ChunkedArray) else vectors_
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def search_all(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, dims: int, exclude_self: bool = True
) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best of ``corpus`` for each of ``queries``, exactly.

    Vectors of other sizes are left out.  The plan follows the size of the queries: up to QUERY_BYTES they
    are shipped as one matrix and the corpus is scanned once, each task keeping its best ``k`` of every
    query; beyond, the queries are worked off in as many passes as they hold such matrices.
    """
    return search_widths(corpus, queries, k, id_col, vec_col, dims, (dims,), exclude_self).drop("dims")


def search_widths(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, dims: int, widths: tuple[int, ...],
    exclude_self: bool = True,
) -> DataFrame:
    """``dims, query_id, id, score, rank``: ``search_all`` over the first components of several widths, in one scan."""
    fits = F.size(vec_col) == dims
    asked = queries.where(fits).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"))
    per_pass = max(1, QUERY_BYTES // (8 * sum(widths)))
    passes = max(1, -(-asked.count() // per_pass))
    rows = corpus.where(fits).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kind = corpus.schema[id_col].dataType.simpleString()
    found = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)
        local = part.toArrow()  # at most about QUERY_BYTES
        whole = _matrix(local["v"], dims)
        hits = _scan(rows, local["q"], {n: _unit(whole[:, :n]) for n in widths}, k, kind, exclude_self, dims)
        found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("dims", "query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Held:
    """The best ``k`` so far of each query: scores, and positions in a list of ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.at = np.full((queries, k), -1, dtype=np.int64)

    def offer(self, s: np.ndarray, at: np.ndarray, order: np.ndarray) -> None:
        """Scores ``s`` of the rows ``at``; ``order`` is the order of all rows by id, for ties."""
        good = s >= self.score[:, -1:]
        many = np.flatnonzero(good.sum(axis=1) > self.k)
        if len(many):
            edge = np.partition(s[many], -self.k, axis=1)[:, -self.k]
            good[many] &= s[many] >= edge[:, None]
        good &= ~np.isneginf(s)
        row, col = np.nonzero(good)
        if not len(row):
            return
        touched = np.unique(row)
        row_all = np.concatenate((row, np.repeat(touched, self.k)))
        s_all = np.concatenate((s[row, col], self.score[touched].ravel()))
        at_all = np.concatenate((at[col], self.at[touched].ravel()))
        by = np.lexsort((np.where(at_all < 0, len(order), order[at_all]), -s_all, row_all))
        row_all, s_all, at_all = row_all[by], s_all[by], at_all[by]
        place = np.arange(len(row_all)) - np.searchsorted(row_all, row_all)
        keep = place < self.k
        self.score[row_all[keep], place[keep]] = s_all[keep]
        self.at[row_all[keep], place[keep]] = at_all[keep]


def _scan(rows: DataFrame, qids: pa.ChunkedArray, units: dict[int, np.ndarray], k: int, kind: str, exclude_self: bool, dims: int):
    q_array = qids.combine_chunks() if isinstance(qids, pa.ChunkedArray) else qids
    n = len(q_array)
    first = pc.index_in(q_array, q_array).to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    repeated = np.flatnonzero(first != np.arange(n))
    step = max(16, min(BLOCK_ROWS, SCORE_BYTES // (8 * max(1, n))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {w: _Held(n, k) for w in units}
        names = pa.array([], q_array.type)  # ids of the rows held, then of the batch
        for batch in batches:
            if not len(batch):
                continue
            # rows no longer held are forgotten
            kept = np.unique(np.concatenate([h.at[h.at >= 0] for h in held.values()]))
            for h in held.values():
                h.at = np.where(h.at < 0, -1, np.searchsorted(kept, h.at))
            names = pa.concat_arrays([names.take(pa.array(kept)), batch["id"].cast(q_array.type)])
            order = np.empty(len(names), dtype=np.int64)
            order[pc.sort_indices(names, null_placement="at_end").to_numpy()] = np.arange(len(names))
            own = pc.index_in(batch["id"], q_array).to_numpy(zero_copy_only=False) if exclude_self else None
            m = _matrix(batch["v"], dims)
            for w, q in units.items():
                unit = _unit(m[:, :w])
                for at in range(0, len(m), step):
                    s = q @ unit[at : at + step].T
                    if exclude_self:
                        mine = own[at : at + step]
                        ok = np.flatnonzero(~np.isnan(mine.astype(float)))
                        s[mine[ok].astype(np.int64), ok] = -np.inf
                        for r in repeated.tolist():  # the same id asked again
                            s[r, mine == first[r]] = -np.inf
                    held[w].offer(s, len(kept) + at + np.arange(s.shape[1]), order)
        for w, h in held.items():
            row, place = np.nonzero(h.at >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), w, np.int32)), q_array.take(pa.array(row)), names.take(pa.array(h.at[row, place])), pa.array(h.score[row, place])],
                ["dims", "query_id", "id", "score"],
            )

    return rows.mapInArrow(score, f"dims int, query_id {kind}, id {kind}, score double")
