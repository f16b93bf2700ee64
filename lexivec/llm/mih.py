"""Problem 1: the most similar vectors for every vector.

Method: multi-index hashing.  Each index (model) learns rotated binary codes from a bounded
sample: principal axes and rotations that bring the vectors close to the corners of the
cube.  A code is split into substrings, each with its own table.  By the pigeonhole
principle two codes of at most ``tables * (radius + 1) - 1`` different bits share a
substring within ``radius`` bits, so probing every table within that radius retrieves
them all.  Candidates are reranked by the floats.

Substrings grow with the rows, so that buckets do not, and tables are added so that no more
pairs of the least cosine are missed.  A table that is too large for a task is cut into parts in
two ways, by the first bits of its substring and by the last: two substrings that differ in one bit
agree in one of the two.  So a row goes to two parts of a table, whatever the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import cut_lineage, spread_out

#: Vectors of each index that the codes are learned from, at most about so many.
SAMPLE_VECTORS = 16_384
ITERATIONS = 25
TABLES = 12
MIN_BITS = 16
#: Rows of a bucket, on average, at most.
BUCKET_ROWS = 16
#: Rows of a table's part, on average, at most.  Parts of more than HOT times as many are split into pairs of blocks.
PART_ROWS = 262_144
HOT = 4
MAX_BLOCKS = 4096
#: Pairs expanded at a time in a task.
CHUNK = 1_000_000
#: Indexes that are searched together; further ones are searched after them.
INDEXES_AT_ONCE = 1000
#: Pairs whose cosines a task computes, at most about, and bytes of their vectors.
RERANK_PAIRS = 200_000
RERANK_BYTES = 64 << 20
#: Bytes of the vectors of an index that codes are learned from, at most about; it has four times its dimensions at least.
SAMPLE_BYTES = 256 << 20


def miss_rate(cosine: float, bits: int, tables: int) -> float:
    """The share of pairs of this cosine with no substring within one bit, for independent bits."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return float((1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)) ** tables)


def tables_for(cosine: float, bits: int, tables: int = TABLES, short: int = MIN_BITS) -> int:
    """So many tables of ``bits`` bits that no more pairs of this cosine are missed than by ``tables`` of ``short``."""
    most = miss_rate(cosine, short, tables)
    while miss_rate(cosine, bits, tables) > most:
        tables += 1
    return tables


def word(bits: int) -> type:
    """The type that holds a substring."""
    return np.uint16 if bits <= 16 else np.uint32


@dataclass
class Codebook:
    """Learned codes of one index: ``tables`` substrings of ``bits`` bits."""

    dims: int
    bits: int
    mean: np.ndarray
    axes: np.ndarray  # dims x (tables * bits)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of ``tables`` substrings."""
        signs = ((unit - self.mean) @ self.axes) > 0
        parts = signs.reshape(len(unit), -1, self.bits)
        whole = (parts * (np.uint32(1) << np.arange(self.bits, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)
        return whole.astype(word(self.bits))


def learn_codes(sample: np.ndarray, dims: int, tables: int, bits: int, seed: int = 7) -> Codebook:
    """Iterative quantization: rotations, each from another start, until the code is long enough."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims, np.float32)
    centred = (sample - mean).astype(np.float32)
    pca = np.linalg.svd(centred.T @ centred)[0].astype(np.float32) if len(sample) else np.eye(dims, dtype=np.float32)
    v = centred @ pca
    blocks = []
    for _ in range(-(-tables * bits // dims)):
        r = np.linalg.qr(rng.standard_normal((dims, dims)))[0].astype(np.float32)
        for _ in range(ITERATIONS if len(sample) > 2 * dims else 0):
            b = np.where(v @ r > 0, np.float32(1), np.float32(-1))
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        blocks.append(pca @ r)
    axes = np.concatenate(blocks, axis=1)
    # neighbouring bits of one rotation go to different substrings
    order = np.arange(tables * bits).reshape(bits, tables).T.ravel()
    return Codebook(dims, bits, mean.astype(np.float32), axes[:, order].astype(np.float32))


def usable_rows(vectors: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and their first ``dims`` components.

    Usable: not null, long enough, the first ``dims`` finite and not all zero.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    lengths = np.diff(offsets)
    if vectors.null_count:
        lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    at = np.flatnonzero(lengths >= dims)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    m = flat[offsets[:-1][at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims), np.float32)
    with np.errstate(invalid="ignore"):
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return at[good], m[good]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow or vanish."""
    x = m.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def binary_column(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix, without an object for each."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * data.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def fixed_width(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """A matrix of a binary column whose values all hold ``width`` numbers of ``kind``; no copy of each value."""
    parts = []
    for chunk in column.chunks:
        size = width * np.dtype(kind).itemsize
        offsets = chunk.buffers()[1]
        first = int(np.frombuffer(offsets, np.int32)[chunk.offset]) if len(chunk) else 0
        parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[first : first + size * len(chunk)])
    return np.concatenate(parts).view(kind).reshape(-1, width) if parts else np.zeros((0, width), kind)


def index_table(indexes: DataFrame, key_col: str, dims_col: str, at_once: int = INDEXES_AT_ONCE) -> list[list[tuple]]:
    """The indexes, ``(key, dimensions)``, in groups of at most ``at_once``; the widest where a key is repeated."""
    rows = (
        indexes.where(F.col(key_col).isNotNull() & (F.col(dims_col) > 0))
        .groupBy(key_col).agg(F.max(dims_col).alias("d")).orderBy(key_col).collect()
    )
    pairs = [(r[0], int(r.d)) for r in rows]
    return [pairs[i : i + at_once] for i in range(0, len(pairs), at_once)] or [[]]


class Vectors:
    """The usable vectors of a group of indexes, encoded.

    ``codes``: ``id, idx, copy, code``, one row for each usable vector, without its floats.
    ``rows()``: ``id, idx, vec`` with the unit vector's float32 bytes.
    """

    def __init__(self, df: DataFrame, meta: list[tuple], id_col: str, vec_col: str, key_col: str,
                 tables: int = TABLES, min_bits: int = MIN_BITS, grow: bool = True, least: float | None = None):
        self.keys = [k for k, _ in meta]
        self.dims = [d for _, d in meta]
        spark = df.sparkSession
        number = F.create_map(*[F.lit(x) for i, k in enumerate(self.keys) for x in (k, i)]) if meta else None
        source = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.col(key_col).isin(self.keys))
        idx = F.element_at(number, F.col(key_col)).cast("int") if meta else F.lit(0)
        self.source = spread_out(source.select(F.col(id_col).alias("id"), idx.alias("idx"), F.col(vec_col).alias("v")))
        self.id_type = df.schema[id_col].dataType.simpleString()
        counted = {r[0]: r.n for r in source.groupBy(key_col).agg(F.count("*").alias("n")).collect()} if meta else {}
        self.counts = [counted.get(k, 0) for k in self.keys]
        largest = max([1, *self.counts])
        # substrings grow with the largest index, so buckets do not
        self.bits = max(min_bits, int(np.ceil(np.log2(largest / BUCKET_ROWS)))) if grow else min_bits
        # longer substrings are within one bit less often; for pairs of cosine ``least`` more tables make up for it
        self.tables = tables if least is None else tables_for(least, self.bits, tables)
        self.books = self._learn(self.tables)
        if not meta:
            self.codes = spark.createDataFrame([], f"id {self.id_type}, idx int, copy binary, code binary")
        else:
            self.codes = cut_lineage(self._encode())

    def _learn(self, tables: int) -> list[Codebook]:
        """Codes of each index, learned in a task of its own from a share of its rows chosen by a hash of the id.

        Only the codes come to the driver.
        """
        dims, bits = self.dims, self.bits
        books = [learn_codes(np.zeros((0, d), np.float32), d, tables, bits) for d in dims]
        if not dims:
            return books
        most = 2**31 - 1
        each = [max(4 * d, min(SAMPLE_VECTORS, SAMPLE_BYTES // (4 * d))) for d in dims]
        limits = F.array(*[F.lit(int(min(1.0, 1.2 * e / max(1, n)) * most)) for e, n in zip(each, self.counts)])
        picked = self.source.where(F.pmod(F.xxhash64("id"), F.lit(most)) <= F.get(limits, F.col("idx")))

        def learn(g: pa.Table) -> pa.Table:
            i = g["idx"][0].as_py()
            _, m = usable_rows(g.sort_by("id")["v"], dims[i])
            book = learn_codes(unit_rows(m).astype(np.float32), dims[i], tables, bits)
            return pa.table({"idx": pa.array([i], pa.int32()), "mean": [book.mean.tobytes()], "axes": [np.ascontiguousarray(book.axes).tobytes()]})

        for r in picked.groupBy("idx").applyInArrow(learn, "idx int, mean binary, axes binary").collect():
            d = dims[r.idx]
            books[r.idx] = Codebook(d, bits, np.frombuffer(r.mean, np.float32), np.frombuffer(r.axes, np.float32).reshape(d, -1))
        return books

    def _each(self, batch: pa.RecordBatch):
        idx = batch["idx"].to_numpy()
        for i, d in enumerate(self.dims):
            of = np.flatnonzero(idx == i)
            if len(of):
                at, m = usable_rows(batch["v"].take(pa.array(of)), d)
                if len(at):
                    yield i, of[at], unit_rows(m)

    def _encode(self) -> DataFrame:
        from hashlib import blake2b

        books, each = self.books, self._each_fn()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, at, unit in each(batch):
                    u32 = unit.astype(np.float32)
                    codes = books[i].encode(u32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["id"].take(pa.array(at)),
                            pa.array(np.full(len(at), i, np.int32)),
                            pa.array([blake2b(r.tobytes(), digest_size=16).digest() for r in u32], pa.binary()),
                            binary_column(codes),
                        ],
                        ["id", "idx", "copy", "code"],
                    )

        return self.source.mapInArrow(encode, f"id {self.id_type}, idx int, copy binary, code binary")

    def _each_fn(self):
        dims = self.dims

        class Holder:
            pass

        holder = Holder()
        holder.dims = dims
        return lambda batch: Vectors._each(holder, batch)

    def rows(self) -> DataFrame:
        each = self._each_fn()

        def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, at, unit in each(batch):
                    vecs = binary_column(unit.astype(np.float32))
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].take(pa.array(at)), pa.array(np.full(len(at), i, np.int32)), vecs],
                        ["id", "idx", "vec"],
                    )

        return self.source.mapInArrow(slim, f"id {self.id_type}, idx int, vec binary")

    def points(self, k: int) -> DataFrame:
        """The first ``k + 1`` rows of each group of exact copies, by id.

        Later copies are in no list of the ``k`` most similar: the earlier copies are as similar to any
        vector and come first.  The limit is applied in each task before the shuffle.
        """
        w = Window.partitionBy("idx", "copy").orderBy("id")
        return self.codes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)


def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits, the empty one first."""
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(out, dtype=np.int64)


def ragged(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with ``lo[i] <= j < hi[i]``, about CHUNK at a time."""
    n = np.maximum(0, hi - lo)
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, side="right")) - 1)
        part = n[at:to]
        i = np.repeat(np.arange(at, to), part)
        j = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], part) + np.repeat(lo[at:to], part)
        # a single row may have more than a chunk
        for s in range(0, len(i), CHUNK):
            yield i[s : s + CHUNK], j[s : s + CHUNK]
        at = to


def close_codes(v: Vectors, k: int, max_bits: int, part_rows: int = PART_ROWS, hot: int = HOT) -> DataFrame:
    """``idx, a, b``: pairs of points with a substring within one bit and at most ``max_bits`` different bits.

    Every pair comes out once.  A table is cut into parts by the first ``cut`` bits of the substring, to be probed in
    its other bits, and again by the last ``cut`` bits, to be probed in the first ones.  Parts that hold very
    many rows are split into blocks and searched block against block, so no task has more than a few blocks.
    """
    points = cut_lineage(v.points(k).select("id", "idx", "code"))
    n = max([1, *(r.n for r in points.groupBy("idx").agg(F.count("*").alias("n")).collect())])
    tables, bits = v.tables, v.bits
    cut = min(bits // 2, max(0, int(np.ceil(np.log2(n / part_rows)))))
    rest = bits - cut
    views = 2 if cut else 1
    size = np.dtype(word(bits)).itemsize

    def parts_of(codes: np.ndarray, idx: np.ndarray, t: int, view: int) -> np.ndarray:
        own = codes[:, t].astype(np.int64)
        return (((idx * tables + t) * 2 + view) << cut) + (own & ((1 << cut) - 1) if view else own >> rest)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            codes = fixed_width(pa.chunked_array([batch["code"]]), word(bits), tables)
            idx = batch["idx"].to_numpy().astype(np.int64)
            for t in range(tables):
                for view in range(views):
                    keys, counts = np.unique(parts_of(codes, idx, t, view), return_counts=True)
                    for key, c in zip(keys.tolist(), counts.tolist()):
                        total[key] = total.get(key, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["part", "n"])

    sizes = points.select("idx", "code").mapInArrow(tally, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    # at most 2 * tables * n / (hot * part_rows) parts
    blocks = {r.part: min(MAX_BLOCKS, -(-r.n // part_rows)) for r in sizes.where(F.col("n") > hot * part_rows).collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = fixed_width(pa.chunked_array([batch["code"]]), word(bits), tables)
            ids = batch["id"].to_numpy()
            idx = batch["idx"].to_numpy().astype(np.int64)
            lot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for t in range(tables):
                for view in range(views):
                    part = parts_of(codes, idx, t, view)
                    row = np.arange(len(part))
                    lo = hi = own = np.zeros(len(part), np.int64)
                    if blocks:
                        big = np.array([blocks.get(p, 1) for p in part.tolist()])
                        row = np.repeat(row, big)
                        other = np.arange(len(row)) - np.repeat(np.cumsum(big) - big, big)
                        own = (lot % big.astype(np.uint64)).astype(np.int64)[row]
                        lo, hi = np.minimum(own, other), np.maximum(own, other)
                    cell = (part[row] * MAX_BLOCKS + lo) * MAX_BLOCKS + hi
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(own.astype(np.int32)), batch["id"].take(pa.array(row)), binary_column(codes[row])],
                        ["cell", "own", "id", "code"],
                    )

    placed = points.mapInArrow(place, f"cell bigint, own int, id {v.id_type}, code binary")

    def probe(g: pa.Table) -> pa.Table:
        part, pair = divmod(g["cell"][0].as_py(), MAX_BLOCKS**2)
        lo, hi = divmod(pair, MAX_BLOCKS)
        table, view = divmod(part >> cut, 2)
        t = table % tables
        codes = fixed_width(g["code"], word(bits), tables)
        ids, own = g["id"].to_numpy(), g["own"].to_numpy()
        value = codes[:, t].astype(np.int64)
        value = value >> cut if view else value & ((1 << rest) - 1)
        order = np.lexsort((ids, value))
        codes, ids, own, value = codes[order], ids[order], own[order], value[order]
        wide = np.zeros((len(codes), -(-tables * size // 8) * 8), np.uint8)
        wide[:, : tables * size] = codes.view(np.uint8).reshape(len(codes), -1)
        wide = wide.view(np.uint64)
        first = np.searchsorted(value, np.arange((1 << rest) + 1))
        found_a, found_b = [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            if lo != hi:
                ok = own[i] != own[j]
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int32) <= max_bits
            i, j = i[ok], j[ok]
            if t:  # else an earlier table has the pair
                ok = (np.bitwise_count(codes[i, :t] ^ codes[j, :t]) > 1).all(axis=1)
                i, j = i[ok], j[ok]
            found_a.append(np.minimum(ids[i], ids[j]))
            found_b.append(np.maximum(ids[i], ids[j]))

        here = np.arange(len(ids))
        if not view:
            for i, j in ragged(here + 1, first[value + 1]):
                keep(i, j)
        for bit in range(rest - cut if view else 0, rest):
            up = here[(value >> bit & 1) == 0]
            to = value[up] + (1 << bit)
            for i, j in ragged(first[to], first[to + 1]):
                keep(up[i], j)
        a = np.concatenate(found_a) if found_a else ids[:0]
        b = np.concatenate(found_b) if found_b else ids[:0]
        idx = np.full(len(a), table // tables, "int32")
        return pa.table({"idx": idx, "a": a, "b": b}).filter(pa.array(a != b))

    return placed.groupBy("cell").applyInArrow(probe, f"idx int, a {v.id_type}, b {v.id_type}")


def reranked(v: Vectors, pairs: DataFrame, per_task: int = RERANK_PAIRS) -> DataFrame:
    """``idx, a, b, cosine`` of the pairs, from the floats.

    Ids are spread over blocks, and pairs over pairs of blocks.  A vector is sent once to each pair of blocks it is
    needed in, however many pairs it has there; so neither what is sent of a vector nor its rows in the join
    grow with its pairs beyond the number of blocks.
    """
    pairs = cut_lineage(pairs)
    per_task = max(1, min(per_task, RERANK_BYTES // max([8, *(8 * d for d in v.dims)])))
    blocks = max(6, int(np.ceil(np.sqrt(pairs.count() / per_task))))

    def block(name: str):
        return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    celled = pairs.select("idx", "a", "b", block("a").alias("x"), block("b").alias("y"))
    # partitioned by id before duplicates are dropped, so that the join needs no further shuffle
    needed = celled.select("idx", "x", "y", F.explode(F.array("a", "b")).alias("id")).repartition("idx", "id").dropDuplicates()
    vectors = needed.join(v.rows(), ["idx", "id"]).select(
        F.col("idx").alias("i"), F.col("x").alias("u"), F.col("y").alias("w"), "id", "vec"
    )
    dims = v.dims

    def cosines(got: pa.Table, floats: pa.Table) -> pa.Table:
        if not len(got):
            return got.select(["idx", "a", "b"]).append_column("cosine", pa.array([], pa.float64()))
        floats = floats.sort_by("id")
        ids = floats["id"].to_numpy()
        unit = fixed_width(floats["vec"], np.float32, dims[got["idx"][0].as_py()])
        i, j = (np.searchsorted(ids, got[c].to_numpy()) for c in ("a", "b"))
        return got.select(["idx", "a", "b"]).append_column("cosine", pa.array(row_products(unit, i, unit, j)))

    return (
        celled.groupBy("idx", "x", "y").cogroup(vectors.groupBy("i", "u", "w"))
        .applyInArrow(cosines, f"idx int, a {v.id_type}, b {v.id_type}, cosine double")
    )


def bits_for(cosine: float, bits: int, slack: float = 3.0) -> int:
    """So many of ``bits`` bits differ at most, ``slack`` deviations out, for vectors of this cosine."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(np.ceil(bits * p + slack * np.sqrt(bits * p * (1 - p)))) + 2


def mutual_neighbours(
    df: DataFrame,
    indexes: DataFrame,
    k: int = 10,
    least: float = 0.92,
    id_col: str = "vec_id",
    vec_col: str = "embeddings",
    key_col: str = "model_fingerprint",
    dims_col: str = "dimensions",
) -> DataFrame:
    """Pairs ``<id>_a < <id>_b`` of cosine at least ``least``, each among the other's ``k`` most similar.

    Vectors of one index are compared over its first ``dims`` components.  Vectors that are null, too short,
    not finite or all zero, and those of unknown indexes or null ids, have no pairs.  Ties go to the lower
    id.  Ids must be unique.  Empty tables give no pairs; other columns are ignored.
    """
    found = [_mutual(Vectors(df, group, id_col, vec_col, key_col, least=least), k, least, id_col) for group in index_table(indexes, key_col, dims_col)]
    return reduce(DataFrame.union, found)


def _mutual(v: Vectors, k: int, least: float, id_col: str) -> DataFrame:
    near = reranked(v, close_codes(v, k, bits_for(least, v.tables * v.bits))).where(F.col("cosine") >= least)
    sides = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q"))))
    w = Window.partitionBy("idx", "p").orderBy(F.col("cosine").desc(), "q")
    listed = (
        near.select("idx", "cosine", sides.alias("s"))
        .select("idx", "cosine", "s.p", "s.q")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
    return (
        listed.groupBy(F.least("p", "q").alias(f"{id_col}_a"), F.greatest("p", "q").alias(f"{id_col}_b"))
        .count()
        .where("count = 2")
        .drop("count")
    )


#: Bytes of one block of the index, and of the queries searched in it at a time.  A vector is sent once for each
#: block of the other kind, so blocks are as large as a task can hold.
INDEX_BYTES = 64 << 20
ASKED_BYTES = 32 << 20
#: Rows of a block at least, where more blocks would only make work for more cores.
BLOCK_ROWS = 16_384
SEARCH_TABLES = 16
SEARCH_BITS = 8


def row_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``a[i]`` and ``b[j]`` in doubles; the same rows give the same bits wherever they stand."""
    out = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        part = slice(s, s + 65_536)
        out[part] = (a[i[part]].astype(np.float64) * b[j[part]]).sum(axis=1)
    return out


def first_copies(ids: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` ids of each group of equal rows."""
    whole = np.ascontiguousarray(unit).view(np.dtype((np.void, unit.itemsize * unit.shape[1]))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) < n])


class _Best:
    """The ``k`` best candidates so far of each query."""

    def __init__(self, n: int, k: int, id_type: np.dtype):
        self.sim = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), dtype=id_type)

    def offer(self, q: np.ndarray, qunit: np.ndarray, unit: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids`` with vectors ``unit`` for queries ``q``; those already held are not taken twice.

        The matrix product only says which candidates may be among the best, ties and its rounding allowed
        for; these are compared by sums that come out the same for equal vectors, then by the lower id.
        """
        k = self.sim.shape[1]
        sims = qunit[q] @ unit.T
        slack = 2 * unit.shape[1] * np.finfo(np.float32).eps
        better = sims >= (self.sim[q, -1] - slack).astype(np.float32)[:, None]
        many = np.flatnonzero(better.sum(axis=1) > 2 * k)
        if len(many):
            some = sims[many]
            better[many] &= some >= np.partition(some, -k, axis=1)[:, -k, None] - np.float32(slack)
        rows, cols = np.nonzero(better)
        if not len(rows):
            return
        row = np.concatenate((np.repeat(np.arange(len(q)), k), rows))
        sim = np.concatenate((self.sim[q].ravel(), row_products(qunit, q[rows], unit, cols)))
        got = np.concatenate((self.ids[q].ravel(), ids[cols]))
        order = np.lexsort((got, -sim, row))
        row, sim, got = row[order], sim[order], got[order]
        again = np.zeros(len(row), dtype=bool)
        by_id = np.lexsort((np.isneginf(sim), got, row))
        r, g, s = row[by_id], got[by_id], sim[by_id]
        again[by_id[1:]] = (r[1:] == r[:-1]) & (g[1:] == g[:-1]) & ~np.isneginf(s[1:])
        row, sim, got = row[~again], sim[~again], got[~again]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < k
        self.sim[q[row[ok]], place[ok]] = sim[ok]
        self.ids[q[row[ok]], place[ok]] = got[ok]


def search_block(
    ids: np.ndarray, unit: np.ndarray, codes: np.ndarray, qids: np.ndarray, qunit: np.ndarray, qcodes: np.ndarray,
    bits: int, k: int, radius: int,
) -> _Best:
    """Probe all tables of one block of the index within ``radius`` bits; rerank what they hold by the floats.

    Queries with the same substring share their buckets, and so one matrix product.  Exact copies beyond the first
    ``k + 1`` ids are left out: the others are as similar and come first.
    """
    kept = first_copies(ids, unit, k + 1)
    ids, unit, codes = ids[kept], unit[kept], codes[kept]
    best = _Best(len(qids), k + 1, ids.dtype)
    masks = flips(bits, radius)
    for t in range(codes.shape[1]):
        order = np.argsort(codes[:, t], kind="stable")
        first = np.searchsorted(codes[order, t], np.arange((1 << bits) + 1))
        q_order = np.argsort(qcodes[:, t], kind="stable")
        values, starts = np.unique(qcodes[q_order, t], return_index=True)
        for value, q in zip(values.tolist(), np.split(q_order, starts[1:])):
            spans = [order[first[b] : first[b + 1]] for b in (value ^ masks).tolist()]
            cand = np.concatenate(spans)
            for at in range(0, len(cand), 8192):
                c = cand[at : at + 8192]
                near, names = unit[c], ids[c]
                for s in range(0, len(q), 2048):
                    best.offer(q[s : s + 2048], qunit, near, names)
    return best


def similar_to(
    df: DataFrame,
    indexes: DataFrame,
    every: int = 20,
    k: int = 10,
    radius: int = 1,
    id_col: str = "vec_id",
    vec_col: str = "embeddings",
    key_col: str = "model_fingerprint",
    dims_col: str = "dimensions",
) -> DataFrame:
    """For each usable vector whose id is divisible by ``every``, its ``k`` most similar of all vectors.

    ``<id>, rank, neighbour, similarity``.  Every usable vector is indexed.  Codes of SEARCH_TABLES *
    SEARCH_BITS bits are probed within ``radius`` bits of each substring, which retrieves all codes within
    ``SEARCH_TABLES * (radius + 1) - 1`` bits.  The index and the queries are cut into blocks; a task
    searches one block of queries in one block of the index, and only its best go on.  Unusable vectors
    neither ask nor answer; ties go to the lower id; exact copies are each other's most similar.
    """
    return reduce(DataFrame.union, [
        _search(Vectors(df, group, id_col, vec_col, key_col, SEARCH_TABLES, SEARCH_BITS, grow=False), every, k, radius, id_col)
        for group in index_table(indexes, key_col, dims_col)
    ])


def _search(v: Vectors, every: int, k: int, radius: int, id_col: str) -> DataFrame:
    rows = v.rows()
    counts = {r.idx: (r.n, r.q) for r in v.codes.groupBy("idx").agg(
        F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}
    cores = v.source.sparkSession.sparkContext.defaultParallelism

    def blocks(n: int, q: int, row: int) -> tuple[int, int]:
        return max(-(-n * row // INDEX_BYTES), min(cores, -(-n // BLOCK_ROWS)), 1), max(1, -(-q * row // ASKED_BYTES))

    grid = {i: blocks(n, q, 4 * v.dims[i]) for i, (n, q) in counts.items()}
    books, tables, bits = v.books, v.tables, v.bits

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for idx, g in batch.groupby("idx"):
                nb, nq = grid[idx]
                ids = g["id"].to_numpy()
                lot = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                for c in range(nq):
                    yield pd.DataFrame({"idx": idx, "b": (lot % nb).astype("int32"), "c": np.int32(c), "asks": False, "id": ids, "vec": g["vec"]})
                asks = ids % every == 0
                for b in range(nb):
                    yield pd.DataFrame({"idx": idx, "b": np.int32(b), "c": (lot[asks] % nq).astype("int32"), "asks": True, "id": ids[asks], "vec": g["vec"][asks]})

    placed = rows.mapInPandas(place, f"idx int, b int, c int, asks boolean, id {v.id_type}, vec binary")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        idx = int(g["idx"].iloc[0])
        asks = g["asks"].to_numpy()
        unit = np.frombuffer(b"".join(g["vec"]), np.float32).reshape(len(g), -1)
        codes = books[idx].encode(unit)
        ids = g["id"].to_numpy()
        best = search_block(ids[~asks], unit[~asks], codes[~asks], ids[asks], unit[asks], codes[asks], bits, k, radius)
        qids = np.repeat(ids[asks], k + 1)
        ok = ~np.isneginf(best.sim.ravel()) & (best.ids.ravel() != qids)
        return pd.DataFrame({"idx": idx, "q": qids[ok], "n": best.ids.ravel()[ok], "s": best.sim.ravel()[ok].astype("float64")})

    found = placed.groupBy("idx", "b", "c").applyInPandas(search, f"idx int, q {v.id_type}, n {v.id_type}, s double")
    w = Window.partitionBy("q").orderBy(F.col("s").desc(), "n")
    return (
        found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select(F.col("q").alias(id_col), "rank", F.col("n").alias("neighbour"), F.round("s", 6).alias("similarity"))
    )
