"""Exact top-k search with a bit-sliced index.

The vectors are quantised to integers and their components are kept as bit
slices: one bitmap over the rows for each component and bit. A query's scores
over all rows of a block are added up by bitmap arithmetic alone (carry-save
adders over slices, weighted by the query's digits). The top rows are then read
off the sum's slices from the most significant one downward, and rows that tie
at the boundary are resolved exactly, by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SCALE = 256.0


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit slices of non-negative integers (rows x dims): array [dims, bits, words], and the mask of real rows."""
    rows, dims = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        plane = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : plane.shape[1]] = plane
    real = np.zeros(words * 8, np.uint8)
    mask = np.packbits(np.ones(rows, np.uint8), bitorder="little")
    real[: len(mask)] = mask
    return out.view(np.uint64), real.view(np.uint64)


@lru_cache(1 << 16)
def signed_digits(n: int) -> list[tuple[int, int]]:
    """n as a sum of few +-2**j: pairs (j, sign), no two of them adjacent."""
    out, j = [], 0
    while n:
        if n & 1:
            s = 2 - (n & 3)
            out.append((j, s))
            n -= s
        n >>= 1
        j += 1
    return out


def add_slices(columns: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight: columns[w] holds bitmaps [m, words] of weight 2**w. Returns the sum's slices from weight 0."""
    out, w = [], 0
    pending = {k: v for k, v in columns.items() if len(v)}
    while pending:
        x = pending.pop(w, None)
        if x is None:
            out.append(np.zeros(words, np.uint64))
            w += 1
            continue
        carries = []
        while len(x) > 2:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (c & half))
            x = np.concatenate([half ^ c, x[3 * n :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0])
        if carries:
            up = [pending[w + 1]] if w + 1 in pending else []
            pending[w + 1] = np.concatenate(up + carries)
        w += 1
    return out


def top_rows(total: list[np.ndarray], live: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among live rows, ties to smaller ids; from the top slice downward."""
    sure, tied = np.zeros_like(live), live
    for s in reversed(total):
        high = tied & s
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure, tied = sure | high, tied & ~s
            if n == k:
                tied = np.zeros_like(tied)
                break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    found, edge = rows(sure), rows(tied)
    edge = edge[np.argsort(ids[edge], kind="stable")][: k - len(found)]
    return np.concatenate([found, edge])


class BitSlicedIndex:
    """Bit slices of integer vectors with distinct or repeated ids; scores come from the slices alone."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, real: np.ndarray) -> None:
        self.ids, self.low, self.slices, self.real = ids, low, slices, real
        self.dims, self.bits, self.words = slices.shape
        self.planes = slices.reshape(-1, self.words)

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> "BitSlicedIndex":
        low = vectors.min(axis=0)
        return cls(ids, low, *slices_of(vectors - low))

    def packed(self) -> tuple[int, int, bytes, bytes, bytes]:
        return self.dims, self.bits, self.ids.tobytes(), self.low.tobytes(), self.slices.tobytes()

    @classmethod
    def unpacked(cls, dims: int, bits: int, ids: bytes, low: bytes, slices: bytes) -> "BitSlicedIndex":
        own = np.frombuffer(ids, np.int64)
        planes = np.frombuffer(slices, np.uint64).reshape(dims, bits, -1)
        real = np.zeros(planes.shape[2] * 8, np.uint8)
        mask = np.packbits(np.ones(len(own), np.uint8), bitorder="little")
        real[: len(mask)] = mask
        return cls(own, np.frombuffer(low, np.int64), planes, real.view(np.uint64))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (inner product + a constant of the query), and that constant.

        A negative digit adds the complement of a slice, which differs from
        subtracting it by a constant; so do the components' least values.
        """
        query = query[: self.dims]
        dims: dict[int, list[int]] = {}
        flip: dict[int, list[int]] = {}
        extra = 0
        for d, q in enumerate(query.tolist()):
            for j, sign in signed_digits(q):
                dims.setdefault(j, []).append(d)
                flip.setdefault(j, []).append(0 if sign > 0 else -1)
                if sign < 0:
                    extra += ((1 << self.bits) - 1) << j
        at = {j: (np.array(x) * self.bits, np.array(flip[j], np.int64).view(np.uint64)) for j, x in dims.items()}
        by_weight: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for j, (first, negative) in at.items():
            for b in range(self.bits):
                by_weight.setdefault(j + b, []).append((first + b, negative))
        columns = {w: self.planes[np.concatenate([x for x, _ in v])] ^ np.concatenate([n for _, n in v])[:, None] for w, v in by_weight.items()}
        return add_slices(columns, self.words), extra - int(query @ self.low[: len(query)])

    def top(self, query: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best rows, without rows whose id is ``but``."""
        live = self.real
        if but is not None:
            same = np.zeros(self.words * 8, np.uint8)
            own = np.packbits(self.ids == but, bitorder="little")
            same[: len(own)] = own
            live = live & ~same.view(np.uint64)
        total, extra = self.scores(query)
        rows = top_rows(total, live, self.ids, k)
        score = np.zeros(len(rows), np.int64)
        for w, s in enumerate(total):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        score -= extra
        order = np.lexsort((self.ids[rows], -score))
        return self.ids[rows][order], score[order]


def quantised(vectors: DataFrame, column: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and q, the components as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    x = F.transform(F.col(column), lambda v: F.floor(v.cast("double") * F.lit(scale)))
    finite = F.forall(F.col(column), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & F.col("vec_id").isNotNull() & finite).select("vec_id", x.alias("q"))


def _matrix(column: pd.Series) -> np.ndarray:
    out = np.zeros((len(column), max(1, max(map(len, column), default=1))), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors but those of its own id.

    vectors and queries have vec_id and q (arrays of integers; a shorter vector
    counts as padded with zeros). Rows are dealt into blocks, each block's slices
    are built once and written packed, and so are the groups of queries. Each
    pair of a packed block and a packed group is one task's work of bounded
    size, and each block keeps k rows a query. Rows that repeat with one id are
    candidates like others. Without rows or queries the result is empty.
    """
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows))
    # as few groups as query_rows allows, but pairs for all cores
    groups = max(1, -(-m // query_rows), min(-(-m // 256), -(-3 * cores // blocks)))

    def dealt(rows: DataFrame, parts: int) -> DataFrame:
        # the row number only spreads rows that repeat; where a row lies changes no result
        return rows.select(F.pmod(F.xxhash64("vec_id", "q", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"), "vec_id", "q").groupBy("part")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        index = BitSlicedIndex.of(rows["vec_id"].to_numpy(np.int64), _matrix(rows["q"]))
        return pd.DataFrame([(int(rows["part"].iloc[0]), *index.packed())], columns=["part", "dims", "bits", "ids", "low", "body"])

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(rows["q"])
        ids = rows["vec_id"].to_numpy(np.int64)
        return pd.DataFrame([(int(rows["part"].iloc[0]), q.shape[1], 0, ids.tobytes(), b"", q.tobytes())], columns=["part", "dims", "bits", "ids", "low", "body"])

    packed = "part int, dims int, bits int, ids binary, low binary, body binary"
    index = materialize(dealt(vectors, blocks).applyInPandas(block, packed), "top-k-blocks")
    asked = materialize(dealt(queries, groups).applyInPandas(group, packed), "top-k-queries")
    one = index.select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("role"), *index.columns[1:])
    two = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("part").alias("group"), F.lit(1).alias("role"), *asked.columns[1:])
    tasks = min(blocks * groups, 64 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pair = F.col("block").cast("long") * groups + F.col("group")
    met = one.unionByName(two).repartitionById(tasks, F.pmod(pair, F.lit(tasks)).cast("int")).sortWithinPartitions("block", "group", "role")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: BitSlicedIndex | None = None
        at = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.role == 0:
                    held, at = BitSlicedIndex.unpacked(r.dims, r.bits, r.ids, r.low, r.body), (r.block, r.group)
                elif at == (r.block, r.group):  # else the block has no rows
                    out: list[tuple] = []
                    for own, query in zip(np.frombuffer(r.ids, np.int64).tolist(), np.frombuffer(r.body, np.int64).reshape(-1, r.dims), strict=True):
                        ids, score = held.top(query, k, own)
                        out += [(own, a, b) for a, b in zip(ids.tolist(), score.tolist(), strict=True)]
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = met.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
