"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. A block of the index holds, for every
dimension, the values less their smallest one, cut into bitmaps: bitmap i has
bit i of every row of the block. A query's score is the weighted sum of its
dimensions, made of bitmaps alone: each signed binary digit of a weight adds
the dimension's slices, shifted by its place (for a negative digit the
complemented slices, which differ from the negated value by a constant), and
carry-save adders reduce every column of bitmaps until one slice per bit of
the score is left. The best rows are then taken from the most significant
slice downward, by counts of bits; rows that tie at the boundary are those
with the smallest ids. Only the chosen rows' scores are put together again.

Cases: vectors null, or with null or non-finite components, take no part; nor
do vectors with a component so large (beyond about 2^27 after scaling, for 64
components) that a score might pass 64 bits; shorter vectors count as ending
in zeros; every row is a candidate but the query's own row, so rows that
repeat an id stay candidates of each other and each such query row has its own
result; a null id is never a query and comes last in ties; fewer candidates
than asked for give fewer rows; an empty table gives none; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.blocks import BLOCK_VALUES, Best, as_queries, id_arrays, in_order, matrix, meet, quantised
from kestrel.llm.common import staged

SCALE = 64


def cut_slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest value, number of slices) of every column of x, and all slices as rows of 64-bit words."""
    low = x.min(axis=0)
    above = (x - low).astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
    words = -(-len(x) // 64)
    flags = np.zeros((int(bits.sum()), words * 64), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        for i in range(n):
            flags[at, : len(x)] = above[:, d] >> np.uint64(i) & np.uint64(1)
            at += 1
    return low, bits, np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def signed_digits(w: np.ndarray) -> np.ndarray:
    """Digits -1, 0, 1 of integers [.., place], no two neighbours of them both other than 0."""
    out = []
    w = w.copy()
    while w.any():
        d = np.where(w & 1, 2 - (w & 3), 0)
        out.append(d)
        w = (w - d) >> 1
    return np.stack(out, axis=-1) if out else np.zeros((*w.shape, 0), np.int64)


def add_up(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of weight 2^c in columns[c] -> the slices of their sum, least significant first."""
    out, carried, c = [], [], 0
    while c < len(columns) or carried:
        arr = np.concatenate([*(columns[c: c + 1]), *carried]) if carried else columns[c]
        carried = []
        while len(arr) > 1:
            if len(arr) == 2:
                carried.append(arr[:1] & arr[1:])
                arr = arr[:1] ^ arr[1:]
                break
            t = len(arr) // 3
            a, b, d = arr[:t], arr[t: 2 * t], arr[2 * t: 3 * t]
            x = a ^ b
            carried.append((a & b) | (x & d))
            x ^= d
            arr = np.concatenate([x, arr[3 * t:]]) if 3 * t < len(arr) else x
        out.append(arr[0] if len(arr) else None)
        c += 1
    return out


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest sums among ``rows`` (a bitmap), ties to the smaller place."""
    sure, n_sure, tied = np.zeros_like(rows), 0, rows
    if int(np.bitwise_count(rows).sum()) <= k:
        return places(rows)
    for s in reversed(slices):
        if s is None:
            continue
        ones = tied & s
        n = int(np.bitwise_count(ones).sum())
        if n_sure + n > k:
            tied = ones
        else:
            sure, n_sure, tied = sure | ones, n_sure + n, tied & ~s
            if n_sure == k:
                return places(sure)
    return np.concatenate([places(sure), places(tied)[: k - n_sure]])


class Block:
    """One block of the index: scores of any query by bitmap arithmetic."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, slices: np.ndarray, n: int) -> None:
        self.low, self.bits = low, bits
        self.dim, self.bit = np.repeat(np.arange(len(bits)), bits), np.concatenate([np.arange(0), *map(np.arange, bits)])
        # Complemented slices follow the plain ones.
        self.both = np.concatenate([slices, ~slices]) if len(slices) else slices
        full = np.zeros(-(-n // 64) * 64, np.uint8)
        full[:n] = 1
        self.rows = np.packbits(full, bitorder="little").view(np.uint64)

    def top(self, w: np.ndarray, digits: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows for the weights w, the row ``own`` left out."""
        place = np.nonzero(digits[self.dim])
        sign = digits[self.dim][place]
        index = place[0] + np.where(sign < 0, len(self.dim), 0)
        column = self.bit[place[0]] + place[1]
        order = np.argsort(column, kind="stable")
        ends = np.searchsorted(column[order], np.arange(column.max() + 2 if len(column) else 0))
        slices = add_up([self.both[index[order[a:b]]] for a, b in zip(ends[:-1], ends[1:])])
        rows = self.rows
        if own is not None:
            rows = rows.copy()
            rows[own >> 6] &= ~np.uint64(1 << (own & 63))
        at = top_rows(slices, rows, k)
        score = np.zeros(len(at), np.int64)
        for c, s in enumerate(slices):
            if s is not None:
                score += (s[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << c
        # What the smallest values add, and what the complements have added too much.
        much = ((digits < 0) << np.arange(digits.shape[1])).sum(axis=1) * ((1 << self.bits) - 1)
        return at, score + int(w @ self.low) - int(much.sum())


def build_index(rows: DataFrame, n: int, dims: int) -> tuple[DataFrame, int]:
    """(blocks in the columns that blocks.meet takes, their number) of rows (uid, id, v)."""
    blocks = max(1, -(-n * max(1, dims) // BLOCK_VALUES))

    def build(t: pa.Table) -> pa.Table:
        ids, null = id_arrays(t.column("id"))
        uids = t.column("uid").to_numpy()
        order = in_order(np.zeros(len(ids), np.int64), ids, null, uids)
        low, bits, slices = cut_slices(matrix(t.column("v"), dims)[order])
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()], pa.int32()),
            "uids": pa.array([uids[order]], pa.list_(pa.int64())),
            "ids": pa.array([t.column("id").combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
            "nums": pa.array([low], pa.list_(pa.int64())), "labels": pa.array([bits], pa.list_(pa.int64())),
            "body": pa.array([slices.tobytes()], pa.binary())})

    out = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), "uid", "id", "v").groupBy(
        "block").applyInArrow(build, "block int, uids array<bigint>, ids array<bigint>, nums array<bigint>, "
                                     "labels array<bigint>, body binary")
    return staged(out, "bitslice_index"), blocks


class Search:
    """Queries of one group against the blocks of a stripe (see blocks.meet)."""

    def __init__(self, dims: int, k: int) -> None:
        self.dims, self.k = dims, k

    def begin(self, queries: pa.Table) -> None:
        self.uid = matrix(queries.column("uids"), 1)[:, 0]
        self.id = matrix(queries.column("ids"), 1)[:, 0]
        self.w = matrix(queries.column("nums"), self.dims)
        self.digits = signed_digits(self.w)
        self.best = Best(len(self.uid), self.k)

    def block(self, uids: np.ndarray, ids: tuple, low: np.ndarray, bits: np.ndarray, body: pa.Buffer) -> None:
        value, null = ids
        total = int(bits.sum())
        slices = np.frombuffer(body, np.uint64).reshape(total, -1) if total else np.zeros((0, -(-len(uids) // 64)), np.uint64)
        index = Block(low, bits, slices, len(uids))
        by_uid = np.argsort(uids)
        spot = np.minimum(np.searchsorted(uids[by_uid], self.uid), len(uids) - 1)
        own = np.where(uids[by_uid[spot]] == self.uid, by_uid[spot], -1)
        for i in range(len(self.uid)):
            at, score = index.top(self.w[i], self.digits[i], int(own[i]) if own[i] >= 0 else None, self.k)
            self.best.add(i, score, value[at], null[at], uids[at])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield self.best.batch([("query_uid", self.uid), ("query_id", self.id)])


def search(df: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every row for which
    ``is_query`` (an expression over ``id``) holds, among all other rows."""
    rows = staged(quantised(df, F.col(vec_col), scale, F.col(id_col).cast("bigint").alias("id")), "bitslice_rows")
    queries = rows.filter(F.col("id").isNotNull() & is_query)
    n, dims, n_queries = rows.select(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(F.col("id").isNotNull() & is_query)).first()
    dims = max(1, dims or 0)
    index, blocks = build_index(rows, n, dims)
    found = meet(as_queries(queries, F.col("v"), F.array()), n_queries, index, blocks, "block",
                 lambda: Search(dims, k), "query_uid bigint, query_id bigint, score bigint, id bigint, uid bigint")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS cuid,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON c.uid <> q.uid WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id ASC NULLS LAST, cuid) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
