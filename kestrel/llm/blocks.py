"""Exact searches of a stated query set against all rows, block by block.

Vectors are turned into integers by Spark, an index of blocks of bounded size
is built once, and queries meet blocks in pairs of (group of queries, stripe
of blocks): each pair is one group of a shuffle, its blocks stream past its
queries one at a time, and only the best rows of each query leave the task.
Nothing is broadcast, and a very common vector fills many blocks, not one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components of a block's vectors, blocks that stream past a group of queries, queries of a group at most.
BLOCK_VALUES = 1 << 20
STRIPE_BLOCKS = 64
GROUP_QUERIES = 4096
# Smaller groups are made until there are so many of them, of so many queries at least.
SPREAD_GROUPS, SPREAD_QUERIES = 12, 128

# What a task gets: queries (kind 0) before the blocks (kind 1) of its stripe.
COLUMNS = ("uids", "ids", "nums", "labels", "body")


def quantised(df: DataFrame, vec: Column, scale: int, *cols: Column) -> DataFrame:
    """``cols``, uid (a number of the row) and v: floor(scale * x) of every component x as double.

    Null vectors and those with a null or non-finite component are left out, and so are those with
    a component so large that an inner product might pass 64 bits.
    """
    x = df.select(*cols, vec.alias("_x"), F.monotonically_increasing_id().alias("uid")).filter(F.col("_x").isNotNull())
    ok = F.forall("_x", lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf")))
    x = x.filter(F.coalesce(ok, F.lit(False)))
    # n components of at most 2^m each: n * 2^2m stays under 2^62.
    most = F.pow(F.lit(2.0), F.floor((61 - F.ceil(F.log2(F.greatest(F.size("_x"), F.lit(1))))) / 2))
    small = F.forall("_x", lambda a: F.abs(a.cast("double") * scale) < most)
    names = [c for c in x.columns if c != "_x"]
    return x.filter(small).select(*names, F.transform("_x", lambda a: F.floor(a.cast("double") * scale)).alias("v"))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims`` values; shorter lists end in zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(np.asarray(col.offsets).astype(np.int64))
    flat = np.asarray(col.flatten(), dtype=np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def id_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are null); a null counts as larger than every id."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.fill_null(np.iinfo(np.int64).max), dtype=np.int64), np.asarray(col.is_null())


def in_order(score: np.ndarray, ids: np.ndarray, null: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Larger score first, then smaller id, null ids last; rows of one id by their number."""
    return np.lexsort((uids, null, ids, -score))


class Best:
    """The k best rows found so far for each of n queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, np.zeros(0, bool), none)] * n

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray, uids: np.ndarray) -> None:
        if len(score):
            s, d, z, u = (np.concatenate(x) for x in zip(self.rows[i], (score, ids, null, uids)))
            keep = in_order(s, d, z, u)[: self.k]
            self.rows[i] = s[keep], d[keep], z[keep], u[keep]

    def floor(self, i: int) -> int | None:
        """The score a further row must reach, or None while there is room."""
        s = self.rows[i][0]
        return int(s[-1]) if len(s) == self.k else None

    def batch(self, keys: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        """All rows, with the values of ``keys`` of their query."""
        n = [len(r[0]) for r in self.rows]
        at = np.repeat(np.arange(len(n)), n)
        s, d, z, u = (np.concatenate([r[c] for r in self.rows]) if n else np.zeros(0, np.int64) for c in range(4))
        cols = [pa.array(x[at]) for _, x in keys] + [pa.array(s), pa.array(d, mask=z.astype(bool)), pa.array(u)]
        return pa.RecordBatch.from_arrays(cols, [name for name, _ in keys] + ["score", "id", "uid"])


def groups_of(n: int) -> int:
    """Groups that n queries are dealt over."""
    return max(1, -(-n // GROUP_QUERIES), min(SPREAD_GROUPS, -(-n // SPREAD_QUERIES)))


def meet(queries: DataFrame, n_queries: int, index: DataFrame, n_blocks: int, order: str,
         visitor: Callable[[], object], out: str) -> DataFrame:
    """Every query with every block of the index, both in the columns COLUMNS.

    ``order``: a column of the index; a stripe's blocks come in its ascending order. ``visitor()``
    gives an object with begin(table of queries), block(uids, ids, nums, labels, body) and end()
    -> record batches of schema ``out``.
    """
    groups, stripes = groups_of(n_queries), max(1, -(-n_blocks // STRIPE_BLOCKS))
    cols = [F.col(c) for c in COLUMNS]
    number = F.element_at("uids", 1)
    q = queries.select(F.pmod(F.xxhash64(number), F.lit(groups)).cast("int").alias("group"),
                       F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"),
                       F.lit(0).cast("bigint").alias("at"), *cols)
    b = index.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
                     F.pmod(F.xxhash64(number), F.lit(stripes)).cast("int").alias("stripe"), F.lit(1).alias("kind"),
                     F.col(order).cast("bigint").alias("at"), *cols)
    both = q.unionByName(b).repartition("group", "stripe").sortWithinPartitions("group", "stripe", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, now = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cut = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for i, j in zip(cut, cut[1:]):
                if tuple(key[:2, i]) != here:
                    if now is not None:
                        yield from now.end()
                    here, held, now = tuple(key[:2, i]), [], None
                part = batch.slice(i, j - i)
                if key[2, i] == 0:
                    held.append(part)
                elif held:
                    if now is None:
                        now = visitor()
                        now.begin(pa.Table.from_batches(held))
                    for r in range(part.num_rows):
                        uids, ids, nums, labels = (part.column(4 + c).slice(r, 1) for c in range(4))
                        now.block(np.asarray(uids.flatten()), id_arrays(ids.flatten()), np.asarray(nums.flatten()),
                                  np.asarray(labels.flatten()), part.column(8)[r].as_buffer())
        if now is not None:
            yield from now.end()

    return both.mapInArrow(run, out)


def as_queries(df: DataFrame, nums: Column, labels: Column) -> DataFrame:
    """Rows (uid, id, ...) in the columns COLUMNS."""
    return df.select(F.array("uid").alias("uids"), F.array("id").alias("ids"), nums.alias("nums"),
                     labels.cast("array<bigint>").alias("labels"), F.lit(b"").cast("binary").alias("body"))
