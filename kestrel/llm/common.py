"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import scratch_dir

# Fixed value: a word is a run of characters other than these ASCII blanks.
WORD_RE = r"[^\x20\x09-\x0D]+"
# Rows handled at once inside a Python task (bounds memory when texts are very long).
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back (cuts the lineage;
    a lost executor only costs a reread)."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a few numbers that may be broadcast (some 50 MB in each executor).
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of a few numeric columns as one side of a join: broadcast if its counted rows
    are within the bound, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text_col: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose texts hold about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.diff(text_offsets(batch.column(text_col)))
    ends = np.cumsum(size)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # What the batch took goes back to the system, or a reused worker keeps its largest size.
    pa.default_memory_pool().release_unused()


def text_offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a string column's values in its data buffer; nulls are empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset: col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offsets (from 0) of its values."""
    off = text_offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (xor-shift and odd multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mix32(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit integers, worked in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


# Bytes of text whose running sums are held at once.
RUN_BYTES = 1 << 20


class WordHashes:
    """Words of a whole Arrow text column at once: their places, and hashes of any of their parts.

    ``in_word`` says which bytes belong to words (A-Z are lower-cased first). A running polynomial
    sum over the bytes gives the hash of any span from two of its values; it is made for RUN_BYTES
    at a time, so a very long text costs a few bytes per byte and some more per word.
    """

    def __init__(self, in_word: np.ndarray, base: np.uint64 = _BYTE_BASE) -> None:
        self.in_word, self.base = in_word, int(base)
        self._pow = powers(base, RUN_BYTES)
        self._inv = powers(np.uint64(pow(int(base), -1, 1 << 64)), RUN_BYTES)

    def load(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end of every word, offsets of the texts' words)."""
        data, off = text_bytes(col)
        n = len(data)
        word = self.in_word[data]
        upper = (data >= 65) & (data <= 90)
        self.data = data | (upper.view(np.uint8) << np.uint8(5))
        first = np.zeros(n + 1, bool)
        first[off] = True
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | first[1:n]
        end[:-1] &= ~word[1:] | first[1:n]
        s, e = np.nonzero(start)[0], np.nonzero(end)[0] + 1
        return s, e, np.searchsorted(s, off)

    def _span_sums(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Sum of (byte + 1) * base^(place in the span) of spans in order of s."""
        out = np.zeros(len(s), np.uint64)
        run = np.zeros(RUN_BYTES + 1, np.uint64)
        a = 0
        while a < len(s):
            x = int(s[a])
            # Spans that start within RUN_BYTES from here; what reaches beyond is added piece by piece.
            b = int(np.searchsorted(s, x + RUN_BYTES))
            y = min(x + RUN_BYTES, len(self.data))
            np.cumsum((self.data[x:y].astype(np.uint64) + np.uint64(1)) * self._pow[: y - x], out=run[1: y - x + 1])
            stop = np.minimum(e[a:b], y)
            out[a:b] = (run[stop - x] - run[s[a:b] - x]) * self._inv[s[a:b] - x]
            for i in (np.flatnonzero(e[a:b] > y) + a).tolist():
                for at in range(y, int(e[i]), RUN_BYTES):
                    part = self.data[at: min(at + RUN_BYTES, int(e[i]))].astype(np.uint64) + np.uint64(1)
                    place = pow(self.base, at - int(s[i]), 1 << 64)
                    out[i] = (int(out[i]) + int((part * self._pow[: len(part)]).sum(dtype=np.uint64)) * place) % (1 << 64)
            a = b
        return out

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans from s (ascending) to e (end excluded)."""
        if not len(s):
            return np.zeros(0, np.uint64)
        return mix64(self._span_sums(s, e) + (e - s).astype(np.uint64) * _WORD_BASE)


def ddl(df: DataFrame, cols: list[str]) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def id_text(c: str) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """All rows when there are at most ``rows``, else those whose hashed key is below the share that
    leaves about ``rows``. The same rows every time, whatever the partitioning."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
