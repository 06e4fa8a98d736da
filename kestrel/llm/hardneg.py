"""Hard negatives by inner product, with buckets of like length pruned by coordinates.

Rows are sorted by length and cut into buckets; a bucket holds, for every
coordinate of its rows at unit length, the order of the rows by that
coordinate. An anchor that looks for scores of at least t needs, in a bucket of
greatest length m, a cosine of t / (|anchor| * m): above 1 the bucket is left
out, else each of the anchor's focus coordinates (its largest ones) allows one
range of values, which is one run of that coordinate's sorted list. Rows in
all of the runs are scored exactly in integers.

Buckets are searched from the longest rows to the shortest, so thresholds rise
early. A first search finds each anchor's positives (best rows of its label),
a second one each positive's negatives (best rows of other labels within the
window of scores); its threshold is the least that any of the anchor's
positives can still use. Pruning never loses a row: ranges are widened by more
than rounding can move a value, and without a positive threshold nothing is
pruned.

Cases: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do vectors with a component so large (beyond about
2^27 after scaling, for 64 components) that a score might pass 64 bits;
shorter vectors count as ending in zeros; other rows that repeat the anchor's
id are rows like any other, and each such anchor row has its own result; a
null id is never an anchor and comes last in ties; an anchor without another
row of its label gives nothing, nor does a positive with a score below 0, as
its window is empty; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.blocks import Best, as_queries, id_arrays, matrix, meet, quantised
from kestrel.llm.common import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score is from LEAST % to all of the positive's.
LEAST = 80
# Values in a bucket; coordinates of an anchor whose ranges are looked at.
BUCKET_VALUES = 1 << 18
FOCUS = 4
SLACK = 1e-9


def feasible(a: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value that unit vectors can have in a coordinate where the anchor, at unit
    length, has a, if their cosine with it is at least ``cosine`` (between 0 and 1)."""
    wide = np.sqrt(np.maximum(0, 1 - cosine * cosine) * np.maximum(0, 1 - a * a))
    low = np.where(a <= -cosine, -1.0, a * cosine - wide)
    high = np.where(a >= cosine, 1.0, a * cosine + wide)
    return low - SLACK, high + SLACK


class Bucket:
    """Rows of like length: exact scores, and the rows that may reach a score."""

    def __init__(self, v: np.ndarray, order: np.ndarray) -> None:
        self.v, self.order = v, order
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(length.max())
        self.unit = v / np.where(length > 0, length, 1)[:, None]
        self.sorted = np.take_along_axis(self.unit.T, order, axis=1)
        # Whole numbers below 2^53 are exact in doubles, whose products are much faster.
        peak = np.abs(v).max(initial=0)
        self.peak, self.fast = int(peak), v.astype(np.float64)

    def candidates(self, anchor: np.ndarray, length: float, least: int | None) -> np.ndarray | None:
        """Rows that may score at least ``least``; None means all of them."""
        if least is None or least <= 0:
            return None
        if not length or not self.longest:
            return np.zeros(0, np.int64)
        cosine = least / (length * self.longest) * (1 - SLACK)
        if cosine > 1:
            return np.zeros(0, np.int64)
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        low, high = feasible(unit[focus], cosine)
        start = [int(np.searchsorted(self.sorted[f], x, side="left")) for f, x in zip(focus, low)]
        stop = [int(np.searchsorted(self.sorted[f], x, side="right")) for f, x in zip(focus, high)]
        size = np.array(stop) - np.array(start)
        if (size == len(self.v)).all():
            return None
        by = np.argsort(size)
        rows = self.order[focus[by[0]], start[by[0]]: stop[by[0]]].astype(np.int64)
        for c in by[1:]:
            if size[c] < len(self.v):
                x = self.unit[rows, focus[c]]
                rows = rows[(x >= low[c]) & (x <= high[c])]
        return rows

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        if self.peak * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2 ** 53:
            return ((self.fast if rows is None else self.fast[rows]) @ anchor.astype(np.float64)).astype(np.int64)
        return (self.v if rows is None else self.v[rows]) @ anchor


def build_buckets(rows: DataFrame, dims: int) -> DataFrame:
    """Buckets, longest rows first, in the columns that blocks.meet takes and ``at`` to order them by."""
    most = max(64, BUCKET_VALUES // dims)

    def bucket(uid, ids, null, label, v, at):
        unit = v / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), 1)[:, None]
        order = np.argsort(unit.T, axis=1, kind="stable").astype(np.int32)
        body = v.tobytes() + order.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([uid], pa.list_(pa.int64())),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, mask=null)),
             pa.array([[]], pa.list_(pa.int64())), pa.array([label], pa.list_(pa.int64())), pa.array([body], pa.binary())],
            ["at", "uids", "ids", "nums", "labels", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, TaskContext.get().partitionId() << 32

        def take(size):
            t = pa.Table.from_batches(held)
            part, rest = t.slice(0, size), t.slice(size)
            ids, null = id_arrays(part.column("id"))
            made = bucket(part.column("uid").to_numpy(), ids, null, part.column("label").to_numpy(),
                          matrix(part.column("v"), dims), at)
            return made, rest.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            while n >= most:
                made, held = take(most)
                n, at = n - most, at + 1
                yield made
        if n:
            yield take(n)[0]

    long2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    by_length = rows.select("uid", "id", "label", "v", long2.alias("long2")).repartitionByRange(
        F.desc("long2"), F.xxhash64("uid")).sortWithinPartitions(F.desc("long2"))
    return staged(by_length.select("uid", "id", "label", "v").mapInArrow(
        run, "at bigint, uids array<bigint>, ids array<bigint>, nums array<bigint>, labels array<bigint>, body binary"),
        "hardneg_buckets")


class Search:
    """Anchors of one group against the buckets of a stripe (see blocks.meet)."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def begin(self, anchors: pa.Table) -> None:
        self.uid = matrix(anchors.column("uids"), 1)[:, 0]
        self.id = matrix(anchors.column("ids"), 1)[:, 0]
        self.v = matrix(anchors.column("nums"), self.dims)
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        self.prepare([np.asarray(x.values, dtype=np.int64) for x in anchors.column("labels")])

    def block(self, uids: np.ndarray, ids: tuple, nums: np.ndarray, label: np.ndarray, body: pa.Buffer) -> None:
        n = len(uids)
        v = np.frombuffer(body, np.int64, n * self.dims).reshape(n, self.dims)
        order = np.frombuffer(body, np.int32, n * self.dims, n * self.dims * 8).reshape(self.dims, n)
        bucket = Bucket(v, order)
        for i in range(len(self.uid)):
            wanted = self.wanted(i, label, uids)
            least = self.least(i)
            rows = bucket.candidates(self.v[i], self.length[i], least)
            rows = np.flatnonzero(wanted) if rows is None else rows[wanted[rows]]
            if len(rows):
                self.found(i, rows, bucket.scores(self.v[i], rows), ids, uids)


class Positives(Search):
    """The best other rows of the anchor's label."""

    def prepare(self, labels: list[np.ndarray]) -> None:
        self.label = np.array([x[0] for x in labels], np.int64)
        self.best = Best(len(labels), POSITIVES)

    def least(self, i: int) -> int | None:
        return self.best.floor(i)

    def wanted(self, i: int, label: np.ndarray, uids: np.ndarray) -> np.ndarray:
        return (label == self.label[i]) & (uids != self.uid[i])

    def found(self, i: int, rows: np.ndarray, score: np.ndarray, ids: tuple, uids: np.ndarray) -> None:
        self.best.add(i, score, ids[0][rows], ids[1][rows], uids[rows])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield self.best.batch([("anchor_uid", self.uid)])


class Negatives(Search):
    """For each positive of the anchor, the best rows of other labels within its window. The labels
    of an anchor row hold its label, then number and score of each positive."""

    def prepare(self, labels: list[np.ndarray]) -> None:
        self.label = np.array([x[0] for x in labels], np.int64)
        self.positives = [x[1:].reshape(-1, 2) for x in labels]
        self.first = np.cumsum([0] + [len(x) for x in self.positives])
        self.best = Best(int(self.first[-1]), NEGATIVES)

    def window(self, i: int, p: int) -> tuple[int, int]:
        top = int(self.positives[i][p, 1])
        floor = self.best.floor(self.first[i] + p)
        low = -(-LEAST * top // 100)
        return (low if floor is None else max(low, floor)), top

    def least(self, i: int) -> int | None:
        return min(self.window(i, p)[0] for p in range(len(self.positives[i])))

    def wanted(self, i: int, label: np.ndarray, uids: np.ndarray) -> np.ndarray:
        return label != self.label[i]

    def found(self, i: int, rows: np.ndarray, score: np.ndarray, ids: tuple, uids: np.ndarray) -> None:
        for p in range(len(self.positives[i])):
            low, top = self.window(i, p)
            inside = (score >= low) & (score <= top)
            if inside.any():
                r = rows[inside]
                self.best.add(self.first[i] + p, score[inside], ids[0][r], ids[1][r], uids[r])

    def end(self) -> Iterator[pa.RecordBatch]:
        n = np.diff(self.first)
        flat = np.concatenate([np.zeros((0, 2), np.int64), *self.positives])
        yield self.best.batch([("anchor_uid", np.repeat(self.uid, n)), ("positive_uid", flat[:, 0])])


def mine(df: DataFrame, is_anchor: Column, label: Column, scale: int = SCALE, id_col: str = "vec_id",
         vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row for
    which ``is_anchor`` (an expression over ``id``) holds; ``label`` is an expression over df."""
    rows = quantised(df, F.col(vec_col), scale, F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"))
    rows = staged(rows.filter("label is not null"), "hardneg_rows")
    anchors = rows.filter(F.col("id").isNotNull() & is_anchor)
    dims, n_anchors = rows.select(F.max(F.size("v")), F.count_if(F.col("id").isNotNull() & is_anchor)).first()
    dims = max(1, dims or 0)
    buckets = build_buckets(rows, dims)
    n_buckets = buckets.count()

    def of(key, k):
        w = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
        return lambda found: found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    near = meet(as_queries(anchors, F.col("v"), F.array("label")), n_anchors, buckets, n_buckets, "at",
                lambda: Positives(dims), "anchor_uid bigint, score bigint, id bigint, uid bigint")
    positives = staged(of(["anchor_uid"], POSITIVES)(near).select("anchor_uid", "score", "id", "uid"), "hardneg_positives")
    # Positives with a score below 0 have an empty window.
    pairs = positives.filter("score >= 0").groupBy(F.col("anchor_uid").alias("uid")).agg(
        F.flatten(F.collect_list(F.array("uid", "score"))).alias("pairs"))
    armed = anchors.join(pairs, "uid")
    far = meet(as_queries(armed, F.col("v"), F.concat(F.array("label"), "pairs")), n_anchors, buckets, n_buckets, "at",
               lambda: Negatives(dims), "anchor_uid bigint, positive_uid bigint, score bigint, id bigint, uid bigint")
    out = of(["anchor_uid", "positive_uid"], NEGATIVES)(far).select(
        "anchor_uid", "positive_uid", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("anchor_uid", F.col("uid").alias("positive_uid"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    return out.join(named, ["anchor_uid", "positive_uid"]).join(
        anchors.select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id")), "anchor_uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.uid AS au, a.vec_id AS anchor_id, c.uid AS cu, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v a JOIN v c ON c.uid <> a.uid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id ASC NULLS LAST, cu) AS r FROM s WHERE same),
n AS (
  SELECT p.au, p.cu, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.au, p.cu ORDER BY s.score DESC, s.vec_id ASC NULLS LAST, s.cu) AS rank
  FROM p JOIN s ON s.au = p.au AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.r <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
