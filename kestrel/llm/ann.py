"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: every node splits at the median of the
projection, among a few random directions, that spreads its sample most. Every
vector is indexed under its leaf in each tree. A query walks all trees through
one shared priority queue, ordered by the squared distance to the planes that
were crossed the wrong way, and takes the leaves in the order they are popped;
members of those leaves are reranked by exact inner products in double
precision.

How many leaves a query pops is measured, not guessed: a bounded set of the
queries is compared with all vectors, and the count is the smallest with which
``TARGET`` of their true neighbours are found. On vectors without structure
that may be a large share of all leaves.

A leaf is searched in blocks of bounded size, so one very common vector fills
many blocks, not one task; within a task only the best of each query are kept.

Cases: vectors null, zero, of another length than most, or with null or
non-finite components take no part, nor do rows with a null id; rows that
repeat an id are one candidate with its best score, and a query never finds
its own id; equal scores go to the smaller id; fewer candidates than asked for
give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import bounded_sample, id_text, staged

TREES = 4
LEAF_ROWS = 512
MAX_DEPTH = 12
DIRECTIONS = 8
# Bounds on the sample the trees are fitted on and on the queries the search is measured with.
SAMPLE_ROWS = 32_768
MEASURED_QUERIES = 256
TARGET = 0.95
# Vectors of a leaf searched at once, candidates a task gathers before it keeps the best of each query.
BLOCK = 4096
GATHER = 1_000_000
SEED = 2


@dataclass
class Forest:
    depth: int
    planes: np.ndarray  # [tree, node, dimension]
    cuts: np.ndarray  # [tree, node]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in each tree [row, tree]."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = (x * self.planes[t][node]).sum(axis=1) > self.cuts[t][node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2 ** self.depth - 1)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances to all planes [row, tree, node]."""
        return np.einsum("qd,tnd->qtn", x, self.planes) - self.cuts

    def walk(self, margins: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order a query with these margins [tree, node] pops them."""
        inner = 2 ** self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue:
            cost, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            yield t, node - inner


def fit_forest(sample: np.ndarray, rows: int) -> Forest:
    """Trees over a sample of ``rows`` vectors, deep enough for leaves of about LEAF_ROWS."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, rows) / LEAF_ROWS)))))
    nodes, dim = 2 ** depth - 1, sample.shape[1]
    rng = np.random.default_rng(SEED)
    planes, cuts = np.zeros((TREES, nodes, dim)), np.zeros((TREES, nodes))
    for t in range(TREES):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            mine = members.pop(node)
            d = rng.standard_normal((DIRECTIONS, dim))
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            p = sample[mine] @ d.T
            best = int(p.std(axis=0).argmax()) if len(mine) else 0
            planes[t, node] = d[best]
            cuts[t, node] = np.median(p[:, best]) if len(mine) else 0.0
            right = p[:, best] > cuts[t, node]
            members[2 * node + 1], members[2 * node + 2] = mine[~right], mine[right]
    return Forest(depth, planes, cuts)


def vectors(col: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.coalesce(ok, F.lit(False)))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (common["n"] if common else 0))


def best(q: np.ndarray, x: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct candidates of each query: larger score first, then smaller id."""
    order = np.lexsort((x, -s, q))
    q, x, s = q[order], x[order], s[order]
    # Equal (query, id) pairs: the first, best one stays.
    pair = np.lexsort((np.arange(len(q)), x, q))
    again = np.zeros(len(q), bool)
    again[pair[1:]] = (q[pair[1:]] == q[pair[:-1]]) & (x[pair[1:]] == x[pair[:-1]])
    q, x, s = q[~again], x[~again], s[~again]
    start = np.searchsorted(q, q)
    keep = np.arange(len(q)) - start < k
    return q[keep], x[keep], s[keep]


def rerank(qid: np.ndarray, qv: np.ndarray, xid: np.ndarray, xv: np.ndarray, k: int):
    """(query, id, score) of at least the k nearest of a block, exact inner products.

    The matrix product only chooses; scores are summed again in one fixed order, so equal vectors
    have equal scores wherever they lie.
    """
    rough = qv @ xv.T
    rough[qid[:, None] == xid[None, :]] = -np.inf
    m = min(k, len(xid))
    floor = np.partition(rough, len(xid) - m, axis=1)[:, len(xid) - m]
    slack = 1e-9 * (1 + np.where(np.isfinite(floor), np.abs(floor), 0))
    i, j = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
    return best(qid[i], xid[j], (qv[i] * xv[j]).sum(axis=1), k)


def measured_leaves(all_rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], forest: Forest, k: int) -> int:
    """The smallest number of leaves with which TARGET of the true neighbours are found."""
    qid, qv = queries
    place = np.full((len(qid), TREES, 2 ** forest.depth), 0, np.int32)
    for i, m in enumerate(forest.margins(qv)):
        for n, (t, leaf) in enumerate(forest.walk(m)):
            place[i, t, leaf] = n
    shared = all_rows.sparkSession.sparkContext.broadcast((qid, qv, place, forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv, place, forest = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), vectors(batch.column(1))
            q, i, s = rerank(qid, qv, ids, x, k)
            leaf = forest.leaves(x)
            order = np.argsort(ids, kind="stable")
            row = order[np.searchsorted(ids[order], i)]
            found = place[np.searchsorted(qid, q)[:, None], np.arange(TREES)[None, :], leaf[row]].min(axis=1)
            part = (q, i, s, found)
            held = part if held is None else tuple(np.concatenate(p) for p in zip(held, part))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in held], ["q", "id", "s", "found"])

    near = all_rows.select("id", "v").mapInArrow(run, "q bigint, id bigint, s double, found int")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    top = near.groupBy("q", "id").agg(F.max("s").alias("s"), F.min("found").alias("found")).withColumn(
        "rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("found").toPandas()["found"].to_numpy()
    return int(np.sort(top)[max(0, int(np.ceil(TARGET * len(top))) - 1)]) + 1 if len(top) else 1


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` (an
    expression over ``id``) holds, among all rows."""
    spark = df.sparkSession
    rows = staged(usable(df, id_col, vec_col), "ann_vectors")
    n = rows.count()
    sample = bounded_sample(rows, id_text("id"), SAMPLE_ROWS).orderBy("id").toArrow()
    x = vectors(sample.column("v").combine_chunks()) if n else np.zeros((0, 1))
    forest = fit_forest(x, n)
    queries = rows.filter(is_query)
    some = bounded_sample(queries, id_text("id"), MEASURED_QUERIES).dropDuplicates(["id"]).orderBy("id").toArrow()
    leaves = 1
    if some.num_rows:
        leaves = measured_leaves(rows, (some.column("id").to_numpy(), vectors(some.column("v").combine_chunks())), forest, k)
    shared = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaves(vectors(batch.column(1))).astype(np.int32)
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(leaf[:, t]), *batch.columns],
                        ["tree", "leaf", "id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    members = staged(rows.select("id", "v").mapInArrow(index, f"tree int, leaf int, id bigint, v {kind}"), "ann_index")
    sizes = members.groupBy("tree", "leaf").count().toPandas()
    size = np.zeros((TREES, 2 ** forest.depth), np.int64)
    size[sizes["tree"], sizes["leaf"]] = sizes["count"]
    counts = spark.sparkContext.broadcast(size)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, tree, leaf = [], [], []
                for i, m in enumerate(shared.value.margins(vectors(part.column(1)))):
                    held = np.zeros(TREES, np.int64)
                    for popped, (t, at_leaf) in enumerate(shared.value.walk(m)):
                        # Enough leaves, and one tree alone has given enough candidates.
                        if popped >= leaves and held.max() > k:
                            break
                        held[t] += counts.value[t, at_leaf]
                        row.append(i)
                        tree.append(t)
                        leaf.append(at_leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()),
                     part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["tree", "leaf", "id", "v"])

    probes = queries.select("id", "v").mapInArrow(probe, f"tree int, leaf int, id bigint, v {kind}")
    # Leaves of more than BLOCK rows are dealt over several blocks; a query visits all of them.
    large = sizes[sizes["count"] > BLOCK]
    blocks = F.lit(1)
    if len(large):
        parts = spark.createDataFrame([(int(t), int(f), int(-(-c // BLOCK))) for t, f, c in large.itertuples(index=False)],
                                      "tree int, leaf int, blocks int")
        members = members.join(F.broadcast(parts), ["tree", "leaf"], "left")
        probes = probes.join(F.broadcast(parts), ["tree", "leaf"], "left")
        blocks = F.coalesce("blocks", F.lit(1))
    m = members.select("tree", "leaf", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    p = probes.select("tree", "leaf", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")
    both = m.unionByName(p).repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "kind", "id")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        here, ids, vecs = None, [], []

        def kept():
            return best(*(np.concatenate(x) for x in zip(*found)), k)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(4)])
            cut = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for i, j in zip(cut, cut[1:]):
                leaf, kind = tuple(key[:3, i]), key[3, i]
                part = batch.slice(i, j - i)
                if leaf != here:
                    here, ids, vecs = leaf, [], []
                if kind == 0:
                    ids.append(part.column(4).to_numpy())
                    vecs.append(vectors(part.column(5)))
                elif ids:
                    ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    qid, qv = part.column(4).to_numpy(), vectors(part.column(5))
                    for a in range(0, len(qid), 256):
                        found.append(rerank(qid[a: a + 256], qv[a: a + 256], ids[0], vecs[0], k))
                    if sum(len(x[0]) for x in found) > GATHER:
                        found = [kept()]
                        if len(found[0][0]) > GATHER // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["query_id", "vec_id", "score"])
                            found = [(none, none, np.zeros(0))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept()], ["query_id", "vec_id", "score"])

    near = both.mapInArrow(visit, "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
