"""Bit-sliced top-k and hard negatives against plain loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import bitslice, blocks, hardneg

VEC = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def rows_of(seed, n=220, dims=6, hot=60):
    """Random rows with a very common vector, ids that repeat, a null id and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32) * rng.choice([0.2, 1, 3], n)[:, None].astype(np.float32)
    x[10: 10 + hot] = x[10]
    x[100] = 0
    rows = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(x)]
    rows += [(20, x[3].tolist(), 1), (None, x[10].tolist(), 1), (None, x[20].tolist(), 2), (300, x[5, :4].tolist(), 0), (400, [], 1)]
    odd = [(500, None, 0), (600, [NAN] + [1.0] * 5, 0), (700, [None] + [1.0] * 5, 0), (800, [INF] + [1.0] * 5, 0)]
    return rows, odd


def integers(rows, scale):
    dims = max((len(r[1]) for r in rows), default=0)
    v = np.zeros((len(rows), dims), object)
    for i, r in enumerate(rows):
        for d, a in enumerate(r[1]):
            v[i, d] = int(np.floor(scale * float(np.float32(a))))
    return v


def order(rows, score, among):
    """Best first: larger score, smaller id, null ids last."""
    return sorted(among, key=lambda j: (-score[j], rows[j][0] is None, rows[j][0] or 0, j))


def key(r):
    return tuple((x is None, x or 0) for x in r)


# --- bitmaps ---

@pytest.mark.parametrize("seed", range(4))
def test_bitmap_sums_are_inner_products(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 60, (150, 5))
    x[:, 3] = 7
    low, bits, slices = bitslice.cut_slices(x)
    index = bitslice.Block(low, bits, slices, len(x))
    for _ in range(20):
        w = rng.integers(-70, 70, 5) * rng.integers(0, 2, 5)
        at, score = index.top(w, bitslice.signed_digits(w[None, :])[0], 4, 30)
        full = x @ w
        assert (full[at] == score).all() and len(at) == 30 and 4 not in at
        want = sorted((i for i in range(150) if i != 4), key=lambda i: (-full[i], i))[:30]
        assert sorted(at.tolist()) == sorted(want)


def test_signed_digits():
    w = np.arange(-300, 300)
    d = bitslice.signed_digits(w)
    assert (d @ (1 << np.arange(d.shape[1])) == w).all()
    assert not (d[:, 1:] * d[:, :-1]).any()


# --- exact top-k ---

@pytest.mark.parametrize("seed", range(3))
def test_topk_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_VALUES", 6 * 70)  # several blocks
    monkeypatch.setattr(blocks, "SPREAD_QUERIES", 4)  # several groups
    monkeypatch.setattr(blocks, "STRIPE_BLOCKS", 2)
    rows, odd = rows_of(seed)
    v = integers(rows, 64)
    want = []
    for i, r in enumerate(rows):
        if r[0] is not None and r[0] % 20 == 0:
            score = [int(s) for s in v @ v[i]]
            best = order(rows, score, [j for j in range(len(rows)) if j != i])[:20]
            want += [(r[0], n + 1, rows[j][0], score[j]) for n, j in enumerate(best)]
    got = bitslice.search(spark.createDataFrame(rows + odd, VEC).repartition(3), F.col("id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_topk_few_and_none(spark):
    assert bitslice.search(spark.createDataFrame([], VEC), F.col("id") % 20 == 0).collect() == []
    one = bitslice.search(spark.createDataFrame([(0, [1.0, 2.0], 1)], VEC), F.col("id") % 20 == 0)
    assert one.collect() == []
    df = spark.createDataFrame([(0, [1.0, -2.0], 1), (1, [3.0, 0.5], 1)], VEC).withColumn("uid", F.lit("x")).withColumn(
        "score", F.lit(1)).withColumn("v", F.lit(2)).withColumn("id", F.lit(None).cast("string"))
    assert [tuple(r) for r in bitslice.search(df, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 192 - 128 * 32)]


def test_topk_of_large_values(spark):
    rows = [(i, [float(2.0 ** (i % 20)), -float(2.0 ** (i % 17)), 0.25 * i], 0) for i in range(45)] + [(60, [3e38, 1.0, 1.0], 0)]
    v = integers(rows[:45], 64)
    got = bitslice.search(spark.createDataFrame(rows, VEC), F.col("id") % 20 == 0, k=3).collect()
    for q in (0, 20, 40):
        score = [int(s) for s in v @ v[q]]
        best = order(rows, score, [j for j in range(45) if j != q])[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [
            (rows[j][0], score[j]) for j in best]


# --- hard negatives ---

def brute_negatives(rows, v):
    out = []
    label = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in rows]
    for i, r in enumerate(rows):
        if r[0] is None or r[0] % 10:
            continue
        score = [int(s) for s in v @ v[i]]
        same = order(rows, score, [j for j in range(len(rows)) if j != i and label[j] == label[i]])[:5]
        for p in same:
            near = [j for j in range(len(rows)) if label[j] != label[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [(r[0], rows[p][0], n + 1, rows[j][0], score[p], score[j]) for n, j in enumerate(order(rows, score, near)[:5])]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_negatives_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hardneg, "BUCKET_VALUES", 6 * 64)
    monkeypatch.setattr(blocks, "SPREAD_QUERIES", 4)
    monkeypatch.setattr(blocks, "STRIPE_BLOCKS", 3)
    rows, odd = rows_of(seed)
    rows = [(*r[:2], r[2] if n % 9 else 5) for n, r in enumerate(rows)]
    odd = odd + [(900, [1.0] * 6, None)]
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    got = hardneg.mine(spark.createDataFrame(rows + odd, VEC).repartition(3), F.col("id") % 10 == 0, moved).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_negatives(rows, integers(rows, 256)), key=key)


def test_negatives_none_and_clashing_names(spark):
    assert hardneg.mine(spark.createDataFrame([], VEC), F.col("id") % 10 == 0, F.col("label")).collect() == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (3, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VEC).withColumn("uid", F.lit("a")).withColumn("score", F.lit("b")).withColumn("id", F.lit("c"))
    got = [tuple(r) for r in hardneg.mine(df, F.col("id") % 10 == 0, F.col("label")).collect()]
    assert got == [(0, 1, 1, 2, 2 * 65536, 65536 + 256 * 230)]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_never_lose_a_row(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-300, 300, (400, 8)) * rng.choice([1, 1, 9], 400)[:, None]
    anchor = rng.integers(-300, 300, 8)
    v[:50] = anchor + rng.integers(-20, 20, (50, 8))
    unit = v / np.sqrt((v ** 2).sum(axis=1))[:, None]
    bucket = hardneg.Bucket(v, np.argsort(unit.T, axis=1).astype(np.int32))
    score = v @ anchor
    pruned = 0
    for least in np.sort(score)[[-1, -3, -20, -60, -200]]:
        rows = bucket.candidates(anchor, float(np.sqrt((anchor ** 2).sum())), int(least))
        if rows is not None:
            pruned += len(v) - len(rows)
            assert set(np.flatnonzero(score >= least)) <= set(rows.tolist())
    assert pruned
