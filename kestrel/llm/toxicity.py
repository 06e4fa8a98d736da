"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees hashed word and
word-prefix features and the probabilities of all earlier categories. While
training, the earlier probabilities are out-of-fold predictions, so a later
model learns from values like those it will meet.

Features are marks of presence, not counts, so one toxic word weighs the same
in a short and in a very long text. Feature counts per category are summed by
Spark over the labelled sample; only features that lean clearly towards a
category are kept for the models.

Cases: a null, empty or wordless text has the probability of a text without
features; without labelled rows, or without one of the two classes, the
category's probability is the share of positive rows (0 without rows); labels
null in a category are left out; an id labelled more than once counts with
its largest labels; repeated documents are judged one by one; null ids are
judged but never matched to labels; further columns are ignored or, with
``keep``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WordHashes, bounded_sample, ddl, id_text, slices, staged

PREFIXES = (4, 5, 6, 7)
# Bound on the labelled documents a chain is fitted on (about; see bounded_sample).
TRAIN_DOCS = 20_000
FOLDS = 3
# A feature is kept if it is in so many positive documents and leans to a category so clearly that
# about this many of all candidates would do so by chance (likelihood ratio test).
MIN_DOCS = 3
BY_CHANCE = 1.0
STEPS = 80
L2 = 2e-5
THRESHOLD = 0.5
SLICE = 1 << 20

# Seed words of two finer categories, for a caller who wants these: English words, and those of the given tables.
SEEDS = {"insult": ("idiot", "moron", "loser", "clown", "scum", "trash"),
         "contempt": ("stupid", "pathetic", "worthless", "disgusting")}
# The chain of the labels' own columns.
LABELLED = ("low_quality", "toxic")

# Letters, digits and all bytes of other scripts belong to words.
IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


class Features:
    """(feature, row) pairs of the texts of an Arrow column; a feature may come more than once."""

    def __init__(self) -> None:
        self.hasher = WordHashes(IN_WORD)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s, e, off = self.hasher.load(col)
        row = np.repeat(np.arange(len(col)), np.diff(off))
        feats, rows = [self.hasher.hashes(s, e)], [row]
        for k in PREFIXES:
            long = e - s > k
            # A prefix hashes apart from the word of the same letters.
            feats.append(self.hasher.hashes(s[long], s[long] + k) + np.uint64(k))
            rows.append(row[long])
        return np.concatenate(feats).view(np.int64), np.concatenate(rows)


class Lookup:
    """Positions of wanted features: a bitmap over 20 hash bits first, then the sorted list."""

    def __init__(self, features: np.ndarray) -> None:
        self.features = features
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[features & 0xFFFFF] = True

    def __call__(self, feat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (position, row) pairs of the wanted features, rows ascending."""
        hit = self.maybe[feat & 0xFFFFF]
        feat, row = feat[hit], row[hit]
        at = np.searchsorted(self.features, feat)
        at[at == len(self.features)] = 0
        same = self.features[at] == feat if len(self.features) else np.zeros(0, bool)
        n = max(1, len(self.features))
        key = np.unique(row[same].astype(np.int64) * n + at[same])
        return key % n, key // n


@dataclass
class Chain:
    """Weights of the links: per category a bias, weights of the kept features, weights of the
    earlier probabilities."""

    categories: list[str]
    features: np.ndarray
    bias: list[float]
    weights: list[np.ndarray]
    links: list[np.ndarray]

    def predict(self, feat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Probabilities [row, category]; ``feat`` are positions in ``features``."""
        p = np.zeros((n, len(self.categories)))
        for j in range(len(self.categories)):
            p[:, j] = link_predict(feat, row, p[:, :j], self.bias[j], self.weights[j], self.links[j])
        return p


def link_predict(feat, row, earlier, bias, weights, links) -> np.ndarray:
    z = bias + np.bincount(row, weights[feat], minlength=len(earlier)) + earlier @ links
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_link(feat: np.ndarray, row: np.ndarray, earlier: np.ndarray, y: np.ndarray, k: int):
    """Logistic regression with a quadratic penalty, by limited-memory quasi-Newton steps:
    (bias, weights, links)."""
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        return (-30.0 if share == 0 else 30.0), np.zeros(k), np.zeros(earlier.shape[1])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, a = x[1: k + 1], x[k + 1:]
        p = link_predict(feat, row, earlier, x[0], w, a)
        err = p - y
        grad = np.concatenate([[err.mean()], np.bincount(feat, err[row], minlength=k) / len(y) + L2 * w,
                               err @ earlier / len(y) + L2 * a])
        return -np.log(np.where(y == 1, p, 1 - p)).mean() + L2 / 2 * (w @ w + a @ a), grad

    x = np.zeros(1 + k + earlier.shape[1])
    x[0] = np.log(share / (1 - share))
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, alphas = -g, []
        for s, d in reversed(past):
            alphas.append((s @ step) / (s @ d))
            step = step - alphas[-1] * d
        step = step * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(g).max()))
        for (s, d), alpha in zip(past, reversed(alphas)):
            step = step + (alpha - (d @ step) / (s @ d)) * s
        t, slope = 1.0, g @ step
        while True:
            f_new, g_new = loss(x + t * step)
            if f_new <= f + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, d = t * step, g_new - g
        if s @ d > 1e-14:
            past = [*past[-7:], (s, d)]
        x, done = x + s, f - f_new < 1e-7 * max(1.0, f)
        f, g = f_new, g_new
        if done:
            break
    return x[0], x[1: k + 1], x[k + 1:]


def fit_chain(categories: list[str], features: np.ndarray, feat: np.ndarray, row: np.ndarray,
              y: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the links in order; the probabilities handed on are out-of-fold predictions."""
    n, k = len(y), len(features)
    chain = Chain(categories, features, [], [], [])
    passed = np.zeros((n, len(categories)))
    for j in range(len(categories)):
        target = y[:, j].astype(float)
        known = ~np.isnan(target)
        earlier = passed[:, :j]

        def part(rows: np.ndarray):
            place = np.cumsum(rows) - 1
            mine = rows[row]
            return feat[mine], place[row[mine]], earlier[rows]

        for f in range(FOLDS):
            fitted = fit_link(*part(known & (fold != f)), target[known & (fold != f)], k)
            passed[fold == f, j] = link_predict(*part(fold == f), *fitted)
        b, w, a = fit_link(*part(known), target[known], k)
        chain.bias.append(b)
        chain.weights.append(w)
        chain.links.append(a)
    return chain


def lean(n: np.ndarray, pos: np.ndarray, docs: float, docs_pos: float) -> np.ndarray:
    """Likelihood ratio statistic of a feature's positive rows against the share of positive rows,
    0 where the feature leans away."""
    p = docs_pos / docs if docs else 0.0
    n, pos = n.astype(float), pos.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = pos * np.log(pos / (n * p)) + (n - pos) * np.log((n - pos) / (n * (1 - p)))
        one = pos * np.log(1 / p) if p else pos * 0
    return np.where(pos > n * p, 2 * np.where(n == pos, one, g), 0.0)


def train(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from rows (id, text, one 0/1 column per category). The caller bounds the rows."""
    flags = [F.col(x).cast("int").alias(x) for x in categories]
    fold = F.pmod(F.xxhash64(id_text(id_col)), F.lit(FOLDS)).cast("int").alias("fold")
    base = staged(labelled.select(F.col(text_col).alias("text"), fold, *flags), "toxicity_sample")
    # Per category: the rows whose label is known, and the positive ones.
    known = [f"n_{x}" for x in categories]
    counts = ", ".join(f"`{x}` bigint" for x in [*known, *categories])

    def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                feat, row = of(part.column(0))
                for i in range(part.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(feat[row == i]))], ["feature"])

    positive = base.filter(" or ".join(f"`{x}` = 1" for x in categories)).select("text")
    often = (positive.mapInArrow(list_features, "feature bigint").groupBy("feature").count()
             .filter(F.col("count") >= MIN_DOCS).select("feature").toPandas()["feature"].to_numpy(np.int64))
    often = np.sort(often)
    wanted = labelled.sparkSession.sparkContext.broadcast(often)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lookup = Features(), Lookup(wanted.value)
        n = np.zeros((2 * len(categories), len(lookup.features)), np.int64)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                at, row = lookup(*of(part.column(0)))
                flags = part.columns[2:]
                for j, y in enumerate([*[x.is_valid() for x in flags], *[x.fill_null(0) for x in flags]]):
                    n[j] += np.bincount(at, y.to_numpy(zero_copy_only=False)[row], minlength=n.shape[1]).astype(np.int64)
        hit = np.nonzero(n.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), *[pa.array(x[hit], pa.int64()) for x in n]],
                                         ["at", *known, *categories])

    totals = base.agg(*[F.count(x).alias(n) for n, x in zip(known, categories)],
                      *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in categories]).first()
    features = often
    if len(often):
        sums = (base.mapInArrow(count, "at int, " + counts).groupBy("at")
                .agg(*[F.sum(x).alias(x) for x in [*known, *categories]]).toPandas().sort_values("at"))
        score = np.max([lean(sums[n].to_numpy(), sums[x].to_numpy(), totals[n], totals[x])
                        for n, x in zip(known, categories)], axis=0)
        features = often[sums["at"].to_numpy()[score >= 2 * np.log(len(often) / BY_CHANCE)]]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lookup = Features(), Lookup(features)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                at, row = lookup(*of(part.column(0)))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, *part.columns[1:]], ["feats", "fold", *categories])

    rows = base.mapInArrow(pick, "feats array<int>, fold int, " + ", ".join(f"`{x}` int" for x in categories)).toArrow()
    lists = rows.column("feats").combine_chunks()
    feat = np.asarray(lists.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    y = np.stack([rows.column(x).to_numpy().astype(float) for x in categories], axis=1)
    return fit_chain(categories, features, feat, row, y, rows.column("fold").to_numpy())


def score(df: DataFrame, chain: Chain, keep: list[str], text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``keep`` columns + the probability of each category for every row of ``df``; a kept column of
    the name of a probability gives way to it."""
    names = [prefix + c for c in chain.categories]
    keep = [c for c in keep if c.lower() not in {x.lower() for x in names}]
    cols = [c for c in keep if c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = Features(), shared.value
        lookup = Lookup(model.features)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                p = model.predict(*lookup(*of(part.column(0))), part.num_rows)
                out = {text_col: part.column(0)} | {c: part.column(i + 1) for i, c in enumerate(cols)}
                yield pa.RecordBatch.from_arrays(
                    [*(out[c] for c in keep), *[pa.array(p[:, j]) for j in range(len(names))]], [*keep, *names])

    schema = ddl(df, keep) + "".join(f", `{x}` double" for x in names)
    return df.select(text_col, *cols).mapInArrow(run, schema)


def fit_documents(docs: DataFrame, labels: DataFrame, seeds: dict[str, tuple[str, ...]] | None = None) -> Chain:
    """A chain from the labelled documents that ends in the given label ``toxic``. Without ``seeds``
    its earlier link is the other given label (quality 0); with them, the links are toxic texts
    that hold one of a category's seed words."""
    flags = {"low_quality": (F.col("quality") == 0).cast("int"), "toxic": F.col("toxic")}
    used = ["toxic"] if seeds else list(LABELLED)
    once = (labels.select("doc_id", *[flags[x].alias(x) for x in used])
            .filter("doc_id is not null and (" + " or ".join(f"{x} is not null" for x in used) + ")")
            .groupBy("doc_id").agg(*[F.max(x).alias(x) for x in used]))
    # About TRAIN_DOCS rows of an id and flags: small enough to send to every task.
    sample = bounded_sample(once, id_text("doc_id"), TRAIN_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # An id may stand for many rows: the bound is one of rows.
    rows = bounded_sample(staged(rows.withColumn("_row", F.monotonically_increasing_id()), "toxicity_labelled"),
                          F.col("_row"), 2 * TRAIN_DOCS).drop("_row")
    for name, words in (seeds or {}).items():
        hit = F.coalesce(F.col("text").rlike(r"(?i)\b(" + "|".join(words) + r")\b"), F.lit(False))
        rows = rows.withColumn(name, ((F.col("toxic") == 1) & hit).cast("int"))
    return train(rows, [*(seeds or {}), *used])
