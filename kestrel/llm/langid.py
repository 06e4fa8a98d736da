"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are no letters becomes one
blank. N-grams of 1 to 3 characters are hashed into a fixed number of buckets.
Training counts buckets per language over a bounded sample of labelled rows
(``TRAIN_DOCS``); the log-probability matrix (languages x buckets, of fixed
size per language) is broadcast, and whole texts are scored in numpy, one
Arrow batch at a time.

Cases: a null text, an empty one or one without a letter is ``und`` with score
0; without any labelled row every text is ``und``; equal scores go to the
language that sorts first; rows with a null language train nothing; repeated
rows are judged one by one; a null id counts as the empty text when rows are
held out; further columns are ignored or, with ``keep``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import bounded_sample, ddl, id_text, slices

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
# Bound on the labelled rows a model is fitted on (about; see bounded_sample).
TRAIN_DOCS = 20_000
SMOOTHING = 0.1
UNKNOWN = "und"
SLICE = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: (bucket, row) of every n-gram of the texts, rows ascending."""
    low = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    is_letter = letters()[cp]
    cp = np.where(is_letter, cp, np.uint32(0))
    # One blank per run: drop a blank that follows a blank of the same text.
    keep = is_letter.copy()
    if len(cp):
        keep[0] = True
        keep[1:] |= is_letter[:-1] | (row[1:] != row[:-1])
    cp, row = cp[keep], row[keep]
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            return
        # The hash of the gram that starts at each place, one character longer each round.
        h = (h[: len(cp) - n + 1] + cp[n - 1:] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if n in ORDERS:
            ok = row[: len(h)] == row[n - 1:]
            if n == 1:
                ok &= cp != 0
            yield (h[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS), row[: len(h)][ok]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket]) from rows with a language.

    Counts are summed by Spark; the driver gets at most languages x buckets rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                texts = part.column(1).to_pylist()
                for lang in set(langs):
                    acc = total.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    for bucket, _ in grams([t for t, la in zip(texts, langs) if la == lang]):
                        acc += np.bincount(bucket, minlength=1 << BUCKET_BITS)
        for lang, acc in total.items():
            hit = np.nonzero(acc)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(acc[hit], pa.int64())],
                ["lang", "bucket", "n"])

    counts = (labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col))
              .mapInArrow(count, "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    m = np.zeros((len(langs), 1 << BUCKET_BITS))
    m[np.searchsorted(langs, counts["lang"]), counts["bucket"]] = counts["n"]
    m += SMOOTHING
    return langs, np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32)


def score_texts(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language index, its posterior, whether the text has a letter) of each text."""
    n, k = len(texts), len(logp)
    total = np.zeros((n, k))
    seen = np.zeros(n, bool)
    for bucket, row in grams(texts):
        if not len(row):
            continue
        rows, start = np.unique(row, return_index=True)
        seen[rows] = True
        for j in range(k):
            total[rows, j] += np.add.reduceat(logp[j][bucket], start, dtype=np.float64)
    if not k:
        return np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
    best = total.argmax(axis=1)
    post = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
    return best, post, seen


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text_col: str = "text",
             pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``keep`` columns + predicted language and its score for every row of ``df``; a kept column of
    the name of a result gives way to it."""
    langs, logp = model
    keep = [c for c in keep if c.lower() not in (pred_col.lower(), score_col.lower())]
    shared = df.sparkSession.sparkContext.broadcast(logp)
    names = [*langs, UNKNOWN]
    cols = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                best, post, seen = score_texts(part.column(0).to_pylist(), shared.value)
                pred = pa.array([names[b] if s else UNKNOWN for b, s in zip(best, seen)], pa.string())
                out = {text_col: part.column(0)} | {c: part.column(i + 1) for i, c in enumerate(cols)}
                yield pa.RecordBatch.from_arrays(
                    [*(out[c] for c in keep), pred, pa.array(np.where(seen, post, 0.0))],
                    [*keep, pred_col, score_col])

    return df.select(text_col, *cols).mapInArrow(
        run, f"{ddl(df, keep)}, `{pred_col}` string, `{score_col}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(id_text(id_col).cast("binary")) % 5 == 0


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Model from the text and language of documents that are not held out."""
    eligible = docs.filter(~held_out() & F.col("lang").isNotNull())
    return train(bounded_sample(eligible, F.coalesce(F.col("doc_id").cast("string"), "text"), TRAIN_DOCS))
