"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a text starts a suffix: itself and up to three words that follow
in its piece. Words travel as 64-bit keys made of language and word; the table
of all words proves that no two share a key (else another seed is taken).

1. Words are counted. 2. Pairs of frequent words are counted, as what leads a
suffix; they tell which suffixes to abandon and how to deal the rest. 3. The
remaining suffixes, cut before the first infrequent pair, are summed up where
they arise and dealt by their leading words; a leading pair with very many
suffixes is dealt by whole suffixes instead, so it is no hot group. Each task
sorts pointers to its suffixes, a bounded number at a time: every round splits
all open partitions at once by a pivot into smaller, equal and larger; an equal
partition's weight is the count of a phrase and is sorted on by the next word;
partitions lighter than the least count are abandoned. Filters of frequent
words and pairs are bitmaps of bounded size: they may let some rows pass in
vain, but lose none. A text is read in runs of bounded size.

Phrases are scored, dropped inside longer ones, and ranked by joins and
windows over the frequent phrases.

Cases: a null language counts as ``und``; null, empty and blank texts hold no
words; repeated rows count as often as they occur; ties are ranked by count,
then by the phrase's bytes; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import WordHashes, mix64, slices, small_side, staged, text_bytes

# The characters that end a piece, and the blanks between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
WORDS = 4
MIN_COUNT = 30
TOP = 2000
# A phrase is dropped inside a longer one that is at least this many % as frequent.
INSIDE = 80
FACTOR = 2_000_000
# Bytes of text worked on at once; suffixes sorted at once; suffixes from which a leading pair is dealt by whole suffixes.
SLICE = 2 << 20
CHUNK = 1 << 20
HOT = 1 << 18
# Phrases and words (with their texts) that may be broadcast.
BROADCAST_ROWS = 100_000
# Bits of a filter: so many for each member, within these bounds (at most 32 MB).
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 28

_BREAK, _WORD = np.zeros(256, bool), np.ones(256, bool)
_BREAK[list(BREAKS)] = True
_WORD[list(BREAKS + BLANKS)] = False
_U64 = np.uint64
_OTHER_BASE, _ODD = _U64(0xBF58476D1CE4E5B9), _U64(0x9E3779B97F4A7C15)
KEYS = [f"h{i + 1}" for i in range(WORDS)]


def runs(data: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """A long text's bytes as (start, stop, end): words that start before stop are the run's own, and
    up to end lie the words that their suffixes may reach."""
    start = 0
    while start < len(data):
        stop = end = len(data)
        if len(data) - start > limit:
            breaks = np.flatnonzero(_BREAK[data[start: start + limit]])
            if len(breaks):
                stop = end = start + int(breaks[-1]) + 1
            else:
                reach = limit
                while start + reach < len(data) and _WORD[data[start: start + reach]].all():
                    reach *= 2
                gaps = np.flatnonzero(~_WORD[data[start: start + reach]])
                stop = start + (int(gaps[-1]) + 1 if len(gaps) else len(data) - start)
                end, ahead = stop, 1 << 12
                while True:  # as far as WORDS - 1 whole words further on
                    word = _WORD[data[stop: stop + ahead]]
                    closed = np.flatnonzero(word[:-1] & ~word[1:])
                    if len(closed) >= WORDS - 1 or stop + ahead >= len(data):
                        end = stop + (int(closed[WORDS - 2]) + 1 if len(closed) >= WORDS - 1 else len(data) - stop)
                        break
                    ahead *= 2
        yield start, stop, end
        start = stop


class Words:
    """Keys, pieces and places of the words of a batch (lang, key of lang, text), run by run."""

    def __init__(self, seed: int) -> None:
        self.seed = _U64(seed)
        self.a, self.b = WordHashes(_WORD), WordHashes(_WORD, _OTHER_BASE)

    def of(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2, SLICE):
            data, off = text_bytes(part.column(2))
            if len(data) <= SLICE or part.num_rows > 1:
                yield from self.load(part.column(0), part.column(1), part.column(2), off, len(data))
            else:
                for start, stop, end in runs(data, SLICE):
                    text = pa.array([data[start:end].tobytes()], pa.large_binary())
                    yield from self.load(part.column(0), part.column(1), text, np.array([0, end - start]), stop - start)

    def load(self, lang: pa.Array, lang_key: pa.Array, text: pa.Array, off: np.ndarray, own: int) -> Iterator["Words"]:
        self.lang = lang
        self.s, self.e, words = self.a.load(text)
        self.data = self.b.data = self.a.data
        self.own = int(np.searchsorted(self.s, own))
        if not self.own:
            return
        self.text = np.repeat(np.arange(len(text)), np.diff(words))
        self.lang_key = lang_key.to_numpy().astype(np.int64).view(np.uint64)[self.text]
        self.parts = (self.a.hashes(self.s, self.e), self.b.hashes(self.s, self.e))
        key = mix64((self.parts[0] ^ mix64(self.parts[1] + self.seed)) + mix64(self.lang_key) * _ODD)
        # 0 stands for no word.
        self.key = np.where(key == 0, _U64(1), key)
        ended = np.cumsum(_BREAK[self.data])
        self.piece = ended[self.s] + self.text
        # Neighbours in one piece.
        self.joined = np.append(self.piece[1:] == self.piece[:-1], False)
        yield self

    def counts(self) -> pa.RecordBatch:
        """(h, lang, word, cnt) of the run's own words."""
        n = self.own
        h, at, back, cnt = np.unique(self.key[:n], return_index=True, return_inverse=True, return_counts=True)
        rep = at[back]
        clash = np.flatnonzero((self.parts[0][:n] != self.parts[0][rep]) | (self.parts[1][:n] != self.parts[1][rep])
                               | (self.lang_key[:n] != self.lang_key[rep]))
        np.subtract.at(cnt, back[clash], 1)
        at, h, cnt = np.concatenate([at, clash]), np.concatenate([h, self.key[clash]]), np.concatenate([cnt, np.ones(len(clash), int)])
        raw = self.data.tobytes()
        word = pa.array([raw[a:b] for a, b in zip(self.s[at].tolist(), self.e[at].tolist())], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), self.lang.take(pa.array(self.text[at])).cast(pa.string()),
                                           word, pa.array(cnt, pa.int64())], ["h", "lang", "word", "cnt"])

    def pair_keys(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word and the next one are frequent words of one piece, key of the pair) for every word."""
        good = member(frequent, self.key)
        both = self.joined & good
        both[:-1] &= good[1:]
        following = np.append(self.key[1:], _U64(0))
        return both, mix64(self.key + mix64(following) * _ODD)


def member(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & _U64(len(bits) * 8 - 1)
    return (bits[(at >> _U64(3)).astype(np.int64)] >> (at & _U64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """A bit for every key, in bytes; keys that meet in a bit are all taken for members."""
    n = keys.count()
    size = FILTER_LEAST
    while size < min(FILTER_MOST, FILTER_BITS * n):
        size *= 2
    at = F.pmod(F.col(col), F.lit(size)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096: r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def sort_suffixes(h: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, pointer to one suffix, count) of every phrase of at least ``least`` occurrences that
    begins one of the suffixes h [row, WORDS]."""
    pointer, start, depth = np.arange(len(h)), np.zeros(min(1, len(h)), np.int64), np.zeros(min(1, len(h)), np.int64)
    found = [(depth[:0], pointer[:0], weight[:0])]
    while len(start):
        size = np.diff(np.append(start, len(pointer)))
        heavy = np.add.reduceat(weight[pointer], start) >= least
        if not heavy.all():
            pointer = pointer[np.repeat(heavy, size)]
            size, depth = size[heavy], depth[heavy]
            start = np.cumsum(size) - size
            if not len(start):
                break
        of = np.repeat(np.arange(len(start)), size)
        value = h[pointer, depth[of]]
        # Pivot: the median of the first, middle and last value.
        x, y, z = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))
        small, same = value < pivot[of], value == pivot[of]
        parts = np.stack([small, same, ~(small | same)])
        counts = np.stack([np.add.reduceat(p.astype(np.int64), start) for p in parts])
        # Places of the three parts of every partition, one after the other.
        first = start + np.cumsum(counts, axis=0) - counts
        moved = np.empty_like(pointer)
        for p, f, c in zip(parts, first, counts):
            moved[(np.cumsum(p) - 1 + (f - np.cumsum(c) + c)[of])[p]] = pointer[p]
        pointer = moved
        summed = np.append(0, np.cumsum(weight[pointer]))
        total = summed[first[1] + counts[1]] - summed[first[1]]
        named = (pivot != 0) & (total >= least)
        found.append((depth[named] + 1, pointer[first[1][named]], total[named]))
        # Equal parts go on with the next word, unless the suffix ends there.
        go = np.stack([counts[0] > 0, named & (depth + 1 < h.shape[1]), counts[2] > 0])
        begin, length, deep = first.T[go.T], counts.T[go.T], np.stack([depth, depth + 1, depth]).T[go.T]
        edge = np.zeros(len(pointer) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
        keep = np.cumsum(edge[:-1]) > 0
        pointer, depth = pointer[keep], deep
        start = np.cumsum(length) - length
    return tuple(np.concatenate(x) for x in zip(*found))


def frequent_phrases(texts: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """(h1.., n_words, a) of every phrase of two words or more; texts are (lang, lang_key, text)."""
    sc = texts.sparkSession.sparkContext
    frequent = sc.broadcast(bitmap(words.filter(F.col("cnt") >= least), "h"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Words(seed)
        for batch in batches:
            for w in source.of(batch):
                both, key = w.pair_keys(frequent.value)
                key, cnt = np.unique(key[: w.own][both[: w.own]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cnt, pa.int64())], ["p", "cnt"])

    led = staged(texts.mapInArrow(pairs, "p bigint, cnt bigint").groupBy("p").agg(F.sum("cnt").alias("cnt"))
                 .filter(F.col("cnt") >= least), "phrase_pairs")
    leading = sc.broadcast(bitmap(led, "p"))
    hot = sc.broadcast(bitmap(led.filter(F.col("cnt") > HOT), "p"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Words(seed)
        for batch in batches:
            for w in source.of(batch):
                both, key = w.pair_keys(frequent.value)
                both &= member(leading.value, key)
                at = np.flatnonzero(both[: w.own])
                h = np.zeros((len(at), WORDS), np.uint64)
                h[:, 0] = w.key[at]
                on = np.ones(len(at), bool)
                for d in range(1, WORDS):
                    on[on] = both[at[on] + d - 1]
                    h[on, d] = w.key[at[on] + d]
                # Equal suffixes of the run are one row.
                whole = h[:, 0]
                for d in range(1, WORDS):
                    whole = mix64(whole * _ODD + h[:, d])
                _, rep, back, cnt = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                differ = np.flatnonzero((h != h[rep[back]]).any(axis=1))
                np.subtract.at(cnt, back[differ], 1)
                rep, cnt = np.concatenate([rep, differ]), np.concatenate([cnt, np.ones(len(differ), int)])
                many = member(hot.value, key[at[rep]])
                route = np.where(many, whole[rep], key[at[rep]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route.view(np.int64)), pa.array(many), pa.array(cnt, pa.int64())]
                    + [pa.array(np.ascontiguousarray(h[rep, d]).view(np.int64)) for d in range(WORDS)],
                    ["route", "hot", "cnt", *KEYS])

    keys = ", ".join(f"{k} bigint" for k in KEYS)
    dealt = texts.mapInArrow(suffixes, f"route bigint, hot boolean, cnt bigint, {keys}").repartition("route")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            h = np.stack([t.column(k).to_numpy().view(np.uint64) for k in KEYS], axis=1)
            weight, hot = t.column("cnt").to_numpy(), t.column("hot").to_numpy(zero_copy_only=False).astype(bool)
            # A hot pair's suffixes lie in many tasks: its counts are parts of a sum and none is abandoned.
            for rows, few in ((~hot, least), (hot, 1)):
                own, own_weight = h[rows], weight[rows]
                depth, at, count = sort_suffixes(own, own_weight, few)
                long = depth > 1
                depth, at, count = depth[long], at[long], count[long]
                out = np.where(np.arange(WORDS)[None, :] < depth[:, None], own[at], _U64(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(out[:, d]).view(np.int64)) for d in range(WORDS)]
                    + [pa.array(depth.astype(np.int32)), pa.array(count)], [*KEYS, "n_words", "a"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n + batch.num_rows > CHUNK and n:
                # The last route may go on in this batch; what lies before it is complete.
                t = pa.Table.from_batches([*held, batch])
                route = t.column("route").to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                if cut:
                    yield from phrases(t.slice(0, cut).to_batches())
                held, n = t.slice(cut).to_batches(), len(route) - cut
            else:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield from phrases(held)

    out = dealt.sortWithinPartitions("route").mapInArrow(sort, f"{keys}, n_words int, a bigint")
    out = staged(out.groupBy(*KEYS, "n_words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "phrases")
    for b in (frequent, leading, hot):
        b.destroy()
    return out


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, cnt) of all words, and the seed with which no two of them share a key."""
    for seed in range(8):
        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            source = Words(seed)
            for batch in batches:
                for w in source.of(batch):
                    yield w.counts()

        words = staged(texts.mapInArrow(count, "h bigint, lang string, word string, cnt bigint").groupBy(
            "h", "lang", "word").agg(F.sum("cnt").alias("cnt")), "phrase_words")
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("words share keys under every seed")


def _keys(cols: list[Column]) -> list[Column]:
    """Key columns of a phrase, 0 where it has no further word."""
    return [*cols, *[F.lit(0).cast("bigint")] * (WORDS - len(cols))]


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with l, r, score of their lowest-scoring cut."""
    counts = small_side(staged(
        words.select(*[c.alias(k) for k, c in zip(KEYS, _keys([F.col("h")]))], F.col("cnt").alias("f")).unionByName(
            phrases.filter(F.col("n_words") < WORDS).select(*KEYS, F.col("a").alias("f"))), "phrase_counts"), BROADCAST_ROWS)

    def part(first: int, last: int) -> Column:
        return F.struct(*[c.alias(k) for k, c in zip(KEYS, _keys([F.col(KEYS[i]) for i in range(first, last)]))])

    def cuts(n: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), part(0, k).alias("left"), part(k, n).alias("right")) for k in range(1, n)])

    which = F.when(F.col("n_words") == 2, cuts(2))
    for n in range(3, WORDS + 1):
        which = which.when(F.col("n_words") == n, cuts(n))
    cut = phrases.select(*KEYS, "a", F.explode(which).alias("cut"))
    for side, name in (("left", "l"), ("right", "r")):
        c = counts.select(*[F.col(k).alias(f"p{k}") for k in KEYS], F.col("f").alias(name))
        on = [F.col(f"cut.{side}.{k}") == F.col(f"p{k}") for k in KEYS]
        cut = cut.join(c, on, "inner").drop(*[f"p{k}" for k in KEYS])
    # Whole-number division of decimals: exact, also where the product passes 64 bits.
    score = F.expr(f"(cast({FACTOR} as decimal(8,0)) * cast(a as decimal(20,0))) "
                   "div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cut.withColumn("score", score).groupBy(*KEYS).agg(
        F.min(F.struct("score", F.col("cut.k").alias("k"), "l", "r")).alias("m"))
    return phrases.join(best, KEYS).select(*KEYS, "n_words", "a", "m.l", "m.r", "m.score")


def outer(phrases: DataFrame) -> DataFrame:
    """phrases that lie in no longer one at least INSIDE % as frequent."""
    def inner(n: int) -> Column:
        return F.array(*[F.struct(*[c.alias(k) for k, c in zip(KEYS, _keys([F.col(KEYS[i]) for i in range(first, first + size)]))])
                         for size in range(2, n) for first in range(n - size + 1)])

    which = F.when(F.col("n_words") == 3, inner(3))
    for n in range(4, WORDS + 1):
        which = which.when(F.col("n_words") == n, inner(n))
    held = phrases.filter("n_words > 2").select(F.explode(which).alias("p"), F.col("a").alias("longer")).groupBy(
        *[F.col(f"p.{k}").alias(k) for k in KEYS]).agg(F.max("longer").alias("longer"))
    held = small_side(staged(held, "phrases_held"), BROADCAST_ROWS)
    inside = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * INSIDE
    return phrases.join(held, KEYS, "left").filter(~F.coalesce(inside, F.lit(False))).drop("longer")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    texts = texts.filter("text is not null").select("lang", F.xxhash64("lang").alias("lang_key"), "text")
    words, seed = word_counts(texts)
    total = small_side(staged(words.groupBy("lang").agg(F.sum("cnt").alias("n")), "phrase_totals"))
    known = staged(words.filter(F.col("cnt") >= least), "phrase_frequent")
    phrases = frequent_phrases(texts, known, seed, least)
    left = staged(outer(scored(phrases, known)), "phrases_left")
    named = small_side(known.select("h", "lang", "word"), BROADCAST_ROWS)
    for i, k in enumerate(KEYS):
        word = named.select(F.col("h").alias(k), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 0 else []))
        left = left.join(word, k, "inner" if i < 2 else "left")
    phrase = F.concat_ws(" ", *[f"w{i}" for i in range(WORDS)])
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").withColumn(
        "rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


PHRASE_SQL = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, d, unnest(s) AS piece, generate_subscripts(s, 1) AS j
      FROM (SELECT lang, d, regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]') AS s FROM t)),
x AS (SELECT lang, d, j, unnest(w) AS w1, generate_subscripts(w, 1) AS i
      FROM (SELECT lang, d, j, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p)),
y AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
      FROM x WINDOW o AS (PARTITION BY lang, d, j ORDER BY i)),
g AS (
  SELECT lang, w1 AS p, 1 AS m FROM y UNION ALL
  SELECT lang, w1 || ' ' || w2, 2 FROM y WHERE w2 IS NOT NULL UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM y WHERE w3 IS NOT NULL UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM y WHERE w4 IS NOT NULL),
f AS (SELECT lang, p, m, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
c AS (SELECT lang, p, m, string_split(p, ' ') AS w, f AS a FROM f WHERE m > 1),
k AS (SELECT lang, p, m, w, a, unnest(range(1, m)) AS k FROM c),
j AS (SELECT *, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM k),
s AS (SELECT j.lang, j.p, j.a, j.k, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score
      FROM j JOIN f x ON x.lang = j.lang AND x.p = j.p1 JOIN f y ON y.lang = j.lang AND y.p = j.p2),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
u AS (SELECT lang, a AS longer, array_to_string(w[1:m - 1], ' ') AS part FROM c WHERE m > 2 UNION ALL
      SELECT lang, a, array_to_string(w[2:m], ' ') FROM c WHERE m > 2 UNION ALL
      SELECT lang, a, unnest([array_to_string(w[i:i + 1], ' ') for i in [1, 2, 3]]) FROM c WHERE m > 3),
h AS (SELECT lang, part, max(longer) AS longer FROM u GROUP BY ALL),
z AS (SELECT m.lang, m.p AS phrase, a, l, r, score FROM m LEFT JOIN h ON h.lang = m.lang AND h.part = m.p
      WHERE longer IS NULL OR 100 * longer < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM q JOIN n USING (lang) WHERE rank <= 2000
"""
