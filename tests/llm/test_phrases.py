"""Phrase collocations against plain counting."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import phrases

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i:i + size])
                if 100 * a >= 80 * cand[part]:
                    gone.add(part)
    out = []
    for lang in n:
        mine = []
        for (at, w), a in cand.items():
            if at == lang and (at, w) not in gone:
                cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, r + 1, p.decode(), -a, lf, rf, n[lang], -s) for r, (s, a, p, lf, rf) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def texts_of(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "The", "über", "zeta", "a-b", "x", "42", "é", "long" * 9] + [f"w{i}" for i in range(15)]
    out = []
    for i in range(n):
        w = rnd.choices(words, weights=[9, 8, 3] + [1] * 22, k=rnd.randrange(120))
        if i % 3 == 0:
            w[2:2] = ["one", "common", "passage", "here", "again"]
        text = "".join(x + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", " ; ", "\x0b"]) for x in w)
        out.append((i, text, rnd.choice(["en", "en", "de", None, "und"]), "s", 0))
    return out + [(90, None, "en", "s", 0), (91, "", "xx", "s", 0), (92, " \t\n..", "xx", "s", 0), (92, "of the x", "en", "s", 0)] * 2


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("h", "h1", "word", "cnt", "rank", "lang_key", "a", "phrase"):
        df = df.withColumn(c, F.lit("clash"))
    return sorted(map(tuple, phrases.mine(df, **kw).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = texts_of(seed)
    want = brute([(r[1], r[2]) for r in rows], 4)
    assert len(want) > 30 and got(spark, rows, least=4) == want


def test_hot_pairs_small_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 12)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "SLICE", 300)
    rows = texts_of(7)
    rnd = random.Random(3)
    # Texts far beyond a slice: with breaks, without any, and with a word longer than a slice.
    rows.append((200, " ".join(rnd.choices(["of", "the", "x", "one"], k=900)), "en", "s", 0))
    rows.append((201, "of the " * 300 + "z" * 2000 + " of the x, " + "one. common passage " * 90, "en", "s", 0))
    rows.append((202, "q" * 1500, "en", "s", 0))
    assert got(spark, rows, least=5) == brute([(r[1], r[2]) for r in rows], 5)
    assert got(spark, rows, least=5, top=3) == brute([(r[1], r[2]) for r in rows], 5, 3)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None, None), (2, "a b c", None, None, None)]) == []


def test_seed_moves_on_when_keys_meet(spark, monkeypatch):
    rows = texts_of(1, 20)
    words, seed = phrases.word_counts(spark.createDataFrame(rows, DOCS).selectExpr(
        "coalesce(lang, 'und') as lang", "xxhash64(coalesce(lang, 'und')) as lang_key", "text"))
    assert seed == 0 and words.count() == words.select("lang", "word").distinct().count()


@pytest.mark.parametrize("seed", range(4))
def test_sorting_counts_every_prefix(seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(1, 4 + seed, (3000, 4)).astype(np.uint64)
    h[rng.random(3000) < 0.3, 2:] = 0
    h[rng.random(3000) < 0.2, 3:] = 0
    weight = rng.integers(1, 5, 3000)
    want = Counter()
    for row, w in zip(h.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    depth, at, count = phrases.sort_suffixes(h, weight, 25)
    found = {tuple(h[i, :d].tolist()): c for d, i, c in zip(depth.tolist(), at.tolist(), count.tolist())}
    assert len(found) == len(depth) and found == {k: c for k, c in want.items() if c >= 25}


def test_filter_is_a_superset(spark):
    keys = np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 5000)
    bits = phrases.bitmap(spark.createDataFrame([(int(k),) for k in keys], "k bigint"), "k")
    assert phrases.member(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 50000).view(np.uint64)
    assert phrases.member(bits, others).mean() < 0.02


def test_runs_cover_a_text():
    rnd = random.Random(0)
    for _ in range(30):
        text = "".join(rnd.choices(["ab", "c" * 40, "d"], k=1)[0] + rnd.choice([" ", "  ", "," if rnd.random() < 0.2 else " "])
                       for _ in range(rnd.randrange(1, 200)))
        data = np.frombuffer(text.encode(), np.uint8)
        out = list(phrases.runs(data, 64))
        assert out[0][0] == 0 and out[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(out, out[1:]))
        for start, stop, end in out:
            # A run ends behind a gap; when that is no break, whole words for three suffixes follow.
            assert stop == len(data) or chr(data[stop - 1]) in " ,"
            assert end >= stop and (end == len(data) or end == stop or not chr(data[end]).isalpha())
            if stop < len(data) and "," not in text[start:stop]:
                assert len(text[stop:end].replace(",", " ").split()) == min(3, len(text[stop:].replace(",", " ").split()))
