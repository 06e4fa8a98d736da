"""Small cases of the text operators: nulls, empty and long texts, ties, repeated rows, empty tables,
columns with clashing names."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from kestrel.llm import bpe, langid, minhash, mixing, quality, tokencount, toxicity
from kestrel.llm.queries import BPE_FILE, op1_toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def word_salad(seed, n, words=None):
    rnd = random.Random(seed)
    words = words or ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, letterless, very long, repeated and null-id rows."""
    long = word_salad(1, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "123 !!! 456", None, "b", 1),
            (5, long, "en", "a", 1), (6, long, "en", None, 1), (7, "one two", "en", "a", 1), (7, "one two", "en", "a", 1),
            (None, "one two", "en", "a", 1), (8, "One  TWO", "de", "c", 1), (9, "x" * 100_000, None, "b", None)]
    return docs(spark, rows)


# --- byte-pair encoding ---

def test_bpe_equals_library(spark, odd):
    lib = tokenizers.Tokenizer.from_file(BPE_FILE)
    lib.no_truncation(), lib.no_padding()
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_digests(odd, BPE_FILE).collect()}
    for r in odd.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        row = got[r.doc_id, sha]
        assert row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_texts():
    lib = tokenizers.Tokenizer.from_file(BPE_FILE)
    mine = bpe.Bpe(BPE_FILE, cache_bytes=20_000)
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'ll", "1", "２", "漢", "\xa0", "\x1c", "́", "😀", "!", "<|endoftext|>", "<|"]
    for _ in range(2000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30)))
        assert mine.encode(s) == lib.encode(s, add_special_tokens=False).ids, repr(s)
        assert mine.decode(mine.encode(s)) == s
    for s in ("ab" * 4000, " " * 999 + "a", "thethe" * 500):
        assert mine.encode(s) == lib.encode(s, add_special_tokens=False).ids


def test_bpe_data_round_trip(spark, odd):
    back = bpe.decode(bpe.encode(odd, BPE_FILE), BPE_FILE)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())


def test_bpe_empty_table(spark):
    assert bpe.encode_digests(docs(spark, []), BPE_FILE).collect() == []


# --- language ---

def test_langid_learns_and_holds_out(spark):
    rnd = random.Random(0)
    make = {"aa": ["ban", "ker", "lom"], "bb": ["xio", "yuz", "wux"]}
    rows = [(i, " ".join("".join(rnd.choice(make[la]) for _ in range(3)) for _ in range(rnd.randrange(1, 30))), la, "s", 1)
            for i in range(300) for la in [("aa", "bb")[i % 2]]]
    df = docs(spark, rows)
    out = langid.identify(df, langid.fit_documents(df), ["doc_id", "lang"]).withColumn("held", langid.held_out()).collect()
    import zlib
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_langid_odd_rows(spark, odd):
    out = {r.doc_id: r for r in langid.identify(odd, langid.fit_documents(odd), ["doc_id"]).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 4))
    assert out[7].lang_pred in ("en", "de")


def test_langid_without_labels_or_rows(spark):
    df = docs(spark, [(1, "abc", None, "s", 1)])
    assert [r.lang_pred for r in langid.identify(df, langid.fit_documents(df), ["doc_id"]).collect()] == ["und"]
    none = docs(spark, [])
    assert langid.identify(none, langid.fit_documents(none), ["doc_id"]).collect() == []


def test_langid_clashing_columns(spark):
    df = docs(spark, [(1, "abc", "en", "s", 1)]).selectExpr("*", "'mine' as lang_pred", "1.5 as score")
    out = langid.identify(df, langid.fit_documents(df), df.columns, pred_col="_l", score_col="_s").first()
    assert out.lang_pred == "mine" and out["_l"] in ("en", "und")


def test_langid_scores_equal_plain_bayes():
    rng = np.random.default_rng(0)
    logp = np.log(rng.random((3, 1 << langid.BUCKET_BITS)))
    texts = ["Abc dé", "", None, "a", "!!", "zzz " * 50]
    best, post, seen = langid.score_texts(texts, logp)
    for i, t in enumerate(texts):
        total = sum((logp[:, b].sum(axis=1) for b, _ in langid.grams([t])), np.zeros(3))
        assert seen[i] == any(c.isalpha() for c in t or "")
        if seen[i]:
            assert best[i] == total.argmax()
            assert post[i] == pytest.approx(1 / np.exp(total - total.max()).sum())


# --- quality ---

def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, odd):
    rnd = random.Random(2)
    texts = [None, "", " \n\n ", "a b c a b c a b c", "é é é é", "x\nx\nx \ny\r\ny\r\n", "# * $ 😀 | <", "\x1cz \x85 q"]
    texts += ["".join(rnd.choice(["a", "b", " ", "\n", "é", "|", " a b c "]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    for r in quality.judge(df).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(texts[r.doc_id])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    long = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert long[5].n_words == 60_000 and (long[5].n_repeat_words,) == brute_quality(odd.filter("doc_id = 5").first().text)[4:]


def test_quality_verdicts(spark):
    prose = ". ".join(word_salad(s, 12) for s in range(8)) + "."
    caps = " ".join(x.upper() + "!!" for x in word_salad(3, 60).split())
    nav = " | ".join(word_salad(4, 60).split())
    noise = " ".join(x + random.Random(x).choice(["###", "%%%"]) for x in word_salad(5, 60).split())
    notice = "All rights reserved.\n" + prose
    df = docs(spark, [(i, t, None, None, None) for i, t in enumerate([prose, caps, nav, noise, notice])])
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}
    cleaned = {r.doc_id: r.text for r in quality.clean_lines(df).collect()}
    assert cleaned[0] == cleaned[4] == prose and cleaned[1] == cleaned[2] == cleaned[3] == ""


def test_quality_empty_table_and_clash(spark):
    assert quality.judge(docs(spark, [])).collect() == []
    df = docs(spark, [(1, "a b", None, None, None)]).selectExpr("*", "1 as words", "2 as lines", "3 as n", "4 as packed")
    assert quality.judge(df).first().n_words == 2
    assert quality.clean_lines(docs(spark, [(1, None, None, None, None)])).first().text is None


# --- near duplicates ---

def brute_near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    s = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in s if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, x in s:
        for b, y in s:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, q = sorted((find(a), find(b)))
                up[q] = r
    return sorted((i if i is not None else -1, len(x), find(i) if i is not None else -1) for i, x in s)


def near_rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles,
                   r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(df).collect())


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for family in range(12):
        base = word_salad(family, rnd.choice([3, 6, 30, 120])).split()
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice("pqrs") * 3
            rows.append((n := n + 1, (" ".join(w)).upper() if n % 3 == 0 else "\n ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  B"), (905, "a b c"), (None, "a b"), (None, None)]
    df = docs(spark, [(i, t, None, None, None) for i, t in rows])
    assert near_rows(df) == brute_near(rows)


def test_near_duplicates_star_is_not_enough(spark):
    """A chain a-b-c whose ends are not linked, and a group whose smallest member links with nobody."""
    w = word_salad(7, 200).split()
    chain = [w[i * 25: i * 25 + 150] for i in range(3)]
    rows = [(i + 1, " ".join(c)) for i, c in enumerate(chain)]
    edge = [w[:100] + [f"q{k}{j}" for j in range(14)] for k in range(6)]
    rows += [(10 + k, " ".join(x)) for k, x in enumerate(edge)]
    df = docs(spark, [(i, t, None, None, None) for i, t in rows])
    assert near_rows(df) == brute_near(rows)


def test_near_duplicates_odd_rows(spark, odd):
    out = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(odd).collect()}
    assert out == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (None, None), (8, 7), (9, 9)}
    kept = sorted((r.doc_id or 0) for r in minhash.keep_one(odd).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 9]
    assert minhash.near_duplicates(docs(spark, [])).collect() == []
    assert minhash.keep_one(docs(spark, [])).collect() == []


def test_signature_is_circulant():
    """Coordinate k is the minimum of one permutation over the places shifted by k, and agreement
    of coordinates estimates the similarity."""
    rng = np.random.default_rng(0)
    s = minhash.Signer()
    x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    place = (minhash.mix64(x) >> np.uint64(32)).astype(np.uint32)
    sig = s.signature(x)
    for k in (0, 1, 77, 255):
        assert sig[k] == minhash.mix32(place + np.uint32(k)).min()
    y = np.concatenate([x[:350], rng.integers(0, 2**63, 50).astype(np.uint64)])
    true = 350 / (len(x) + 50)
    assert abs((s.signature(y, 1024) == s.signature(x, 1024)).mean() - true) < 0.06


# --- mixing ---

def brute_targets(size, weights, cap):
    total, free = sum(size.values()), dict(size)
    names = sorted((n for n in size if n is not None)) + ([None] if None in size else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target = {}
    while free:
        left = total - sum(target.values())
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] >= cap * size[n]]
        if not over:
            return target | share
        for n in over:
            target[n] = cap * size[n]
            del free[n]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets(spark, seed):
    rnd = random.Random(seed)
    names = [None, "a", "B", "é", "z1", "z10", "z2"][: rnd.randrange(2, 8)]
    rows = [(i, word_salad(i, rnd.choice([0, 1, 5, 40])) or None, "en", rnd.choice(names), 1) for i in range(300)]
    rows += [(1000 + i, word_salad(i, 30), "en", names[0], 1) for i in range(300)]
    df = docs(spark, rows)
    out = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    taken = {}
    by_id = {r[0]: r for r in rows}
    for r in out:
        s = by_id[r.doc_id][3]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)


def test_mixing_repeats_rows(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    wide = odd.selectExpr("*", "'s' as size", "'t' as target", "1 as u", "2 as times")
    rows = mixing.repeat(wide).collect()
    assert set(rows[0].asDict()) == set(wide.columns) and all(r.size == "s" for r in rows)
    words = sum(len((r.text or "").split(" ")) if (r.text or "").strip() else 0 for r in rows if r.doc_id in (5, 6))
    assert words == sum(r.taken for r in out if r.doc_id in (5, 6))
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.repeat(docs(spark, [])).collect() == []
    blank = mixing.mix(docs(spark, [(1, None, None, None, None)])).first()
    assert (blank.size, blank.target, blank.taken) == (0, 0.0, 0)


def test_mixing_many_equal_rows(spark):
    """One row repeated many times shares one hash: the border still falls inside the copies."""
    df = docs(spark, [(1, "a b c", "en", "s", 1)] * 300 + [(i, "x y", "en", "t", 1) for i in range(2, 400)])
    out = mixing.mix(df).collect()
    for doc, source in (((1,), "s"), (range(2, 400), "t")):
        mine = [r for r in out if r.doc_id in doc]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


# --- edit-aware counts ---

def test_token_tree_edits():
    lib = tokenizers.Tokenizer.from_file(BPE_FILE)
    counter = tokencount.Counter(bpe.Bpe(BPE_FILE), cache_bytes=20_000)
    rnd = random.Random(5)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "l", "re", "1", "漢", "\xa0", "!", "<|endoftext|>", "<|", "endof", "text", "|>"]
    for k in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(600 if k % 20 == 0 else 30)))
        tree = tokencount.TokenTree(counter, text)
        for _ in range(4):
            at, cut = rnd.randrange(len(text) + 3), rnd.randrange(6)
            new = "".join(rnd.choice(parts) for _ in range(rnd.randrange(5))) * rnd.choice([1, 1, 1, 120])
            tree.edit(at, cut, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + cut:]
            sizes, tokens = tree.leaves()
            assert tree.text == text and tree.sums[1, 0] == len(text) == sizes.sum()
            assert tree.n_tokens == tokens.sum() == len(lib.encode(text, add_special_tokens=False).ids)


def test_token_tree_touches_little():
    counter = tokencount.Counter(bpe.Bpe(BPE_FILE))
    tree = tokencount.TokenTree(counter, word_salad(3, 50_000))
    tree.edit(100_000, 3, "edit")
    assert tree.reencoded < 20


def test_count_edits_query_columns(spark, odd):
    lib = tokenizers.Tokenizer.from_file(BPE_FILE)
    df = odd.withColumn("edits", tokencount.derived_edits())
    want = []
    for r in df.collect():
        t = r.text or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        for e in r.edits:
            t = t[:e.place] + e.inserted + t[e.place + e.removed:]
        want.append((r.doc_id or 0, n, len(lib.encode(t, add_special_tokens=False).ids)))
    got = [(r.doc_id or 0, r.n_tokens, r.n_tokens_edited) for r in tokencount.count_edits(df, BPE_FILE).collect()]
    assert sorted(got) == sorted(want)
    stored = tokencount.trees(odd, BPE_FILE).join(df.select("doc_id", "edits").distinct(), "doc_id")
    edited = tokencount.edit_trees(stored, BPE_FILE).select("doc_id", "n_tokens").distinct().collect()
    assert {(r.doc_id, r.n_tokens) for r in edited} <= {(a, c) for a, _, c in want}
    assert tokencount.count_edits(docs(spark, []).withColumn("edits", tokencount.derived_edits()), BPE_FILE).collect() == []


# --- toxicity ---

def toxic_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = word_salad(i % 40 + 100, rnd.randrange(5, 60)).split()
        bad = i % 6 == 0
        for _ in range(2 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "stupid", "scum", "worthless"]))
        rows.append((seed * 100_000 + i, " ".join(w), "en", "s", 1, int(bad)))
    return rows


def test_toxicity_chain(spark):
    train, test = toxic_rows(1, 600), toxic_rows(2, 200)
    df = docs(spark, [r[:5] for r in train + test])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in train], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit_documents(df, labels, seeds=toxicity.SEEDS)
    assert chain.categories == ["insult", "contempt", "toxic"] and [len(x) for x in chain.links] == [0, 1, 2]
    out = {r.doc_id: r for r in toxicity.score(df, chain, ["doc_id"]).collect()}
    right = [(out[r[0]].p_toxic >= toxicity.THRESHOLD) == bool(r[5]) for r in test]
    assert sum(right) / len(right) > 0.97


def test_toxicity_links_are_given_labels(spark, tmp_path):
    """Both links come from labelled columns: the toxic words are in no list and not English."""
    rnd, rows = random.Random(3), []
    for i in range(900):
        w = word_salad(i % 40 + 100, rnd.randrange(5, 60)).split()
        bad, low = int(i % 6 == 0), int(i % 5 == 0)
        for many, words in ((2 * bad, ["schweinehund", "dreckskerl", "mistst\u00fcck"]), (2 * low, ["xqzzk", "vvbnw"])):
            for _ in range(many):
                w.insert(rnd.randrange(len(w)), rnd.choice(words))
        rows.append((i, " ".join(w), "de", "s", 1, bad, low))
    docs(spark, [r[:5] for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    # Of the labelled rows some have only one of the two labels.
    known = [(r[0], None if r[0] % 7 == 0 else 1 - r[6], None if r[0] % 7 == 1 else r[5]) for r in rows[:600]]
    spark.createDataFrame(known, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in op1_toxicity(spark, str(tmp_path)).collect()}
    held = rows[600:]
    assert sum((out[r[0]].p_low_quality >= 0.5) == bool(r[6]) for r in held) / len(held) > 0.97
    assert sum(out[r[0]].toxic == bool(r[5]) for r in held) / len(held) > 0.97


def test_toxicity_without_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit_documents(odd, none)
    out = toxicity.score(odd, chain, ["doc_id"]).collect()
    assert len(out) == odd.count() and all(r.p_toxic < 0.5 for r in out)
    nulls = spark.createDataFrame([(5, 1, None), (None, 1, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.p_toxic < 0.5 for r in toxicity.score(odd, toxicity.fit_documents(odd, nulls), ["doc_id"]).collect())
    empty = docs(spark, [])
    assert toxicity.score(empty, toxicity.fit_documents(empty, none), ["doc_id"]).collect() == []


def test_out_of_fold_predictions_feed_the_chain(monkeypatch):
    """The probabilities a link is fitted with come from models that have not seen the row."""
    rng = np.random.default_rng(0)
    n = 300
    y = rng.integers(0, 2, (n, 2))
    feat, row, fold = np.arange(n), np.arange(n), np.arange(n) % toxicity.FOLDS
    seen = []
    real = toxicity.fit_link

    def spy(f, r, earlier, target, k):
        seen.append(earlier.copy())
        return real(f, r, earlier, target, k)

    monkeypatch.setattr(toxicity, "fit_link", spy)
    # Every row has a feature of its own: in-sample predictions would give the label away.
    toxicity.fit_chain(["a", "b"], np.arange(n), feat, row, y.astype(float), fold)
    passed = seen[-1][:, 0]
    assert abs(np.corrcoef(passed, y[:, 0])[0, 1]) < 0.3


# --- pipeline ---

def brute_repeats(rows):
    """id -> times a document is taken, by a direct loop over each source in hash order."""
    words, by_source, times = {r[0]: len(r[1].split()) for r in rows}, {}, {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r[0])
    size = {s: sum(words[i] for i in ids) for s, ids in by_source.items()}
    target = brute_targets(size, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    for s, ids in by_source.items():
        whole = int(target[s] / size[s] + 1e-9)
        part, before = target[s] - whole * size[s], 0
        for i in sorted(ids, key=lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16), i)):
            times[i] = whole + (2 * before + words[i] <= 2 * part + 1e-6)
            before += words[i]
    return times, words, target


def test_pipeline_equals_plain_python(spark, tmp_path):
    """run()'s rows are those of a plain loop; only the two fitted models' verdicts are taken as given."""
    rnd, rows = random.Random(11), []
    vocab = {x: word_salad(k, 1).split() + ["".join(rnd.choice(a) for _ in range(rnd.randrange(3, 8))) for _ in range(150)]
             for k, (x, a) in enumerate({"en": "abcdefgh", "de": "klmnopäü"}.items())}
    for i in range(150):
        lang = "en" if i % 3 else "de"
        w = word_salad(i, rnd.randrange(8, 70), vocab[lang]).split()
        if i % 6 == 0 and rows:  # a near copy of an earlier document of any source
            _, text, lang, *_ = rnd.choice(rows)
            w = text.split()
            w[rnd.randrange(len(w))] = "qqq"
        if i % 10 == 1:
            w = w[:4] + ["idiot", "scum"] + w[4:]
        rows.append((i, " ".join(w) if i % 25 != 2 else "12 34 !", lang, rnd.choice("aab" "c"), 1))
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int("idiot" in r[1])) for i, r in enumerate(rows)],
                                   "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit_documents(df), ["doc_id"]).collect()}
    one = [r for r in rows if said[r[0]][0] != "und" and said[r[0]][1] >= 0.5]
    known = docs(spark, one)
    chain = toxicity.fit_documents(known, labels, seeds=None)
    toxic = {r.doc_id for r in toxicity.score(known, chain, ["doc_id"]).collect() if r.p_toxic >= 0.5}
    two = [r for r in one if r[0] not in toxic]
    first = {i for i, _, group in brute_near([r[:2] for r in two]) if i == group}
    three = [r for r in two if r[0] in first]
    assert len(rows) > len(one) > len(two) > len(three) > 0
    times, words, target = brute_repeats(three)
    lib = tokenizers.Tokenizer.from_file(BPE_FILE)
    want = Counter()
    for i, text, *_ in three:
        ids = lib.encode(text, add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        want[row] += times[i]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == +want
    source, taken = {r[0]: r[3] for r in three}, Counter()
    for r in out:
        taken[source[r.doc_id]] += words[r.doc_id]
    assert all(abs(taken[s] - target[s]) <= max(words.values()) / 2 for s in target)
