"""Rows that share an id, names that clash, and very long texts."""
import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import ann, bpe, langid, minhash, tokencount, toxicity
from kestrel.llm.common import WordHashes, free_name, text_bytes
from kestrel.llm.queries import BPE_FILE

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside; every one of them may be a column of the input.
CLASH = ["_language", "_sure", "_p_toxic", "_p_low_quality", "_row", "row", "rep", "id", "node", "component", "component_id", "k1",
         "kept", "n_shingles", "bands", "lang_pred", "score", "p_toxic", "fold", "feats", "label", "query_id", "rank", "v", "ids",
         "n_tokens", "size", "weight", "target", "path", "value"]


def salad(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en" if n % 2 else "de", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)], DOCS)
    return df.select("*", *[F.lit(7 if n % 2 else "x").alias(c) for n, c in enumerate(CLASH)]) if clash else df


def brute_rows(rows):
    """Component of every row, each row a node of its own: (id, smallest id of its component)."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i) if i is not None else None
    return sorted((i is None, i or 0, len(x), least[find(a)] or 0) for a, ((i, _), x) in enumerate(zip(rows, s)))


def near(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.near_duplicates(df).collect())


# --- rows that share an id ---

def test_a_link_of_a_repeated_id_is_kept(spark):
    t = salad(1, 120)
    rows = [(1, t), (2, t + " more words"), (2, "zz " + salad(2, 80)), (3, salad(2, 80) + " end")]
    assert near(frame(spark, rows)) == brute_rows(rows)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2)}
    kept = minhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in kept) == [(1, t[:2]), (2, "zz")]


@pytest.mark.parametrize("seed", range(1))
def test_repeated_ids_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for family in range(10):
        base = salad((seed, family).__hash__(), rnd.choice([4, 30, 90])).split()
        for _ in range(rnd.randrange(1, 7)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                w[rnd.randrange(len(w))] = rnd.choice("pqrs") * 3
            rows.append((rnd.randrange(1, 9), " ".join(w)))
    rows += [(4, None), (4, ""), (None, rows[0][1]), (None, None)]
    assert near(frame(spark, rows)) == brute_rows(rows)
    # One row of each component stays, and every row without an id.
    parts = len({x for x in brute_components(rows)})
    assert minhash.keep_one(frame(spark, rows)).count() == parts


def brute_components(rows):
    """A name for the component of each row."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    s, name = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if rows[a][0] is not None and rows[b][0] is not None and s[a] and s[b] \
                        and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    name[a] = name[b] = min(name[a], name[b])
    return name


def test_large_sets_split_a_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_BYTES", 2000)
    base = salad(5, 150).split()
    rows = [(i, " ".join(base[: 140] + [f"q{i}"])) for i in range(30)]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {0}


# --- names that clash ---

def test_operators_with_clashing_names(spark):
    rows = [(i, salad(i % 5, 60)) for i in range(20)] + [(None, None), (3, "")]
    df, plain = frame(spark, rows, clash=True), frame(spark, rows)
    assert near(df) == near(plain)
    assert minhash.keep_one(df).columns == df.columns and minhash.keep_one(df).count() == minhash.keep_one(plain).count()
    said = langid.identify(df, langid.fit_documents(df), df.columns)
    assert sorted(said.columns) == sorted(df.columns) and {r.lang_pred for r in said.collect()} <= {"en", "de", "und"}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int").withColumn(
        "_row", F.lit(1)).withColumn("text", F.lit("t"))
    chain = toxicity.fit_documents(df, labels)
    scored = toxicity.score(df, chain, df.columns)
    assert scored.count() == len(rows) and all(0 <= r.p_toxic <= 1 for r in scored.select("p_toxic").collect())
    assert bpe.encode_digests(df, BPE_FILE).count() == len(rows)
    assert tokencount.count_edits(df.withColumn("edits", tokencount.derived_edits()), BPE_FILE).count() == len(rows)
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    for c in ("id", "v", "rank", "score", "query_id", "tree", "leaf", "block", "kind"):
        vec = vec.withColumn(c, F.lit("x"))
    assert ann.search(vec, F.col("id") % 20 == 0).count() == 40


def test_pipeline_stages_with_clashing_names(spark, tmp_path):
    rows = [(i, salad(i % 7, 80)) for i in range(40)]
    df = frame(spark, rows, clash=True)
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.collect()
    assert free_name(df, "_Language") == "_Language_"


# --- very long texts ---

def test_word_hashes_in_pieces_equal_a_plain_sum():
    in_word = minhash.IN_WORD
    rnd = random.Random(0)
    texts = ["", None, salad(1, 300).upper(), "x" * 2_500_000 + " tail " + "y" * 1_200_000, "é ü " * 50]
    col, h = pa.array(texts), WordHashes(in_word)
    s, e, off = h.load(col)
    data, _ = text_bytes(pa.array([(t or "").lower() for t in texts]))
    got = h.hashes(s, e)
    again = WordHashes(in_word)
    for i in rnd.sample(range(len(s)), 40) + [len(s) - 101, len(s) - 103]:
        word = bytes(data[s[i]: e[i]]).decode()
        a, b, _ = again.load(pa.array(["q " + word]))
        assert again.hashes(a, b)[1] == got[i]
    assert (np.diff(off) == [len((t or "").split()) for t in texts]).all()


def test_memory_of_a_very_long_text():
    """A 50 MB text raises the process by less than 12 bytes for each of its bytes."""
    text = pa.array([(salad(3, 2000) + "\n") * 4000])
    n = len(text_bytes(text)[0])
    assert n > 40_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    h = WordHashes(minhash.IN_WORD)
    s, e, _ = h.load(text)
    assert len(h.hashes(s, e)) == len(s) > 8_000_000 * 0.9
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 12 * n


def test_worker_tables_are_bounded_by_bytes():
    b = bpe.Bpe(BPE_FILE, cache_bytes=50_000)
    for i in range(3000):
        b.encode_bytes(f"word{i} " + "z" * (i % 50))
    size = sum(bpe.ENTRY_BYTES + len(k) + len(v) for t in (b.cache, b.older) for k, v in t.items())
    assert size <= 2 * 50_000
    assert b.encode_bytes("q" * 200_000) == bpe.Bpe(BPE_FILE).encode_bytes("q" * 200_000)
