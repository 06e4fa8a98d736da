"""Small cases of vectors, archives, URLs, components and the pipeline."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import ann, urls, warc
from kestrel.llm.components import components

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- components ---

@pytest.mark.parametrize("seed", range(3))
def test_components_brute_force(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        r, q = sorted((find(a), find(b)))
        up[q] = r
    want = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- nearest neighbours ---

VEC = "vec_id bigint, embedding array<float>, label int"


def brute_neighbours(ids, x, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [int(i) for i in ids[order] if s[list(ids).index(i)] > -np.inf]


def test_ann_small_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:90] = x[50]  # one very common vector: ties to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] + [1.0] * 7, 0), (1060, [None] + [1.0] * 7, 0),
           (1080, [float("inf")] + [1.0] * 7, 0), (1100, [1.0] * 5, 0), (None, [1.0] * 8, 0)]
    out = ann.search(spark.createDataFrame(rows + odd, VEC), F.col("id") % 20 == 0).collect()
    ids = np.arange(300)
    for q in range(0, 300, 20):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [r.vec_id for r in mine] == brute_neighbours(ids, x.astype(float), q, 20)
        for r in mine:
            assert r.score == pytest.approx(float(x[q].astype(float) @ x[r.vec_id].astype(float)), abs=1e-12)
    assert {r.query_id for r in out} == set(range(0, 300, 20))


def test_ann_recall_with_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[:250] = x[0] + rng.standard_normal((250, 16)).astype(np.float32) * 1e-3
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    out = ann.search(df, F.col("id") % 20 == 0).collect()
    ids, hit = np.arange(1500), 0
    for q in range(0, 1500, 20):
        mine = {r.vec_id for r in out if r.query_id == q}
        assert len(mine) == 20 and q not in mine
        hit += len(mine & set(brute_neighbours(ids, x.astype(float), q, 20)))
    assert hit / (75 * 20) >= 0.9


def test_ann_few_rows(spark):
    assert ann.search(spark.createDataFrame([], VEC), F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], VEC)
    assert ann.search(one, F.col("id") % 20 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 1.0], 0), (1, [3.0, 1.0], 0)], VEC)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(two, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 5.0)]


def test_shared_queue_order():
    """Leaves are popped by the sum of squared margins of the planes crossed the wrong way."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 6))
    f = ann.fit_forest(x, 8 * ann.LEAF_ROWS)
    m = f.margins(x[:1])[0]
    popped = list(f.walk(m))
    assert sorted(popped) == [(t, leaf) for t in range(ann.TREES) for leaf in range(2 ** f.depth)]

    def cost(t, leaf):
        node, c = leaf + 2 ** f.depth - 1, 0.0
        while node:
            up = (node - 1) // 2
            right = node == 2 * up + 2
            c += m[t, up] ** 2 if (m[t, up] > 0) != right else 0.0
            node = up
        return c
    costs = [cost(t, leaf) for t, leaf in popped]
    assert costs == pytest.approx(sorted(costs))
    assert {(t, int(leaf)) for t, leaf in enumerate(f.leaves(x[:1])[0])} == set(popped[: ann.TREES])


# --- archives ---

PAGES = "page_id bigint, url string, html string"


def round_trip(spark, tmp_path, rows, schema=PAGES):
    folder = str(tmp_path / "warc")
    warc.write_archive(warc.plan_records(spark.createDataFrame(rows, schema)), folder)
    return folder


def test_warc_round_trip(spark, tmp_path):
    import hashlib
    big = "é<p>" * 60
    tricky = "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 400_000 + "\r\n\r\n"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "short"),
            (6, "u", "short"), (7, "u", tricky), (8, "u", tricky), (None, "u", big), (3, "again", big)]
    folder = round_trip(spark, tmp_path, rows)
    read = warc.read_archive(spark, folder)
    out = sorted(warc.digest_records(read).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    kinds = {1: None, 2: None, 3: None, 4: None, 5: 3, 6: None, 7: None, 8: 7, 9: 3, None: 3}
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, _, t in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == hashlib.sha256(text.encode()).hexdigest()
        assert r.refers_to == kinds[r.page_id] and r.record_type == ("revisit" if r.refers_to else "response")
    assert {r.payload.decode() for r in read.filter("record_type = 'response'").collect()} == {t or "" for _, _, t in rows}
    assert "http://b/%0D%0AX: y" in {r.target_uri for r in read.collect()}


def test_warc_filters_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"{i:04d}" * 100) for i in range(50)] + [(100 + i, "v", "0001" * 100) for i in range(5)]
    folder = round_trip(spark, tmp_path, rows)
    read = warc.read_archive(spark, folder)
    one = read.filter((F.col("record_type") == "response") & (F.col("target_uri") == "http://h/7"))
    assert [bytes(r.payload) for r in one.collect()] == [b"0007" * 100]
    reader = warc.WarcReader({"files": "\n".join(f"{n}\t{p}" for p, n in warc.archive_files(spark, folder))})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan] and reader.equal == {"record_type": "revisit"}
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 5 and all(r["payload"] is None and r["refers_to"] == "urn:page:1" for r in got)
    assert warc.read_archive(spark, folder, payload=False).filter("payload is not null").count() == 0


def test_warc_reads_only_the_headers_of_unwanted_records(tmp_path):
    import pyarrow.fs as pafs
    path = tmp_path / "x.warc"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 3_000_000
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    path.write_bytes((head + block + b"\r\n\r\n") * 3)
    read = 0

    class Counting:
        def __init__(self, f):
            self.f = f

        def size(self):
            return self.f.size()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            nonlocal read
            read += n
            return self.f.read(n)

    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        assert list(warc.records(Counting(f), lambda h: False, True)) == []
    assert read < 1_500_000


def test_warc_empty_table_and_clash(spark, tmp_path):
    folder = round_trip(spark, tmp_path, [])
    assert warc.read_archive(spark, folder).collect() == []
    df = spark.createDataFrame([(1, "u", "h", "x", 5)], PAGES + ", payload string, first int")
    assert warc.plan_records(df).first().payload == "h"


# --- URLs ---

def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if c in urls._UPPER else c for c in host), tail[:stop]


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_url_rules(spark):
    cases = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Org/es/1", "http://a.example.org/en/12?x=://y", "http://org",
             "http://org/", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/1#a/b", "http://com/de/",
             "http://x.net/de/", "http://É.ORG/a?b/c", "a://b://c/d", "http://x.com?/fr/", "http://x.com#/de/", "http://h/\nline"]
    rows = [(i, u, "") for i, u in enumerate(cases)] + [(0, None, ""), (None, "http://org/", "")]
    none = spark.createDataFrame([], "page_id bigint, url string, bad double")
    out = urls.judge(spark.createDataFrame(rows, PAGES), none).collect()
    assert len(out) == len(rows)
    for r in out:
        url = cases[r.page_id] if r.page_id is not None else "http://org/"
        host, path = parts(url)
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), url


def test_url_trees_learn(spark):
    rnd = random.Random(0)

    def url(bad, i):
        host = f"{'cheap-pills-' if bad else 'news'}{rnd.randrange(9)}.net"
        return f"http://{host}/en/{i}" + ("?a=1&b=2&c=" + "9" * rnd.randrange(10, 30) if bad else "")
    rows = [(i, url(i % 3 == 0, i), "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame(rows, PAGES)
    out = urls.judge(pages, urls.labelled_urls(pages, labels)).collect()
    right = [(r.verdict == "block") == (r.page_id % 3 == 0) for r in out if r.page_id % 2]
    assert sum(right) / len(right) > 0.95
    again = urls.judge(pages.repartition(5), urls.labelled_urls(pages, labels)).collect()
    assert sorted((r.page_id, r.verdict) for r in again) == sorted((r.page_id, r.verdict) for r in out)


def test_url_suffixes_count_all_labelled(spark, monkeypatch):
    """Suffix statistics are of all labelled URLs, however few the trees are fitted on."""
    monkeypatch.setattr(urls, "TRAIN_URLS", 60)
    end = [f"r{i // 4}" if i % 3 else "com" for i in range(900)]
    bad = [float(i % 5 == 0) for i in range(900)]
    labelled = spark.createDataFrame([(i, f"http://h.{end[i]}/en/{i}", bad[i]) for i in range(900)], "page_id bigint, url string, bad double")
    _, suffixes, share = urls.train(labelled)
    assert share == pytest.approx(sum(bad) / 900)
    want = {}
    for e, b in zip(end, bad):
        n, s = want.get(e, (0, 0))
        want[e] = n + 1, s + b
    got = {r.suffix: (r.suffix_urls, r.suffix_bad) for r in suffixes.collect()}
    assert got == {e: (n, pytest.approx((s + urls.PRIOR_ROWS * share) / (n + urls.PRIOR_ROWS))) for e, (n, s) in want.items()}
    pages = labelled.selectExpr("page_id", "url")
    out = {(r.page_id, r.verdict) for r in urls.judge(pages, labelled).collect()}
    monkeypatch.setattr("kestrel.llm.common.BROADCAST_ROWS", 0)
    assert {(r.page_id, r.verdict) for r in urls.judge(pages, labelled).collect()} == out and len(out) == 900


def test_url_single_class_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.net/en/1", "")], PAGES)
    bad = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert urls.judge(pages, urls.labelled_urls(pages, bad)).first().verdict == "block"
    none = spark.createDataFrame([], PAGES)
    assert urls.judge(none, urls.labelled_urls(none, bad)).collect() == []


def test_entropy(spark):
    import math
    for s in ("", "aaaa", "ab", "http://a.b/c?d"):
        got = spark.createDataFrame([(s,)], "s string").select(urls.entropy(F.col("s")).alias("e")).first().e
        want = -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
        assert got == pytest.approx(want)


# --- pipeline ---

def labels_dir(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_odd_rows(spark, tmp_path):
    d = labels_dir(spark, tmp_path, [(1, 1, 0)])
    rows = [(1, "some plain words here", "en", "a", 1), (2, "some plain words here", "en", "a", 1), (3, None, "en", "a", 0),
            (4, "12 34", None, None, 1), (5, "other words " * 2000, "en", None, 1), (5, "other words " * 2000, "en", None, 1),
            (None, "words without a number", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as score", "1 as size", "0.5 as _x")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "tokens":
            assert docs.columns == df.columns
        if name == "language":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 5, 5]
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 5]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 5}


def test_pipeline_empty_table(spark, tmp_path):
    d = labels_dir(spark, tmp_path, [])
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_pipeline_decisions_take_effect(spark):
    """On the smallest tables: stages reject and keep what their operators say."""
    from kestrel.llm import langid, minhash, toxicity
    from kestrel.llm.common import table
    sf = "/root/testdata/sf0.001"
    raw = table(spark, sf, "documents")
    one = corpus_pipeline.language(spark, raw, sf)
    pred = langid.identify(raw, langid.fit_documents(raw), ["doc_id"]).filter("lang_pred <> 'und' and score >= 0.5")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in pred.collect()}
    two = corpus_pipeline.toxic(spark, one, sf)
    chain = toxicity.fit_documents(one, table(spark, sf, "labels"))
    clean = toxicity.score(one, chain, ["doc_id"]).filter(F.col("p_toxic") < toxicity.THRESHOLD)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in clean.collect()} != {r.doc_id for r in one.collect()}
    three = corpus_pipeline.near_duplicates(spark, two, sf)
    near = minhash.near_duplicates(two).filter("kept")
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in near.collect()}
    assert corpus_pipeline.tokens(spark, corpus_pipeline.mix(spark, three, sf), sf).count() > 0
