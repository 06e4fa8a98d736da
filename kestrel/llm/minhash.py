"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's shingles are hashed onto a ring of 2^32 places by a first
permutation. Signature coordinate k is the least value, over the set, of a
second permutation applied to the place shifted by k: two permutations give
all coordinates, of which one byte each is kept as a sketch. Each band hashes
a fixed choice of coordinates; documents
that agree in a band are candidates, and candidates are confirmed on their
full shingle sets.

No group is ever expanded into all pairs. Documents with equal sets become
one class first. Within a band's group everything is compared with the
smallest member only, starting with the member met in most bands. Groups that
the confirmed links have not joined into one component are then compared
across their components: block by block on one-byte sketches of the
signatures, of which only likely links come out, and these are confirmed. So
every candidate pair is inside one component or has been looked at itself. A
hot representative is split over many comparison groups of bounded size.

Words are runs of characters other than ASCII blanks, A-Z lower-cased; a
shingle is five words, or the whole sequence of a shorter text. Links have
100 * intersection >= 75 * union.

Cases: a null text, or one without words, has an empty set, no links and is
its own component; a null id cannot be linked to: its component is null and
it is kept; every row is a node of its own, also where rows share an id;
repeated rows give repeated results; equal sets are linked whatever their
texts; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WordHashes, free_name, mix32, mix64, powers, slices, small_side, staged
from kestrel.llm.components import components

SHINGLE_WORDS = 5
MIN_PERCENT = 75
# 72 bands of 6 coordinates out of 256: at similarity 0.75 about 1 in 10^5 pairs shares no band.
COORDINATES = 256
BANDS = 72
BAND_COORDINATES = 6
# Documents compared with one representative in one task, and bytes of their sets.
GROUP = 64
GROUP_BYTES = 32 << 20
# Members of a band's group whose sketches are compared at once. A pair is checked if the similarities
# told by its sketch and by a wider one (two bits of more coordinates) are less than 4.5 standard
# deviations below that of a link.
BLOCK = 1024
LIKELY = 0.63
WIDE = 1024
LIKELY_WIDE = 0.677
SLICE = 1 << 20

_U64 = np.uint64
_BYTE_BASE, _WORD_BASE = _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F)
# Every byte but the ASCII blanks belongs to a word.
IN_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Shingler:
    """Shingle sets of the texts of an Arrow column, as sorted 64-bit hashes per text."""

    def __init__(self) -> None:
        self.hasher = WordHashes(IN_WORD)

    def sets(self, col: pa.Array) -> Iterator[np.ndarray]:
        start, end, off = self.hasher.load(col)
        w = self.hasher.hashes(start, end)
        k = SHINGLE_WORDS
        base = powers(_WORD_BASE, k)
        win = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for i in range(k):
            win += w[i: i + len(win)] * base[i]
        win = mix64(win)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            if b - a >= k:
                yield np.unique(win[a: b - k + 1])
            elif b > a:
                short = (w[a:b] * base[: b - a]).sum(dtype=np.uint64)
                yield mix64(np.array([short + _U64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)


def band_choice() -> np.ndarray:
    """The coordinates of each band, fixed by seeds."""
    return np.stack([np.random.default_rng([8, j]).choice(COORDINATES, BAND_COORDINATES, replace=False)
                     for j in range(BANDS)])


class Signer:
    """Signatures and band keys of shingle sets."""

    def __init__(self) -> None:
        self.shift = np.arange(WIDE, dtype=np.uint32)[:, None]
        self.choice = band_choice()
        self.weight = powers(_BYTE_BASE, BAND_COORDINATES + 1)[1:]
        self.tag = powers(_WORD_BASE, BANDS + 1)[1:]

    def signature(self, shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
        place = (mix64(shingles) >> _U64(32)).astype(np.uint32)
        out = np.full(n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(place), 512):
            np.minimum(out, mix32(place[None, i: i + 512] + self.shift[:n]).min(axis=1), out=out)
        return out

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One byte of each coordinate."""
        return self.signature(shingles).astype(np.uint8)

    def wide(self, shingles: np.ndarray) -> bytes:
        """Two bits of each of the WIDE coordinates, four to a byte."""
        two = (self.signature(shingles, WIDE) & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
        return (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()

    def bands(self, sketch: np.ndarray) -> np.ndarray:
        """Band keys [..., BANDS] of sketches [..., COORDINATES]."""
        chosen = sketch[..., self.choice].astype(np.uint64)
        return mix64((chosen * self.weight).sum(axis=-1, dtype=np.uint64) + self.tag).view(np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that stand for a whole set (128 bits)."""
    m = mix64(shingles)
    a = np.array([m.sum(dtype=np.uint64), mix64(m ^ _BYTE_BASE).sum(dtype=np.uint64)]).view(np.int64)
    return int(a[0]), int(a[1])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1, k2 (key of the set), bands array<long> (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n, k1, k2, bands = [], [], [], []
                for x in shingler.sets(part.column(1)):
                    n.append(len(x))
                    a, b = set_key(x)
                    k1.append(a)
                    k2.append(b)
                    bands.append(signer.bands(signer.sketch(x)) if len(x) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                     pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, size, sketch, wide, shingles): the full sets as little-endian 64-bit integers, sorted, and
    their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets = list(shingler.sets(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([signer.sketch(x).tobytes() for x in sets], pa.binary()),
                     pa.array([signer.wide(x) for x in sets], pa.binary()),
                     pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "size", "sketch", "wide", "shingles"])

    return docs.mapInArrow(run, "id bigint, size bigint, sketch binary, wide binary, shingles binary")


def likely_pairs(seated: DataFrame) -> DataFrame:
    """(a, b, size of a) of rows (key, id, c, size, sketch, wide) that share a key, are in different components and
    whose sketches agree enough.

    A group is cut into blocks of about BLOCK rows and the blocks are paired, so a task holds two
    blocks at a time; only the pairs that pass are emitted, each in the first band it shares.
    """
    blocks = seated.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = seated.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       "block", "id", "c", "size", "sketch", "wide")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(t: pa.Table, signer: Signer) -> pa.RecordBatch:
        ids, c, size, block = (t.column(x).to_numpy() for x in ("id", "c", "size", "block"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(len(ids), WIDE // 4)
        wide = (wide[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & np.uint8(3)).reshape(len(ids), WIDE)
        crossing = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        key = t.column("key")[0].as_py()
        a, b, of = [], [], []
        for i in range(len(ids) - 1):
            rest = slice(i + 1, None)
            ok = ((c[rest] != c[i]) & (ids[rest] != ids[i])
                  & (100 * np.minimum(size[rest], size[i]) >= MIN_PERCENT * np.maximum(size[rest], size[i])))
            if crossing:
                ok &= block[rest] != block[i]
            j = np.nonzero(ok)[0] + i + 1
            if len(j):
                same = sketch[j] == sketch[i]
                likely = same.mean(axis=1) >= LIKELY
                # Two bits agree by chance in a quarter of the differing coordinates.
                likely[likely] = (wide[j[likely]] == wide[i]).mean(axis=1) >= LIKELY_WIDE + (1 - LIKELY_WIDE) / 4
                j, same = j[likely], same[likely]
            if len(j):
                first = same[:, signer.choice].all(axis=2).argmax(axis=1)
                j = j[signer.bands(sketch[i])[first] == key]
                a.append(np.maximum(ids[j], ids[i]))
                b.append(np.minimum(ids[j], ids[i]))
                of.append(np.where(ids[j] > ids[i], size[j], size[i]))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (a, b, of)], ["a", "b", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        signer = Signer()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not held.num_rows:
                continue
            k = np.stack([held.column(x).to_numpy() for x in ("key", "lo", "hi")])
            cut = [0, *(np.nonzero((k[:, 1:] != k[:, :-1]).any(axis=0))[0] + 1).tolist()]
            for i, j in zip(cut, cut[1:]):
                found = compare(held.slice(i, j - i), signer)
                if found.num_rows:
                    yield found
            held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield compare(held, signer)

    return rows.mapInArrow(run, "a bigint, b bigint, size bigint")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (a, b, size of a's set) whose full sets are similar enough.

    A representative b with many partners is dealt over groups of about GROUP partners, or fewer if
    their sets are large, so each group holds one set and a bounded number of bytes of others.
    """
    many = pairs.groupBy("b").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("size") * 8 / GROUP_BYTES)).cast("int").alias("parts"))
    dealt = staged(pairs.join(many, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), "minhash_dealt")
    left = dealt.join(sets.select(F.col("id").alias("a"), "shingles"), "a")
    right = dealt.select(F.col("b").alias("rep"), F.col("part").alias("rep_part")).distinct().join(
        sets.select(F.col("id").alias("rep"), F.col("shingles").alias("rep_shingles")), "rep")

    def check(one: pa.Table, many: pa.Table) -> pa.Table:
        a, b = [], []
        if one.num_rows and many.num_rows:
            rep = np.frombuffer(one.column("rep_shingles")[0].as_py(), np.uint64)
            for i, raw in zip(many.column("a").to_pylist(), many.column("shingles")):
                x = np.frombuffer(raw.as_py(), np.uint64)
                at = np.searchsorted(rep, x)
                at[at == len(rep)] = 0
                both = int((rep[at] == x).sum())
                if 100 * both >= MIN_PERCENT * (len(x) + len(rep) - both):
                    a.append(i)
            b = [one.column("rep")[0].as_py()] * len(a)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (right.groupBy("rep", "rep_part").cogroup(left.groupBy("b", "part"))
            .applyInArrow(check, "a bigint, b bigint"))


def links_and_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a stored table (row, doc_id, text) with numbered rows: (per row: doc_id, row, n_shingles,
    rep = smallest row with the same set; per rep that has a link: node, component)."""
    sig = staged(signatures(rows.filter("doc_id is not null"), "row", "text").withColumnRenamed("doc_id", "row"),
                 "minhash_signatures")
    named = sig.filter("n_shingles > 0")
    copies = small_side(staged(
        named.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1").drop("rows"), "minhash_copies"))
    classes = sig.select("row", "n_shingles", "k1", "k2").join(copies, ["k1", "k2"], "left").select(
        "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "row")).otherwise(F.col("row")).alias("rep"))
    # One signature per class.
    once = named.join(copies, ["k1", "k2"], "left_anti").select("row", "bands").unionByName(
        named.join(copies, ["k1", "k2"]).filter("row = rep").select("row", "bands"))
    keys = once.select(F.col("row").alias("id"), F.explode("bands").alias("key"))
    groups = staged(keys.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("other"))
                    .filter("b < other").select("key", "b"), "minhash_groups")
    members = staged(keys.join(small_side(groups), "key"), "minhash_members")
    ids = small_side(staged(members.select("id").distinct(), "minhash_ids"))
    texts = rows.select(F.col("row").alias("id"), "text").join(ids, "id", "left_semi")
    sets = staged(shingle_sets(texts), "minhash_sets")
    met = members.filter("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    met = staged(_of_like_size(met, sets), "minhash_met")
    # Round 1: each member with the representative it meets in most bands.
    best = staged(met.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"), F.max("size").alias("size"))
                  .select("a", (-F.col("m.b")).alias("b"), "size"), "minhash_pairs")
    links = staged(verify(best, sets), "minhash_links")
    comp = staged(components(links), "minhash_components")
    # Round 2: the other representatives that are still in another component.
    pairs = staged(_apart(met.select("a", "b", "size"), comp).join(best, ["a", "b"], "left_anti"), "minhash_pairs")
    links, comp = _more_links(pairs, sets, links, comp)
    # Round 3: groups that still hold several components, member by member across them.
    seated = members.select("key", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("c"))
    mixed = seated.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    seated = staged(seated.join(mixed, "key", "left_semi"), "minhash_mixed")
    cross = likely_pairs(seated.join(sets.select("id", "size", "sketch", "wide"), "id"))
    cross = staged(cross.join(met, ["a", "b"], "left_anti").distinct(), "minhash_pairs")
    return classes, _more_links(cross, sets, links, comp)[1]


def _more_links(pairs: DataFrame, sets: DataFrame, links: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after checking further pairs; the given ones if none of them is a link."""
    if pairs.isEmpty():
        return links, comp
    found = staged(verify(pairs, sets), "minhash_links")
    if found.isEmpty():
        return links, comp
    links = links.unionByName(found)
    return links, staged(components(links), "minhash_components")


def _of_like_size(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose set sizes allow the similarity at all."""
    n = sets.select("id", "size")
    j = pairs.join(n.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(
        n.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
    return j.filter(100 * F.least("na", "nb") >= MIN_PERCENT * F.greatest("na", "nb")).drop("nb").withColumnRenamed("na", "size")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    c = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    d = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    j = pairs.join(c, "a", "left").join(d, "b", "left")
    return j.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "size")


def components_of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a stored table (row, doc_id, text): (row, doc_id, n_shingles, component of every row with an
    id; component, component_id = smallest doc_id, first = its first row, of components of several rows)."""
    classes, comp = links_and_components(rows)
    known = rows.filter("doc_id is not null").select("row", "doc_id").join(classes, "row").join(
        comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = staged(known.select("row", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component")), "minhash_rows")
    least = known.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.filter("n > 1").select("component", F.col("m.doc_id").alias("component_id"), F.col("m.row").alias("first"))
    return known, small_side(staged(least, "minhash_least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                              F.col(text_col).alias("text")), "minhash_texts")
    known, least = components_of_rows(rows)
    known = known.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    # Rows with a null id stand alone; only the size of their set is wanted.
    alone = signatures(rows.filter("doc_id is null"), "row", "text").select(
        F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return known.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each component: one with the smallest
    id. Rows with a null id stay."""
    cols = docs.columns
    row = free_name(docs, "row")
    stored = staged(docs.withColumn(row, F.monotonically_increasing_id()), "minhash_docs")
    known, least = components_of_rows(
        stored.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    gone = staged(known.join(least, "component").filter(F.col("row") != F.col("first")).select(F.col("row").alias(row)),
                  "minhash_gone")
    return stored.join(small_side(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in cols])


# The same relation for the DuckDB check: shared shingles of all pairs, then reachability.
NEAR_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, n, concat_ws(' ', a, lead(a, 1) OVER p, lead(a, 2) OVER p, lead(a, 3) OVER p, lead(a, 4) OVER p) AS s, i
      FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i + 4 <= n OR (n < 5 AND i = 1)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * shared >= 75 * (ka.n + kb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN k USING (doc_id) JOIN c USING (doc_id)
"""
