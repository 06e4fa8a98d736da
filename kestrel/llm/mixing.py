"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source has a weight and may be repeated up to ``max_epochs`` times. The
target of a source is its share of the total by weight; sources whose share
exceeds their cap are clamped there and the excess is shared again by weight
until nobody is above its cap. That fixed point is a water level: with the
sources in ascending order of cap / weight, a source is clamped exactly when
the level left for it and all later ones is at least its cap / weight. A
source's documents are then taken floor(target / size) times, and a seeded
choice of them once more: documents in the order of a seeded hash, until the
remaining words are reached (a document at the border counts when at least
half of it fits). The border is found from two histograms of the hash per
source, so no task ever sorts a whole source.

Cases: a null or blank text has size 0 (it may be repeated, adding nothing);
a null source is a source of its own that sorts last; an empty table or one
without words gives targets 0; a null id counts as the empty text in the
hash; repeated rows share a hash and are ordered by size; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import WORD_RE, id_text, staged

# Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
# Bits of each of the two histogram levels of the hash.
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def order_key(id_col: str, seed: str = SEED) -> Column:
    """52 hash bits that fix a document's place in its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_text(id_col))), 1, 13), 16, 10).cast("bigint")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, u): all that the mix needs of a document; u orders the documents."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), order_key(id_col, seed).alias("u"))


def source_targets(per_source: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + weight, target. One row per source comes in, so the
    unpartitioned windows run over a table of sources, not of documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = per_source.select("source", "source_size",
                          F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth).alias("weight"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w = w.withColumn("level", rest / F.sum("weight").over(onward))
    w = w.withColumn("clamped", F.col("level") * F.col("weight") >= F.col("cap"))
    # The unclamped sources share the level of the first one, which is the highest of theirs.
    open_level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(whole)
    return w.select("source", "source_size", "weight",
                    F.when(F.col("clamped"), F.col("cap")).otherwise(open_level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Staged (doc_id, source, size, u) -> one row per source: source_size, target, whole (times that
    every document is taken), part (words still to take) and border, the cell of the hash in which
    the part is reached."""
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(per_source, weights, max_epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                     .otherwise(0).cast("bigint"))
    t = staged(t.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix_sources")
    same = F.col("d.source").eqNullSafe(F.col("t.source"))

    def passing(hist: DataFrame, tag: str) -> DataFrame:
        """The cell of each source in which the running sum (from ``carry``) passes the part."""
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        h = hist.withColumn("below", F.coalesce(F.sum("n").over(run), F.lit(0)) + F.col("carry"))
        h = h.filter((F.col("below") < F.col("part")) & (F.col("below") + F.col("n") >= F.col("part")))
        return h.groupBy("source").agg(F.min(F.struct("b", "below")).alias(tag))

    h1 = (docs.groupBy("source", cell(1).alias("b")).agg(F.sum("size").alias("n")).alias("d")
          .join(t.alias("t"), same).select("t.source", "t.part", "b", "n", F.lit(0).alias("carry")))
    t1 = t.alias("t").join(passing(h1, "c1").alias("d"), same, "left").select("t.*", "d.c1")
    h2 = (docs.alias("d").join(t1.filter("c1 is not null").alias("t"), same & (cell(1) == F.col("t.c1.b")))
          .groupBy("t.source", "t.part", F.col("t.c1.below").alias("carry"), cell(2).alias("b"))
          .agg(F.sum("size").alias("n")))
    return staged(t1.alias("t").join(passing(h2, "border").alias("d"), same, "left")
                  .select("t.source", "t.source_size", "t.target", "t.whole", "t.part", "d.border"), "mix_plan")


def cell(level: int) -> Column:
    return F.shiftright("u", 52 - level * LEVEL_BITS)


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, u and any others) + source_size, target, times, taken.

    Cells below the border are taken once more, cells above are not. Only the rows of the border
    cell (about one in 2^24 of a source) are ordered one by one."""
    cols = [F.col(f"d.`{c}`") for c in rows.columns]
    j = rows.alias("d").join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        *cols, "t.source_size", "t.target", "t.whole", "t.part", "t.border")
    at = F.coalesce(F.sign(cell(2) - F.col("border.b")), F.lit(1.0))
    sure = j.filter(at != 0).withColumn("once_more", at < 0)
    run = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("border.below")
    close = j.filter(at == 0).withColumn("once_more", 2 * before + F.col("size") <= 2 * F.col("part"))
    out = sure.unionByName(close).withColumn("times", F.col("whole") + F.col("once_more").cast("bigint"))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop("whole", "part", "border", "once_more")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document."""
    small = staged(sizes(docs).drop("u"), "mix_sizes").withColumn("u", order_key("doc_id"))
    return apply_plan(small, mix_plan(small, weights, max_epochs))


def repeat(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, with its own columns."""
    small = staged(sizes(docs).drop("u"), "mix_sizes").withColumn("u", order_key("doc_id"))
    plan = mix_plan(small, weights, max_epochs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                       word_count(F.col("text")).alias("size"), order_key("doc_id").alias("u"))
    out = apply_plan(rows, plan).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


# The same mix for the DuckDB check: the rule on whole sources, without cells.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap
        ELSE (SELECT max(level) FROM l WHERE NOT level * weight >= cap) * weight END AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS part,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * before + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
