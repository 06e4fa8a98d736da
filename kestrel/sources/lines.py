"""Raw line folders (read and write) and the file manifest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names recognised in file names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]
# How a month is written in file names.
MONTH_NAME_YEAR = r"(?i)(" + "|".join(MONTHS) + r")\s*([0-9]{4})"
YEAR_MONTH = r"([0-9]{4})[-_ ]?([0-9]{2})\b"


# Ordering blocks (``blk``) of a source that are written as one file.
CHUNK_BLOCKS = 256
# A chunk's place in the order key of its lines: above every byte offset.
CHUNK_SHIFT = 40


def write_line_files(lines: DataFrame, folder: str, chunk_blocks: int | None = CHUNK_BLOCKS) -> None:
    """Write lines as text under ``file=<name>/chunk=<n>``, one file for every ``chunk_blocks`` ordering
    blocks of a source, in line order (``None``: one file, written by one task, for a whole source)."""
    chunk = F.lit(0) if chunk_blocks is None else F.coalesce(F.floor(F.col("blk") / chunk_blocks), F.lit(0))
    (lines.withColumn("chunk", chunk).repartition("file", "chunk").sortWithinPartitions("file", "chunk", "blk", "ord")
     .select("file", "chunk", "line").write.mode("overwrite").partitionBy("file", "chunk").text(folder))


def line_block() -> Column:
    """``blk`` of a scanned line: its split's byte offset, after the offsets of earlier chunks."""
    chunk = F.regexp_extract(F.col("_metadata.file_path"), r"/chunk=([0-9]+)/[^/]+$", 1)
    return F.shiftleft(F.coalesce(F.nullif(chunk, F.lit("")).cast("bigint"), F.lit(0)), CHUNK_SHIFT) + F.col("_metadata.file_block_start")


def clean_path(path: str) -> str:
    return re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?/*", "/", path)


def file_id(spark: SparkSession, folder: str) -> Column:
    """Identity of the source file of a row: its path under ``folder``, so files of one name in
    different sub-folders stay apart. A ``file=<name>`` folder (with or without chunks) names the source file itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    root = clean_path(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()).rstrip("/")
    return path_under(F.col("_metadata.file_path"), root)


def path_under(path: Column, root: str) -> Column:
    """A file's (URL-encoded) path relative to ``root``; the value of a ``file=`` folder if it has one."""
    plain = F.regexp_replace(F.url_decode(path), r"^[A-Za-z0-9+.-]+:(//[^/]*)?/*", "/")
    rel = F.substring(plain, F.lit(len(root) + 2), F.length(plain))
    named = F.regexp_extract(rel, r"(?:^|/)file=([^/]+)/(?:chunk=[0-9]+/)?[^/]+$", 1)
    return F.when(named != "", F.url_decode(named)).otherwise(rel)


def scan_lines(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """Lines of every text file under ``folder`` -> (file, blk, ord, line, hdr).

    ``blk`` is the byte offset of the split (see ``line_block``) and ``ord`` a per-split increasing
    id, so (blk, ord) is file order. Empty lines are dropped (CR, LF and CRLF
    all end a line). The ids depend on the split layout, so the lines are
    written once to ``stage`` before they are used twice; the header (first
    line of each file) is then found with a per-file minimum, joined back
    (AQE picks the join from the table's real size).
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    name = file_id(spark, folder)
    staged = raw.select(name.alias("file"), line_block().alias("blk"),
                        F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    staged.filter(F.col("line") != "").write.mode("overwrite").parquet(stage)
    lines = spark.read.parquet(stage)
    # Only the first split of a file (blk = 0) can hold its header, so only
    # those rows meet the per-file minimum; later splits pass through.
    head_split = lines.filter(F.col("blk") == 0)
    first = head_split.groupBy("file").agg(F.min("ord").alias("ord")).withColumn("hdr", F.lit(True))
    marked = head_split.join(first, ["file", "ord"], "left").select(
        "file", "blk", "ord", "line", F.coalesce(F.col("hdr"), F.lit(False)).alias("hdr"))
    rest = lines.filter(F.col("blk") != 0).select("file", "blk", "ord", "line", F.lit(False).alias("hdr"))
    return marked.unionByName(rest)


def file_months(name: Column) -> tuple[Column, Column, Column]:
    """Year, month and ``YYYY-MM`` from ``<Month> YYYY`` or ``YYYY[-_ ]?MM`` in a file's name; else NULL."""
    base = F.regexp_replace(name, r"(?i)\.csv$", "")
    named, num = F.regexp_extract(base, MONTH_NAME_YEAR, 0), F.regexp_extract(base, YEAR_MONTH, 0)
    mname = F.lower(F.regexp_extract(base, MONTH_NAME_YEAR, 1))
    mnum = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mname).cast("int")
    y = (F.when(named != "", F.regexp_extract(base, MONTH_NAME_YEAR, 2))
         .when(num != "", F.regexp_extract(base, YEAR_MONTH, 1))).cast("int")
    m = F.when(named != "", mnum).when(num != "", F.regexp_extract(base, YEAR_MONTH, 2).cast("int"))
    return y, m, F.when(y.isNotNull(), F.format_string("%04d-%02d", y, m))


def is_csv(name: Column) -> Column:
    return F.lower(name).endswith(".csv")


def file_manifest(names: DataFrame, col: str = "file") -> DataFrame:
    """``.csv`` names (any case) with year and month from ``<Month> YYYY`` or ``YYYY[-_ ]?MM``."""
    n = names.select(F.col(col).alias("file")).distinct().filter(is_csv(F.col("file")))
    y, m, ym = file_months(F.col("file"))
    return n.select("file", y.alias("y"), m.alias("m"), ym.alias("ym"))


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """S2 of a folder: (file, y, m, ym, size), names and sizes from its listing; no file is opened.
    A ``file=<name>`` folder of several files is one source with the sum of their sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sized = files.select(file_id(spark, folder).alias("file"), "length").filter(is_csv(F.col("file")))
    y, m, ym = file_months(F.col("file"))
    return sized.groupBy("file").agg(F.sum("length").alias("size")).select(
        "file", y.alias("y"), m.alias("m"), ym.alias("ym"), "size")


def read_range(spark: SparkSession, folder: str, a: str, b: str) -> DataFrame:
    """S3 rows: (file, line) of the ``.csv`` sources whose month lies in [a, b], empty lines left out.
    The condition rests on the file's path alone, so Spark drops the other files before it reads."""
    name = file_id(spark, folder)
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    wanted = raw.filter(is_csv(name) & file_months(name)[2].between(a, b))
    return wanted.select(name.alias("file"), F.col("value").alias("line")).filter(F.col("line") != "")


def files_in_range(manifest: DataFrame, a: str, b: str) -> DataFrame:
    """S3: files with a ym in [a, b] (inclusive, lexical on YYYY-MM), ascending."""
    return manifest.filter(F.col("ym").isNotNull() & F.col("ym").between(a, b)).orderBy("ym", "file")


def files_newest_first(manifest: DataFrame) -> DataFrame:
    """Year desc, month desc, name desc; files without ym last (name desc)."""
    return manifest.orderBy(F.col("y").desc_nulls_last(), F.col("m").desc_nulls_last(), F.col("file").desc())
