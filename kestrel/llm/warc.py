"""WARC archives: a writer of native expressions and a PySpark data source that reads them back.

Writing: every record is one row of text, so Spark's text writer lays down the
archive files on whatever file system holds the folder; the line separator is
the blank line pair that ends a record. Payloads that occur more than once
(100 bytes or more) are stored once; the other records are revisits that name
the response they refer to.

Reading: ``spark.read.format("warc")`` plans one partition per group of files
and pushes down equality filters on the record type and on named headers
(``spark.sql.python.filterPushdown.enabled``). Headers are parsed first; the
payload of a record that the filters reject, or any payload when the columns
made from it are not wanted, is skipped by its length and never decoded.

Cases: a null payload counts as empty; a null URL gives a record without a
target; line breaks in a URL are percent-encoded; a null id is written as
``null`` and read as null; among equal payloads the smallest id is the
response (every row of that id, if repeated; all rows, if all ids are null);
an empty table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations


import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from kestrel.llm.common import staged

# Payloads below this size are never replaced by a revisit.
MIN_SHARED_BYTES = 100
# Fixed values of the format.
VERSION = "WARC/1.1"
EOL = "\r\n"
RECORD_END = EOL * 2
ID_PREFIX = "urn:page:"
NO_DATE = "1970-01-01T00:00:00Z"
# Rows per archive file, and bytes of files per partition when reading.
FILE_RECORDS = 200_000
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"),
                       "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    keys = p.filter(F.col("payload_bytes") >= MIN_SHARED_BYTES)
    shared = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    shared = staged(shared.filter("rows > 1").drop("rows"), "warc_shared")
    p = p.join(shared, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                    F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("first")).alias("refers_to"))


def write_archive(records: DataFrame, folder: str, date: str = NO_DATE) -> None:
    """Write planned records as WARC files (UTF-8) into ``folder``."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    full = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    body = F.when(full, F.concat(http, "payload")).otherwise("")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(EOL))

    head = F.concat(
        F.lit(VERSION + EOL), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<" + ID_PREFIX), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(~full, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<" + ID_PREFIX), F.col("refers_to").cast("string"), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")))
    (records.select(F.concat(head, F.lit(EOL), body).alias("value")).write.option("lineSep", RECORD_END)
     .option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def archive_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archive files of a folder, listed by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    named = [(f.getPath().toString(), int(f.getLen()), f.getPath().getName()) for f in files]
    return sorted((p, n) for p, n, name in named if n and not name.startswith(("_", ".")))


class WarcPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_length bigint, payload binary")
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
             "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
             "payload_length": "x-payload-length"}


class WarcSource(DataSource):
    """Options: ``files`` (lines of ``bytes<TAB>path``), ``payload`` (false: never read payloads)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        rows = [x.split("\t", 1) for x in options.get("files", "").split("\n") if x]
        self.files = [(p, int(n)) for n, p in rows]
        self.want_payload = options.get("payload", "true").lower() != "false"
        self.equal: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on text columns that stand for headers is judged here, before any payload."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo) and len(f.attribute) == 1 else None
            if name in HEADER_OF and name != "payload_length" and isinstance(f.value, str) and name not in self.equal:
                self.equal[name] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[list[str]] = []
        room = 0
        for path, n in self.files:
            if not out or n > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(path)
            room -= n
        return [WarcPartition(p) for p in out] or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.string()) for n in HEADER_OF]
                           + [("payload", pa.binary())])
        rows: list[list] = []
        held = 0
        for path in partition.paths:
            fs, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
            with fs.open_input_file(inner) as f:
                for head, payload in records(f, self._wanted, self.want_payload):
                    rows.append([clean(n, head.get(h)) for n, h in HEADER_OF.items()] + [payload])
                    held += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def _wanted(self, head: dict[str, str]) -> bool:
        return all(clean(n, head.get(HEADER_OF[n])) == v for n, v in self.equal.items())


def clean(name: str, value: str | None):
    """A header's value as the column's: ids without brackets, digests without the scheme."""
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.strip("<>")
    if name == "payload_digest":
        return value.rpartition(":")[2]
    return int(value) if name == "payload_length" else value


def records(f, wanted, want_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the wanted records of an open archive file. Blocks that are
    not wanted are skipped by their Content-Length."""
    size = f.size()
    at = 0
    window = io.BytesIO()
    start, stop = 0, 0

    def need(a: int, n: int) -> bytes:
        """Bytes a .. a + n, through a window that is read ahead."""
        nonlocal window, start, stop
        if a < start or a + n > stop:
            f.seek(a)
            data = f.read(max(n, 1 << 18))
            window, start, stop = io.BytesIO(data), a, a + len(data)
        window.seek(a - start)
        return window.read(n)

    while at < size:
        span = 1024
        while True:
            raw = need(at, min(span, size - at))
            end = raw.find(b"\r\n\r\n")
            if end >= 0 or span >= size - at:
                break
            span *= 2
        if end < 0:
            raise ValueError(f"no end of header at byte {at}")
        first, *lines = raw[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block, length = at + end + 4, int(head["content-length"])
        if wanted(head):
            payload = None
            if want_payload and head.get("warc-type") == "response":
                payload = need(block, length).partition(b"\r\n\r\n")[2]
            yield head, payload
        at = block + length + len(RECORD_END)


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder; filter on the header columns to have them pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = "\n".join(f"{n}\t{p}" for p, n in archive_files(spark, folder))
    return spark.read.format("warc").option("files", files).option("payload", str(payload).lower()).load()


def digest_records(read: DataFrame) -> DataFrame:
    """The payloads as counts and digests, taken from the bytes of responses and from the headers of
    revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def page(c: str) -> Column:
        return F.regexp_extract(c, ID_PREFIX + r"(-?\d+)$", 1).try_cast("bigint")

    full = F.col("record_type") == "response"
    return read.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


# The same table for the DuckDB check, from the pages themselves.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_SHARED_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
