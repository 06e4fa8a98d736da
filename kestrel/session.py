"""Session construction and the shared scratch folder.

Jobs cut lineage by writing tables into the folder the cluster names in
``spark.checkpoint.dir``. A folder of our own is created only when that
setting is absent (local tests), never on a configured cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every job relies on: UTC wall clock (timestamps compare
# equal to the DuckDB oracle), ANSI semantics, adaptive execution.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Keep generated methods within the JIT's huge-method limit: the wide
    # parse projection otherwise runs as interpreted bytecode (2x slower).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "kestrel", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(k, BASE_CONF[k])
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local runs and tests) a
    fresh folder is made and registered as the checkpoint dir. On a cluster
    without the setting, executors would write to their own disks: an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d.rstrip("/")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new, unique sub-folder of the shared folder (never reused)."""
    base = shared_dir(spark)
    return f"{base}/kestrel/{tag}-{uuid.uuid4().hex[:12]}"


# Bytes of an Arrow batch on its way to a Python worker: rows are whole texts, so a bound by number
# alone (Spark's 10,000 rows) lets a batch take any size.
ARROW_BATCH_BYTES = "4m"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in Python workers (pandas UDF paths).

    The package is zipped once per application into the shared folder and
    added with ``addPyFile``, as ``--py-files`` would on submit.
    """
    import io
    import pathlib
    import zipfile

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in root.rglob("*.py"):
            z.write(p, f"kestrel/{p.relative_to(root)}")
    target = scratch_dir(spark, "pyfiles") + "/kestrel.zip"
    # Written through the Hadoop file system of the shared folder (local,
    # HDFS or an object store alike).
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Sizing for a large cluster run (pass to ``build_session(extra=...)`` or spark-submit).

    Scan splits and shuffle partitions are sized so one task handles about
    ``target_partition_bytes``; AQE coalesces small partitions and splits
    skewed ones at run time, so the static count is an upper bound.
    """
    shuffle = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 2),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(8 << 20),
    }


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
