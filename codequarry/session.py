"""Spark session and shared-folder settings.

Cluster jobs read ``spark.checkpoint.dir`` from the session; only a local
test session, where it is unset, gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles keep several tasks: CPU-heavy Python steps follow them.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Static broadcast only when the estimate, taken as 4x the compressed
    # file size, is under 10MB; AQE may also broadcast a side whose shuffle
    # was measured under 32MB.  Large tables never qualify.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Key state of streaming dedupe lives on disk (RocksDB), not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Python rewrite / completer jobs are fed in Arrow batches of this size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def build_session(master: str | None = None, app: str = "codequarry",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the engine defaults.

    On a cluster leave ``master`` unset (spark-submit decides) and size
    ``shuffle_partitions`` to the data; AQE coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` when set; otherwise, and only
    for a local master (tests), creates a fresh scratch folder; a cluster
    without the setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="cq-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the shared folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persisted(df: DataFrame, name: str, free_shuffles: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    A stage that several branches read, or that holds sampled completions,
    runs once; later scans prune columns and know their sizes.
    ``free_shuffles`` deletes the shuffle files of the write once the table
    stands; otherwise they lie beside it until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    was = spark.conf.get(_FREE_SHUFFLES, None)
    if free_shuffles:
        spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffles:
            spark.conf.unset(_FREE_SHUFFLES) if was is None else spark.conf.set(_FREE_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def path_has_data(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists and holds something besides marker files; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    return any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``codequarry`` importable in Python workers (once per application).

    Python steps pickle functions by module reference, so executors need the
    package; it is zipped on the driver and distributed with ``addPyFile``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="cq-pkg-"), "codequarry.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
