"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "candlewick", extra: dict | None = None) -> SparkSession:
    """Return a session with UTC time, AQE and Arrow enabled.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[N]``. Settings already present on an active session are kept.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Only a local-mode session
    without that setting gets a fresh temporary folder; a cluster session
    without it is an error, because machine-local folders do not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        root = tempfile.mkdtemp(prefix="candlewick-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder for a written intermediate table.

    The name is random, so two drivers that share the folder never meet.
    """
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that ``scratch_path`` named (any Hadoop file system)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: State stores keep their rows on disk, not on the heap of the executors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What holds while the library runs a job of its own: the files of its shuffles go as soon as it is
#: done, instead of when the driver happens to collect its garbage; a task keeps the files of
#: this many partitions open instead of sorting its rows by partition once more; and streams leave no local
#: copy of their state between micro-batches, which a run that has died would keep beside that of the next.
_JOB_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "32",
             "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


@contextlib.contextmanager
def own_job(spark: SparkSession):
    """For jobs that run whole inside the ``with``, and for streams that start there. A plan that is run again afterwards computes its
    shuffles again, so DataFrames that the caller gets to run are better planned outside."""
    before = {k: spark.conf.get(k, None) for k in _JOB_CONF}
    for key, value in _JOB_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def recommended_conf(shuffle_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large run, from the expected shuffle volume.

    Initial shuffle partitions are sized so each holds about
    ``target_partition_bytes`` (AQE coalesces small ones at run time) and
    never fewer than two waves of the cluster's cores; scans split at 256 MB;
    AQE's skew split kicks in for partitions five times the median and above
    512 MB.
    """
    parts = max(2 * total_cores, -(-int(shuffle_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.session.timeZone": "UTC",
    }
