"""Spark session and lineage helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # window-heavy stages are CPU-bound per byte: keep AQE from merging small
    # shuffle partitions below 256 KB (no effect once partitions are large)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # map_concat in store upserts: later maps win on equal keys
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # reliable checkpoints of intermediates are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "veloscope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on.

    On a cluster, leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); locally it defaults to the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir`` (tests name their own)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="veloscope-")        # one process on one machine: tests and local runs
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss); inside ``written_alone`` a written table."""
    if getattr(_passing, "tables", None) is not None:       # a checkpoint is not compressed, and stays until the driver collects its garbage
        return written_once(df, "cut")
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


#: shuffle files go when their execution ends, not when the driver happens to collect its garbage
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
#: ``tables``: what the thread has written inside ``written_alone``
_passing = threading.local()


def written_once(df: DataFrame, name: str, partition_by: Sequence[str] = (), level: int = 3) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: computed once, with known size.

    ``partition_by``: a folder per value of these columns (which come last then); ``level``: of its compression. The folder is removed when the driver process ends.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df = df.select(*[c for c in df.columns if c not in partition_by], *partition_by) if partition_by else df
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")                 # the table stands for them from here on
    try:
        df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": level}).partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    _written.append((df.sparkSession, path))
    if getattr(_passing, "tables", None) is not None:
        _passing.tables.append(_written[-1])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, ``written_once``; the tables that are written while it is built are removed then.

    They are not to be read by anything but the result. The disk holds the tables of one step at a time.
    """
    outer, _passing.tables = getattr(_passing, "tables", None), []
    try:
        out = written_once(build(), name)
        *spent, own = _passing.tables
    finally:
        _passing.tables = outer
    for table in spent:
        _remove(*table)
        _written.remove(table)
    if outer is not None:
        outer.append(own)
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """A folder of the shared file system that tasks fill themselves goes when the driver process ends."""
    _written.append((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            return
