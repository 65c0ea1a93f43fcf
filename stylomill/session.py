"""Session building and the few things that need the cluster's shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def build_session(app: str = "stylomill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under; a cluster's own settings win where given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Without one, a folder of our own in local mode; a cluster must name one."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or f"file:///tmp/checkpoints/{sc.applicationId}")
        _forget_at_exit(spark, sc.getCheckpointDir())
    return (given or sc.getCheckpointDir()).rstrip("/")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """The JVM removes path when it ends in good order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in one of this application's that goes when it ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _shipped:
        _shipped.add(own)
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
        _forget_at_exit(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: columnar, so later readers prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that a written result no longer needs."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp()  # the driver's; Spark hands the file on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    zipped = Path(folder) / "stylomill.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in (ROOT / "stylomill").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(zipped))


#: A stored table goes to all executors up to this many bytes of files; beyond, Spark's shuffle joins take over.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its files are known to be small."""
    from pyspark.sql import functions as F

    n = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(n)) <= BROADCAST_BYTES else df


#: Rows of about so many bytes of files are worth a task of their own where a row takes much work.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame, task_bytes: int = SPREAD_BYTES) -> DataFrame:
    """df dealt to more tasks where its scan makes fewer than there are cores, and it has the bytes for more; df as it is where it makes enough."""
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(str(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    wanted = min(sc.defaultParallelism, max(1, size // task_bytes))
    return df.repartition(wanted) if size // most < wanted - 1 else df
