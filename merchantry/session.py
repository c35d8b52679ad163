"""Session helpers.

On a cluster the session comes from the platform; we only read its settings. A
checkpoint directory is set here only when the session has none (tests, local runs).
"""
from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | str = "*", app: str = "merchantry", extra: dict | None = None
                  ) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir. Only a local session may have none: it gets a scratch
    folder; on a cluster a machine-local folder would be unreadable elsewhere."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="merchantry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``merchantry`` importable on executors (Python UDFs and mapInPandas run
    our functions there): zip the package once and ship it with ``addPyFile``."""
    sc = spark.sparkContext
    key = f"{sc.applicationId}:{sc.startTime}"
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="merchantry-pkg-")
    base = shutil.make_archive(os.path.join(out, "merchantry"), "zip", os.path.dirname(pkg), "merchantry")
    sc.addPyFile(base)
    _SHIPPED.add(key)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession):
    """Inside, Spark deletes a statement's shuffle files when the statement ends. They are of no use
    after a write, whose rows are in its table, but would else stay until the driver's collector finds them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


ROWS_A_TASK = 50_000           # most rows, by ``spread``, for a task with costly expressions
LEAST_ROWS_A_TASK = 2_000


def spread(df, rows: int):
    """``df``, of about ``rows`` rows, dealt evenly to tasks of up to ROWS_A_TASK: a file with few row groups, or
    a shuffle of few bytes, would leave costly expressions to a few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // ROWS_A_TASK), min(2 * cores, rows // LEAST_ROWS_A_TASK + 1)))


def materialize(df, name: str, codec: str | None = None):
    """Write ``df`` as Parquet (compressed by ``codec`` or as the session says) under the session's
    checkpoint directory (a shared folder on a cluster) and read it back: this cuts the lineage, so
    later plans are small and survive executor loss, and scans keep column pruning and filter pushdown.
    The shuffle files of the write go with its end."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    with _shuffles_end_with_the_write(spark):
        df.write.mode("overwrite").parquet(path, compression=codec)
    table = spark.read.parquet(path)
    table._own_folder = path
    return table


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote. Call it once all that was derived from them is written
    itself; a table from elsewhere, or a DataFrame derived from one, is left alone."""
    for table in tables:
        path = getattr(table, "_own_folder", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
