"""Session helpers.

Library code never creates a session on its own; it takes the caller's.
``local_session`` is for tests, the bench and notebooks on one machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. Timestamps are read as TIMESTAMP_NTZ, so
# the zone only matters for ``current_timestamp``-style functions; UTC keeps
# runs on differently configured hosts equal.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Whole-stage generated methods of the feature/grid projections exceed
    # HotSpot's 8000-byte JIT limit; let the JIT compile them (set the same
    # on executors of a cluster).
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    # PySpark otherwise records a Python call site (several JVM round trips)
    # for every Column function call while a plan is being built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "citysense", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and benchmarks (UI off, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cores}]")
               .appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("CITYSENSE_DRIVER_MEMORY", "8g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names it (HDFS/S3/...); a session on a
    cluster without that setting raises, since a folder of one host would be
    lost to the others. A session on one machine (tests, a laptop) gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_one_machine(sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: the master is {sc.master}")
        conf_dir = tempfile.mkdtemp(prefix="citysense-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialize(df):
    """Cut lineage before iterative work (model fits): a reliable checkpoint.

    Written to the shared checkpoint folder, so a lost executor does not send
    every ML iteration back through the whole preparation plan. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes it once
    nothing refers to it any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables; all of a session's
    are removed when the session's JVM ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _SCRATCH.add(root)
    return f"{root}/{name}"


_SCRATCH: set[str] = set()
