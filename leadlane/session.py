"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library relies on. Time zone UTC makes
# date arithmetic and timestamp parsing reproducible; AQE re-plans joins and
# coalesces shuffle partitions from runtime statistics.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Local mode only: the driver JVM is the executor.
LOCAL_DEFAULTS = {
    "spark.driver.memory": os.environ.get("LEADLANE_DRIVER_MEMORY", "16g"),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "leadlane", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the provided session."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    if master.startswith("local"):
        conf.update(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if master.startswith("local["):  # tests and benchmarks; a cluster names its shared folder itself
        conf.setdefault("spark.checkpoint.dir",
                        os.environ.get("LEADLANE_CHECKPOINT_DIR", "/tmp/leadlane-checkpoints"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named in ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the platform and must be shared
    storage; we only set our own when the setting is absent (local tests).
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name storage that all nodes share")
    path = fallback or os.environ.get("LEADLANE_CHECKPOINT_DIR") or "/tmp/leadlane-checkpoints"
    sc.setCheckpointDir(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, by its own Hadoop file system; errors of the store rise."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def remember_scratch(path: str) -> None:
    """Have ``release_lineage_tables`` delete this folder too."""
    _LINEAGE_TABLES.append(path)


def cut_lineage(df):
    """Materialise ``df`` as a parquet table under the shared checkpoint folder
    (``spark.checkpoint.dir``) and return a scan of it.

    One write job (``Dataset.checkpoint`` would compute the data twice), the
    result survives executor loss, and downstream scans get column pruning and
    filter pushdown. Never a machine-local folder on a cluster.
    """
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _LINEAGE_TABLES.append(path)
    return df.sparkSession.read.parquet(path)


_LINEAGE_TABLES: list[str] = []


def lineage_tables() -> list[str]:
    """Tables written by ``cut_lineage`` and folders named by ``remember_scratch`` in this driver process."""
    return list(_LINEAGE_TABLES)


def release_lineage_tables(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete lineage tables once no DataFrame built on them is used any more.

    Caller-driven on purpose: a DataFrame returned by an operator keeps
    reading its table lazily, so only the job owner knows when it is done.
    Uses the Hadoop FileSystem of each path (works for shared storage).
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for p in list(paths if paths is not None else _LINEAGE_TABLES):
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).delete(hp, True):
            done += 1
        if p in _LINEAGE_TABLES:
            _LINEAGE_TABLES.remove(p)
    return done
