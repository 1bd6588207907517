"""SparkSession helpers shared by tests, bench and the entry module."""

from __future__ import annotations

import atexit
import contextvars
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library relies on.  Session time zone UTC keeps
# hour/weekday extraction identical to the SQL oracle.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "txrisk", extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with this library's settings; the cluster's own partition count and driver memory
    stay unless given here (or, for memory, in TXRISK_DRIVER_MEMORY)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if memory := driver_memory or os.environ.get("TXRISK_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the folder shared by the cluster (``spark.checkpoint.dir``), or set ``fallback``.

    Only a local master, whose executors are the driver itself, gets a scratch folder of its own
    where neither is given; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None) or fallback
    if current is None:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="txrisk-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where several statistics are taken from one expensive intermediate: the
    intermediate is computed once, later passes are column-pruned scans, and the
    files survive the loss of executors (unlike a cache or a local checkpoint).
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"txrisk-{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: What the library has persisted for the work of this thread or context, and not yet released.
_PERSISTED: contextvars.ContextVar[tuple] = contextvars.ContextVar("persisted", default=())


def persist_shared(df):
    """Persist an intermediate that several branches of one plan read (MEMORY_AND_DISK,
    rebuilt from lineage if an executor is lost) and remember it for ``release_shared``."""
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.set((*_PERSISTED.get(), out))
    return out


def release_shared() -> int:
    """Unpersist the intermediates that the library persisted for the caller's own thread or context
    (call after the results that use them have been written); those of others stay."""
    held = _PERSISTED.get()
    _PERSISTED.set(())
    for df in held:
        df.unpersist()
    return len(held)
