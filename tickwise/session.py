"""Session construction and shared-storage helpers.

The builder only sets what the engine relies on: UTC session time zone (all
timestamps are compared against an oracle and against vendor formats that carry
their own zone), adaptive execution (runtime broadcast choice, partition
coalescing, skew-join splitting) and Arrow for the few pandas functions.
Everything else is left to the cluster's own defaults.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A shuffle side is turned into a broadcast at runtime only when its
    # *measured* size is below this bound; otherwise the join stays sort-merge.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tickwise", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session configured for the engine."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply the runtime (SQL) settings to an existing session."""
    for k, v in _DEFAULTS.items():
        if k.startswith("spark.sql.") and k != "spark.sql.session.timeZone":
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf in a shared session: keep the cluster's value
                pass
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh directory below the cluster's shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``; it is only set
    here when a local session has none (tests), never overridden; on a cluster
    a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tickwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return "/".join([base, "tickwise", *parts, uuid.uuid4().hex])


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files below ``paths`` (Hadoop content summaries; metadata only)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        jpath = jvm.org.apache.hadoop.fs.Path(p)
        total += jpath.getFileSystem(conf).getContentSummary(jpath).getLength()
    return int(total)


def size_shuffles(spark: SparkSession, paths: list[str], target_bytes: int = 256 << 20,
                  min_partitions: int | None = None) -> int:
    """Set the shuffle partition count so one partition holds about ``target_bytes`` of input.

    AQE coalesces partitions that turn out small and splits skewed ones, so the
    count only has to be large enough for the biggest shuffle; the input size is
    a safe upper estimate. Returns the count that was set.
    """
    floor = min_partitions or spark.sparkContext.defaultParallelism
    n = max(floor, -(-input_bytes(spark, paths) // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(target_bytes, 256 << 20)))
    return n
