"""Session construction and the settings every job in this package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators assume. Time arithmetic is done on TIMESTAMP_NTZ with
# timestampadd/timestampdiff, which never consults the session zone, but UTC is
# still pinned so that any LTZ value that reaches an output prints unshifted.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from static size estimates: only explicit, size-checked
    # hints, or AQE's decision on measured runtime sizes.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings for the full-scale job (~100 TB of readings, ~1000 executors). Scan
# splits are large because scans are column-pruned to 4-6 columns; AQE starts
# from many shuffle partitions and coalesces them to ~256 MB, and splits skewed
# join partitions. Speculation re-runs stragglers; decommissioning migrates
# shuffle blocks off executors that are being lost; RocksDB keeps the streaming
# per-tag state off the JVM heap.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "32768",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32768",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.speculation": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "millrun", extra: dict | None = None,
                profile: str = "local") -> SparkSession:
    """Return the active session, or build one with ``BASE_CONF`` (plus
    ``CLUSTER_CONF`` when ``profile="cluster"``).

    On a cluster the session already exists (spark-submit); the SQL settings
    are then applied to it at runtime; core settings (speculation,
    decommissioning, state store) belong in the submit configuration.
    """
    active = SparkSession.getActiveSession()
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if active is not None:
        for k, v in conf.items():
            if not k.startswith("spark.ui."):
                active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("MILLRUN_MASTER", "local[*]"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Lineage is cut with ``checkpoint()`` or a table written here, never with
    ``localCheckpoint``; without a folder named by the session this raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3); "
                           "a machine-local folder does not survive executor loss")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
