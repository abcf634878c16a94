"""SparkSession helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans rely on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, broadcast conversion) and a fixed
# session zone so calendar arithmetic never depends on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "arrears", extra: dict | None = None) -> SparkSession:
    """A session with the defaults above. Master, partitions and memory come
    from the deployment unless given; ``extra`` may hold ``cluster_conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, also set as the
    reliable checkpoint folder. Never a folder of our own choice."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Only a local
    session may leave that unset; it then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            return checkpoint_dir(spark)  # refuses
        base = "file://" + tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cluster_conf(executors: int, cores_per_executor: int, input_tb: float) -> dict[str, str]:
    """Suggested settings for a large run (apply at submit time).

    * Initial shuffle partitions ~ 3 x total cores, but at least one per
      ~256 MB of shuffled input; AQE then coalesces small ones toward the
      advisory size and splits skewed ones (a key with a third of the rows
      is cut into advisory-size pieces for joins).
    * Scan splits of 256 MB keep a task's input well inside executor memory.
    * Broadcasts stay behind Spark's size check (64 MB), never forced.
    """
    cores = executors * cores_per_executor
    by_size = int(input_tb * 1024 * 1024 / 256)        # 256 MB per partition
    parts = max(3 * cores, by_size)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }
