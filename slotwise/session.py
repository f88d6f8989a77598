"""Spark session helpers.

The library never creates its own cluster configuration beyond what a job
needs to be deterministic (UTC session time zone).  Tests and the bench use
:func:`local_session`; on a cluster callers pass their own session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session used with this library should carry.  AQE lets Spark
# coalesce small shuffle partitions, split skewed join partitions and turn a
# sort-merge join into a broadcast join once the real size of a side is known.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Delete reliable-checkpoint files once their DataFrame is unreachable.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Starting point for a large cluster (~100 TB inputs, ~1000 executors):
# many initial shuffle partitions that AQE coalesces towards the advisory
# size, scan splits of the same size, and skew splitting for joins.
CLUSTER_DEFAULTS = {
    **SESSION_DEFAULTS,
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def apply_conf(builder, conf: dict = CLUSTER_DEFAULTS):
    """Apply a settings preset to a ``SparkSession.builder``."""
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "slotwise") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The state store of transformWithStateInPandas talks to the Python
        # worker over a Unix socket rather than a loopback TCP port.
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Lineage cuts, snapshots and streaming checkpoints all live below it, never
    in a machine-local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; call ensure_checkpoint_dir() in tests")
    return root


_CHECKPOINT_SET: set = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the checkpoint dir the cluster configures (``spark.checkpoint.dir``).

    Only a local-mode session (tests) without one gets a private folder; on a
    cluster an unset setting is an error, never a machine-local fallback.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        root = tempfile.mkdtemp(prefix="slotwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    key = (id(spark.sparkContext), root)
    if key not in _CHECKPOINT_SET:
        spark.sparkContext.setCheckpointDir(root)
        _CHECKPOINT_SET.add(key)
    return root


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint root (for snapshots and sinks)."""
    return os.path.join(checkpoint_root(spark), *parts)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``slotwise`` importable in the Python workers (once per context).

    Operators that run Python per partition pickle functions of this package
    by reference.  When the package is not installed on the executors, a zip
    of it is added with ``addPyFile``; the zip is written under the shared
    checkpoint root when that is a local path.  With a remote checkpoint root
    the package is expected to be installed on the cluster.
    """
    import uuid
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    _SHIPPED.add(id(sc))
    root = checkpoint_root(spark)
    if "://" in root and not root.startswith("file:"):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = os.path.join(root.replace("file://", "").replace("file:", ""), "pyfiles")
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, f"slotwise-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
