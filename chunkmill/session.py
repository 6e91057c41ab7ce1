"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on. AQE re-plans joins at runtime: it turns a
# shuffle join into a broadcast only after measuring the smaller side, and splits skewed
# partitions (a hot filename or store) into several tasks.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep its last value, as Python's decoder does
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "chunkmill", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a private folder (tests, benches);
    a cluster session without it is an error, because a machine-local folder does not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running chunkmill jobs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkmill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder (reliable; survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables next to the checkpoints (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def range_partitioned(df: DataFrame, cols: list, num_partitions: int | None = None) -> DataFrame:
    """Range partition ``df`` on ``cols`` and sort inside partitions. Without an explicit count the
    shuffle setting applies and AQE may merge neighbouring ranges (order is kept); the count is
    never derived from ``df.rdd``, which would execute the upstream shuffles just to count."""
    parted = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    return parted.sortWithinPartitions(*cols)


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``chunkmill`` importable in the Python workers (``mapInPandas``, pandas UDFs) on every
    executor, whatever the driver's working directory: zip the package once per process and add it
    with ``addPyFile`` once per application."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if _SHIPPED.get("app") == app:
        return
    zpath = _SHIPPED.get("zip")
    if not zpath:
        root = os.path.dirname(os.path.abspath(__file__))
        zpath = os.path.join(tempfile.mkdtemp(prefix="chunkmill-pkg-"), "chunkmill.zip")
        with zipfile.ZipFile(zpath, "w") as z:
            for base, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        _SHIPPED["zip"] = zpath
    sc.addPyFile(zpath)
    _SHIPPED["app"] = app
