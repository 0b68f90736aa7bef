"""Session helpers: a local session for tests/bench and a checkpoint-dir lookup.

Library operators never create sessions; they take DataFrames. These helpers
exist for tests, ``bench.py`` and the driver entry point.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session used with this library should carry. UTC pins
# date_trunc/date casts so results match the SQL oracle; AQE re-plans shuffles
# (coalesces small partitions, splits skewed join partitions) at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "skylane") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": os.environ.get("SKYLANE_DRIVER_MEMORY", "16g"),
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    })
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint dir; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is respected as-is. Only in local runs with nothing configured
    do we fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="skylane-ckpt-")
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``skylane`` importable in Python workers (the ``--py-files`` mechanism), once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="skylane-pyfiles-"), "skylane"), "zip",
                                  root_dir=root, base_dir="skylane")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """What every registered query needs: the time zone, a checkpoint folder and the package on the workers.

    Only settings that change results are forced; everything else is left to the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", BASE_CONF["spark.sql.session.timeZone"])
    ensure_checkpoint_dir(spark)
    ship_package(spark)
