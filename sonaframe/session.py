"""Session helpers.

Library code never creates a session on its own; these helpers exist for the
bench, the tests and the driver entry.  On a cluster the session is built by
the platform and ``ensure_checkpoint_dir`` only reads what is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sonaframe") -> SparkSession:
    """A local session tuned for small test data (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SONA_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    is.  Only when nothing is configured and the master is local (tests) a
    scratch folder is created; on a cluster an unset folder is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return conf_dir or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        # executors would each write to a disk of their own
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="sona-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir
