"""Session construction and shared scratch locations.

On a cluster the session comes from the caller; the library only reads
``spark.checkpoint.dir`` to find the shared folder for intermediate tables
and streaming checkpoints. A directory is only chosen here when the setting
is absent (local tests), never on a configured cluster.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "quarry") -> SparkSession:
    """Local session for tests and the bench; settings match the cluster profile."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting (tests, the bench); it gets
    a temporary folder. Anywhere else executors would write to disks of their
    own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getConf().get(_CHECKPOINT_KEY) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", sc.master):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (once per application).

    Arrow-batch functions (``mapInPandas``, pandas UDFs) are pickled by module
    reference, so executors must be able to import the package. The package
    is zipped into the shared checkpoint folder and registered with
    ``SparkContext.addPyFile``, which distributes it to every executor. When
    the checkpoint folder is not a local path (a cluster file system), the
    package is expected to be installed on the executors (``--py-files`` or
    the cluster's library setup) and nothing is shipped from here.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    local = base.startswith("/") or base.startswith("file:")
    if local:
        folder = scratch_path(spark, "pyfiles").removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        pkg = os.path.dirname(os.path.abspath(__file__))
        staging = os.path.join(folder, "src")
        shutil.copytree(pkg, os.path.join(staging, "quarry"),
                        ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        archive = shutil.make_archive(os.path.join(folder, "quarry"), "zip", root_dir=staging, base_dir="quarry")
        sc.addPyFile(archive)
    _SHIPPED.add(app)
