"""Session defaults and the reliable lineage cut used by every iterative job."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "shiftgrain", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings the operators assume (UTC clock, AQE, dynamic partition overwrite).

    Executor counts, memory and the master stay with spark-submit on a cluster; `master` and
    `shuffle_partitions` are only for local runs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (`spark.checkpoint.dir`).

    Only a local-mode session without that setting (tests, a laptop) gets a folder of its own; a
    cluster session without it is an error, because a machine-local folder does not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if shared:
        sc.setCheckpointDir(shared)
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="shiftgrain-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, so a lost executor re-reads files, not history."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def limit_solver_threads(n: int = 2) -> None:
    """Cap the linear-algebra threads of the driver process.

    A small dense solve beside a local-mode JVM that owns all cores crawls when every core gets a
    spinning solver thread. Does nothing where the library or its setter is not found.
    """
    import ctypes
    import glob

    import numpy

    for lib in glob.glob(os.path.join(os.path.dirname(numpy.__file__), os.pardir, "numpy.libs", "*openblas*")):
        handle = ctypes.CDLL(lib)
        for setter in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(handle, setter):
                getattr(handle, setter)(n)
                return
