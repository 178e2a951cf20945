"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. A value the caller set on the session is never changed.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even if that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    given = spark.sparkContext.getConf()
    for name, value in SETTINGS.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a shared folder.

    The folder is the one the cluster names in `spark.checkpoint.dir`; only where none is
    configured and driver and executors are one process (local runs, tests) a fresh temporary one is set,
    and deleted when that process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if context.master != "local" and not context.master.startswith("local["):  # more than one process
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="flowfeat-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint `df` to the shared folder, so lost executors cannot change or re-run it.

    With `eager=False` it is stored by the first action on it; for callers that count next.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=eager)
