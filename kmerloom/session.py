"""Session helpers: parallelism of narrow inputs, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import gc
import itertools
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if rows x row bytes stays under this.
BROADCAST_BYTES = 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: spark.checkpoint.dir.

    Where the setting is absent (a local test session) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kmerloom-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's workers this package, once, unless the environment they inherit has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    # made at the driver, which serves it to the workers
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "kmerloom"), "zip", root, "kmerloom"))
    _shipped.add(sc.applicationId)


_cuts = itertools.count(1)
#: After so many cuts the driver collects its garbage.
COLLECT_AFTER = 6


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the checkpoint folder and drop its lineage.

    Spark deletes shuffle files and checkpoints of frames that are no longer used only when the driver collects its
    garbage, which a long iteration must not leave to chance: files and plans of past rounds would pile up.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint()
    if next(_cuts) % COLLECT_AFTER == 0:
        collect_garbage(spark)
    return done


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan of fewer files than cores, else CPU-heavy row work runs in one task."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the counted size is under BROADCAST_BYTES; beyond, a shuffle join is left to the planner."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
