"""Session helpers: table reading and lineage cutting that behave alike on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A parquet table of the registry: one file or one directory called ``<name>.parquet``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests on one machine) a
    folder of this machine is created.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shelfmark-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there; survives the loss of executors."""
    spark = df.sparkSession
    wanted = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(wanted)
    return df.checkpoint(eager=True)


#: Most rows of a table that is broadcast because it was counted.
SMALL_ROWS = 20_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` (written down, of few and narrow columns) with a broadcast hint if it has ``limit`` rows at most, else as it is.

    For joins on keys that few values share, where hashing both sides would give all rows of a key to one task.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def has_columns(df: DataFrame, *names: str) -> bool:
    """Whether every name is a column of ``df``."""
    return set(names) <= set(df.columns)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path to it.

    On a cluster where the package is installed everywhere this changes nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="shelfmark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "shelfmark_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(home, "shelfmark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, home))
    context.addPyFile(archive)
    context._shelfmark_shipped = True
