"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers once for each Spark application, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_refloom_shipped", False):
        return
    import refloom

    root = os.path.dirname(os.path.abspath(refloom.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="refloom-package-"), "refloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("refloom", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._refloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` wins. Without the setting a
    temporary one is made in local mode, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="refloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Survives the loss of an executor, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for costly work on rows that a few input splits hold.

    Tables with more splits than cores, that is all large ones, aren't shuffled.
    ``df`` should be no more than a scan with projections and filters.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
