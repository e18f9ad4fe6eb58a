"""Writing files back (K2-K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.sources.bibtex import put_file


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """K4: ``(project, file, content)`` of the later texts that differ from the earlier ones or are new."""
    b = before.select("project", "file", F.col("content").cast("string").alias("_old"))
    j = after.select("project", "file", "content").join(b, ["project", "file"], "left")
    return j.where(F.col("_old").isNull() | (F.col("_old") != F.col("content"))).select("project", "file", "content")


def write_files(texts: DataFrame, root: str, by_project: bool = False) -> None:
    """``(project, file, content)`` as files under ``root``/file, with ``by_project`` under ``root``/project/file.

    Each is written beside its place and moved there. Runs in the tasks, so ``root``
    must be a folder that all executors share, or the URI of a file system that
    pyarrow knows. Files that no row names stay; a task that is repeated writes the same bytes again.
    """

    def write(rows) -> None:
        for r in rows:
            put_file(root, f"{r['project']}/{r['file']}" if by_project else r["file"], r["content"])

    texts.select("project", "file", "content").foreachPartition(write)


def create_backup(files: DataFrame, root: str, by_project: bool = False) -> DataFrame:
    """K3: a copy of each file of ``(project, file, content)`` as <name>.backup beside it, byte for byte; gives ``(project, file)`` of the copies."""
    copies = files.select("project", F.concat("file", F.lit(".backup")).alias("file"), "content")
    write_files(copies, root, by_project)
    return copies.select("project", "file")


def save_table(df: DataFrame, path: str) -> None:
    """A table as Parquet, laid out by project so that one project can be read alone."""
    df.repartition("project").sortWithinPartitions("file").write.mode("overwrite").partitionBy("project").parquet(path)
