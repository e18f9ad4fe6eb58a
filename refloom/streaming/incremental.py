"""Files that keep arriving: parsing and scalar repairs as a stream of files (beyond the original's scope)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.plans.workflow import repaired
from refloom.sources import bibtex


def arriving_files(spark: SparkSession, path: str, project: str = "default", files_per_batch: int = 1000) -> DataFrame:
    """A stream of ``(project, file, content)`` from a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.bib").load(path)
    return raw.select(F.lit(project).alias("project"), F.col("path").alias("file"), "content")


def curate_stream(files: DataFrame, target: str, checkpoint: str, journals: DataFrame | None = None, on_batch: Callable[[DataFrame], None] | None = None):
    """Starts a query that appends the repaired entries of new files to a Parquet table; a batch that is repeated writes its own folder again."""

    def batch(df: DataFrame, number: int) -> None:
        entries = repaired(bibtex.read_entries(df, decode=True), journals).drop("fixes")
        entries.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(entries)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
