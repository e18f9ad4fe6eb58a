"""Which files of a project count (S4-S6, J9), as filters and joins over a listing of files.

A listing holds ``(project, file)``, file names relative to the project's folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, project: str = "default") -> DataFrame:
    """``(project, file, content)`` of the .tex and .bib files in a folder and its sections folder."""
    paths = [f"{root}/*.tex", f"{root}/*.bib", f"{root}/sections/*.tex", f"{root}/sections/*.bib"]
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    jvm = spark._jvm
    kept = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            kept.append(p)
    if not kept:
        return spark.createDataFrame([], "project string, file string, content binary")
    in_sections = F.regexp_extract("path", r"/(sections/[^/]+)$", 1)
    name = F.when(in_sections != "", in_sections).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return reader.load(kept).select(F.lit(project).alias("project"), name.alias("file"), "content")


def stem(file: Column) -> Column:
    """A file's name without its last suffix and without folders."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.[^.]*$", "")


def folder(file: Column) -> Column:
    return F.regexp_extract(file, r"^(.*/)?[^/]*$", 1)


def tex_files(listing: DataFrame) -> DataFrame:
    """``sections/*.tex`` and ``main.tex``; no other folders, no other files of the root."""
    f = F.col("file")
    return listing.where(f.rlike(r"^sections/[^/]+\.tex$") | (f == "main.tex"))


def bib_files(listing: DataFrame) -> DataFrame:
    """``sections/*.bib`` with ``references.bib`` and ``bibliography.bib``; other files of the root only if there are none of these."""
    f = F.col("file")
    known = f.rlike(r"^sections/[^/]+\.bib$") | f.isin("references.bib", "bibliography.bib")
    has_known = F.max(F.coalesce(known, F.lit(False))).over(Window.partitionBy("project"))
    return listing.where(f.rlike(r"^(?:sections/)?[^/]+\.bib$")).withColumn("_known", has_known).where(known | ~F.col("_known")).drop("_known")


def corresponding_bib(tex: DataFrame, bibs: DataFrame) -> DataFrame:
    """``(project, file, bib)``: the .bib of each .tex, NULL if it has none.

    A .bib with the same stem in the same folder comes first. For main.tex follow
    references.bib, bibliography.bib and the first other .bib of its folder.
    """
    t = tex.select("project", "file", folder(F.col("file")).alias("dir"), stem(F.col("file")).alias("stem"))
    b = bibs.where("file LIKE '%.bib'").select("project", F.col("file").alias("bib"), folder(F.col("file")).alias("dir"), stem(F.col("file")).alias("bstem")).distinct()
    same = b.select("project", "dir", F.col("bstem").alias("stem"), F.col("bib").alias("same"))
    rank = F.when(F.col("bstem") == "references", 0).when(F.col("bstem") == "bibliography", 1).otherwise(2)
    spare = b.groupBy("project", "dir").agg(F.min(F.struct(rank.alias("r"), "bib"))["bib"].alias("spare"))
    out = t.join(same, ["project", "dir", "stem"], "left").join(spare, ["project", "dir"], "left")
    return out.select("project", "file", F.coalesce("same", F.when(F.col("stem") == "main", F.col("spare"))).alias("bib"))
