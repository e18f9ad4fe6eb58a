"""Command line: validate, curate or polish a project folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from refloom import schema
from refloom.plans import workflow
from refloom.runtime import cut_lineage
from refloom.sources import discovery, sinks
from refloom.sources.journals import read_journals


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refloom", description="Check and repair bibliographies.")
    p.add_argument("action", nargs="?", default="polish", choices=("validate", "curate", "polish"))
    p.add_argument("root", nargs="?", default=".", help="project folder")
    p.add_argument("--no-backup", action="store_true")
    p.add_argument("--yes", "-y", action="store_true", help="don't ask")
    p.add_argument("--preserve-keys", action="store_true")
    p.add_argument("--no-enrich", action="store_true")
    p.add_argument("--journals", nargs="*", default=(), metavar="CSV", help="lists of full and short journal names, later ones first; other names are shortened word by word")
    p.add_argument("--metadata", metavar="TABLE", help="JSON lines or Parquet with columns doi and fields")
    p.add_argument("--broad-citations", action="store_true", help="stars, optional arguments and capitals count as citations too")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all is well, 1 if validation failed or there was nothing to do."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("refloom").getOrCreate()
    # Read once: the files are written over later.
    listing = cut_lineage(discovery.list_files(spark, os.path.abspath(a.root)))
    bibs, tex = discovery.bib_files(listing), discovery.tex_files(listing)
    tex = tex.withColumn("content", tex["content"].cast("string"))
    if bibs.isEmpty():
        print("no bib files")
        return 1
    strict = not a.broad_citations
    if a.action == "validate":
        return _show(workflow.validate(bibs, tex, strict))
    if not a.yes and input("Files will be rewritten. Go on? [y/N] ").strip().lower() not in ("y", "yes"):
        return 1
    if a.action == "polish":
        _show(workflow.validate(bibs, tex, strict))
    journals = read_journals(spark, *a.journals) if a.journals else spark.createDataFrame([], schema.JOURNALS)
    enrich = not (a.no_enrich or os.environ.get("REFLOOM_NO_ENRICH"))
    metadata = _metadata(spark, a.metadata) if a.metadata and enrich else None
    done = workflow.curate(bibs, tex, journals=journals, metadata=metadata, preserve_keys=a.preserve_keys, enrich=enrich, strict=strict)
    # All is computed before a file is touched.
    new_bibs, new_tex = cut_lineage(done.texts()), cut_lineage(done.tex)
    for r in done.warnings.toLocalIterator():
        print(r["message"])
    if not a.no_backup:
        sinks.create_backup(listing, a.root).count()
    sinks.write_files(sinks.changed_files(bibs, new_bibs), a.root)
    sinks.write_files(sinks.changed_files(tex, new_tex), a.root)
    if a.action == "polish":
        _show(workflow.validate(new_bibs, new_tex, strict))
    return 0


def _metadata(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema("doi string, fields map<string,string>").json(path)


def _show(result) -> int:
    found, verdict, summary = result
    for r in found.toLocalIterator():
        print(r["message"])
    for r in summary.collect():
        print(f"Files checked: {r['n_tex']} tex, {r['n_bib']} bib; unique keys: {r['n_keys']}; citations: {r['n_cited']}")
    return int(not all(r["ok"] for r in verdict.collect()))


if __name__ == "__main__":
    sys.exit(main())
