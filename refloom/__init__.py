"""refloom: bibliographic data quality on Spark DataFrames.

The names below are loaded when first used, so workers that need a single
module import no more than that.
"""

from importlib import import_module

__version__ = "0.1.0"

_PUBLIC = {
    "validate": "refloom.plans.workflow", "curate": "refloom.plans.workflow", "polish": "refloom.plans.workflow",
    "parse_files": "refloom.sources.bibtex", "read_entries": "refloom.sources.bibtex", "read_bib_files": "refloom.sources.bibtex", "file_texts": "refloom.sources.bibtex", "register": "refloom.sources.bibtex",
    "list_files": "refloom.sources.discovery", "bib_files": "refloom.sources.discovery", "tex_files": "refloom.sources.discovery", "corresponding_bib": "refloom.sources.discovery",
    "citations": "refloom.operators.citations", "missing": "refloom.operators.citations", "used_entries": "refloom.operators.citations", "rewrite_citations": "refloom.operators.citations",
    "field_transform": "refloom.operators.repairs", "walk_fields": "refloom.operators.repairs", "uncomment": "refloom.operators.repairs",
    "synchronize": "refloom.operators.dedup", "consolidate_dois": "refloom.operators.dedup", "consolidate_titles": "refloom.operators.dedup", "drop_cross_file": "refloom.operators.dedup",
    "sanitize": "refloom.operators.keys", "standardize": "refloom.operators.keys", "unpack": "refloom.operators.packed_fields",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(name)
