"""Repairs over entries, with counters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions import repair as R
from refloom.functions.latex import decode as latex_decode
from refloom.functions.normalize import present
from refloom.sources.bibtex import parse_blocks


def walk_fields(entries: DataFrame) -> DataFrame:
    """``(project, file, pos, field, value)``, the pseudo-fields ID and ENTRYTYPE included."""
    pseudo = F.create_map(F.lit("ID"), F.coalesce("key_raw", F.lit("")), F.lit("ENTRYTYPE"), F.coalesce("entry_type", F.lit("")))
    return entries.where("fields IS NOT NULL").select("project", "file", "pos", F.explode(F.map_concat("fields", pseudo)).alias("field", "value"))


def field_transform(entries: DataFrame, f: Callable[[Column], Column], names: tuple[str, ...] | None = None, keys: bool = True) -> DataFrame:
    """``f`` applied to every field value (with ``names`` only to these), and ``changed``, how many values that changed.

    ``f`` maps a Column to a Column; one that gives NULL changes nothing. With
    ``keys`` the ID and the entry type are values too. Errors in ``f`` propagate.
    """
    new_value = lambda k, v: F.coalesce(f(v), v) if names is None else F.when(k.isin(*names), F.coalesce(f(v), v)).otherwise(v)
    step = entries.withColumn("_new", F.transform_values("fields", new_value))
    changed = F.size(F.filter(F.map_values(F.map_zip_with("fields", "_new", lambda k, a, b: ~a.eqNullSafe(b))), lambda x: x))
    changed = F.when(F.col("fields").isNull(), 0).otherwise(changed)
    out = step
    if keys and names is None:
        for c in ("key_raw", "entry_type"):
            out = out.withColumn(f"_{c}", F.coalesce(f(F.col(c)), F.col(c)))
            changed = changed + F.when(F.col(f"_{c}").eqNullSafe(F.col(c)), 0).otherwise(1)
    out = out.withColumn("changed", changed).withColumn("fields", F.col("_new")).drop("_new")
    if keys and names is None:
        for c in ("key_raw", "entry_type"):
            out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out


def python_transform(entries: DataFrame, f: Callable[[str], str | None], names: tuple[str, ...] | None = None) -> DataFrame:
    """``field_transform`` for a Python function of one value, in Arrow batches; only entries with the fields travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = b.column(b.schema.get_field_index("fields")).to_pylist()
            out, n = [], []
            for m in maps:
                if m is None:
                    out.append(None)
                    n.append(0)
                    continue
                new = [(k, v if v is None or (names is not None and k not in names) or (r := f(v)) is None else r) for k, v in m]
                out.append(new)
                n.append(sum(a != c for (_, a), (_, c) in zip(m, new)))
            at = b.schema.get_field_index
            columns = [pa.array(out, pa.map_(pa.string(), pa.string())) if name == "fields" else b.column(at(name)) for name in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32())], names=[*b.schema.names, "changed"])

    return entries.mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField("changed", T.IntegerType())]))


def fix_files(files: DataFrame) -> DataFrame:
    """F1, F2 on the text of files: ``(project, file, content, changed)``; bytes that are no UTF-8 are always repaired."""
    text = R.valid_text(F.col("content"))
    fixed = R.fix_unicode(R.fix_broken_accents(text))
    return files.select("project", "file", fixed.alias("content"), (fixed != text).alias("changed"))


def fix_html(entries: DataFrame) -> DataFrame:
    """F3 on every field."""
    return field_transform(entries, R.fix_html, keys=False)


def fix_percent(entries: DataFrame) -> DataFrame:
    """F4 on every field, ID and type included."""
    return field_transform(entries, R.escape_percent)


def fix_authors(entries: DataFrame) -> DataFrame:
    """F5 on the author field."""
    return field_transform(entries, R.fix_author, ("author",))


def remove_accents(entries: DataFrame) -> DataFrame:
    """F6 on the fields that hold names and titles."""
    return python_transform(entries, R.plain_letters, R.NAME_FIELDS)


def _first_spelling(entries: DataFrame, spellings: tuple[str, ...], f: Callable[[Column], Column]) -> DataFrame:
    m = F.col("fields")
    name = F.coalesce(*[F.when(m[s].isNotNull(), F.lit(s)) for s in spellings])
    old = present(m[name])
    new = f(old)
    changed = F.when(old.isNull() | new.eqNullSafe(old), 0).otherwise(1)
    fields = F.when(changed == 1, F.transform_values(m, lambda k, v: F.when(k == name, new).otherwise(v))).otherwise(m)
    return entries.withColumns({"changed": changed, "fields": fields})


def fix_years(entries: DataFrame) -> DataFrame:
    """F8 on the first spelling of year an entry has."""
    return _first_spelling(entries, ("year", "Year", "YEAR"), R.fix_year)


def fix_months(entries: DataFrame) -> DataFrame:
    """F9 on the first spelling of month an entry has."""
    return _first_spelling(entries, ("month", "Month", "MONTH"), R.fix_month)


def drop_fields(entries: DataFrame) -> DataFrame:
    """entries without the fields the formatter drops; ``changed`` counts them."""
    kept = R.drop_fields(F.col("fields"))
    return entries.withColumns({"changed": F.coalesce(F.size("fields") - F.size(kept), F.lit(0)), "fields": kept, "n_fields": F.size(kept) + 2})


def uncomment(entries: DataFrame, decode: bool = False) -> DataFrame:
    """``(project, file, pos, entry_type, key_raw, fields, raw)`` of the commented entries that can be read once unwrapped.

    With ``decode`` LaTeX accents and escapes in values become plain characters, as in ``parse_files``.
    """
    return opened(entries.where("is_commented"), decode).where("changed = 1").select("project", "file", "pos", "entry_type", "key_raw", "fields", "raw")


def opened(commented: DataFrame, decode: bool) -> DataFrame:
    """Commented entries, the readable ones as entries; ``changed`` is 1 for these. Rows change where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist(maps_as_pydicts="strict")
            for r in rows:
                text = R.repair_commented(r["raw"])
                first = next(parse_blocks(text), None) if text else None
                r["changed"] = int(bool(first) and first["kind"] == "entry" and not first["error"])
                if r["changed"]:
                    fields = {k: latex_decode(v) for k, v in first["fields"].items()} if decode else first["fields"]
                    key = unicodedata.normalize("NFC", first["key_raw"]) or None
                    r |= {"entry_type": first["entry_type"], "key_raw": first["key_raw"], "key": key, "fields": fields, "n_fields": len(fields) + 2, "is_commented": False, "raw": text}
                r["fields"] = r["fields"] and list(r["fields"].items())
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*b.schema, pa.field("changed", pa.int32())]))

    # The batch schema follows the rows', so other columns travel along.
    return commented.mapInArrow(run, T.StructType([*commented.schema.fields, T.StructField("changed", T.IntegerType())]))


def with_uncommented(entries: DataFrame, decode: bool = False) -> DataFrame:
    """Entries with the readable commented ones in their own places; ``changed`` is 1 for these. Nothing is shuffled for it."""
    return entries.where("NOT is_commented").withColumn("changed", F.lit(0)).unionByName(opened(entries.where("is_commented"), decode))


def count_changes(df: DataFrame) -> DataFrame:
    """``(project, file, fixes)``."""
    return df.groupBy("project", "file").agg(F.sum("changed").cast("long").alias("fixes"))
