"""BibTeX text to rows and back.

The parser is a single forward scan over balanced braces. It never fails: a
block that can't be read comes out as a row with an ``error``, and the scan goes
on at the next line that opens a block. Files are parsed where they are read, in
Arrow batches; a file is the unit of work.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from refloom import schema
from refloom.functions.latex import decode as latex_decode
from refloom.functions.normalize import with_nfc
from refloom.runtime import spread

_OPEN = re.compile(r"@[ \t]*([A-Za-z][\w-]*)[ \t\r\n]*([{(])")
_NEXT = re.compile(r"^[ \t]*@[ \t]*[A-Za-z]+[ \t]*[{(]", re.MULTILINE)
_NAME = re.compile(r"[\s,]*([^\s=,{}\"#%'()]+)\s*=\s*")
_WRAPPED = re.compile(r"@[ \t]*comment[ \t]*\{[ \t\r\n]*(@[ \t]*\w+[ \t]*\{)", re.IGNORECASE)


def decode_text(content: bytes | None) -> str:
    """File bytes as text: the byte order mark decides, then UTF-8, then the Western one-byte encoding."""
    if not content:
        return ""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace").replace("\r\n", "\n").replace("\r", "\n")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("cp1252", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _close(text: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``, or -1. An escaped brace still counts, as for TeX."""
    opens, closes = text[at], {"{": "}", "(": ")"}[text[at]]
    depth = 0
    for m in re.compile(r"[{}()]").finditer(text, at):
        c = m[0]
        if c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if depth == 0:
                return m.start()
    return -1


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """The value that begins at ``at`` and where it ends; pieces joined by # become one."""
    parts = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise ValueError("value missing")
        if text[at] == "{":
            end = _close(text, at)
            if end < 0:
                raise ValueError("brace not closed")
            parts.append(text[at + 1 : end])
            at = end + 1
        elif text[at] == '"':
            depth, end = 0, at + 1
            while end < len(text) and not (text[end] == '"' and depth == 0 and text[end - 1] != "\\"):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            if end >= len(text):
                raise ValueError("quote not closed")
            parts.append(text[at + 1 : end])
            at = end + 1
        else:
            m = re.compile(r"[^\s,#{}\"]+").match(text, at)
            if not m:
                raise ValueError("value missing")
            parts.append(strings.get(m[0].lower(), m[0]))
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            return "".join(parts), at
        at = m.end()


def parse_entry(body: str, strings: dict[str, str]) -> tuple[str, dict[str, str]]:
    """Key and fields of the text between an entry's brackets. The last of equally named fields wins."""
    head, comma, rest = body.partition(",")
    if "=" in head or "{" in head or '"' in head:
        raise ValueError("key missing")
    fields: dict[str, str] = {}
    at = 0
    while comma:
        m = _NAME.match(rest, at)
        if not m:
            if rest[at:].strip(" \t\r\n,"):
                raise ValueError(f"no field at: {rest[at:].strip()[:40]}")
            break
        value, at = _value(rest, m.end(), strings)
        fields[m[1]] = value
        if rest[at:].strip() and rest[at:].lstrip()[0] != ",":
            raise ValueError("comma missing")
    return head.strip(), fields


def parse_blocks(text: str) -> Iterator[dict]:
    """All blocks of a text in order, as dicts of the columns of ``schema.BLOCKS``.

    ``at`` counts the readable and the commented entries alone; other blocks have
    the number of the next of these. What stands between blocks is a block of kind "text".
    """
    kept = 0
    for pos, row in enumerate(_scan(text)):
        yield row | {"pos": pos, "at": kept}
        kept += row["kind"] == "commented" or (row["kind"] == "entry" and not row["error"])


def _scan(text: str) -> Iterator[dict]:
    strings: dict[str, str] = {}
    at = 0
    while True:
        m = _OPEN.search(text, at)
        loose = text[at : m.start() if m else len(text)].strip()
        if loose:
            yield {"kind": "text", "entry_type": None, "key_raw": None, "fields": None, "error": None, "raw": loose}
        if not m:
            return
        kind = m[1].lower()
        end = _close(text, m.end() - 1)
        row = {"kind": "entry", "entry_type": m[1], "key_raw": None, "fields": None, "error": None}
        if end < 0:
            after = _NEXT.search(text, m.end())
            end = after.start() if after else len(text)
            # A wrapper that never closes must not swallow what it wraps twice.
            if kind == "comment" and (w := _WRAPPED.match(text, m.start())):
                after = _NEXT.search(text, w.end())
                end = after.start() if after else len(text)
            row["raw"], row["error"], at = text[m.start() : end].rstrip(), "brackets not closed", end
        else:
            row["raw"], at = text[m.start() : end + 1], end + 1
        inner = text[m.end() : end]
        if kind == "comment":
            row["kind"] = "commented" if _WRAPPED.match(row["raw"]) else "comment"
            if row["kind"] == "commented":
                row["entry_type"] = re.match(r"@\s*(\w+)", _WRAPPED.match(row["raw"])[1])[1]
        elif kind == "preamble":
            row["kind"], row["entry_type"] = "preamble", None
        elif kind == "string":
            row["kind"], row["entry_type"] = "string", None
            try:
                if s := _NAME.match(inner):
                    strings[s[1].lower()] = _value(inner, s.end(), strings)[0]
            except ValueError as e:
                row["error"] = str(e)
        elif not row["error"]:
            try:
                row["key_raw"], row["fields"] = parse_entry(inner, strings)
            except ValueError as e:
                row["error"] = str(e)
        yield row


def _nfc(key: str | None) -> str | None:
    return unicodedata.normalize("NFC", key) if key else None


def parse_files(files: DataFrame, decode: bool = False) -> DataFrame:
    """``(project, file, pos, at, kind, entry_type, key_raw, fields, raw, error)`` of all blocks of ``(project, file, content)``.

    ``pos`` counts a file's blocks from 0, ``at`` its entries. NULL and empty contents have none. With
    ``decode`` LaTeX accents and escapes in values become plain characters.
    """
    parts = schema.BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("pos", "at", "kind", "entry_type", "key_raw", "fields", "raw", "error")
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # a batch out for each file bounds memory by the largest file
                project, file, content = (batch.column(c)[i].as_py() for c in range(3))
                rows = list(parse_blocks(content if isinstance(content, str) else decode_text(content)))
                for r in rows if decode else ():
                    r["fields"] = r["fields"] and {k: latex_decode(v) for k, v in r["fields"].items()}
                cells = [pa.array([list(r[c].items()) if c == "fields" and r[c] is not None else r[c] for r in rows], t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([project] * len(rows), pa.string()), pa.array([file] * len(rows), pa.string()), *cells], names=["project", "file", *columns])

    return spread(files.select("project", "file", "content")).mapInArrow(run, f"project string, file string, {parts}")


_KEPT = "(kind = 'entry' AND error IS NULL) OR kind = 'commented'"


def entries(blocks: DataFrame) -> DataFrame:
    """Blocks as the entries table: readable entries and commented ones; ``pos`` counts these from 0 in a file."""
    own = lambda c: F.when(F.col("kind") == "entry", c)
    kept = with_nfc(blocks.where(_KEPT).withColumn("key_raw", own(F.col("key_raw"))), "key_raw", "key")
    return kept.select(
        "project",
        "file",
        F.col("at").alias("pos"),
        "entry_type",
        "key_raw",
        "key",
        "fields",
        own(F.size("fields") + 2).alias("n_fields"),
        (F.col("kind") == "commented").alias("is_commented"),
        "raw",
    )


def others(blocks: DataFrame) -> DataFrame:
    """``(project, file, at, pos, raw)`` of all that ``entries`` leaves out: strings, preambles, comments, loose text, unreadable entries."""
    return blocks.where(f"NOT ({_KEPT})").select("project", "file", "at", "pos", "raw")


def read_entries(files: DataFrame, decode: bool = False) -> DataFrame:
    """The entries of ``(project, file, content)``."""
    return entries(parse_files(files, decode))


def read_bib_files(spark: SparkSession, *paths: str, project: str = "default") -> DataFrame:
    """``(project, file, content)`` of files on any Hadoop file system; ``file`` is the path."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return raw.select(F.lit(project).alias("project"), F.col("path").alias("file"), "content")


# Writing -------------------------------------------------------------------


def entry_text(entry_type, key, fields):
    """K1: an entry as text: two blanks of indent, ``FIELD_ORDER`` first, then the other fields by name."""
    rank = F.create_map(*[x for i, f in enumerate(schema.FIELD_ORDER) for x in (F.lit(f), F.lit(i))])
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(rank[F.lower(e["key"])], F.lit(99)).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    lines = F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit("  "), p["k"], F.lit(" = {"), F.coalesce(p["v"], F.lit("")), F.lit("}")))
    head = F.concat(F.lit("@"), F.coalesce(entry_type, F.lit("misc")), F.lit("{"), F.coalesce(key, F.lit("")))
    return F.concat(F.concat_ws(",\n", F.concat(F.array(head), lines)), F.lit("\n}"))


def file_texts(table: DataFrame, rest: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``(project, file, content)``: each file's entries as text, in order of position; commented entries keep their own text.

    ``rest`` holds the blocks of other kinds (see ``others``), which keep their text
    and their place before the entry they preceded. With ``files`` every file of it
    comes out, empty where nothing is left of it. A file is written whole by one
    task, so its entries meet in one group; a file's size bounds that group.
    """
    text = F.when(F.col("is_commented"), F.col("raw")).otherwise(entry_text(F.col("entry_type"), F.col("key_raw"), F.col("fields")))
    rows = table.select("project", "file", F.struct(F.col("pos").alias("at"), F.lit(1).alias("own"), F.col("pos").alias("pos"), text.alias("t")).alias("b"))
    if rest is not None:
        rows = rows.unionByName(rest.select("project", "file", F.struct("at", F.lit(0).alias("own"), "pos", F.col("raw").alias("t")).alias("b")))
    parts = F.array_sort(F.collect_list("b"))
    texts = rows.groupBy("project", "file").agg(F.concat(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n"), F.lit("\n")).alias("content"))
    if files is None:
        return texts
    return files.select("project", "file").join(texts, ["project", "file"], "left").select("project", "file", F.coalesce("content", F.lit("")).alias("content"))


#: A split of the reader holds files of about so many bytes.
SPLIT_BYTES = 32 << 20


class _Split(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    path = re.sub("^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.project = options["path"], options.get("project", "default")

    def partitions(self):
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True, recursive=True))
        out, room = [], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".bib")), key=lambda f: f.path):
            if not out or room < f.size:
                out.append(_Split([]))
                room = SPLIT_BYTES
            out[-1].paths.append(f.path)
            room -= f.size
        return out or [_Split([])]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                text = decode_text(f.read())
            for r in parse_blocks(text):
                if (r["kind"] == "entry" and not r["error"]) or r["kind"] == "commented":
                    key = r["key_raw"]
                    yield (self.project, path, r["at"], r["entry_type"], key, _nfc(key), r["fields"], None if r["fields"] is None else len(r["fields"]) + 2, r["kind"] == "commented", r["raw"])


def put_file(root: str, name: str, content: str | bytes | None) -> None:
    """A file under ``root``, written beside its place and moved there, so readers never see a part of it."""
    fs, base = _filesystem(root)
    target = f"{base}/{name}"
    fs.create_dir(os.path.dirname(target), recursive=True)
    with fs.open_output_stream(f"{target}.part") as f:
        f.write(content.encode() if isinstance(content, str) else content or b"")
    fs.move(f"{target}.part", target)


class _Writer(DataSourceWriter):
    """One file under path/project for each row of ``file_texts``."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows):
        for r in rows:
            # Rows of entries may lie in several tasks, none of which has a whole file.
            if "content" not in r:
                raise ValueError("the format bibtex writes (project, file, content), one row a file: write file_texts(entries)")
            put_file(self.path, f"{r['project']}/{r['file'].lstrip('/')}", r["content"])
        return WriterCommitMessage()


class BibtexSource(DataSource):
    """``spark.read.format("bibtex").load(path)`` gives entries; ``file_texts(entries).write.format("bibtex")`` writes files.

    ``path`` is a folder or file on a file system that the workers reach: a mounted folder or a URI that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return schema.ENTRIES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format "bibtex" known to a session."""
    spark.dataSource.register(BibtexSource)
