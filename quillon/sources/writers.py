"""Notes as Markdown files with headers, and files of other tools as notes.

A file is a row (file, content). As Spark's sinks don't name files, tasks write each note to a file of its name below the folder, which all executors share, and
a table beside the folder keeps the names; ``read_back`` opens what that table names, so no folder is listed and a write can be checked.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import slug
from quillon.storage import small_batches

#: Files of other tools that can be imported, by the name of the note that they become.
CONFIG_FILES = {
    "CLAUDE.md": "claude-md.md", ".cursorrules": "cursorrules.md", ".windsurfrules": "windsurfrules.md", "AGENTS.md": "agents-md.md", ".github/copilot-instructions.md": "copilot-instructions.md",
}
FOLDERS = {"decision": "decisions", "handoff": "sessions", "kaizen": "kaizen"}
#: Names that files have on disk as well; no folder ends like a note, so none is the folder of another.
_PLAIN = re.compile(r"(?:(?![.])[A-Za-z0-9_. -]+(?<![.]md)/)*(?![.])[A-Za-z0-9_. -]+[.]md\Z")
#: Files that a task reads, contents that are handed to Python at once, and bytes that come back at once.
FILES, BATCH, BYTES = 5000, 64, 4 << 20


def _quoted(x: Column) -> Column:
    """A header's value in quotes; line breaks become blanks."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " "), r'(["\\])', r"\\$1"), F.lit('"'))


def plain_title(content: Column) -> Column:
    """A file's content with its title as it was before it was quoted, still between quotes; all else stays."""
    title = F.regexp_extract(content, r'^---\ntitle: "((?:[^"\\\n]|\\.)*+)"\n', 1)
    rest = F.substr(content, F.length(title) + 13)
    return F.when(content.startswith('---\ntitle: "'), F.concat(F.lit('---\ntitle: "'), F.regexp_replace(title, r'\\(["\\])', "$1"), rest)).otherwise(content)


def markdown(notes: DataFrame) -> DataFrame:
    """(file, content) of notes (path, title, content_type, tags, text). Notes without a path are named by type, day and title (``day`` is a column then)."""
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("  - "), t)), "\n")
    head = F.concat(F.lit("---\ntitle: "), _quoted(F.col("title")), F.lit("\ncontent_type: "), F.coalesce("content_type", F.lit("note")), F.when(tags != "", F.concat(F.lit("\ntags:\n"), tags)).otherwise(""), F.lit("\n---\n\n"))
    folder = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("content_type")), F.lit("notes"))
    day = F.date_format("day", "yyyy-MM-dd") if "day" in notes.columns else F.lit("undated")
    named = F.concat(folder, F.lit("/"), day, F.lit("-"), F.substring(slug(F.coalesce("title", F.lit("untitled"))), 1, 60), F.lit(".md"))
    return notes.select(F.coalesce("path", named).alias("file"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))


def place(file: str | None) -> str:
    """Where a file lies below the folder: at its own name, if that is a plain one of a note; else below ``%`` by a hash."""
    if file is not None and _PLAIN.match(file) and max(map(len, file.split("/"))) <= 200 and len(file) <= 1000:
        return file
    return "%/" + ("none" if file is None else hashlib.sha256(file.encode(errors="surrogatepass")).hexdigest())


def _base(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _names(folder: str) -> str:
    return folder.rstrip("/") + ".names"


def write(files: DataFrame, folder: str) -> None:
    """Of rows that repeat a file one is written; what another write has put there under the same name goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _base(folder)
        known: set[str] = set()
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                at = f"{base}/{place(file.as_py())}"
                parent = posixpath.dirname(at)
                if parent not in known:
                    system.create_dir(parent, recursive=True)
                    known.add(parent)
                # other attempts of a task write elsewhere, and a file is there whole or not at all
                new = f"{parent}/.{uuid.uuid4().hex}"
                with system.open_output_stream(new, compression=None) as out:
                    out.write(content.as_buffer() or b"")
                system.move(new, at)
            yield batch.select(["file"])

    once = files.groupBy("file").agg(F.max("content").alias("content")).select("file", F.col("content").cast("binary").alias("content"))
    with small_batches(files.sparkSession, BATCH):
        once.mapInArrow(run, "file string").write.mode("append").parquet(_names(folder))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of all files that were written to the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _base(folder)
        for batch in batches:
            names, contents, size = [], [], 0
            for file in batch.column("file").to_pylist():
                with system.open_input_stream(f"{base}/{place(file)}", compression=None) as into:
                    contents.append(into.read())
                names.append(file)
                size += len(contents[-1])
                if size >= BYTES:
                    yield _rows(names, contents)
                    names, contents, size = [], [], 0
            yield _rows(names, contents)

    names = spark.read.schema("file string").parquet(_names(folder)).distinct()
    names = names.repartition(max(1, math.ceil(names.count() / FILES)))
    return names.mapInArrow(run, "file string, content binary").select("file", F.col("content").cast("string").alias("content"))


def _rows(names: list[str | None], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])


def imports(files: DataFrame, done: DataFrame, root: str, everywhere: bool = False) -> DataFrame:
    """(path, content, provenance_source, provenance_hash) of known files of other tools (path, content) as notes below ``imports/``.

    Only those in the root folder itself count, or anywhere if ``everywhere`` (but in hidden folders and those of packages). What ``done`` (path, provenance_hash) has
    with the same hash is left out.
    """
    path = F.col("path")
    known = F.create_map(*[F.lit(x) for kv in CONFIG_FILES.items() for x in kv])
    relative = F.regexp_replace(path, f"^{root.rstrip('/')}/", "") if root else path
    rows = files.withColumn("relative", relative)
    if everywhere:
        skip = F.exists(F.split("relative", "/"), lambda p: (p.startswith(".") & ~p.isin(".github", ".cursorrules", ".windsurfrules")) | p.isin("node_modules", "vendor", "__pycache__"))
        name = F.coalesce(F.nullif(F.regexp_extract("relative", r"(?:^|/)(\.github/[^/]+)$", 1), F.lit("")), F.regexp_extract("relative", r"([^/]*)$", 1))
        rows = rows.where(~skip).withColumn("name", name)
    else:
        rows = rows.withColumn("name", F.col("relative"))
    place = F.regexp_extract("relative", r"^(.*)/", 1)
    note = F.concat(F.lit("imports/"), F.when((place != "") & ~F.col("name").startswith(".github/"), F.concat(slug(place), F.lit("-"))).otherwise(""), known[F.col("name")])
    found = rows.where(F.map_contains_key(known, F.col("name"))).select(note.alias("path"), "content", path.alias("provenance_source"), F.sha2(F.col("content").cast("binary"), 256).alias("provenance_hash"))
    return found.join(done.select("path", "provenance_hash"), ["path", "provenance_hash"], "left_anti")
