"""Markdown folders as tables: the walk, ignore rules, frontmatter and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are no notes; more can be given.
SKIP_FOLDERS = (".git", "node_modules", ".smart-env", ".obsidian", ".logseq", ".claude", ".trash", "_PRIVATE")
SKIP_FILES = ("CLAUDE.md",)


def walk(spark: SparkSession, folder: str, ignore: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, modified, content_hash) of every Markdown file below ``folder`` outside skipped and ignored places.

    Spark's file sources follow links and don't tell them; a path that isn't below the folder when it is listed is left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = re.escape(folder.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^.*?{root}/", "")
    files = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").cast("double").alias("modified"))
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_FOLDERS + skip))) | F.element_at(parts, -1).isin(*SKIP_FILES) | F.col("path").startswith("/") | F.array_contains(parts, "..")
    return files.where(~skipped & ~ignored(F.col("path"), ignore or [])).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: * and ? within a folder, and classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1 : j].replace("\\", "\\\\").replace("!", "^", 1) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Rules as in ignore files: comments, a trailing slash for folders, a slash inside for whole paths or any ending of them."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        if p.endswith("/"):
            out = out | path.rlike(f"(^|/){glob_regex(p.strip('/'))}/")
        elif "/" in p:
            out = out | path.rlike(f"(^|/){glob_regex(p.lstrip('/'))}$")
        else:
            out = out | path.rlike(f"(^|/){glob_regex(p)}$")
    return out


def frontmatter(files: DataFrame) -> DataFrame:
    """Adds title, tags, domain, workstream, agent, content_type, review_by and body; a text without a header is all body."""
    block = F.regexp_extract("content", r"\A---\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace("content", r"\A---\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")

    def value(*names: str) -> Column:
        found = [F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{n}:[ \t]*(.*)$", 1), F.lit(" \t\r\"'")), F.lit("")) for n in names]
        return F.coalesce(*found)

    inline = F.regexp_extract(block, r"(?m)^tags:[ \t]*\[(.*)\]", 1)
    listed = F.regexp_extract(block, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]*.*\n?)+)", 1)
    trim = lambda t: F.btrim(t, F.lit(" \t\r\"'"))
    tags = F.when(inline != "", F.transform(F.split(inline, ","), trim)).when(
        listed != "", F.transform(F.filter(F.split(listed, "\n"), lambda x: F.btrim(x) != ""), lambda x: trim(F.regexp_replace(x, r"^[ \t]*-", "")))
    ).otherwise(F.array().cast("array<string>"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    return files.select(
        "*", F.coalesce(value("title"), name).alias("title"), F.filter(tags, lambda t: t != "").alias("tags"), value("domain").alias("domain"),
        value("workstream").alias("workstream"), value("agent").alias("agent"), value("content_type").alias("explicit_type"),
        value("review_by", "review-by").alias("review_by"), value("trust_state").alias("trust_state"), body.alias("body"),
    )
