"""What models answered, as tables: JSON rescued from their texts, facts, entities and relations.

A model's answer is an input column. The objects in it are found by a scanner that keeps track of brackets and strings, so an object ends where its own
bracket closes, whatever stands behind it. Null answers and answers without a valid object give null, and no facts, nodes or edges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks in which a model thinks aloud.
THOUGHTS = re.compile(r"(?is)<think>.*?</think>|<reasoning>.*?</reasoning>")
_MARK = re.compile(r'["{}\[\]]')
#: Shortest fact, confidence where none in (0, 1] is given, and the relation from a note to what it names.
LEAST_FACT, SURE, MENTIONS = 10, 0.6, "mentions"


def _string_end(text: str, at: int) -> int:
    """Behind the quote that closes the string that begins at ``at``; the text's length if none does."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == '"':
            return i + 1
        else:
            i += 1
    return len(text)


def balanced(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the outermost bracketed objects, in order; one that is never closed is left out, and those within it count instead."""
    at = text.find("{")
    while at >= 0:
        open_, i, end = [], at, -1
        while i < len(text):
            m = _MARK.search(text, i)
            if m is None:
                break
            c, i = m[0], m.end()
            if c == '"':
                i = _string_end(text, m.start())
            elif c in "{[":
                open_.append(c)
            elif not open_ or open_.pop() != ("{" if c == "}" else "["):
                break
            elif not open_:
                end = i
                break
        if end > 0:
            yield at, end
        at = text.find("{", end if end > 0 else at + 1)


def _valid(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def rescued(answer: str | None) -> str | None:
    """The first valid JSON object of an answer, outside its thoughts if there is one there, else inside them."""
    if not answer:
        return None
    outside = THOUGHTS.sub("", answer).strip()
    for text in (outside, answer) if outside != answer else (answer,):
        if text.startswith("{") and _valid(text):
            return text
        for a, b in balanced(text):
            if _valid(text[a:b]):
                return text[a:b]
    return None


def rescue_json(answer: Column) -> Column:
    @F.pandas_udf("string")
    def run(answers: pd.Series) -> pd.Series:
        return answers.map(rescued)

    return run(answer)


def facts(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(source_path, fact_text, confidence) of answers (source_path, answer) that list facts; short ones go, and of equal ones of a note all but the surest."""
    shape = "struct<facts:array<struct<text:string,fact:string,confidence:double>>>"
    found = answers.select("source_path", F.explode(F.from_json(rescue_json(F.col(answer)), shape)["facts"]).alias("f"))
    text = F.btrim(F.coalesce("f.text", "f.fact"), F.lit(" \t\r\n"))
    sure = F.when((F.col("f.confidence") > 0) & (F.col("f.confidence") <= 1), F.col("f.confidence")).otherwise(SURE)
    return found.select("source_path", text.alias("fact_text"), sure.alias("confidence")).where(F.octet_length("fact_text") >= LEAST_FACT).groupBy("source_path", "fact_text").agg(F.max("confidence").alias("confidence"))


def without_facts(notes: DataFrame, known: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Notes (path, ...) that have no facts yet and, if ``tried`` (source_path) is kept, were not asked about before."""
    for done in (known, tried):
        if done is not None:
            notes = notes.join(done.select(F.col("source_path").alias("path")), "path", "left_anti")
    return notes


def add_facts(old: DataFrame, answers: DataFrame) -> DataFrame:
    """The next snapshot of facts (fact_id, fact_text, source_path, confidence): those of answers about notes that had none are added.

    Ids follow from note and text, so a run that is repeated adds nothing.
    """
    new = facts(answers.join(old.select("source_path").distinct(), "source_path", "left_anti"))
    return old.unionByName(new.withColumn("fact_id", F.xxhash64("source_path", "fact_text")).select(*old.columns))


def entities(answers: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of answers (path, answer): nodes (type, name), edges (source_type, source, target_type, target, rel).

    An edge counts only if the same answer lists both its ends; of nodes of one name the last listed is meant. Each note mentions what its answer lists.
    """
    shape = "struct<nodes:array<struct<type:string,name:string>>,edges:array<struct<source:string,target:string,relation:string>>>"
    read = answers.select("path", F.from_json(rescue_json(F.col(answer)), shape).alias("j")).where("j is not null")
    listed = read.select("path", F.posexplode("j.nodes").alias("at", "n")).where("n.name is not null and n.type is not null")
    nodes = listed.select("n.type", "n.name").distinct()
    named = listed.groupBy("path", F.col("n.name").alias("name")).agg(F.max_by("n.type", "at").alias("type"))
    wanted = read.select("path", F.explode("j.edges").alias("e")).select("path", "e.source", "e.target", F.coalesce("e.relation", F.lit("")).alias("rel"))
    ends = [named.select("path", F.col("name").alias(x), F.col("type").alias(f"{x}_type")) for x in ("source", "target")]
    met = wanted.join(ends[0], ["path", "source"]).join(ends[1], ["path", "target"]).select("source_type", "source", "target_type", "target", "rel")
    mentions = named.select(F.lit("note").alias("source_type"), F.col("path").alias("source"), F.col("type").alias("target_type"), F.col("name").alias("target"), F.lit(MENTIONS).alias("rel"))
    return nodes, met.unionByName(mentions).distinct()


def merge_entities(nodes: DataFrame, edges: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshots of a graph (nodes: type, name, note_id; edges: source_type, source, target_type, target, rel, weight) with what answers say.

    Nodes that are there keep their note; edges that are there keep their weight.
    """
    new_nodes, new_edges = entities(answers)
    added = new_nodes.join(nodes.select("type", "name"), ["type", "name"], "left_anti").withColumn("note_id", F.lit(None).cast("long"))
    key = ["source_type", "source", "target_type", "target", "rel"]
    more = new_edges.join(edges.select(*key), key, "left_anti").withColumn("weight", F.lit(1.0))
    return nodes.unionByName(added.select(*nodes.columns)), edges.unionByName(more.select(*edges.columns))


#: Titles and lines of a consolidation that was not filled in.
NO_TITLE, UNFILLED, UNFILLED_CONFLICT = "consolidated", ("fact 1", "fact 2"), "[describe contradiction"


def summary(output: Column) -> Column:
    """struct(title, facts, conflicts) of a consolidation in Markdown: the title of its header, and the bullets below "Key Facts" (or "Facts") and "Conflicts".

    A header stands between lines of ``---``; any other heading of the second or third level ends a section.
    """
    lines = F.transform(F.split(F.coalesce(output, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("header"), F.lit("").alias("section"), F.lit(NO_TITLE).alias("title"), none.alias("facts"), none.alias("conflicts"))

    def step(s: Column, x: Column) -> Column:
        low, rule = F.lower(x), x == "---"
        inside = s["header"] & ~rule
        section = F.when(low.rlike("^### (key )?facts"), "facts").when(low.startswith("### conflicts"), "conflicts").when(x.rlike("^#{2,3} "), "").otherwise(s["section"])
        bullet = F.when(x.startswith("- ") & ~rule & ~inside, F.substring(x, F.lit(3), F.length(x)))
        fact = (section == "facts") & bullet.isNotNull() & ~bullet.isin("", *UNFILLED)
        conflict = (section == "conflicts") & bullet.isNotNull() & (bullet != "") & ~bullet.contains(UNFILLED_CONFLICT)
        title = F.btrim(F.btrim(F.substring(x, F.lit(7), F.length(x))), F.lit("\"'"))
        return F.struct(
            F.when(rule, ~s["header"]).otherwise(s["header"]).alias("header"),
            F.when(inside | rule, s["section"]).otherwise(section).alias("section"),
            F.when(inside & x.startswith("title:"), title).otherwise(s["title"]).alias("title"),
            F.when(fact, F.array_append(s["facts"], bullet)).otherwise(s["facts"]).alias("facts"),
            F.when(conflict, F.array_append(s["conflicts"], bullet)).otherwise(s["conflicts"]).alias("conflicts"),
        )

    return F.aggregate(lines, start, step, lambda s: F.struct(s["title"].alias("title"), s["facts"].alias("facts"), s["conflicts"].alias("conflicts")))
