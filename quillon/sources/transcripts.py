"""Agent transcripts (JSON lines) as messages and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CALL = "struct<type:string,text:string,name:string,input:map<string,string>>"
_ENVELOPE = "struct<role:string,type:string,content:string,message:struct<role:string,content:string>>"
WRITERS = ("write", "create", "edit", "replace", "multiedit")
#: Ways a shell command names a file that it changes.
SHELL = (r">>?\s*([^\s;|&<>]+)", r"\btee\s+(?:-a\s+)?([^\s;|&]+)", r"\bmv\s+\S+\s+([^\s;|&]+)", r"\bcp\s+\S+\s+([^\s;|&]+)")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, role, text, calls) of each line that is a JSON object; other lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return parse(lines)


def parse(lines: DataFrame) -> DataFrame:
    e = lines.withColumn("e", F.from_json("value", _ENVELOPE)).where("e is not null and (e.role is not null or e.type is not null or e.message is not null)")
    content = F.coalesce("e.message.content", "e.content")
    blocks = F.coalesce(F.from_json(content, f"array<{_CALL}>"), F.array().cast(f"array<{_CALL}>"))
    listed = content.startswith("[")
    text = F.when(listed, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(content)
    calls = F.when(listed, F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("input"))))
    return e.select("file", "line", F.coalesce("e.role", "e.message.role", "e.type").alias("role"), text.alias("text"), calls.alias("calls"))


def files_changed(messages: DataFrame) -> DataFrame:
    """(file, changed): files that tool calls write, by their arguments or by what a shell command says; options are no files."""
    calls = messages.select("file", F.explode_outer("calls").alias("c")).where("c is not null")
    tool = F.lower("c.name")
    named = F.coalesce(F.try_element_at("c.input", F.lit("file_path")), F.try_element_at("c.input", F.lit("path")))
    command = F.coalesce(F.try_element_at("c.input", F.lit("command")), F.lit(""))
    found = F.flatten(F.array(*[F.regexp_extract_all(command, F.lit(p), F.lit(1)) for p in SHELL]))
    changed = F.when(tool.isin(*WRITERS), F.array(named)).when(tool == "bash", found)
    out = calls.select("file", F.explode_outer(changed).alias("changed")).where("changed is not null")
    return out.select("file", F.btrim("changed", F.lit("\"'")).alias("changed")).where("changed <> '' and not startswith(changed, '-')").distinct()
