"""Cutting Markdown into chunks, natively: at headings, at turns of speech, by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_FROM, LARGEST = 6000, 7500  # bytes


def by_headings(notes: DataFrame, text: str = "text", kept: int | None = None, numbered: bool = False) -> DataFrame:
    """(…, chunk_heading, chunk) cut at ``## ``; a part that is too large is cut at ``### ``, then by size.

    Empty parts are dropped; a text without a part is one chunk, "(full)".
    ``kept`` is what ``by_size`` has; ``numbered`` adds each chunk's place: ``place`` of its heading, ``part`` below it.
    """
    body = F.col(text)
    parts = F.transform(
        F.filter(F.split(body, r"(?m)^(?=## )"), lambda p: F.btrim(p) != ""),
        lambda p: F.struct(
            F.when(p.startswith("## "), F.btrim(F.regexp_extract(p, r"\A## ([^\n]*)", 1))).otherwise("(intro)").alias("heading"),
            F.btrim(F.regexp_replace(p, r"\A## [^\n]*\n?", "")).alias("chunk"),
        ),
    )
    parts = F.filter(parts, lambda p: p["chunk"] != "")
    fine = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(
                F.octet_length(p["chunk"]) > LARGEST,
                F.transform(
                    F.filter(F.split(p["chunk"], r"(?m)^(?=### )"), lambda s: F.btrim(s) != ""),
                    lambda s: F.struct(
                        F.when(s.startswith("### "), F.concat(p["heading"], F.lit(" > "), F.btrim(F.regexp_extract(s, r"\A### ([^\n]*)", 1)))).otherwise(p["heading"]).alias("heading"),
                        F.btrim(F.regexp_replace(s, r"\A### [^\n]*\n?", "")).alias("chunk"),
                    ),
                ),
            ).otherwise(F.array(p)),
        )
    )
    whole = F.array(F.struct(F.lit("(full)").alias("heading"), body.alias("chunk")))
    chosen = F.when((F.octet_length(body) > CHUNK_FROM) & (F.size(fine) > 0), fine).otherwise(whole)
    keep = [c for c in notes.columns if c != text]
    cut = notes.select(*keep, F.posexplode_outer(chosen).alias("place", "p"))
    sized = by_size(cut.select(*keep, *(["place"] if numbered else []), F.col("p.heading").alias("heading"), F.col("p.chunk").alias("chunk")), "chunk", kept=kept, numbered=numbered)
    return sized


def _pieces(paragraph: Column, largest: int) -> Column:
    """A paragraph that is too large in pieces, cut behind white space where there is some; pieces but the first begin with a sign, and nothing is lost."""
    cut = lambda n: F.regexp_extract_all(paragraph, F.lit(rf"(?s).{{1,{n}}}(?:(?<=\s)|\z)|.{{1,{n}}}"), F.lit(0))
    parts = F.when(F.octet_length(paragraph) == F.length(paragraph), cut(largest)).otherwise(cut(max(1, largest // 4)))
    marked = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(_GOES_ON), p)))
    return F.when(F.octet_length(paragraph) <= largest, F.array(paragraph)).otherwise(marked)


_GOES_ON = "\x01"


def by_size(rows: DataFrame, column: str, largest: int = LARGEST, kept: int | None = None, numbered: bool = False) -> DataFrame:
    """Paragraphs packed in order into chunks of at most ``largest`` bytes; parts of one chunk get "(part n)".

    A paragraph that is larger is cut into pieces, so all of the text is in some chunk. ``kept``, if given, cuts each chunk to so many characters.
    """
    spaced = F.split(F.translate(column, _GOES_ON, ""), "\n\n")
    parts = F.flatten(F.transform(spaced, lambda p: _pieces(p, largest)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        on = p.startswith(_GOES_ON)
        plain = F.when(on, F.substring(p, F.lit(2), F.length(p))).otherwise(p)
        joined = F.concat(acc["open"], F.when(on, "").otherwise("\n\n"), plain)
        fits = acc["open"].isNull() | (F.octet_length(joined) <= largest) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(acc["open"].isNull(), plain).when(fits, joined).otherwise(plain).alias("open"))

    packed = F.aggregate(parts, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    packed = F.filter(F.transform(packed, lambda c: F.btrim(c, F.lit(" \t\r\n"))), lambda c: c != "")
    keep = [c for c in rows.columns if c not in (column, "heading")]
    chosen = F.when(F.octet_length(column) > largest, packed).otherwise(F.array(F.col(column)))
    out = rows.select(*keep, "heading", F.size(chosen).alias("n_parts"), F.posexplode_outer(chosen).alias("part", "chunk"))
    heading = F.when(F.col("n_parts") > 1, F.concat(F.col("heading"), F.lit(" (part "), F.col("part") + 1, F.lit(")"))).otherwise(F.col("heading"))
    return out.select(*keep, *(["part"] if numbered else []), heading.alias("chunk_heading"), (F.left("chunk", F.lit(kept)) if kept else F.col("chunk")).alias("chunk"))


def full_text(chunks: DataFrame) -> DataFrame:
    """(path, text): a note's chunks in order, joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    return chunks.groupBy("path").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("text"))


#: Fixed value: how a line begins that hands a conversation over.
TURN = r"(?m)^\*{0,2}(?:User|Assistant|Human|AI)\*{0,2}\s*:"


def turn_markers(notes: DataFrame) -> DataFrame:
    """(path, turn, role, text) of each turn marked in a text; markers in fenced code don't count.

    Lines of fences get a control sign in front, so that none begins with a marker; it is taken away in the end.
    """
    fences = F.regexp_extract_all("text", F.lit(r"(?s)```.*?(?:```|\z)"), F.lit(0))
    masked = F.aggregate(fences, F.col("text"), lambda t, f: F.replace(t, f, F.replace(f, F.lit("\n"), F.lit("\n\x01"))))
    marked = F.regexp_replace(masked, TURN, "\x00$0")
    parts = F.split(marked, "\x00")
    rows = notes.select("path", F.posexplode_outer(parts).alias("turn", "part")).where("turn > 0").withColumn("turn", F.col("turn") - 1)
    head = F.regexp_extract("part", TURN, 0)
    role = F.when(F.lower(head).rlike("user|human"), "user").otherwise("assistant")
    return rows.select("path", "turn", role.alias("role"), F.btrim(F.regexp_replace(F.translate(F.substring("part", F.length(head) + 1, F.length("part")), "\x01", ""), r"^\*{1,2}", ""), F.lit(" \n\t")).alias("text"))
