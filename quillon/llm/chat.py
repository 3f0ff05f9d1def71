"""Chat formatting with Spark expressions only (operator 2).

A conversation's turns are sorted by turn number, adjacent turns of one role become one block, and blocks are joined:

    ### assistant: first text</turn>second text</turn>
    ### user: ...

Inside texts and roles the control strings are escaped, so they never occur there: ``\\`` as ``\\b``, ``###`` as
``\\h``, ``</turn>`` as ``\\e`` (in roles also ``:`` as ``\\c``). Every ``\\`` of an escaped text begins such a pair, so
plain replacement restores it. The loss mask is a list of (start, length) in code points: each assistant text, in
order, without marks. ``read_back`` parses the formatted text again.

Null texts and roles count as empty. Rows with equal turn numbers follow by role and text; repeated rows stay. Rows
with a null conversation form one conversation with a null id. Null turns come first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, HEAD = "</turn>", "### "
#: Order matters: the backslash goes first, and comes back last.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), (END, "\\e"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start,length>>) of each conversation."""
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit(":"), F.lit("\\c"))
    rows = turns.select("conv_id", "turn", role.alias("role"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    # where each text begins in the formatted one: a running sum of texts, marks, and heads (with a line break) where a block begins
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    head = F.when(before.isNull(), F.length("role") + len(HEAD) + 2).when(before != F.col("role"), F.length("role") + len(HEAD) + 3).otherwise(0)
    end = F.sum(head + F.length("text") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", (end - F.length("text") - len(END)).cast("int"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("turns"))
    # where runs of one role begin, then a block for each run
    merged = gathered.withColumn(
        "begins", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role)")
    ).withColumn(
        "blocks",
        F.expr(
            "transform(begins, (b, k) -> named_struct('role', turns[b].role, 'texts', "
            "transform(slice(turns, b + 1, coalesce(get(begins, k + 1), size(turns)) - b), t -> t.text)))"
        ),
    )
    pieces = merged.withColumn("heads", F.expr(f"transform(blocks, b -> concat('{HEAD}', b.role, ': '))"))
    formatted = pieces.withColumn(
        "formatted",
        F.expr(f"array_join(transform(blocks, (b, k) -> concat(heads[k], array_join(b.texts, '{END}'), '{END}')), '\n')"),
    )
    spans = F.expr(f"transform(filter(turns, t -> t.role = '{loss_role}'), t -> named_struct('start', t.at, 'length', length(t.text)))")
    return formatted.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text), parsed from ``formatted`` and its mask."""
    # a head is the only place where "### " can stand; what follows a block's last mark is no turn
    raw = formatted.withColumn("raw", F.expr(f"slice(split(formatted, '{HEAD}'), 2, greatest(size(split(formatted, '{HEAD}')) - 1, 0))"))
    parsed = raw.withColumn(
        "parts",
        F.expr(f"transform(raw, b -> named_struct('role', substring(b, 1, instr(b, ': ') - 1), 'texts', split(substring(b, instr(b, ': ') + 2), '{END}')))"),
    )
    cut = F.expr("flatten(transform(parts, p -> transform(slice(p.texts, 1, size(p.texts) - 1), t -> named_struct('role', p.role, 'text', t))))")
    restored = F.transform(
        cut,
        lambda t: F.struct(
            unescape(F.replace(t["role"], F.lit("\\c"), F.lit(":"))).alias("role"),
            unescape(t["text"]).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return parsed.select("conv_id", restored.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(turns: DataFrame) -> DataFrame:
    """The contract's columns, all from what ``read_back`` finds."""
    got = read_back(format_conversations(turns))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
