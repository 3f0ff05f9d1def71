"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, ended as well by a sentence end before a vowel, so that texts on one line have several; blank
ones don't count and a repeated one counts once. Their 64-bit hashes go into a sketch of ``CELLS`` cells: each hash into one cell of every
third, and a cell holds how many it got, their exclusive or, and the exclusive or of their check hashes. One sketch less another leaves the
hashes that only one text has; peeling recovers them from the cells that hold a single one. If some cells stay, the pair is tried
again with a larger sketch (several tables, chosen by further hash bits, sized by the number of paragraphs), as often as it takes, so
the difference is always exact. Likeness is 1 - differing / (paragraphs of both), 1 for two empty texts.

All of it is array expressions in a text's own row. Retries that don't fit in a row (long texts) go on in rows of their own, a
few paragraphs each. Only the texts are shuffled, once, to put each next to the one that follows it.

Null texts are empty, and their fingerprint is that of no paragraphs. Documents follow each other by id, nulls first, then by
length and hash of the text; after the last comes the first (itself, if alone). Rows that repeat an id each have a row. Texts that
differ in blanks around paragraphs, their order or repetition only have equal fingerprints. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import table

#: Cells of a fingerprint, and of each table of a larger sketch; a third of them for each of three hashes.
CELLS, LARGER = 24, 96
#: Differing paragraphs that a table of a larger sketch is meant for; tables of one row at most.
LOAD, TABLES = 4, 128
#: Rounds of peeling, in each of which all single hashes go at once; what needs more of them counts as a failure.
PEELS = 6
#: Where a paragraph ends: a line's end, or a sentence's before a vowel.
ENDS = r"[\n\r]+|(?<=[.!?] )(?=[AEIOUaeiou])"


def _letting(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Hashes of a text's paragraphs, each once."""
    parts = F.filter(F.transform(F.split(text, ENDS), lambda p: F.btrim(p, F.lit(" \t\r\n\x0b\x0c"))), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _at(key: Column, j: int, seed: int, cells: int) -> Column:
    """A hash's cell in the j-th third."""
    third = cells // 3
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(j)), F.lit(third)) + j * third).cast("int")


def _entry(key: Column, sign: Column, seed: int, cells: int) -> list[Column]:
    """A hash with its sign, its check and its cells."""
    return [key.alias("key"), sign.alias("n"), _check(key).alias("check"), *[_at(key, j, seed, cells).alias(f"at{j}") for j in range(3)]]


def _added(cell: Column, entry: Column, sign: int = 1) -> Column:
    n = cell["n"] + entry["n"] if sign > 0 else cell["n"] - entry["n"]
    return F.struct(cell["at"].alias("at"), n.alias("n"), cell["key"].bitwiseXOR(entry["key"]).alias("key"), cell["check"].bitwiseXOR(entry["check"]).alias("check"))


def _filled(entries: Column, places: list[Column]) -> Column:
    """The cells at ``places``, given for each third, with what entries put into them."""
    zero = lambda at: F.struct(at.alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def third(j: int) -> Column:
        return F.transform(places[j], lambda at: F.aggregate(F.filter(entries, lambda e: e[f"at{j}"] == at), zero(at), lambda c, e: _added(c, e)))

    return F.concat(*[third(j) for j in range(3)])


def sketch(keys: Column, seed: int = 0, cells: int = CELLS) -> Column:
    """Cells struct(at, n, key, check) of a set of hashes."""
    third = cells // 3
    places = [F.array(*map(F.lit, range(j * third, (j + 1) * third))) for j in range(3)]
    return _letting(F.transform(keys, lambda k: F.struct(*_entry(k, F.lit(1), seed, cells))), lambda entries: _filled(entries, places))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _added(x, y, -1))


def _occupied(c: Column) -> Column:
    return (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)


def peel(difference: Column, seed: int = 0, cells: int = CELLS) -> Column:
    """struct(more, less) of the hashes recovered from a difference, by sign; null if some cells stay. Cells that are empty take no part."""
    single = lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"])
    entry = lambda c: F.struct(*_entry(c["key"], c["n"], seed, cells))
    meets = lambda e, at: (e["at0"] == at) | (e["at1"] == at) | (e["at2"] == at)

    def once(state: Column, _: Column) -> Column:
        def without(found: Column) -> Column:
            rest = F.transform(state["left"], lambda c: F.aggregate(F.filter(found, lambda e: meets(e, c["at"])), c, lambda x, e: _added(x, e, -1)))
            got = F.concat(state["got"], F.transform(found, lambda e: F.struct(e["key"].alias("key"), e["n"].alias("n"))))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(F.filter(rest, _occupied).alias("left"), got.alias("got")))

        return _letting(F.array_distinct(F.transform(F.filter(state["left"], single), entry)), without)

    start = F.struct(F.filter(difference, _occupied).alias("left"), F.array().cast("array<struct<key:bigint,n:int>>").alias("got"))
    sign = lambda got, way: F.transform(F.filter(got, lambda g: g["n"] == way), lambda g: g["key"])
    end = lambda s: F.when(F.size(s["left"]) == 0, F.struct(sign(s["got"], 1).alias("more"), sign(s["got"], -1).alias("less")))
    return _letting(F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, once), end)


def _differing(recovered: Column) -> Column:
    """How many hashes; null if they were not recovered."""
    return _letting(recovered, lambda r: F.when(r.isNotNull(), F.size(r["more"]) + F.size(r["less"])))


def _tables(a: Column, b: Column) -> Column:
    """How many tables a larger sketch gets: for all paragraphs of both, as many may differ."""
    wanted = F.ceil((F.size(a) + F.size(b)) / F.lit(float(LOAD)))
    return F.least(F.greatest(wanted, F.lit(2)), F.lit(TABLES)).cast("int")


def _table_of(key: Column, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit("table")), n)


def _one_table(entries: Column, seed: int) -> Column:
    """How many hashes differ, by one table of a larger sketch: both texts' hashes go in with their signs, which is one sketch less the other.

    Only cells that get something are made.
    """
    places = [F.array_distinct(F.transform(entries, _of(f"at{j}"))) for j in range(3)]
    return _differing(peel(_filled(entries, places), seed, LARGER))


def _of(field: str):
    return lambda e: e[field]


def _signed(a: Column, b: Column, n: Column, seed: int) -> Column:
    """Hashes of both with their signs, and the table of ``n`` that each goes to."""
    part = lambda keys, sign: F.transform(keys, lambda k: F.struct(_table_of(k, n, seed).alias("t"), *_entry(k, F.lit(sign), seed, LARGER)))
    return F.concat(part(a, 1), part(b, -1))


def larger(a: Column, b: Column, seed: int) -> Column:
    """How many hashes differ by a larger sketch; null if a table of it could not be peeled, or it needs more than ``TABLES``."""

    def every(x: Column) -> Column:
        one = lambda at: _letting(F.filter(x["entries"], lambda e: e["t"] == at), lambda mine: _one_table(mine, seed))
        found = F.transform(F.sequence(F.lit(0), x["n"].cast("long") - 1), one)
        return _letting(found, lambda f: F.when(F.forall(f, lambda d: d.isNotNull()), F.aggregate(f, F.lit(0), lambda t, d: t + d)))

    fits = F.size(a) + F.size(b) <= LOAD * TABLES
    with_tables = _letting(_tables(a, b), lambda n: F.struct(n.alias("n"), _signed(a, b, n, seed).alias("entries")))
    return F.when(fits, _letting(with_tables, every))


def _settle(open_: DataFrame) -> DataFrame:
    """(uid, kind, differing) of pairs (uid, kind, a, b) by larger and larger sketches, a table in a row."""
    done, seed = [], 10
    while open_.limit(1).count():
        n = _tables(F.col("a"), F.col("b"))
        cut = open_.withColumn("n", n).select("uid", "kind", "a", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
        own = lambda x: F.filter(x, lambda k: _table_of(k, F.col("n"), seed) == F.col("at"))  # noqa: E731, B023
        cut = cut.select("uid", "kind", own("a").alias("a"), own("b").alias("b"))
        # tables still too full for their size are cut again before they are tried
        small = F.size("a") + F.size("b") <= 6 * LOAD
        tried = F.when(small, _letting(_signed(F.col("a"), F.col("b"), F.lit(1), seed), lambda entries: _one_table(entries, seed)))  # noqa: B023
        tried = table(cut.withColumn("d", tried), "larger")
        done.append(tried.where("d is not null").select("uid", "kind", "d"))
        open_ = tried.where("d is null").select("uid", "kind", "a", "b")
        seed += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.groupBy("uid", "kind").agg(F.sum("d").cast("int").alias("differing"))


def encoded(cells_: Column) -> Column:
    """A sketch as a string: 16 bytes for each cell in base 64 (its count, its hashes and half of their checks)."""
    part = lambda c: F.concat(
        F.lpad(F.hex(c["n"].cast("long")), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.right(F.lpad(F.hex(c["check"]), 16, "0"), F.lit(8))
    )
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(cells_, part), ""))), "\r\n", "")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys): each document with the one that follows it.

    Ids are dealt into ranges, four for each shuffle partition at most, by quantiles; so the ranges' limits and first ids are a bounded
    table. Each range's first document goes to the range before it as well, and a window over ranges finds the next.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    limits = rows.agg(F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 40 * parts).alias("q")).first().q or [] if parts else []
    limits = sorted(set(limits))
    # a binary search: the number of limits below the id
    steps = max(1, len(limits)).bit_length()
    bound = F.array(*map(F.lit, limits)).cast("array<bigint>")

    def halve(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead <= len(limits)) & (F.get(bound, ahead - 1) < F.col("doc_id")), ahead).otherwise(at)

    place = F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0), halve)
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    first = ranged.groupBy("range").agg(F.min("doc_id").alias("first"))
    line = Window.orderBy("range")
    ends = first.agg(F.max("range").alias("last"))
    first = first.withColumn("before", F.lag("range").over(line)).crossJoin(ends)  # one row for each range, and one row
    first = table(first.select("range", "first", F.coalesce("before", "last").alias("before")), "ranges")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("r"), F.lit(1).alias("copy"))))
    copies = copies.otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy"))))
    dealt = ranged.join(F.broadcast(first), "range").withColumn("keys", paragraphs(F.col("text"))).select("doc_id", "text", "keys", F.inline(copies))
    order = Window.partitionBy("r").orderBy("copy", "doc_id", F.length("text"), F.xxhash64("text"))
    return dealt.select("doc_id", "text", "keys", "copy", F.lead(F.struct("text", "keys")).over(order).alias("next")).where("copy = 0").select(
        "doc_id", "text", "keys", F.col("next.text").alias("next_text"), F.col("next.keys").alias("next_keys")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents (doc_id, text).

    A text's edited form has its last half replaced by as much of the beginning of the next document's, or by all of it.
    """
    rows = with_next(docs).withColumn("n", F.length("text")).withColumn("half", F.expr("cast(n div 2 as int)"))
    edited = F.concat(F.expr("left(text, n - half)"), F.expr("left(next_text, half)"))
    rows = rows.select("doc_id", "n", "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("doc_id", "n", "keys", "next_keys", F.sha2("edited", 256).alias("sha"), paragraphs(F.col("edited")).alias("edited_keys"))
    rows = rows.withColumns({"own": sketch(F.col("keys")), "changed": sketch(F.col("edited_keys")), "following": sketch(F.col("next_keys"))})

    def tried(other_sketch: str, other: str) -> Column:
        pair = (F.col("keys"), F.col(other))
        return F.coalesce(_differing(peel(subtract(F.col("own"), F.col(other_sketch)))), larger(*pair, 1), larger(*pair, 2))

    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n", "sha", "keys", "edited_keys", "next_keys", encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("changed")).alias("edited_fingerprint"), tried("changed", "edited_keys").alias("d_edited"), tried("following", "next_keys").alias("d_next"),
    )
    rows = table(rows, "sketches")
    settled = rows.where("d_edited is not null and d_next is not null")
    other = rows.where("d_edited is null or d_next is null")
    pairs = [other.where(f"d_{k} is null").select("uid", F.lit(k).alias("kind"), F.col("keys").alias("a"), F.col(f"{k}_keys").alias("b")) for k in ("edited", "next")]
    waiting = pairs[0].unionByName(pairs[1])
    if waiting.limit(1).count():
        found = _settle(waiting).groupBy("uid").agg(*[F.max(F.when(F.col("kind") == k, F.col("differing"))).alias(f"f_{k}") for k in ("edited", "next")])
        late = other.join(found, "uid")
        settled = settled.unionByName(late.withColumns({f"d_{k}": F.coalesce(f"d_{k}", f"f_{k}") for k in ("edited", "next")}).select(*settled.columns))

    def near(k: str) -> Column:
        both = F.size("keys") + F.size(f"{k}_keys")
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.col(f"d_{k}") / both)

    return settled.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited").alias("near_edited"), near("next").alias("near_next")
    )
