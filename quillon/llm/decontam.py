"""Benchmark passages in documents by SimHash of item-sized windows, with Spark expressions only (operator 9).

Words are maximal runs other than space and \\x09-\\x0D of the lower-cased text; shingles are ``K`` words (an item or
document with fewer words has its whole sequence as one, so a shorter item is found as a whole document only). A window has as many words as some item.
Windows that hold no shingle of an item have similarity 0 with it, and one that begins with a place the item lacks is no
better than the next window; so windows are laid at every place whose shingle some item has, for the lengths of the items
that have it, and no best similarity is missed. A window in which more places are foreign to the whole benchmark than
``LEAST`` allows is not laid. The end of a text may cut a window short.

The fingerprint of a window or item has ``BITS`` bits, the signs of its distinct shingles' hash bits summed up, each by the square root
of the shingle's weight (one that no item has weighs the most): so the angle between a window and an item follows from the weights that the
similarity below compares, and one of 0.8 has a cosine of 0.889 at least, however unequal the weights are. Fingerprints of
equal window length within ``RADIUS`` are found by a multi-index: of ``BLOCKS`` blocks at least one differs in at most
RADIUS // BLOCKS bits, and the items' side of the index lists every value of a block within that distance, so none
within the radius is missed. Candidates are verified exactly:

    similarity = weight(shingles of both) / weight(shingles of either)

where a shingle weighs ln(1 + items / items that have it), and each place of the window whose shingle the item lacks
weighs ln(1 + items), the most.
A pair is reported at ``LEAST`` or more, with its best window (ties: the first).

Null and empty texts match nothing. Repeated rows of one id are one document each with the same pairs (once). Rows with
null ids are left out; an empty benchmark gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import table

#: A similarity of 0.8 leaves 19 of 128 bits different on average, with a deviation of 4.
K, BITS, BLOCKS, RADIUS, LEAST = 5, 128, 11, 32, 0.8
#: Values of the marks by which documents without a shared place are left where they lie; no more rows than this are broadcast.
MARKS = 1 << 20


# Arrays are exploded with the outer form: for the inner one Spark adds a filter on the array's size below the step
# that makes it, and so would split the text again for every word.


def tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def shingle_hashes(words: str) -> Column:
    """Hashes of the K-word shingles, in order."""
    run = ", ".join(f"{words}[i + {j}]" for j in range(K))
    return F.expr(
        f"case when size({words}) >= {K} then transform(sequence(0, size({words}) - {K}), i -> xxhash64({run})) "
        f"when size({words}) > 0 then array(xxhash64({words}, size({words}))) else cast(array() as array<bigint>) end"
    )


def fingerprint(weighed: str) -> Column:
    """128 signs packed in two longs, of an array of struct(s, w): a bit is set if the hashes that have it outweigh the others."""
    bits = "aggregate(transform(sequence(0, 63), b -> if(aggregate(x, 0D, (acc, y) -> acc + if(shiftright(y.s, b) & 1 = 1, y.w, -y.w)) > 0, shiftleft(1L, b), 0L)), 0L, (acc, y) -> acc | y)"
    return F.expr(f"transform(array({weighed}, transform({weighed}, x -> named_struct('s', xxhash64(x.s), 'w', x.w))), x -> {bits})")


def _block_bounds() -> list[tuple[int, int]]:
    """(first bit, bits) of each block; none crosses the two longs."""
    left = BLOCKS // 2
    edges = [i * 64 // left for i in range(left + 1)] + [64 + i * 64 // (BLOCKS - left) for i in range(1, BLOCKS - left + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def block_values(finger: str) -> Column:
    return F.array(*[F.expr(f"cast(shiftrightunsigned({finger}[{at // 64}], {at % 64}) & {(1 << n) - 1} as int)") for at, n in _block_bounds()])


def distance(a: str, b: str) -> Column:
    """Bits that differ."""
    return F.expr(f"bit_count({a}[0] ^ {b}[0]) + bit_count({a}[1] ^ {b}[1])")


def _near_masks(n: int) -> list[int]:
    """All masks of n bits with at most RADIUS // BLOCKS bits."""
    return [sum(1 << i for i in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(n), k)]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, shingles map<hash, weight>, weight, most, finger) of each item with a word."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens("text").alias("w")).where("item_id is not null and size(w) > 0")
    items = items.select("item_id", F.size("w").alias("n_words"), F.array_distinct(shingle_hashes("w")).alias("h"))
    n = items.agg(F.count_distinct("item_id").alias("n")).first()["n"]
    weights = (
        items.select("item_id", F.explode_outer("h").alias("s"))
        .groupBy("s")
        .agg(F.count_distinct("item_id").alias("df"))
        .select("s", F.log1p(F.lit(float(n)) / F.col("df")).alias("weight"), F.log1p(F.lit(float(n))).alias("most"))
    )
    by_item = (
        items.select("item_id", F.explode_outer("h").alias("s"))
        .distinct()
        .join(weights, "s")
        .groupBy("item_id")
        .agg(F.collect_list(F.struct("s", "weight")).alias("entries"), F.sum("weight").alias("weight"), F.max("most").alias("most"))
        .select("item_id", F.map_from_entries("entries").alias("shingles"), F.transform("entries", lambda e: F.struct(e["s"].alias("s"), F.sqrt(e["weight"]).alias("w"))).alias("z"), "weight", "most")
    )
    return items.groupBy("item_id").agg(F.max("n_words").alias("n_words")).join(by_item, "item_id").select("item_id", "n_words", "shingles", "weight", "most", fingerprint("z").alias("finger"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words) for each document and item that it holds."""
    spark = docs.sparkSession
    items = table(benchmark_items(benchmark), "items")
    # with the distinct lengths of the items that have it: as many as the longest item has words at most
    known = items.select("n_words", F.explode("shingles").alias("s", "weight")).groupBy("s").agg(F.collect_set("n_words").alias("lengths"), F.sqrt(F.max("weight")).alias("w"))
    known = table(known, "known")
    empty = "doc_id long, item_id long, similarity double, start int, n_words int"
    one = items.select("most").first()
    if one is None:
        return spark.createDataFrame([], empty)
    # rows that repeat an id are told apart by their texts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.withColumn("row", F.xxhash64("text"))
    hashed = docs.select("doc_id", "row", tokens("text").alias("w")).select("doc_id", "row", shingle_hashes("w").alias("h"))
    # only hashes meet the benchmark's, which Spark sends to all tasks while they are few, and shuffles otherwise
    hits = hashed.select("doc_id", "row", F.posexplode_outer("h").alias("pos", "s")).join(known, "s")
    # a document's shared places; no more than its words
    places = table(hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "lengths", "w"))).alias("f")), "places")
    # what shares anything is cut into words again; of the others only texts that meet a mark by chance are shuffled
    mark = F.pmod(F.xxhash64("doc_id", "row"), F.lit(MARKS)).cast("int").alias("mark")
    some = docs.select("*", mark).join(F.broadcast(places.select(mark).distinct()), "mark", "left_semi")
    again = some.join(places.hint("merge"), ["doc_id", "row"]).select("doc_id", "f", tokens("text").alias("w"))
    placed = again.select("doc_id", shingle_hashes("w").alias("h"), F.col("f.pos").alias("p"), F.col("f.lengths").alias("q"), F.col("f.w").alias("known"))
    # the weight at each place: those between the known ones are foreign to the benchmark
    most = f"sqrt({one.most!r}D)"
    between = f"flatten(transform(p, (x, i) -> concat(array_repeat({most}, x - coalesce(get(p, i - 1), -1) - 1), array(known[i]))))"
    weights = F.expr(f"concat({between}, array_repeat({most}, size(h) - element_at(p, -1) - 1))")
    placed = placed.withColumn("z", F.arrays_zip(F.col("h").alias("s"), weights.alias("w")))
    wide = f"greatest(l - {K} + 1, 1)"
    # a place whose shingle no item has weighs at least as much as any other: beyond this share of them a window can't reach LEAST
    enough = f"greatest(least({wide}, size(h) - x) - cast(floor({wide} * {1 / LEAST - 1}) as int), 1)"
    windows = placed.select(
        "doc_id", "z",
        F.expr(
            "flatten(transform(p, (x, i) -> transform("
            f"filter(q[i], l -> coalesce(get(p, i + {enough} - 1) < x + {wide}, false)), l -> named_struct('start', x, 'n_words', l))))"
        ).alias("windows"),
    )
    laid = (
        windows.select("doc_id", F.explode_outer(F.expr(f"transform(windows, v -> named_struct('start', v.start, 'n_words', v.n_words, 'z', slice(z, v.start + 1, greatest(v.n_words - {K} + 1, 1))))")).alias("v"))
        .where("v is not null")
        .select("doc_id", "v.*")
        .select("doc_id", "start", "n_words", F.col("z.s").alias("h"), fingerprint("array_distinct(z)").alias("finger"))
    )
    laid = table(laid, "laid")
    masks = F.create_map(*[x for b, (_, n) in enumerate(_block_bounds()) for x in (F.lit(b), F.array(*[F.lit(m) for m in _near_masks(n)]))])
    index = (
        items.select("item_id", "n_words", F.col("finger").alias("item_finger"), F.posexplode(block_values("finger")).alias("block", "own"))
        .select("item_id", "n_words", "item_finger", "block", F.explode(F.transform(masks[F.col("block")], lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    )
    fingers = laid.select("n_words", "finger").distinct().select("n_words", "finger", F.posexplode(block_values("finger")).alias("block", "value"))
    close = (
        fingers.join(index, ["n_words", "block", "value"])
        .where(distance("finger", "item_finger") <= RADIUS)
        .select("n_words", "finger", "item_id")
        .distinct()
    )
    pairs = laid.join(table(close, "close"), ["n_words", "finger"]).join(items.select("item_id", "shingles", "weight", "most"), "item_id")
    shared = F.expr("aggregate(array_intersect(h, map_keys(shingles)), 0D, (acc, s) -> acc + shingles[s])")
    foreign = F.expr("size(filter(h, s -> not map_contains_key(shingles, s)))")
    return (
        pairs.select("doc_id", "item_id", "start", "n_words", F.round(shared / (F.col("weight") + foreign * F.col("most")), 9).alias("similarity"))
        .where(F.col("similarity") >= LEAST)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "best.n_words")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a leak, with all their columns; rows with null ids or texts stay."""
    bad = table(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti")
