"""The registered queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.chat import digests

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*rows)))
    return digests(turns.unionByName(extra))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import read_bundles, write_bundles

    return read_bundles(write_bundles(_read(spark, sf_dir, "pages"), least=0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.rules import judge

    return judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.licenses import scan

    return scan(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillon.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.shared import shared_path
    from quillon.llm.sharding import read_shards, write_shards

    docs, path = _read(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "shards")
    write_shards(docs, path)
    written = read_shards(spark, path, "doc_id long, text string, shard string")
    return written.select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontam import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.html import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.fingerprints import fingerprints

    return fingerprints(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.negatives import mine

    return mine(_read(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.clusters import lloyd

    return lloyd(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_quality, op2_chat, op3_near_duplicates, op4_warc, op5_quality_rules,
        op6_licenses, op7_packing, op8_sharding, op9_decontamination, op10_html,
        op11_fingerprints, op12_hard_negatives, op13_centroids,
    )
    return {f.__name__: f for f in ops}


#: Turns as they are stored; the formatted length follows the template of quillon.llm.chat.
OP2_SQL = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
    select *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) + 7 as body,
        lag(role) over (partition by conv_id order by turn, role, text) as before
    from t
), f as (
    select *, case when before is null then 4 + length(role) + 2 when before <> role then 1 + 4 + length(role) + 2 else 0 end as head from e
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(body + head) as bigint) as formatted_chars
from f group by conv_id
"""


#: Vectors without a null or non-finite component, as whole numbers.
_WHOLE = """list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

OP12_SQL = f"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE} and label is not null),
s as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v::double[], b.v::double[]) as bigint) as score
    from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
    select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as int) as rank,
    s.other as negative_id, p.positive_score, s.score as negative_score
from p join s using (anchor_id) where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify rank <= 3
"""


def _op13_sql(rounds: int = 5, k: int = 40, seed: int = 2) -> str:
    """Every round in full: all vectors against all centroids."""
    parts = [
        f"r as materialized (select vec_id, {_WHOLE} and len(embedding) = 64)",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v as c from r order by sha256('{seed}:' || vec_id) limit {k})",
    ]
    far = "cast(list_inner_product(v::double[], v::double[]) - 2 * list_inner_product(v::double[], c::double[]) + list_inner_product(c::double[], c::double[]) as bigint)"
    for i in range(rounds + 1):
        parts.append(
            f"a{i} as materialized (select vec_id, any_value(v) as v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from (select vec_id, v, cluster, {far} as d from r, c{i}) group by vec_id)"
        )
        if i < rounds:
            parts.append(
                f"""m{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as c from (
                    select cluster, pos, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i}) group by all) group by cluster)"""
            )
            parts.append(f"c{i + 1} as materialized (select cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))")
    return f"""with {", ".join(parts)} select vec_id, cast(cluster as int) as cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
        cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op12_hard_negatives": OP12_SQL, "op13_centroids": _op13_sql()}
