"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm import bpe, extendible_sharding, html_layout, language_id, mixing, ngram_bloom, secret_scan, segment_topk
from lexfold.llm.common import bucket_of, table
from lexfold.llm.grace_dedup import dedup_members
from lexfold.llm.simhash_tiles import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    """The public vocabulary; TOKENIZER_FILE names another place for it."""
    if named := os.environ.get("TOKENIZER_FILE"):
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(bucket_of("doc_id", 5) == 1, F.lit(False)))
    model = ngram_bloom.train(docs.where("not held_out"))
    found = ngram_bloom.score(docs, model, keys=("held_out",))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_digest(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_members(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Each kind's matches are wrapped in marks, and lengths of what stands between the marks give their places."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    long_enough = {"assign": r"length(regexp_extract(hit, '^[^:=]*[:=]\x20*[\x22\x27]?(.*)$', 1)) >= 6", "access": "length(hit) >= 20", "hex": "length(hit) >= 24", "forge_token": "length(hit) >= 40"}
    each = " UNION ALL ".join(
        f"SELECT rid, {k} AS ord, {quoted(r.kind)} AS kind, string_split(regexp_replace(t, {quoted(f'({r.pattern})')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM d" for k, r in enumerate(secret_scan.RULES))
    keep = " ".join(f"WHEN {quoted(k)} THEN {c}" for k, c in long_enough.items())
    base = len(secret_scan.BASE_RULES)
    written = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
             m AS ({each}),
             x AS (SELECT rid, ord, kind, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM m),
             y AS (SELECT *, split_part(piece, chr(2), 1) AS hit,
                          coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY rid, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM x),
             z AS (SELECT rid, ord, kind, start, start + length(hit) AS stop FROM y WHERE k > 1 AND CASE kind {keep} ELSE true END)
        SELECT doc_id, {counts}, sha256({written(f'ord < {base}')}) AS base_sha256, {written('ord >= 0')} AS spans FROM d LEFT JOIN z USING (rid) GROUP BY rid, doc_id
    """


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_extendible_sharding, op2_lm_score, op3_language_id, op4_segment_topk, op5_bpe_roundtrip, op6_simhash_neardup, op7_source_mixing, op8_secret_scan, op9_html_layout, op10_exact_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op1_extendible_sharding": rf"""
        WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT AS h
                   FROM documents),
             b AS (SELECT d, h >> (60 - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one
                   FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY 1, 2),
             l AS (SELECT c.* FROM b AS c LEFT JOIN b AS p ON p.d = c.d - 1 AND p.prefix = c.prefix >> 1
                   WHERE (c.shard_bytes <= {SHARD_BYTES} OR c.one) AND (c.d = 0 OR NOT (p.shard_bytes <= {SHARD_BYTES} OR p.one))),
             f AS (SELECT r.*, l.*, one AND shard_bytes > {SHARD_BYTES} AND shard_docs > 1 AS paged, greatest(1, {SHARD_BYTES} // greatest(bytes, 1)) AS room,
                          row_number() OVER (PARTITION BY h) - 1 AS nth
                   FROM r JOIN l ON l.prefix = r.h >> (60 - l.d)),
             g AS (SELECT *, CASE WHEN paged THEN nth // room ELSE 0 END AS page FROM f),
             o AS (SELECT *, CASE WHEN paged THEN least(room, shard_docs - page * room) ELSE shard_docs END AS here FROM g)
        SELECT doc_id, bytes AS doc_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d::INT, '0') END AS shard, d AS depth, page,
               CASE WHEN paged THEN here * bytes ELSE shard_bytes END AS shard_bytes, here AS shard_docs
        FROM o
    """,
    "op4_segment_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
                   FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_secret_scan": _secrets_sql(),
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             g AS (SELECT doc_id, body, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                          row_number() OVER (PARTITION BY body ORDER BY doc_id) AS nth
                   FROM n WINDOW w AS (PARTITION BY body))
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(body) AS text_sha256 FROM g
    """,
}
